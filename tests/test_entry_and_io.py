import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from sellerscope.plans.registry import ORACLES, QUERIES
from sellerscope.sources import catalog
from sellerscope.streaming.scoring import score_frame, start_scoring_stream
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "segment_name" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles_match_at_smoke_scale(spark, name):
    con = duckdb.connect()
    for t in ["customer", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    s, d = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert rows_of(s) == rows_of(d)


def test_register_csv_folder(spark):
    folder = tempfile.mkdtemp(prefix="csvfold-", dir="/tmp")
    with open(os.path.join(folder, "test.csv"), "w") as f:
        f.write("col1,col2\n1,a\n2,b\n")
    views = catalog.register_folder(spark, folder, fmt="csv").collect()
    assert [v["view_name"] for v in views] == ["data_test"]
    assert spark.table("data_test").count() == 2
    assert "data_test" in [r["view_name"] for r in catalog.list_views(spark).collect()]


def test_register_folder_of_part_files(spark):
    folder = tempfile.mkdtemp(prefix="partfold-", dir="/tmp")
    spark.range(10).repartition(3).write.parquet(os.path.join(folder, "big-table.parquet"))
    spark.range(4).coalesce(1).write.parquet(os.path.join(folder, "other.parquet"))
    views = catalog.register_folder(spark, folder, fmt="parquet").collect()
    assert sorted(v["view_name"] for v in views) == ["data_big_table", "data_other"]
    assert spark.table("data_big_table").count() == 10


def test_report_is_written_and_read(spark):
    lines = QUERIES["profile_report"](spark, SF).collect()
    assert {r["section"] for r in lines} == {1, 2, 3, 4, 5, 6} and all(r["line"] for r in lines)
    assert len({(r["section"], r["line_no"]) for r in lines}) == len(lines)


def test_stream_scoring_matches_batch(spark):
    from sellerscope.plans.registry import ctx
    c = ctx(spark, SF)
    cents = c.ref_centroids
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    c.model.features.limit(50).write.mode("overwrite").json(os.path.join(src, "batch1"))
    out, ck = tempfile.mkdtemp(prefix="stream-out-", dir="/tmp"), tempfile.mkdtemp(prefix="stream-ck-", dir="/tmp")
    q = start_scoring_stream(spark, os.path.join(src, "batch1"), c.model.params, cents, out, ck, available_now=True)
    q.awaitTermination(120)
    streamed = {r["seller_nickname"]: r["cluster_id"] for r in spark.read.parquet(out).collect()}
    batch = {r["seller_nickname"]: r["cluster_id"] for r in
             score_frame(c.model.features.limit(50), c.model.params, cents).collect()}
    assert streamed == batch and len(streamed) == 50
