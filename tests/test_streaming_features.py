"""Seller features of a stream: late and repeated rows, a restart, replayed batches, compaction."""
import datetime as dt
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from sellerscope.operators.features import FEATURES, seller_features
from sellerscope.session import own_session
from sellerscope.streaming import features as sf

COLUMNS = ("url string, seller_nickname string, category_id string, snapshot_on date, price double, regular_price double, stock long, "
           "titulo string, seller_reputation string, condition string, is_refurbished boolean")


def row(i, day, seller=None, category=None):
    seller = f"s{i % 3}" if seller is None else seller
    return (f"u{i}", seller, f"c{i % 5}" if category is None else category, dt.date(2024, 1, 1) + dt.timedelta(days=day), None if i % 7 == 0 else 10.0 + i, 12.0 + i,
            i % 4, "title " * (i % 3 + 1), ["green", "red", None][i % 3], "used" if i % 2 else "new", i % 5 == 0)


def rows_of(df):
    return {r["seller_nickname"]: tuple(None if r[f] is None else round(r[f], 9) for f in FEATURES) for r in df.collect()}


@pytest.fixture()
def folders():
    root = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    return f"{root}/in", f"{root}/state", f"{root}/checkpoint"


def feed(spark, rows, folder, name):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, path, checkpoint):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = sf.start_feature_stream(stream, path, checkpoint, available_now=True, delay="30 days", period="10 days")
    q.awaitTermination()
    return q


def test_late_and_repeated_rows_and_a_restart_give_the_batch_rows(spark, folders):
    src, path, checkpoint = folders
    first = [row(i, i) for i in range(20)] + [row(90, 3, seller="only", category=None)]
    late = [row(i, i - 100) for i in range(100, 110)]         # days 0..9: late, within the delay
    late += [("u111", "s0", None, dt.date(2024, 1, 8), 5.0, None, None, None, None, None, None), ("u112", None, "c1", dt.date(2024, 1, 8), 5.0, None, 1, "x", None, "new", False)]
    feed(spark, first, src, "a")
    run(spark, src, path, checkpoint)
    feed(spark, late + first[5:12], src, "b")                 # late rows, and rows sent again
    run(spark, src, path, checkpoint)                         # a new query from the checkpoint
    want = rows_of(seller_features(spark.createDataFrame(first + late, COLUMNS)))
    assert rows_of(sf.read_features(spark, path)) == want
    assert sf.compact(spark, path) is not None and rows_of(sf.read_features(spark, path)) == want
    feed(spark, [row(200, 25)], src, "c")                     # batches after a compaction add to it
    run(spark, src, path, checkpoint)
    assert rows_of(sf.read_features(spark, path)) == rows_of(seller_features(spark.createDataFrame(first + late + [row(200, 25)], COLUMNS)))


def test_rows_behind_the_watermark_are_left_out(spark, folders):
    src, path, checkpoint = folders
    first, too_late = [row(i, 200 + i) for i in range(5)], [row(50, 0, seller="late")]
    feed(spark, first, src, "a")
    run(spark, src, path, checkpoint)
    feed(spark, too_late, src, "b")
    q = run(spark, src, path, checkpoint)
    assert "late" not in rows_of(sf.read_features(spark, path))
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) >= 1


def test_a_replayed_batch_leaves_no_trace(spark, folders):
    _, path, _ = folders
    df = spark.createDataFrame([row(i, i) for i in range(12)], COLUMNS)
    state = sf.feature_state(df, period="10 days")
    sf.commit_batch(state, 0, path)
    once = rows_of(sf.read_features(spark, path))
    sf.commit_batch(state, 0, path)
    assert rows_of(sf.read_features(spark, path)) == once == rows_of(seller_features(df))


def test_nothing_committed_gives_no_rows(spark, folders):
    assert sf.read_features(spark, folders[1]).count() == 0 and sf.compact(spark, folders[1]) is None


def test_registered_query_reads_state(spark):
    from sellerscope.plans.registry import QUERIES
    df = QUERIES["streamed_seller_features"](spark, "/root/testdata/sf0.001")
    assert df.where(F.col("num_publicaciones") > 0).count() == df.count() > 0


def test_state_in_rocksdb_and_the_callers_session_unchanged(spark, folders):
    src, path, checkpoint = folders
    rows = [row(i, i % 9) for i in range(20)]
    feed(spark, rows, src, "a")
    feed(spark, rows[3:9], src, "b")                          # sent again
    before, own = spark.conf.getAll, sf.state_session(spark)
    assert spark.conf.getAll == before and all(own.conf.get(k) == v for k, v in sf.STATE_CONF.items())
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    q = run(own, src, path, checkpoint)
    assert any("rocksdb" in k for k in q.lastProgress["stateOperators"][0]["customMetrics"])
    assert rows_of(sf.read_features(spark, path)) == rows_of(seller_features(spark.createDataFrame(rows, COLUMNS)))


def test_ids_that_differ_in_where_they_are_null_are_two_listings(spark, folders):
    src, path, checkpoint = folders
    one, two = row(1, 1, seller="s", category="x"), row(1, 1, seller="s", category="x")
    rows = [(None, *one[1:2], "x", *one[3:]), ("x", *two[1:2], None, *two[3:])]
    feed(spark, rows, src, "a")
    stream = spark.readStream.schema(COLUMNS).parquet(f"{src}/*")
    sf.start_feature_stream(stream, path, checkpoint, available_now=True, listing_id=("url", "category_id")).awaitTermination()
    assert sf.read_features(spark, path).first()["num_publicaciones"] == 2


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def left(spark, before):
    """New shuffle files, once those being removed are gone."""
    for _ in range(50):
        new = shuffle_files(spark) - before
        if not new:
            break
        time.sleep(0.1)
    return new


def test_shuffle_files_of_committed_batches_and_compactions_go(spark, folders):
    src, path, checkpoint = folders
    rows = [row(i, i % 9) for i in range(60)]
    for n in range(3):
        feed(spark, rows[20 * n:20 * n + 20], src, f"part{n}")
    own, before = sf.state_session(spark), shuffle_files(spark)
    run(own, src, path, checkpoint)
    assert not left(spark, before)  # stayed until a garbage collection before
    assert sf.compact(own, path) is not None and not left(spark, before)
    sf.drop_checkpoint(own, checkpoint)
    assert not os.path.exists(checkpoint)
    assert rows_of(sf.read_features(spark, path)) == rows_of(seller_features(spark.createDataFrame(rows, COLUMNS)))


def test_a_session_of_its_own_leaves_no_shuffle_files_and_the_caller_as_it_was(spark, folders):
    before, conf = shuffle_files(spark), spark.conf.getAll
    own_session(spark).range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(folders[1])
    assert not left(spark, before) and spark.conf.getAll == conf
    assert spark.read.parquet(folders[1]).agg(F.sum("count")).first()[0] == 1000


def test_compaction_merges_once_and_reads_plainly(spark, folders):
    _, path, _ = folders
    for i, n in enumerate((4, 9, 12)):
        sf.commit_batch(sf.feature_state(spark.createDataFrame([row(j, j) for j in range(n)], COLUMNS), period="10 days"), i, path)
    want = rows_of(seller_features(spark.createDataFrame([row(j, j) for j in range(12)], COLUMNS)))
    assert sf.compact(spark, path) == 2 and sf.compact(spark, path) == 2
    plan = sf.latest_state(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and rows_of(sf.read_features(spark, path)) == want  # compacted rows were grouped again before
