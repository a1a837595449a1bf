"""Top values by digests against the plain top values: unique columns, ties, hot values, NULLs, shared digests."""
import pytest
from pyspark.sql import functions as F

from sellerscope.operators import profile as pr
from sellerscope.operators import top_values as tv

SCHEMA = "one string, few string, middle string, nearly string, nulls string, number double"


def same(df, n=5, **kw):
    plain = pr.top_values(pr.value_frequency(df), n).select("column_name", "value", "freq", "rank").collect()
    assert sorted(map(tuple, tv.top_values_by_digest(df, n, **kw).collect()), key=str) == sorted(map(tuple, plain), key=str)


@pytest.fixture(scope="module")
def facts(spark):
    data = [(f"u{i * 7919 % 9000:05d}", "hot" if i % 3 else f"f{i % 4}", f"m{i % 3000}", "again" if i < 40 else f"n{i}",
             None if i % 2 else f"{i % 11}", float(i % 5)) for i in range(9000)]
    return spark.createDataFrame(data, SCHEMA).repartition(5).persist()


def test_equals_the_plain_top_values(facts):
    same(facts)
    same(facts, most_tied=20)  # the tied columns go over the least texts


def test_ties_in_the_middle_take_the_plain_way(spark):
    data = [(f"v{i}",) for i in range(600) for _ in range(2)] + [(f"w{i}",) for i in range(100)]
    same(spark.createDataFrame(data, "v string"), most_tied=50)
    same(spark.createDataFrame(data, "v string"))


def test_texts_that_share_a_digest(facts, monkeypatch):
    monkeypatch.setattr(tv, "digest", lambda text: F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(3))))
    same(facts)
    monkeypatch.setattr(tv, "digest", lambda text: F.when(text.isNotNull(), F.pmod(F.xxhash64(text), F.lit(5000))))
    same(facts, most_tied=20)


def test_empty_null_and_long_texts(spark):
    same(spark.createDataFrame([], "a string, b int"))
    same(spark.createDataFrame([(None, 1), (None, None), ("", 1), ("x" * 200_000, 2), ("x" * 200_000, None)], "a string, b int"), n=2)


def test_a_unique_column_stays_out_of_the_exchanges(spark, facts):
    least = tv._least(facts, [(0, "one")], {0: []}, 5)
    assert [r.value for r in least.orderBy("value").collect()] == [f"u{i:05d}" for i in range(5)]
    digests = tv._long(facts, [(0, "one")], values=False).groupBy("c", "h").count()
    plan = digests._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "hashpartitioning(c#" in exchange and "h#" in exchange and "value" not in exchange and digests.columns == ["c", "h", "count"]
