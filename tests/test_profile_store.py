"""Stored column sketches: periods merged in any grouping against the whole table, replays, odd tables."""
import math

import numpy as np
import pytest

from sellerscope.operators import profile_store as ps
from sellerscope.sources.sinks import append_snapshot

SCHEMA = "month string, price double, code string, few string"


@pytest.fixture(scope="module")
def facts(spark):
    r = np.random.default_rng(8)
    n = 30_000
    price, few = r.lognormal(3, 1, n) + 1e6, r.choice(["a", "b", "c", "d"], n, p=[.4, .3, .2, .1])
    data = [(f"2024-{i % 5 + 1:02d}", None if i % 97 == 0 else float(price[i]), f"code-{i % 20_000}", None if i % 50 == 0 else str(few[i]))
            for i in range(n)]
    return data, spark.createDataFrame(data, SCHEMA).persist()


def test_merged_periods_equal_the_whole_within_the_stated_error(spark, facts, tmp_path):
    data, df = facts
    path = str(tmp_path / "store")
    append_snapshot(ps.column_sketches(df.where("month <= '2024-03'"), "month"), path, "period")
    append_snapshot(ps.column_sketches(df.where("month >= '2024-03'"), "month"), path, "period")  # March is replayed
    store = spark.read.parquet(path)
    assert store.count() == 15
    merged = ps.merge_sketches(store)
    exact = {r.column_name: r for r in ps.exact_part(merged).collect()}
    prices = np.array([d[1] for d in data if d[1] is not None])
    p = exact["price"]
    assert (p.rows, p.nulls, p.numbers) == (len(data), len(data) - len(prices), len(prices))
    assert math.isclose(p.mean, prices.mean(), rel_tol=1e-13) and math.isclose(p.stddev, prices.std(ddof=1), rel_tol=1e-9)
    assert exact["few"].least == "a" and exact["few"].greatest == "d" and exact["few"].mean is None and exact["few"].nulls == 600
    got = {r.column_name: r for r in ps.estimates(merged).collect()}
    for column, i in (("price", 1), ("code", 2), ("few", 3)):
        true = len({d[i] for d in data} - {None})
        assert abs(got[column].distinct_estimate - true) <= 0.049 * true
    ordered = np.sort(prices)
    for q, value in ((.25, got["price"].q25), (.5, got["price"].q50), (.75, got["price"].q75)):
        assert abs(np.searchsorted(ordered, value) / len(ordered) - q) < 0.007
    assert got["code"].q50 is None
    counts = {v: sum(d[3] == v for d in data) for v in "abcd"}
    assert [(t["item"], t["count"]) for t in got["few"].top_estimate if t["item"] is not None] == sorted(counts.items(), key=lambda kv: -kv[1])


def test_a_hot_value_is_found_among_many(spark):
    df = spark.range(60_000).selectExpr("'p' AS month", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id) END AS v").repartition(6)
    top = ps.estimates(ps.merge_sketches(ps.column_sketches(df, "month")), top=1).first().top_estimate[0]
    assert top["item"] == "hot" and abs(top["count"] - 20_000) <= 3.5 * 60_000 / 1024


def test_merging_in_steps_and_single_periods(spark, facts):
    _, df = facts
    store = ps.column_sketches(df, "month").persist()
    one = ps.merge_sketches(store, ["period", "column_name"])
    assert one.count() == 15
    steps, direct = (ps.exact_part(ps.merge_sketches(s)).orderBy("column_name").collect() for s in (one, store))
    for a, b in zip(steps, direct):
        assert (a.rows, a.nulls, a.least, a.greatest) == (b.rows, b.nulls, b.least, b.greatest)
        assert a.stddev is None and b.stddev is None or math.isclose(a.stddev, b.stddev, rel_tol=1e-9)


def test_empty_all_null_nan_and_null_period(spark):
    none = ps.column_sketches(spark.createDataFrame([], SCHEMA), "month")
    assert ps.merge_sketches(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, ""), (None, float("nan"), None, "x" * 100_000)], SCHEMA)
    merged = ps.merge_sketches(ps.column_sketches(odd, "month"))
    rows = {r.column_name: r for r in ps.exact_part(merged).collect()}
    assert (rows["code"].nulls, rows["price"].nulls, rows["price"].numbers, rows["price"].mean) == (2, 1, 0, None)
    assert rows["few"].least == "" and len(rows["few"].greatest) == 100_000
    est = {r.column_name: r for r in ps.estimates(merged).collect()}
    assert est["code"].distinct_estimate == 0 and est["price"].q50 is None and est["few"].distinct_estimate == 2
    assert sorted(len(t["item"]) for t in est["few"].top_estimate) == [0, 448 + 1 + 64]
    assert [(t["item"], t["count"]) for t in est["code"].top_estimate] == [(None, 2)]


def test_only_sketches_are_shuffled(spark, facts):
    plan = ps.column_sketches(facts[1], "month", tracked=512)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_hll_sketch_agg" in plan
