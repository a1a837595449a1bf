"""Large values, k-means draws, safe variances, model files, label history, small brackets, foreign working folder."""
import datetime as dt
import math
import os
import subprocess
import sys
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sellerscope.functions.expressions import snap
from sellerscope.functions.quantiles import exact_quantiles
from sellerscope.operators import evaluate as ev
from sellerscope.operators import explore as ex
from sellerscope.operators import preprocess as pp
from sellerscope.operators import segments as sg
from sellerscope.operators.batch_kmeans import fit_many
from sellerscope.operators.features import FEATURES
from sellerscope.plans import scoring
from sellerscope.plans.oracle_sql import rnd
from sellerscope.sources import sinks
from sellerscope.streaming.scoring import score_frame

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("bits", [8, 10, 12, 20])
def test_snap_agrees_with_sql_and_never_saturates(spark, bits):
    values = [0.0, -1e-9, 0.0196875, 2.5 / 2 ** bits, -3.5 / 2 ** bits, 123.456, -7e8 + 0.3, 9e12, 2e13, 5e16, 1e17, -1e17, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(snap("x", bits)).collect()]
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(values)), "x": values}))
    assert got == [r[0] for r in con.execute(f"SELECT {rnd('x', 'x', bits)} FROM t ORDER BY i").fetchall()]
    assert got[9] == 5e16 and got[12] == 1e300


@pytest.mark.parametrize("scale", [1e13, 1e17])
def test_large_gmv_stays_whole(spark, scale):
    rows = [(f"s{i}", "green_platinum", dt.date(2024, 1 + i % 3, 1), scale * (i + 1)) for i in range(9)]
    listings = spark.createDataFrame(rows, "seller_nickname string, seller_reputation string, snapshot_on date, gmv double")
    labels = spark.createDataFrame([(f"s{i}", 2) for i in range(9)], "seller_nickname string, cluster_id int")
    alerts = {r["seller_nickname"]: r["g"] for r in sg.promotion_alerts(sg.seller_gmv(listings), labels).select("seller_nickname", snap("gmv", 8).alias("g")).collect()}
    assert alerts == {f"s{i}": scale * (i + 1) for i in range(9)}
    months = [r["g"] for r in sg.segment_gmv_growth(listings, labels).orderBy("month").select(snap("gmv", 8).alias("g")).collect()]
    assert months == [scale * 12, scale * 15, scale * 18]


def _line(spark, n, parts):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("seller_nickname"), F.col("id").cast("double").alias("a"),
                                              (F.col("id") % 7).cast("double").alias("b"))


def test_first_centres_come_from_all_rows_and_any_layout(spark):
    n, runs = 40_000, [(2, r) for r in range(60)]
    one = fit_many(_line(spark, n, 1), runs, ["a", "b"], max_iter=0)
    many = fit_many(_line(spark, n, 8), runs, ["a", "b"], max_iter=0)
    first = np.array([one[r][0][0][0] for r in runs])
    assert (first > 10_000).mean() > 0.5 and first.max() > 0.9 * n
    for r in runs:
        assert np.allclose(one[r][0], many[r][0], rtol=1e-12)


def test_null_points_are_refused(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 3.0)], "seller_nickname string, a double")
    with pytest.raises(ValueError, match="a"):
        fit_many(df, [(2, 0)], ["a"])
    with pytest.raises(ValueError, match="a"):
        pp.fitted_params(pp.scaler_params(df.where("a is null"), ["a"]), ["a"])


def test_anova_of_large_prices(spark):
    rng = np.random.default_rng(4)
    price = np.concatenate([1e9 + rng.normal(0, 50, 400), 1e9 + 40 + rng.normal(0, 50, 300), 4.77e9 + rng.normal(0, 50, 5)])
    group = ["x"] * 400 + ["y"] * 300 + ["z"] * 5
    got = ex.anova_f(spark.createDataFrame(list(zip(group, price.tolist())), "g string, v double"), "v", "g").first()["f_statistic"]
    parts = [price[np.array(group) == g].astype(np.longdouble) for g in "xyz"]
    mean = sum(p.sum() for p in parts) / len(price)
    ssb = sum(len(p) * (p.mean() - mean) ** 2 for p in parts)
    ssw = sum(((p - p.mean()) ** 2).sum() for p in parts)
    assert got > 0 and math.isclose(got, float((ssb / 2) / (ssw / (len(price) - 3))), rel_tol=1e-7)


def test_silhouette_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), float(3 * (i % 3) + x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(90, 2)))]
    near = spark.createDataFrame(rows, "cluster_id int, a double, b double")
    far = near.select("cluster_id", (F.col("a") + 1e7).alias("a"), (F.col("b") - 1e7).alias("b"))
    s = [ev.silhouette(d, ["a", "b"]).first()["silhouette"] for d in (near, far)]
    assert math.isclose(s[0], s[1], rel_tol=1e-6)


@pytest.mark.parametrize("bracket", [1, 40])
def test_quantiles_with_brackets_that_must_shrink(spark, bracket):
    v = np.concatenate([np.random.default_rng(0).normal(size=500), np.full(700, 1.5), [1e12, -1e12]])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = [r["quantile"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0], max_bracket=bracket).orderBy("p").collect()]
    assert np.allclose(got, np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12)


def test_saved_model_scores_new_sellers_with_the_ids_of_the_fit(spark):
    path = tempfile.mkdtemp(prefix="model-", dir="/tmp")
    params = spark.createDataFrame([(f, float(i), 0.0, 1.0, 2.0) for i, f in enumerate(FEATURES)], "feature string, median double, q25 double, q75 double, scale double")
    cents = spark.createDataFrame([(7, *[0.0] * 9), (3, *[1.0] * 9)], "cluster_id int, " + ", ".join(f"{f} double" for f in FEATURES))
    scoring.save_model(path, params, cents)
    p, c = scoring.load_model(spark, path)
    one = spark.createDataFrame([("low", *[float(i) for i in range(9)]), ("high", *[i + 2.0 for i in range(9)]), ("none", *[None] * 9)],
                                "seller_nickname string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r["seller_nickname"]: (r["cluster_id"], r["distance2"]) for r in score_frame(one, p, c).collect()}
    assert got == {"low": (7, 0.0), "high": (3, 0.0), "none": (7, 0.0)}  # nulls take the median


def test_label_history_appends_and_replaces_by_date(spark):
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    day = lambda d, k: spark.createDataFrame([("a", k), ("b", k)], "seller_nickname string, cluster_id int").withColumn("label_date", F.lit(d))
    sinks.append_snapshot(day("2024-01-01", 0), path, "label_date")
    sinks.append_snapshot(day("2024-01-02", 1), path, "label_date")
    sinks.append_snapshot(day("2024-01-02", 2), path, "label_date")
    got = sorted((str(r["label_date"]), r["cluster_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", 0)] * 2 + [("2024-01-02", 2)] * 2


def test_upgrades(spark):
    snaps = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 0), ("b", 2, 2), ("c", 1, 0), ("d", 1, 1)], "seller_nickname string, period int, cluster_id int")
    got = {(r["from_period"], r["from_cluster"]): (r["sellers"], r["upgraded"]) for r in sg.segment_upgrades(snaps).collect()}
    assert got == {(1, 0): (3, 1), (2, 2): (1, 0)}


def test_oversample_in_blocks(spark):
    df = spark.createDataFrame([(i, i < 2) for i in range(1000)], "id int, flag boolean")
    out = pp.oversample_minority(df, "flag", 5.0, block=7)
    reps = {r["id"]: (r["n"], r["d"], r["m"]) for r in out.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("replica").alias("d"), F.max("replica").alias("m")).collect()}
    assert reps[0] == reps[1] == (2495, 2495, 2495) and reps[5] == (1, 1, 1)


def test_group_rare_keeps_rows_and_does_not_shuffle_them(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 39 + [("c",)] + [(None,)] * 30, "x string")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pp.group_rare(df, "x", 0.05)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert {r["x"]: r["count"] for r in out.groupBy("x").count().collect()} == {"a": 60, "b": 39, "OTHER": 1, None: 30}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_facts_are_summed_before_they_meet_labels(spark):
    rows = [(f"s{i % 5}", dt.date(2024, 1, 1 + i % 3), 3, 10.0) for i in range(50)]
    listings = spark.createDataFrame(rows, "seller_nickname string, snapshot_on date, snapshot_rep int, gmv double")
    labels = spark.createDataFrame([(f"s{i}", 1) for i in range(5)], "seller_nickname string, cluster_id int")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (sg.churn_alerts(listings, labels), sg.segment_gmv_growth(listings, labels)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            at = plan.index("SortMergeJoin")
            assert "HashAggregate" in plan[at:]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_kmeans_tasks_need_no_package_on_the_executors():
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession, functions as F\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from sellerscope.operators.batch_kmeans import fit_many\n"
            "d = s.range(100).select(F.col('id').cast('string').alias('seller_nickname'), F.col('id').cast('double').alias('a'))\n"
            "print('FITTED', len(fit_many(d, [(2, 0)], ['a'])))\n" % REPO)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(dir="/tmp"), env=env, capture_output=True, text=True, timeout=300)
    assert "FITTED 1" in out.stdout, out.stderr[-800:]
