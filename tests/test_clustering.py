import math

import numpy as np
from pyspark.sql import functions as F

from sellerscope.operators import evaluate as ev
from sellerscope.operators import kmeans as km
from sellerscope.operators.batch_kmeans import fit_many
from sellerscope.operators.elbow import kneedle

COLS = ["a", "b"]


def _points(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [5, 5], [0, 6]])
    rows = []
    for i in range(n):
        c = centers[i % 3]
        rows.append((f"p{i}", float(c[0] + rng.normal()), float(c[1] + rng.normal()), int(i % 3)))
    return spark.createDataFrame(rows, "seller_nickname string, a double, b double, cluster_id int")


def _np(df):
    pdf = df.toPandas()
    return pdf[COLS].to_numpy(), pdf["cluster_id"].to_numpy()


def test_silhouette_matches_bruteforce_sqeuclidean(spark):
    df = _points(spark)
    x, lab = _np(df)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = ev.silhouette(df, COLS).collect()[0]["silhouette"]
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)


def test_silhouette_matches_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    df = _points(spark, 1)
    vec = VectorAssembler(inputCols=COLS, outputCol="features").transform(df).withColumn("prediction", F.col("cluster_id").cast("double"))
    ref = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vec)
    assert math.isclose(ev.silhouette(df, COLS).collect()[0]["silhouette"], ref, rel_tol=1e-6)


def test_db_and_ch_bruteforce(spark):
    df = _points(spark, 2)
    x, lab = _np(df)
    ks = sorted(set(lab))
    cents = {k: x[lab == k].mean(0) for k in ks}
    s = {k: np.sqrt(((x[lab == k] - cents[k]) ** 2).sum(1)).mean() for k in ks}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in ks if j != i) for i in ks])
    g = x.mean(0)
    ssb = sum((lab == k).sum() * ((cents[k] - g) ** 2).sum() for k in ks)
    ssw = sum(((x[lab == k] - cents[k]) ** 2).sum() for k in ks)
    ch = (ssb / (len(ks) - 1)) / (ssw / (len(x) - len(ks)))
    assert math.isclose(ev.davies_bouldin(df, COLS).collect()[0]["davies_bouldin"], db, rel_tol=1e-9)
    assert math.isclose(ev.calinski_harabasz(df, COLS).collect()[0]["calinski_harabasz"], ch, rel_tol=1e-9)


def test_assignment_is_nearest_centroid_and_lloyd_fixed_point(spark):
    df = _points(spark, 3)
    cents, cost = km.fit_kmeans(df, 3, COLS, n_init=3)
    labels = km.assign_with_features(df, cents, COLS).toPandas()
    c = np.array([[r[x] for x in COLS] for r in cents.orderBy("cluster_id").collect()])
    x = labels[COLS].to_numpy()
    nearest = ((x[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
    assert (nearest == labels["cluster_id"].to_numpy()).all()
    assert math.isclose(labels["distance2"].sum(), cost, rel_tol=1e-6)
    step = km.lloyd_step(df, cents, COLS).orderBy("cluster_id").toPandas()
    assert np.abs(step[COLS].to_numpy() - c).max() < 1e-3


def test_inertia_non_increasing_in_k(spark):
    df = _points(spark, 4, 90)
    fits = fit_many(df, [(k, r) for k in (2, 3, 4, 5) for r in range(3)], COLS)
    best = [min(v[1] for key, v in fits.items() if key[0] == k) for k in (2, 3, 4, 5)]
    assert all(best[i] >= best[i + 1] - 1e-9 for i in range(3))
    tss = km.total_sum_squares(df, COLS).collect()[0]["total_sum_squares"]
    assert tss >= best[0]


def _kneedle_reference(x, y, S=1.0):
    """Plain-loop transcription of the published offline Kneedle rule (convex, decreasing)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    xn = (x - x.min()) / (x.max() - x.min())
    yn = (y - y.min()) / (y.max() - y.min())
    d = (1 - yn) - xn
    n = len(d)
    is_max = [(d[i] >= d[max(i - 1, 0)]) and (d[i] >= d[min(i + 1, n - 1)]) for i in range(n)]
    is_min = [(d[i] <= d[max(i - 1, 0)]) and (d[i] <= d[min(i + 1, n - 1)]) for i in range(n)]
    step = 1.0 / (n - 1)
    first = is_max.index(True)
    thr, tidx = None, None
    for i in range(first, n - 1):
        if is_max[i]:
            thr, tidx = d[i] - S * step, i
        if is_min[i]:
            thr = 0.0
        if d[i + 1] < thr:
            return int(x[tidx])
    return None


def test_kneedle_matches_reference(spark):
    curves = [
        [7276.4, 6297.9, 5599.6, 5261.8, 4980.8, 4755.4, 4560.9, 4379.9, 4252.7, 4132.0, 4034.2, 3936.3, 3864.8, 3773.3],
        [100, 40, 20, 15, 12, 10, 9, 8.5, 8, 7.8],
        [10, 9, 8, 7, 6, 5, 4, 3, 2, 1],
    ]
    for ys in curves:
        xs = list(range(1, len(ys) + 1))
        cdf = spark.createDataFrame(list(zip(xs, [float(v) for v in ys])), "k int, inertia double")
        got = kneedle(cdf).collect()[0]
        ref = _kneedle_reference(xs, ys)
        assert got["elbow_k"] == (ref if ref is not None else 3)
        assert got["found"] == (ref is not None)


def test_batched_quality_matches_single_scores(spark):
    from sellerscope.operators.batch_kmeans import quality_many
    df = _points(spark, 5)
    cents, cost = km.fit_kmeans(df, 3, COLS, n_init=2)
    c = np.array([[r[x] for x in COLS] for r in cents.orderBy("cluster_id").collect()])
    k, sil, db, ch, inertia = quality_many(df, {3: c}, COLS)[0]
    pts = km.assign_with_features(df, cents, COLS)
    assert math.isclose(sil, ev.silhouette(pts, COLS).collect()[0]["silhouette"], rel_tol=1e-9)
    assert math.isclose(db, ev.davies_bouldin(pts, COLS).collect()[0]["davies_bouldin"], rel_tol=1e-9)
    assert math.isclose(ch, ev.calinski_harabasz(pts, COLS).collect()[0]["calinski_harabasz"], rel_tol=1e-9)
    assert math.isclose(inertia, cost, rel_tol=1e-9)


def test_lloyd_sums_of_all_runs_equal_brute_force_also_on_ties():
    from sellerscope.operators import batch_kmeans as bk
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 3)), 1)
    runs = [x[:2], x[5:8], x[20:23], np.vstack([x[:1], x[:1], x[30:32]])]  # two runs of one size side by side; a centre met twice
    runs[0] = np.array([[0.0, 0, 0], [2.0, 0, 0]])
    x[:40, 0] = 1.0                                                       # equally near both centres of the first run
    at = np.cumsum([0] + [len(r) for r in runs])
    got = bk._lloyd_sums([(None, x[:300]), (None, x[300:])], np.vstack(runs), at)
    for j, c in enumerate(runs):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        near = d.argmin(1)
        for i in range(len(c)):
            own = near == i
            want = [*x[own].sum(0), own.sum(), d[own, i].sum()]
            assert np.allclose(got[at[j] + i], want, atol=1e-9), (j, i)


def test_points_are_dealt_to_every_core(spark):
    from sellerscope.operators import batch_kmeans as bk
    df = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a")).coalesce(1)
    blocks, _, n, _ = bk._points(df, ["a"], "k")
    try:  # one partition before: every pass ran on one core
        assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and n == 5000
    finally:
        blocks.unpersist()


def test_lloyd_passes_give_the_sums_of_the_cost_pass_without_costs():
    from sellerscope.operators import batch_kmeans as bk
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(bk.CHUNK + 70, 3)), np.zeros((40, 3))])
    runs = [x[:2], x[2:5], np.vstack([x[:1], x[:1], np.zeros((1, 3))])]  # two equal centres, and centres that are points
    at = np.cumsum([0] + [len(r) for r in runs])
    whole = bk._lloyd_sums([(None, x)], np.vstack(runs), at)
    moved = bk._lloyd_sums([(None, x)], np.vstack(runs), at, cost=False)
    assert np.array_equal(moved[:, :4], whole[:, :4]) and not moved[:, 4].any()
    for j, r in enumerate(runs):
        d = ((x[:, None, :] - r[None]) ** 2).sum(2)
        lab = d.argmin(1)
        assert np.array_equal(whole[at[j]:at[j + 1], 3], np.bincount(lab, minlength=len(r)))
        assert np.allclose(whole[at[j]:at[j + 1], 4], np.bincount(lab, weights=d.min(1), minlength=len(r)), atol=1e-9)


def test_draws_of_all_runs_equal_brute_force():
    from sellerscope.operators import batch_kmeans as bk
    rng = np.random.default_rng(8)
    x, ids = np.vstack([rng.normal(size=(bk.CHUNK + 90, 3)), np.zeros((20, 3))]), rng.integers(-2 ** 63, 2 ** 63 - 1, bk.CHUNK + 110)
    runs = [x[:2], np.zeros((0, 3)), x[4:7], np.zeros((1, 3))]  # one run has no centre yet, one a centre that is a point many times
    at, salts = np.cumsum([0] + [len(r) for r in runs]), np.array([bk._salt(42, r, 2) for r in range(4)])
    got = bk._draws([(ids[:300], x[:300]), (ids[300:], x[300:])], np.vstack(runs), at, salts)
    for j, c in enumerate(runs):
        d2 = ((x[:, None, :] - c[None]) ** 2).sum(2).min(1) if len(c) else np.ones(len(x))
        keys = np.where(d2 > 1e-12, np.log(bk._uniform(ids, salts[j:j + 1])[0]) / np.maximum(d2, 1e-300), -np.inf)
        assert np.array_equal(got[j][1], x[keys.argmax()]) and math.isclose(got[j][0], keys.max(), rel_tol=1e-9)
    assert bk._draws([(ids[-20:], x[-20:])], runs[3], np.array([0, 1]), salts[:1]) == {}  # every point is the centre


def test_a_pass_asks_for_few_buckets(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    df, plans, real, was = _points(spark, 6), [], DataFrame.collect, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(DataFrame, "collect", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        fit_many(df, [(2, 0), (3, 0)], COLS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    passes = [p for p in plans if "hashpartitioning(run#" in p]
    assert len(passes) > 4 and not any(", 61)" in p for p in passes)  # 61 files per task and pass before
