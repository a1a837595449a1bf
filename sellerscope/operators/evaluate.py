"""Cluster validation: silhouette, Davies-Bouldin, Calinski-Harabasz, quality sweep.

Every score is built from per-cluster sufficient statistics (k rows: count,
vector sum, sum of squared norms), computed by one partial aggregate, plus at
most one more pass over the points with the k centroids inlined as literals.
No pairwise (n^2) work and no cross join is ever planned.

Silhouette: exact Euclidean silhouette needs every pair of points.  Instead
this computes the exact *squared*-Euclidean silhouette, which decomposes:
the summed squared distance from x to the members of cluster C is
``n_C |x|^2 - 2 x.S_C + Q_C``.  (Spark ML's ClusteringEvaluator uses the same
decomposition; scikit-learn gives the same value with metric="sqeuclidean".)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

MAX_K = 1000


def cluster_stats(points: DataFrame, columns=FEATURES, cluster_id="cluster_id") -> list[dict]:
    """k rows: n, per-feature sums, sum of squared norms (bounded by k)."""
    sq = None
    for c in columns:
        t = F.col(c) * F.col(c)
        sq = t if sq is None else sq + t
    rows = (points.groupBy(cluster_id)
                  .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s__{c}") for c in columns],
                       F.sum(sq).alias("q"))
                  .limit(MAX_K + 1).collect())
    if len(rows) > MAX_K:
        raise ValueError("too many clusters")
    return [{"id": r[cluster_id], "n": r["n"], "s": [r[f"s__{c}"] for c in columns], "q": r["q"]}
            for r in sorted(rows, key=lambda r: r[cluster_id])]


def silhouette(points: DataFrame, columns=FEATURES, cluster_id="cluster_id") -> DataFrame:
    """One row ``(n_clusters, silhouette)``: mean squared-Euclidean silhouette."""
    mean = points.agg(*[F.avg(c).alias(c) for c in columns]).first()
    # n |x|^2 - 2 x.S + Q cancels far from the origin: measure from the global mean
    points = points.select(cluster_id, *[(F.col(c) - F.lit(mean[c])).alias(c) for c in columns])
    st = cluster_stats(points, columns, cluster_id)
    k = len(st)
    if k < 2:
        return points.sparkSession.createDataFrame([(k, None)], "n_clusters int, silhouette double")
    norm2 = None
    for c in columns:
        t = F.col(c) * F.col(c)
        norm2 = t if norm2 is None else norm2 + t

    def total_sq(s):  # sum of squared distances from the row to every member of s
        dot = None
        for c, v in zip(columns, s["s"]):
            t = F.col(c) * F.lit(float(v))
            dot = t if dot is None else dot + t
        return F.lit(float(s["n"])) * norm2 - F.lit(2.0) * dot + F.lit(float(s["q"]))

    own = F.col(cluster_id)
    a_expr = None
    b_expr = None
    for s in st:
        a_s = F.when(own == s["id"], F.try_divide(total_sq(s), F.lit(float(s["n"] - 1))))
        a_expr = a_s if a_expr is None else F.coalesce(a_expr, a_s)
        b_s = F.when(own != s["id"], total_sq(s) / F.lit(float(s["n"])))
        b_expr = b_s if b_expr is None else F.least(b_expr, b_s)
    sizes = F.create_map(*[x for s in st for x in (F.lit(s["id"]), F.lit(s["n"]))])
    per_point = points.select(a_expr.alias("__a"), b_expr.alias("__b"), own.alias("__c")).withColumn(
        "__s", F.when(F.element_at(sizes, F.col("__c")) <= 1, F.lit(0.0)).otherwise(
            F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest(F.col("__a"), F.col("__b"))), F.lit(0.0))))
    return per_point.agg(F.lit(k).alias("n_clusters"), F.avg("__s").alias("silhouette"))


def _centroids(st):
    return {s["id"]: [v / s["n"] for v in s["s"]] for s in st}


def davies_bouldin(points: DataFrame, columns=FEATURES, cluster_id="cluster_id") -> DataFrame:
    """One row ``(n_clusters, davies_bouldin)``; S_i is the mean Euclidean distance to the centroid."""
    st = cluster_stats(points, columns, cluster_id)
    k = len(st)
    spark = points.sparkSession
    if k < 2:
        return spark.createDataFrame([(k, None)], "n_clusters int, davies_bouldin double")
    cents = _centroids(st)
    dist = None
    for s in st:
        d2 = None
        for c, v in zip(columns, cents[s["id"]]):
            t = (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
            d2 = t if d2 is None else d2 + t
        e = F.when(F.col(cluster_id) == s["id"], F.sqrt(d2))
        dist = e if dist is None else F.coalesce(dist, e)
    spread = {r[cluster_id]: r["s"] for r in
              points.select(cluster_id, dist.alias("d")).groupBy(cluster_id).agg(F.avg("d").alias("s")).collect()}
    ids = [s["id"] for s in st]
    total = 0.0
    for i in ids:
        best = 0.0
        for j in ids:
            if i == j:
                continue
            dij = math.sqrt(sum((a - b) ** 2 for a, b in zip(cents[i], cents[j])))
            r = (spread[i] + spread[j]) / dij if dij > 0 else float("inf")
            best = max(best, r)
        total += best
    return spark.createDataFrame([(k, total / k)], "n_clusters int, davies_bouldin double")


def calinski_harabasz(points: DataFrame, columns=FEATURES, cluster_id="cluster_id") -> DataFrame:
    """One row ``(n_clusters, calinski_harabasz)`` = (SSB/(k-1)) / (SSW/(n-k))."""
    st = cluster_stats(points, columns, cluster_id)
    k = len(st)
    spark = points.sparkSession
    n = sum(s["n"] for s in st)
    if k < 2 or n <= k:
        return spark.createDataFrame([(k, None)], "n_clusters int, calinski_harabasz double")
    p = len(columns)
    mean = [sum(s["s"][f] for s in st) / n for f in range(p)]
    ssb = sum(s["n"] * sum((s["s"][f] / s["n"] - mean[f]) ** 2 for f in range(p)) for s in st)
    cents = _centroids(st)
    # SSW with a second pass (numerically safer than q - |s|^2/n)
    expr = None
    for s in st:
        acc = None
        for c, v in zip(columns, cents[s["id"]]):
            t = (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
            acc = t if acc is None else acc + t
        e = F.when(F.col(cluster_id) == s["id"], acc)
        expr = e if expr is None else F.coalesce(expr, e)
    ssw = points.select(F.sum(expr).alias("w")).collect()[0]["w"]
    ch = (ssb / (k - 1)) / (ssw / (n - k)) if ssw else None
    return spark.createDataFrame([(k, ch)], "n_clusters int, calinski_harabasz double")


def cluster_quality(scaled: DataFrame, ks=range(2, 11), columns=FEATURES, *, n_init: int = 10,
                    max_iter: int = 300, seed: int = 42, fits: dict | None = None) -> DataFrame:
    """``(k, silhouette, davies_bouldin, calinski_harabasz, inertia)`` for each k.

    ``fits`` (``{k: (centres, inertia)}``, e.g. from the k sweep) avoids refitting;
    all scores for all k come from two passes over the points."""
    from .batch_kmeans import quality_many
    from .kmeans import fit_sweep
    ks = [int(k) for k in ks]
    if fits is None or any(k not in fits for k in ks):
        fits = fit_sweep(scaled, ks, columns, n_init=n_init, max_iter=max_iter, seed=seed)
    rows = quality_many(scaled, {k: fits[k][0] for k in ks}, columns)
    return scaled.sparkSession.createDataFrame(
        rows, "k int, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double")
