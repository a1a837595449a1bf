"""k-means: nearest-centroid assignment, Lloyd step, inertia, fitting.

A centroid set is k rows of a parameter table (k is small and fixed by the
caller, a proven bound).  It is collected once and compiled into one
projection (k unrolled squared distances and an argmin ``CASE``), so assigning
100 million sellers is a map-only stage: no join, no broadcast table, no
shuffle.  Fitting advances all restarts together (``batch_kmeans``) and keeps
the lowest cost.  More than MAX_K centroids raise an error, none are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .batch_kmeans import TOLERANCE
from .features import FEATURES

MAX_K = 1000


def collect_centroids(centroids: DataFrame, columns=FEATURES, id_col="cluster_id") -> list[tuple[int, list[float]]]:
    rows = centroids.select(id_col, *columns).limit(MAX_K + 1).collect()
    if len(rows) > MAX_K:
        raise ValueError(f"more than {MAX_K} centroids")
    return sorted((int(r[id_col]), [float(r[c]) for c in columns]) for r in rows)


def sq_distance(center: list[float], columns=FEATURES) -> Column:
    terms = [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(columns, center)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def assign_expr(cents: list[tuple[int, list[float]]], columns=FEATURES) -> tuple[Column, Column]:
    """(cluster_id, squared distance) of the nearest centroid; ties -> lowest id."""
    dists = [(cid, sq_distance(c, columns)) for cid, c in cents]
    best = dists[0][1]
    for _, d in dists[1:]:
        best = F.least(best, d)
    cid_expr = None
    for cid, d in dists:
        cond = d <= best
        cid_expr = F.when(cond, F.lit(cid)) if cid_expr is None else cid_expr.when(cond, F.lit(cid))
    return cid_expr.cast("int"), best


def assign_segments(scaled: DataFrame, centroids: DataFrame, columns=FEATURES, key="seller_nickname") -> DataFrame:
    """``(key, cluster_id, distance2)``: nearest centroid by squared Euclidean distance."""
    cents = collect_centroids(centroids, columns)
    cid, best = assign_expr(cents, columns)
    return scaled.select(key, cid.alias("cluster_id"), best.alias("distance2"))


def assign_with_features(scaled: DataFrame, centroids: DataFrame, columns=FEATURES) -> DataFrame:
    cents = collect_centroids(centroids, columns)
    cid, best = assign_expr(cents, columns)
    return scaled.withColumns({"cluster_id": cid, "distance2": best})


def lloyd_step(scaled: DataFrame, centroids: DataFrame, columns=FEATURES) -> DataFrame:
    """One fixed-point step: assign, then recompute each centroid as the mean of its
    members.  ``(cluster_id, n, features...)``; partial aggregation keeps a hot
    cluster from landing in one task."""
    a = assign_with_features(scaled, centroids, columns)
    return a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def total_sum_squares(scaled: DataFrame, columns=FEATURES) -> DataFrame:
    """Inertia for k = 1: sum over features of n * population variance."""
    n = F.count(F.lit(1))
    tss = None
    for c in columns:
        t = F.var_pop(c) * n
        tss = t if tss is None else tss + t
    return scaled.agg(n.alias("n"), tss.alias("total_sum_squares"))


def quantile_profile_centroids(scaled: DataFrame, probs=(0.1, 0.5, 0.9), columns=FEATURES) -> DataFrame:
    """Deterministic centroids: centroid i is the vector of per-feature exact
    quantiles at ``probs[i]`` (a reproducible initialisation / reference model)."""
    q = exact_quantiles(scaled, list(columns), list(probs))
    aggs = [F.first(F.when(F.col("column") == c, F.col("quantile")), ignorenulls=True).alias(c) for c in columns]
    ids = F.create_map(*[x for i, p in enumerate(probs) for x in (F.lit(float(p)), F.lit(i))])
    return q.groupBy(F.element_at(ids, F.col("p")).alias("cluster_id")).agg(*aggs)


def _centroid_frame(spark, centres, columns):
    rows = [(i, *[float(x) for x in c]) for i, c in enumerate(centres)]
    schema = "cluster_id int, " + ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, schema)


def fit_kmeans(scaled: DataFrame, k: int, columns=FEATURES, *, n_init: int = 10, max_iter: int = 300,
               tol: float = TOLERANCE, seed: int = 42):
    """Fit k-means with ``n_init`` restarts, all advanced together (see
    ``batch_kmeans``), and keep the lowest inertia.  Returns ``(centroids
    DataFrame with ids 0..k-1, inertia)``."""
    if k < 2:
        raise ValueError("k-means needs k >= 2; use total_sum_squares for k = 1")
    from .batch_kmeans import best_of, fit_many
    fits = fit_many(scaled, [(k, i) for i in range(n_init)], columns, max_iter=max_iter, tol=tol, seed=seed)
    centres, cost = best_of(fits, k)
    return _centroid_frame(scaled.sparkSession, centres, columns), float(cost)


def fit_sweep(scaled: DataFrame, ks, columns=FEATURES, *, n_init: int = 10, max_iter: int = 300,
              tol: float = TOLERANCE, seed: int = 42) -> dict:
    """Best centroids and inertia for every k >= 2 in ``ks`` from one batched fit:
    ``{k: (centres ndarray, inertia)}``."""
    from .batch_kmeans import best_of, fit_many
    ks = [int(k) for k in ks if int(k) >= 2]
    fits = fit_many(scaled, [(k, i) for k in ks for i in range(n_init)], columns, max_iter=max_iter, tol=tol, seed=seed)
    return {k: best_of(fits, k) for k in ks}
