"""Mean Euclidean silhouette against hash-drawn anchors, with a standard error.

The exact value needs every pair of points.  Here each point is compared with at
most ``anchors`` points of every cluster: those whose key has the least MD5, a draw
that does not depend on layout.  All points are scored; only the clusters' members
they are compared with are drawn, so the memory of a task is bounded by
``clusters x anchors`` points and nothing is shuffled but one row per task.  Where no
cluster has more members than anchors the value is exact.

Standard error: the anchors are dealt into ``GROUPS`` groups by rank, the value is
computed without each group in turn in the same pass (delete-one-group jackknife),
and the spread is scaled by the share of points that are not anchors.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import MAX_K, silhouette
from .features import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHORS = 1024
GROUPS = 8
ROWS = 512  # points that a task compares with all anchors at a time


def draw_anchors(points: DataFrame, columns=FEATURES, key="seller_nickname", cluster_id="cluster_id", anchors: int = ANCHORS) -> DataFrame:
    """``(cluster, rank, key, columns)``: at most ``anchors`` points of each cluster, by MD5 of the key.

    ``row_number() <= n`` is planned as a group limit before the shuffle: each task sends at most ``anchors`` rows a cluster."""
    order = Window.partitionBy("cluster").orderBy(F.md5(F.col("key").cast("binary")), "key")
    rows = points.select(F.col(cluster_id).alias("cluster"), F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= anchors)


def _score(own, d, mine, of, count):
    """Silhouette of points from ``d`` (summed distances per cluster) and ``of`` (anchors per cluster); ``mine``: is an anchor."""
    n_own = of[own] - mine
    rows = np.arange(len(own))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(of > 0, d / np.where(of > 0, of, 1), np.inf)
        a = np.where(n_own > 0, d[rows, own] / np.where(n_own > 0, n_own, 1), 0.0)
        mean[rows, own] = np.inf
        b = mean.min(1)
        den = np.maximum(a, b)
        s = np.where((count[own] > 1) & (n_own > 0) & np.isfinite(b) & (den > 0), (b - a) / np.where(den > 0, den, 1), 0.0)
    return s


def euclidean_silhouette(points: DataFrame, columns=FEATURES, key="seller_nickname", cluster_id="cluster_id",
                         anchors: int = ANCHORS) -> DataFrame:
    """One row ``(n_clusters, points, anchors, silhouette, silhouette_euclidean, standard_error)``.

    Points with a NULL are left out of the Euclidean value.  Fewer than two clusters: NULL."""
    columns = list(columns)
    whole = points.where(F.col(cluster_id).isNotNull()).dropna(subset=columns)
    spark = points.sparkSession
    sizes = {r["c"]: r["n"] for r in whole.groupBy(F.col(cluster_id).alias("c")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_K + 1).collect()}
    if len(sizes) > MAX_K:
        raise ValueError("too many clusters")
    schema = "n_clusters int, points long, anchors long, silhouette double, silhouette_euclidean double, standard_error double"
    if len(sizes) < 2:
        return spark.createDataFrame([(len(sizes), sum(sizes.values()), 0, None, None, None)], schema)
    held = draw_anchors(whole, columns, key, cluster_id, anchors).toPandas()  # at most clusters x anchors rows
    held = held.sort_values(["cluster", "rank"])
    ids = sorted(sizes)
    at = {c: i for i, c in enumerate(ids)}
    a_x, a_key = held[columns].to_numpy(float), held["key"].to_numpy(str)
    a_c = held["cluster"].map(at).to_numpy(int)
    a_g = ((held["rank"] - 1) % GROUPS).to_numpy(int)
    cell = a_c * GROUPS + a_g
    one = np.eye(len(ids) * GROUPS)[cell]               # anchor -> (cluster, group)
    per = one.sum(0).reshape(len(ids), GROUPS)          # anchors in each
    place = {k: (c, g) for k, c, g in zip(a_key, a_c, a_g)}
    count = np.array([sizes[c] for c in ids])

    def task(it):
        total = np.zeros(GROUPS + 1)
        for pdf in it:
            xs, keys, own_ids = pdf[columns].to_numpy(float), pdf["_key"].to_numpy(str), pdf["_c"].map(at).to_numpy(int)
            for lo in range(0, len(xs), ROWS):
                x, own = xs[lo:lo + ROWS], own_ids[lo:lo + ROWS]
                d = np.sqrt(sum((x[:, f][:, None] - a_x[:, f][None, :]) ** 2 for f in range(x.shape[1])))
                by = (d @ one).reshape(len(x), len(ids), GROUPS)
                met = [place.get(k, (-1, -1)) for k in keys[lo:lo + ROWS]]
                mine = np.array([m[0] == o for m, o in zip(met, own)]).astype(int)
                group = np.array([m[1] for m in met])
                total[GROUPS] += _score(own, by.sum(2), mine, per.sum(1), count).sum()
                for g in range(GROUPS):
                    total[g] += _score(own, by.sum(2) - by[:, :, g], mine * (group != g), (per.sum(1) - per[:, g]), count).sum()
        yield pd.DataFrame([total.tolist()], columns=[f"t{g}" for g in range(GROUPS + 1)])
    rows = whole.select(*columns, F.col(key).cast("string").alias("_key"), F.col(cluster_id).alias("_c"))
    sums = rows.mapInPandas(task, ", ".join(f"t{g} double" for g in range(GROUPS + 1))).agg(*[F.sum(f"t{g}").alias(f"t{g}") for g in range(GROUPS + 1)])
    n = int(count.sum())
    less = [F.col(f"t{g}") / n for g in range(GROUPS)]
    middle = sum(less[1:], less[0]) / GROUPS
    spread = sum(((v - middle) * (v - middle) for v in less[1:]), (less[0] - middle) * (less[0] - middle))
    unseen = 1.0 - len(held) / n
    return (sums.select((F.col(f"t{GROUPS}") / n).alias("silhouette_euclidean"),
                        F.sqrt(spread * F.lit((GROUPS - 1) / GROUPS * unseen)).alias("standard_error"))
            .join(F.broadcast(silhouette(whole, columns, cluster_id)), how="cross")  # one row each
            .select(F.col("n_clusters"), F.lit(n).cast("long").alias("points"), F.lit(len(held)).cast("long").alias("anchors"),
                    "silhouette", "silhouette_euclidean", "standard_error"))
