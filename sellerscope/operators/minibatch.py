"""Mini-batch k-means: many runs advanced together over row-keyed batches.

Rows are dealt to ``batches`` batches by a hash of their key and written once, a
folder per batch, so a step reads its batch only and a pass reads the data once.
A step assigns the rows of one batch to the nearest centre of every run and moves
each centre to the mean of all rows it has been given so far: its count is the
learning rate (a centre met n times moves by 1 / n of a row's way).  A new pass
keeps a part of the counts, so that early places fade.  Centres start by k-means++
on the ``start`` rows of least hash, the same for every layout.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .batch_kmeans import _distances, _pieces, _stacked, _sums
from .features import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCHES = 8
PASSES = 3
KEEP = 0.1      # part of the counts that a new pass keeps
START = 4096    # rows that the first centres are drawn from
TRIES = 3       # restarts per k


def _first_centres(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Greedy k-means++ on the start rows (a few candidates a step, the one that lowers the sum most)."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        if d.sum() <= 0:
            centres.append(centres[-1])
            continue
        tries = rng.choice(len(x), size=2 + int(np.log(k)), p=d / d.sum())
        lower = np.minimum(d[None, :], _distances(x, x[tries]).T)
        best = int(lower.sum(1).argmin())
        centres.append(x[tries[best]])
        d = lower[best]
    return np.array(centres)


def fit_minibatch(scaled: DataFrame, ks, columns=FEATURES, *, tries: int = TRIES, passes: int = PASSES, batches: int = BATCHES,
                  start: int = START, keep: float = KEEP, seed: int = 42, key: str = "seller_nickname") -> dict:
    """``{k: (centres ndarray, inertia)}``: of ``tries`` runs each the one of least inertia over all rows.

    The driver holds centres and ``start`` rows.  A NULL in a column is an error; an empty table too."""
    cols = list(columns)
    p, spark = len(cols), scaled.sparkSession
    x = [F.col(c).cast("double") for c in cols]
    stats = scaled.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v.isNull()).alias(f"e{i}") for i, v in enumerate(x)],
                       *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    if any(stats[f"e{i}"] for i in range(p)):
        raise ValueError("NULL in a column: impute before clustering")
    if not stats["n"]:
        raise ValueError("no rows to cluster")
    mean = np.array([stats[f"m{i}"] for i in range(p)])
    names = [f"x{i}" for i in range(p)]
    rows = scaled.select(F.xxhash64(key).alias("id"), *[(v - F.lit(float(m))).alias(n) for v, m, n in zip(x, mean, names)])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/minibatch-{uuid.uuid4().hex}"
    rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    data = spark.read.schema("id long, " + ", ".join(f"{n} double" for n in names) + ", batch int").parquet(path)
    head = np.array([r[1:] for r in data.select(F.xxhash64("id", F.lit(seed)).alias("h"), *names).orderBy("h", *names).limit(start).collect()], float)
    runs = [(int(k), t) for k in ks for t in range(tries)]
    centres = {r: _first_centres(head, r[0], np.random.default_rng([seed, *r])) for r in runs}
    counts = {r: np.zeros(r[0]) for r in runs}
    schema = "run int, cluster int, n long, sse double, " + ", ".join(f"s{i} double" for i in range(p))

    def sums(part: DataFrame):
        at = _stacked(centres)

        def task(it):
            names_, c, lows = at
            acc = {}
            for _, x in _pieces(it):
                d = _distances(x, c)
                for j, r in enumerate(names_):
                    own = d[:, lows[j]:lows[j + 1]]
                    lab, k = own.argmin(1), own.shape[1]
                    got = (np.bincount(lab, minlength=k), np.bincount(lab, weights=own[np.arange(len(x)), lab], minlength=k), _sums(lab, x, k))
                    acc[r] = got if r not in acc else tuple(u + v for u, v in zip(acc[r], got))
            out = [(runs.index(r), j, int(n[j]), float(sse[j]), *s[j].tolist()) for r, (n, sse, s) in acc.items() for j in range(len(n))]
            yield pd.DataFrame(out, columns=["run", "cluster", "n", "sse"] + [f"s{i}" for i in range(p)])
        agg = part.select("id", *names).mapInPandas(task, schema).groupBy("run", "cluster").agg(
            F.sum("n").alias("n"), F.sum("sse").alias("sse"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)])
        out = {r: (np.zeros(r[0]), np.zeros((r[0], p)), np.zeros(r[0])) for r in runs}
        for row in agg.collect():
            n, s, sse = out[runs[row["run"]]]
            n[row["cluster"]], s[row["cluster"]], sse[row["cluster"]] = row["n"], [row[f"s{i}"] for i in range(p)], row["sse"]
        return out

    for turn in range(passes):
        for r in runs:
            counts[r] = counts[r] * (keep if turn else 0.0)
        for b in range(batches):
            for r, (n, s, _) in sums(data.where(F.col("batch") == b)).items():
                met = n > 0
                counts[r] = counts[r] + n
                step = np.divide(1.0, counts[r], out=np.zeros_like(counts[r]), where=met)
                centres[r] = centres[r] + step[:, None] * (s - n[:, None] * centres[r])
    last = {r: float(v[2].sum()) for r, v in sums(data).items()}
    best = {int(k): min((last[r], r[1]) for r in runs if r[0] == int(k)) for k in ks}
    return {k: (centres[(k, t)] + mean, inertia) for k, (inertia, t) in best.items()}
