"""Batched k-means: many (k, restart) runs advanced together, one pass per step.

Choosing k needs ~14 k values x 10 restarts.  Fitting them one by one costs
~150 sequential fits of dozens of small jobs each.  Here all runs share every
pass over the data:

* init (k-means++): step t picks the t-th centre of every run at once.  Each
  point gets the key ``log(u) / D2`` (u uniform, D2 = squared distance to the
  run's current centres); the point with the largest key per run is a sample
  proportional to D2 (Efraimidis-Spirakis).  Per partition only the best
  candidate per run leaves the task; the driver keeps the max.
* Lloyd: each task assigns its points to the nearest centre of every run and
  emits partial sums per (run, cluster) (count, vector sum, SSE).  A
  ``groupBy(run, cluster)`` merges them (sum of k x runs small rows per task),
  so one cluster holding a third of all points never lands in one task.
* a final pass computes every run's inertia with its final centres.

Data stays partitioned by Spark; numpy runs inside Arrow tasks.  The points are
persisted as blocks of ``ROWS`` (ids and a matrix as bytes), so a pass hands them
to numpy as they are, and a pass is two matrix products per ``CHUNK`` points and
number of centres: distances to all centres, and sums by the one-hot marks of the
nearest.  Squared distances are added up in the last pass only.
The driver holds only centres (sum of k over runs, times p floats) per step.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

#: A fit has settled when its centres move by less than this share of the mean variance (sum of squares).
TOLERANCE = 1e-4

# tasks get this module's functions by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 2048  # points per stored block
CHUNK = 512  # points per matrix product: the distances to the centres of ten runs of one size stay in the processor's cache
#: Points that one task may hold (80 MB of nine columns); fewer where that gives every core a task.
MOST = 1_000_000


def _points(scaled: DataFrame, cols, key: str | None):
    """``(blocks, mean, rows, variances)``: the centred point matrix with row ids, in blocks persisted for the many passes.

    A NULL is an error (impute first).  Centring keeps squared distances exact
    for data far from the origin.  The id is a hash of ``key``, so random draws
    belong to the row, not to its batch, partition or cluster; without a key
    column rows are numbered by position.  Every pass is one task per
    partition: as many as cores, more where a partition would have over ``MOST``
    rows.  Larger numbers are coalesced (no shuffle), smaller ones dealt out once."""
    x = [F.col(c).cast("double") for c in cols]
    stats = scaled.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v.isNull()).alias(f"e{i}") for i, v in enumerate(x)],
                       *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(x)]).first()
    empty = [c for i, c in enumerate(cols) if stats[f"e{i}"]]
    if empty:
        raise ValueError(f"NULL in {empty}: impute before clustering")
    n, p = int(stats["n"]), len(cols)
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(p)])
    row = F.xxhash64(key) if key and key in scaled.columns else F.xxhash64(F.monotonically_increasing_id())
    data = scaled.select(row.alias("id"), *[(v - F.lit(float(m))).alias(f"x{i}") for i, (v, m) in enumerate(zip(x, mean))])
    tasks = max(scaled.sparkSession.sparkContext.defaultParallelism, -(-n // MOST))
    have = data.rdd.getNumPartitions()
    if have > tasks:
        data = data.coalesce(tasks)
    elif have < tasks and n > ROWS:
        data = data.repartition(tasks)

    def stored(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            m = np.column_stack([b.column(i + 1).to_numpy() for i in range(p)])
            at = range(0, len(ids), ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([ids[lo:lo + ROWS].tobytes() for lo in at], pa.binary()),
                                              pa.array([m[lo:lo + ROWS].tobytes() for lo in at], pa.binary())], ["ids", "points"])
    blocks = data.mapInArrow(stored, "ids binary, points binary").persist(StorageLevel.MEMORY_AND_DISK)
    return blocks, mean, n, [stats[f"v{i}"] or 0.0 for i in range(p)]


def _salt(seed: int, run: int, step: int) -> np.uint64:
    return np.random.default_rng([seed, run, step]).integers(0, 2 ** 63, dtype=np.uint64)


def _uniform(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One number in (0, 1) per salt, of (seed, run, step), and row id: a finaliser of the hash, no generator state."""
    h = ids.view(np.uint64)[None, :] ^ salts[:, None]
    part = np.empty_like(h)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(h, np.uint64(shift), out=part)
        h ^= part
        if factor > 1:
            h *= np.uint64(factor)
    h >>= np.uint64(11)
    u = h.astype(float)
    u += 0.5
    u /= 2.0 ** 53
    return u


def _stacked(centres: dict):
    """All runs' centres below each other, with each run's first row: one matrix product serves every run."""
    keys = list(centres)
    rows = [np.asarray(centres[k]) for k in keys]
    at = np.cumsum([0] + [len(r) for r in rows])
    return keys, (np.vstack(rows) if len(rows) else np.zeros((0, 0))), at


def _distances(x: np.ndarray, stack: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all stacked centres (points and centres are centred)."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ stack.T) + (stack * stack).sum(1)[None, :], 0.0)


def _assign(x: np.ndarray, centres: np.ndarray):
    d = _distances(x, centres)
    lab = d.argmin(1)
    return lab, d[np.arange(x.shape[0]), lab]


def _sums(lab: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Vector sums per cluster, as a product with the one-hot labels."""
    return (lab[None, :] == np.arange(k)[:, None]).astype(float) @ x


def _blocks(it, p: int):
    """(ids, points) of the stored blocks of a task."""
    for b in it:
        for ids, points in zip(b.column(0), b.column(1)):
            yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(points.as_buffer(), float).reshape(-1, p)


def _lloyd_sums(blocks, stack: np.ndarray, at: np.ndarray, cost: bool = True) -> np.ndarray:
    """Per stacked centre of all runs: sums of its points, their number, their squared distances (0 without ``cost``).

    Each point counts for the nearest centre of every run, the first of equally near ones; run j has the rows
    ``at[j]:at[j + 1]`` of ``stack``.  Runs of one size that lie side by side are compared together, in buffers that are
    kept from chunk to chunk and fit the processor's cache."""
    total, p = np.zeros((len(stack), stack.shape[1] + 2)), stack.shape[1]
    product = np.hstack([-2.0 * stack, (stack * stack).sum(1)[:, None], np.ones((len(stack), 1))])
    sizes = np.diff(at)
    ends = [j for j in range(1, len(sizes) + 1) if j == len(sizes) or sizes[j] != sizes[j - 1]]
    groups = [(int(at[i]), int(at[j]), j - i, int(sizes[i])) for i, j in zip([0] + ends, ends)]
    most = max((e - a for a, e, _, _ in groups), default=0)
    room = np.empty((3, most * CHUNK))
    row = np.empty((CHUNK, p + 2))
    for _, points in blocks:
        for lo in range(0, len(points), CHUNK):
            x = points[lo:lo + CHUNK]
            n = len(x)
            one = row[:n]
            one[:, :p], one[:, p], one[:, p + 1] = x, 1.0, (x * x).sum(1)
            for a, e, runs, k in groups:
                d, mark = (room[i, :(e - a) * n].reshape(e - a, n) for i in (0, 1))
                near = room[2, :runs * n].reshape(runs, n)
                np.matmul(product[a:e], one.T, out=d)
                own, out = d.reshape(runs, k, n), mark.reshape(runs, k, n)
                np.minimum.reduce(own, axis=1, out=near)
                if near.min() < 0:  # rounding at a point that is a centre
                    np.maximum(d, 0.0, out=d)
                    np.maximum(near, 0.0, out=near)
                np.equal(own, near[:, None, :], out=out, casting="unsafe")
                sums = mark @ one[:, :p + 1]
                if sums[:, p].sum() > runs * n:  # equally near centres: the first takes the point
                    out *= np.cumsum(out, axis=1) == 1
                    sums = mark @ one[:, :p + 1]
                total[a:e, :p + 1] += sums
                if cost:
                    total[a:e, p + 1] += np.einsum("kr,kr->k", mark, d)
    return total


def _draws(blocks, stack: np.ndarray, at: np.ndarray, salts: np.ndarray) -> dict:
    """Per run (place in ``at``) the largest key ``log(u) / D2`` and its point; a run without a point off its centres is left out.

    ``at`` and ``salts`` as in ``_stacked`` and ``_uniform``; a run without centres draws all points alike.  The distances of
    a chunk to the centres of all runs stay in the processor's cache."""
    best, squares, runs = {}, (stack * stack).sum(1)[:, None], np.arange(len(salts))
    for ids, points in blocks:
        for lo in range(0, len(points), CHUNK):
            x = points[lo:lo + CHUNK]
            d2 = np.ones((len(salts), len(x)))
            if len(stack):
                d = (-2.0 * stack) @ x.T
                d += (x * x).sum(1)[None, :]
                d += squares
                for j in runs:
                    if at[j + 1] > at[j]:
                        np.minimum.reduce(d[at[j]:at[j + 1]], axis=0, out=d2[j])
            draw = _uniform(ids[lo:lo + CHUNK], salts)
            np.log(draw, out=draw)
            with np.errstate(divide="ignore", invalid="ignore"):
                draw /= d2
            draw[~(d2 > 0)] = -np.inf
            i = draw.argmax(1)
            for j, key in zip(runs, draw[runs, i]):
                if np.isfinite(key) and (j not in best or key > best[j][0]):
                    best[j] = (float(key), x[i[j]])
    return best


def _merged(parts: DataFrame, tasks: int, keys, *sums) -> DataFrame:
    """The partial rows of all tasks, one per key and task, brought together: ``tasks`` buckets of them.

    They are few, so the session's number of shuffle partitions (a file each per task and pass) isn't asked for them."""
    return parts.repartition(tasks, *keys).groupBy(*keys).agg(*sums)


def _table(rows, names, whole: int) -> pa.RecordBatch:
    """Rows as an Arrow batch: the first ``whole`` columns whole numbers (int; long for ``n``), the others doubles."""
    kinds = [pa.int64() if c == "n" else pa.int32() if i < whole else pa.float64() for i, c in enumerate(names)]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, kind.to_pandas_dtype()), kind) for c, kind in zip(columns, kinds)], names)


def _pieces(it):
    """(ids, points) of at most ROWS rows from the batches of a task."""
    for pdf in it:
        ids, x = pdf["id"].to_numpy(), pdf.drop(columns="id").to_numpy(dtype=float)
        for lo in range(0, len(x), ROWS):
            yield ids[lo:lo + ROWS], x[lo:lo + ROWS]


def fit_many(scaled: DataFrame, runs: list[tuple[int, int]], columns=FEATURES, *, max_iter: int = 300,
             tol: float = TOLERANCE, seed: int = 42, key: str | None = "seller_nickname") -> dict:
    """Fit every run ``(k, restart)``; returns ``{(k, restart): (centres ndarray, inertia)}``.

    Draws depend on the seed, the run, the step and the row's ``key`` only."""
    cols = list(columns)
    p = len(cols)
    data, mean, n, variances = _points(scaled, cols, key)
    tasks = scaled.sparkSession.sparkContext.defaultParallelism
    try:
        if n == 0:
            raise ValueError("no rows to cluster")
        tol_abs = tol * float(np.mean(variances))
        ks = [k for k, _ in runs]
        centres = [np.zeros((0, p)) for _ in runs]

        # ---- k-means++ init, all runs per pass ----
        cand_schema = "run int, key double, " + ", ".join(f"x{i} double" for i in range(p))
        for step in range(max(ks)):
            active = [r for r in range(len(runs)) if centres[r].shape[0] < ks[r]]
            if not active:
                break

            def pick(it, stack=_stacked({r: centres[r] for r in active}), salts=np.array([_salt(seed, r, step) for r in active])):
                names, c, at = stack
                rows = [(names[j], key, *x.tolist()) for j, (key, x) in _draws(_blocks(it, p), c, at, salts).items()]
                yield _table(rows, ["run", "key"] + [f"x{i}" for i in range(p)], 1)

            cands = _merged(data.mapInArrow(pick, cand_schema), tasks, ["run"],
                            F.max_by(F.struct(*[f"x{i}" for i in range(p)]), F.struct("key", *[f"x{i}" for i in range(p)])).alias("c")).collect()
            got = {row["run"]: np.array([row["c"][f"x{i}"] for i in range(p)]) for row in cands}
            for r in active:
                if r in got:
                    centres[r] = np.vstack([centres[r], got[r][None, :]])
                else:  # fewer distinct points than k: repeat the last centre
                    centres[r] = np.vstack([centres[r], centres[r][-1:]]) if centres[r].shape[0] else np.zeros((1, p))

        # ---- Lloyd iterations, all unconverged runs per pass ----
        part_schema = "run int, cluster int, n long, sse double, " + ", ".join(f"s{i} double" for i in range(p))

        def partial_fn(stack, cost):
            def f(it):
                names, c, at = stack
                total = _lloyd_sums(_blocks(it, p), c, at, cost)
                rows = [(r, i - at[j], int(total[i, p]), total[i, p + 1], *total[i, :p])
                        for j, r in enumerate(names) for i in range(at[j], at[j + 1])]
                yield _table(rows, ["run", "cluster", "n", "sse"] + [f"s{i}" for i in range(p)], 3)
            return f

        def run_pass(snap_c, cost=False):
            agg = _merged(data.mapInArrow(partial_fn(_stacked(snap_c), cost), part_schema), tasks, ["run", "cluster"],
                          F.sum("n").alias("n"), F.sum("sse").alias("sse"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)]).collect()
            out = {}
            for row in agg:
                out.setdefault(row["run"], {})[row["cluster"]] = (row["n"], row["sse"], np.array([row[f"s{i}"] for i in range(p)]))
            return out

        converged = set()
        for _ in range(max_iter):
            active = {r: centres[r] for r in range(len(runs)) if r not in converged}
            if not active:
                break
            res = run_pass(active)
            for r, c in active.items():
                new = c.copy()
                for j, (cnt, _, s) in res.get(r, {}).items():
                    if cnt > 0:
                        new[j] = s / cnt
                shift = float(((new - c) ** 2).sum())
                centres[r] = new
                if shift <= tol_abs:
                    converged.add(r)
        final = run_pass({r: centres[r] for r in range(len(runs))}, cost=True)
        return {runs[r]: (centres[r] + mean, float(sum(v[1] for v in final.get(r, {}).values()))) for r in range(len(runs))}
    finally:
        data.unpersist()


def best_of(fits: dict, k: int):
    """Lowest-inertia run for ``k``: (centres, inertia)."""
    cands = [(v[1], key[1], v[0]) for key, v in fits.items() if key[0] == k]
    inertia, _, centres = min(cands, key=lambda t: (t[0], t[1]))
    return centres, inertia


def quality_many(scaled: DataFrame, centres_by_k: dict, columns=FEATURES) -> list[tuple]:
    """Silhouette (squared Euclidean), Davies-Bouldin, Calinski-Harabasz and inertia
    for several labelings (one per k, points labelled by nearest centre) in two passes.

    Pass 1 collects per (k, cluster) counts, vector sums, squared-norm sums and
    the SSE to the fitted centre; pass 2 uses those k-row summaries to add each
    point's silhouette, its distance to its cluster mean and its squared
    distance to that mean.  Returns ``[(k, silhouette, db, ch, inertia)]``."""
    cols = list(columns)
    p = len(cols)
    data, mean, n_total, _ = _points(scaled, cols, None)
    centres_by_k = {k: np.asarray(c) - mean for k, c in centres_by_k.items()}
    ks = sorted(centres_by_k)
    try:
        schema1 = "k int, cluster int, n long, q double, sse double, " + ", ".join(f"s{i} double" for i in range(p))

        def pass1(it):
            acc = {}
            for _, x in _blocks(it, p):
                nx = (x * x).sum(1)
                for k in ks:
                    c = centres_by_k[k]
                    lab, d2 = _assign(x, c)
                    m = c.shape[0]
                    part = (np.bincount(lab, minlength=m), np.bincount(lab, weights=nx, minlength=m),
                            np.bincount(lab, weights=d2, minlength=m), _sums(lab, x, m))
                    acc[k] = part if k not in acc else tuple(a + b for a, b in zip(acc[k], part))
            rows = [(k, j, int(a[0][j]), float(a[1][j]), float(a[2][j]), *a[3][j].tolist())
                    for k, a in acc.items() for j in range(a[0].shape[0])]
            yield _table(rows, ["k", "cluster", "n", "q", "sse"] + [f"s{i}" for i in range(p)], 3)

        st = (data.mapInArrow(pass1, schema1).groupBy("k", "cluster")
                  .agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("sse").alias("sse"),
                       *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)]).collect())
        stats = {}
        for r in st:
            stats.setdefault(r["k"], {})[r["cluster"]] = (r["n"], r["q"], r["sse"], np.array([r[f"s{i}"] for i in range(p)]))
        summ = {}
        for k in ks:
            m = centres_by_k[k].shape[0]
            n = np.array([stats.get(k, {}).get(j, (0, 0.0, 0.0, np.zeros(p)))[0] for j in range(m)], dtype=float)
            q = np.array([stats.get(k, {}).get(j, (0, 0.0, 0.0, np.zeros(p)))[1] for j in range(m)])
            sv = np.vstack([stats.get(k, {}).get(j, (0, 0.0, 0.0, np.zeros(p)))[3] for j in range(m)])
            summ[k] = (n, q, sv)
        schema2 = "k int, cluster int, sil double, dist double, ssw double"

        def pass2(it):
            acc = {}
            for _, x in _blocks(it, p):
                nx = (x * x).sum(1)
                for k in ks:
                    n, q, sv = summ[k]
                    m = n.shape[0]
                    lab, _ = _assign(x, centres_by_k[k])
                    tot = n[None, :] * nx[:, None] - 2.0 * x @ sv.T + q[None, :]
                    rows_i = np.arange(x.shape[0])
                    n_own = n[lab]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        a = np.where(n_own > 1, tot[rows_i, lab] / np.maximum(n_own - 1, 1), 0.0)
                        b_all = np.where(n[None, :] > 0, tot / np.where(n[None, :] > 0, n[None, :], 1), np.inf)
                    b_all[rows_i, lab] = np.inf
                    b = b_all.min(1)
                    den = np.maximum(a, b)
                    sil = np.where((n_own > 1) & (den > 0) & np.isfinite(b), (b - a) / np.where(den > 0, den, 1), 0.0)
                    means = sv / np.where(n > 0, n, 1)[:, None]
                    diff = x - means[lab]
                    d2 = np.maximum((diff * diff).sum(1), 0.0)
                    part = (np.bincount(lab, weights=sil, minlength=m), np.bincount(lab, weights=np.sqrt(d2), minlength=m),
                            np.bincount(lab, weights=d2, minlength=m))
                    acc[k] = part if k not in acc else tuple(u + v for u, v in zip(acc[k], part))
            rows = [(k, j, float(a[0][j]), float(a[1][j]), float(a[2][j])) for k, a in acc.items() for j in range(a[0].shape[0])]
            yield _table(rows, ["k", "cluster", "sil", "dist", "ssw"], 2)

        st2 = (data.mapInArrow(pass2, schema2).groupBy("k", "cluster")
                   .agg(F.sum("sil").alias("sil"), F.sum("dist").alias("dist"), F.sum("ssw").alias("ssw")).collect())
        agg2 = {}
        for r in st2:
            agg2.setdefault(r["k"], {})[r["cluster"]] = (r["sil"], r["dist"], r["ssw"])
        out = []
        for k in ks:
            n, q, sv = summ[k]
            live = [j for j in range(n.shape[0]) if n[j] > 0]
            kk = len(live)
            means = {j: sv[j] / n[j] for j in live}
            sil = sum(agg2[k][j][0] for j in live) / n_total
            spread = {j: agg2[k][j][1] / n[j] for j in live}
            db = None
            if kk > 1:
                tot = 0.0
                for i in live:
                    tot += max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in live if j != i)
                db = tot / kk
            g = sv[live].sum(0) / n_total
            ssb = sum(n[j] * float(((means[j] - g) ** 2).sum()) for j in live)
            ssw = sum(agg2[k][j][2] for j in live)
            ch = (ssb / (kk - 1)) / (ssw / (n_total - kk)) if kk > 1 and ssw > 0 and n_total > kk else None
            inertia = sum(stats[k][j][2] for j in stats[k])
            out.append((int(k), float(sil) if kk > 1 else None, None if db is None else float(db),
                        None if ch is None else float(ch), float(inertia)))
        return out
    finally:
        data.unpersist()
