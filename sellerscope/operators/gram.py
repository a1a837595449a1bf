"""Covariance from centred partials that can be stored and merged.

A partial is one row per key: row count, means and centred cross products
(the upper triangle) of some rows.  Each task makes its partials from Arrow
batches, one matrix product per batch, and merges them as it goes; partials
of any tasks, days or runs merge by the pairwise update, which never
subtracts large sums, so columns far from zero lose no digits.  One scan
gives means and matrix together.  Rows with a NULL or NaN in any of the
columns count as ``skipped`` and take no part.  An empty table gives no partial.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a task holds at a time; beyond that it hands its partials on and starts afresh.
KEYS_HELD = 4096
#: Groups that the first merge deals the partials of one key to.
FANOUT = 64

VALUES = [T.StructField("n", T.LongType()), T.StructField("skipped", T.LongType()),
          T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("products", T.ArrayType(T.DoubleType()))]


def _merge(a, b):
    """The partial of the rows of both; a partial is (n, skipped, means, products as a square matrix)."""
    if not a[0] or not b[0]:
        full = a if a[0] else b
        return full[0], a[1] + b[1], full[2], full[3]
    n, step = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + step * (b[0] / n), a[3] + b[3] + np.outer(step, step) * (a[0] * b[0] / n)


def _of_block(x):
    good = x[~np.isnan(x).any(axis=1)]
    mean = good.mean(axis=0) if len(good) else np.zeros(x.shape[1])
    centred = good - mean
    return len(good), len(x) - len(good), mean, centred.T @ centred


def _square(flat, p):
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = flat
    return m + np.triu(m, 1).T


def _batch(held, types, p):
    upper = np.triu_indices(p)
    rows = list(held.items())
    columns = [pa.array([key[i] for key, _ in rows], type=t) for i, t in enumerate(types)]
    columns += [pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64()),
                pa.array([v[2].tolist() for _, v in rows], pa.list_(pa.float64())),
                pa.array([v[3][upper].tolist() for _, v in rows], pa.list_(pa.float64()))]
    return columns


def gram_partials(df: DataFrame, columns, by=()) -> DataFrame:
    """``(*by, n, skipped, means, products)``: partials of each task, per value of the ``by`` columns (NULL is a value).  Map-only."""
    columns, by, p = list(columns), list(by), len(columns)
    d = df.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    schema = T.StructType([d.schema[c] for c in by] + VALUES)
    names = [f.name for f in schema.fields]

    def partials(batches):
        held = {}
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(i).type for i in range(len(by))]
            x = np.column_stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False).astype("f8") for i in range(p)])
            keys = pa.Table.from_batches([batch]).select(range(len(by))).append_column(
                "_row", pa.array(np.arange(batch.num_rows))) if by else None
            if by:
                groups = keys.group_by(names[:len(by)]).aggregate([("_row", "list")])
                parts = zip(zip(*[groups.column(c).to_pylist() for c in names[:len(by)]]), groups.column("_row_list").to_pylist())
            else:
                parts = [((), slice(None))]
            for key, rows in parts:
                new = _of_block(x[rows])
                held[key] = _merge(held[key], new) if key in held else new
                if len(held) >= KEYS_HELD:
                    yield pa.RecordBatch.from_arrays(_batch(held, types, p), names)
                    held = {}
        if held:
            yield pa.RecordBatch.from_arrays(_batch(held, types, p), names)

    return d.mapInArrow(partials, schema)


def merge_partials(partials: DataFrame, by=()) -> DataFrame:
    """One partial per value of ``by`` (one in all without): in ``FANOUT`` groups a key first, then their results."""
    by = list(by)
    schema = T.StructType([partials.schema[c] for c in by] + VALUES)
    names = [f.name for f in schema.fields]

    def merged(table):
        whole = None
        for n, skipped, means, products in zip(*[table.column(c).to_pylist() for c in names[len(by):]]):
            part = n, skipped, np.array(means), _square(products, len(means))
            whole = part if whole is None else _merge(whole, part)
        columns = _batch({tuple(table.column(c)[0].as_py() for c in by): whole}, [table.schema.field(c).type for c in by], len(whole[2]))
        return pa.Table.from_arrays(columns, names)

    # the group is a hash of the partial itself, so a task that runs again deals its rows alike
    dealt = partials.select(*by, *names[len(by):]).withColumn("_deal", F.pmod(F.xxhash64("n", "means", "products"), F.lit(FANOUT)))
    first = dealt.groupBy(*by, "_deal").applyInArrow(merged, schema)
    return first.groupBy(*by).applyInArrow(merged, schema)


def covariance_from_partials(merged: DataFrame, columns, by=()) -> DataFrame:
    """Long sample covariance ``(*by, col_x, col_y, x_position, y_position, covariance, n)`` of merged partials; NULL below two rows."""
    columns, p = list(columns), len(columns)
    place = {pair: i for i, pair in enumerate(zip(*[ix.tolist() for ix in np.triu_indices(p)]))}
    cells = [F.struct(F.lit(columns[i]).alias("col_x"), F.lit(columns[j]).alias("col_y"), F.lit(i).alias("x_position"),
                      F.lit(j).alias("y_position"),
                      F.try_divide(F.col("products")[place[min(i, j), max(i, j)]], F.col("n") - 1).alias("covariance"))
             for i in range(p) for j in range(p)]
    return merged.select(*by, "n", F.inline(F.array(*cells)))


def means_and_covariance(df: DataFrame, columns):
    """``(n, means, covariance)`` as numpy from one scan; only the one merged partial reaches the driver."""
    p = len(columns)
    row = merge_partials(gram_partials(df, columns)).first()
    if row is None or not row["n"]:
        return 0, np.zeros(p), np.zeros((p, p))
    products = _square(row["products"], p)
    return row["n"], np.array(row["means"]), products / (row["n"] - 1) if row["n"] > 1 else np.zeros((p, p))
