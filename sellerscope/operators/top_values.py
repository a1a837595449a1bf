"""Exact top values of every column without moving the column's texts.

``profile.top_values`` shuffles each distinct text.  Here only 64-bit digests
are shuffled: a digest occurs at least as often as any of its texts, so the
``n`` most frequent digests bound what can be listed.  What is listed comes from

* ``heads``: digests above the n-th count, fewer than ``n`` a column;
* where several digests share the n-th count, all of these while there are at
  most ``most_tied``; else, if no digest has a lower count (a unique column),
  the least texts outside the heads, of which each task sends at most ``n``.

The texts of those digests are then counted exactly, after partial counts in the
tasks.  If each digest has one text, no other text can enter: its count is
at most that of its digest, and of equal counts the least texts are known.
Columns where two texts share a wanted digest, or where too many digests tie in
the middle, take the plain way.  NULL is a value (last of equal counts), the
empty text too; very long texts move only if listed; an empty table lists nothing.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import profile as pr

MOST_TIED = 4096
SCHEMA = "column_name string, value string, freq bigint, rank int"


def digest(text):
    return F.when(text.isNotNull(), F.xxhash64(text))


def _long(df, columns, *, values):
    """``(c, h[, value])``: a row per fact row and column; ``c`` is the column's place in ``columns``."""
    cells = []
    for i, c in columns:
        text = pr.as_text(df, c)
        cells.append(F.struct(F.lit(i).alias("c"), digest(text).alias("h"), *([text.alias("value")] if values else [])))
    return df.select(F.inline(F.array(*cells)))


def _least(df, columns, heads, n):
    """The ``n`` least texts of each column outside its heads, as ``(c, h, value)``; a task sends at most ``n`` a column."""
    known = {i: {h for h in heads[i] if h is not None} for i, _ in columns}
    cells = []
    for i, c in columns:
        text = pr.as_text(df, c)
        cells.append((F.when(~digest(text).isin(list(known[i])), text) if known[i] else text).alias(f"c{i}"))
    names = [i for i, _ in columns]

    def smallest(batches):
        kept = {i: pa.array([], pa.string()) for i in names}
        for batch in batches:
            for place, i in enumerate(names):
                both = pa.concat_arrays([kept[i], pc.drop_null(batch.column(place).cast(pa.string()))])
                seen = pc.unique(both)
                kept[i] = seen.take(pc.array_sort_indices(seen)[:n])
        yield pa.RecordBatch.from_arrays([pa.array([i for i in names for _ in range(len(kept[i]))], pa.int32()),
                                          pa.concat_arrays([kept[i] for i in names])], ["c", "value"])

    found = df.select(*cells).mapInArrow(smallest, "c int, value string").distinct()
    order = Window.partitionBy("c").orderBy("value")
    return (found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
            .select("c", digest(F.col("value")).alias("h"), "value"))


def top_values_by_digest(df: DataFrame, n: int = 10, columns=None, most_tied: int = MOST_TIED) -> DataFrame:
    """``(column_name, value, freq, rank)`` as ``profile.top_values`` gives them; runs its jobs when called.

    At most ``n`` rows a column and what they are drawn from (``n + most_tied`` digests a column) reach the driver."""
    names = list(df.columns) if columns is None else list(columns)
    spark, indexed = df.sparkSession, list(enumerate(names))
    counts = _long(df, indexed, values=False).groupBy("c", "h").agg(F.count(F.lit(1)).alias("freq")).persist(StorageLevel.MEMORY_AND_DISK)
    order = Window.partitionBy("c").orderBy(F.desc("freq"), "h")
    first = {i: [] for i, _ in indexed}
    for r in counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).collect():
        first[r.c].append((r.freq, r.h))
    nth = {i: min(f for f, _ in found) if len(found) == n else 0 for i, found in first.items()}
    heads = {i: [h for f, h in found if f > nth[i]] for i, found in first.items()}

    at = F.create_map(*[x for i, t in nth.items() for x in (F.lit(i), F.lit(t).cast("bigint"))]) if nth else F.lit(None)
    level = F.element_at(at, F.col("c"))
    spread = counts.groupBy("c").agg(F.min("freq").alias("lowest"), F.count_if(F.col("freq") == level).alias("tied"))
    listed, unique, plain = [], [], []
    for r in spread.collect():
        (listed if r.tied <= most_tied else unique if r.lowest == nth[r.c] else plain).append(r.c)
    wanted = [(i, h) for i in heads for h in heads[i] if i not in plain]
    if listed:
        wanted += [tuple(r) for r in counts.where(F.col("c").isin(listed) & (F.col("freq") == level)).select("c", "h").collect()]
    if unique:
        wanted += [(r.c, r.h) for r in _least(df, [(i, c) for i, c in indexed if i in unique], heads, n).collect()]
    counts.unpersist()

    rows, left = [], set(plain)
    if wanted:
        keys = F.broadcast(spark.createDataFrame(wanted, "wc int, wh bigint").distinct())
        texts = _long(df, [(i, c) for i, c in indexed if i not in plain], values=True)
        exact = (texts.join(keys, (F.col("c") == F.col("wc")) & F.col("h").eqNullSafe(F.col("wh")), "left_semi")
                 .groupBy("c", "h", "value").agg(F.count(F.lit(1)).alias("freq")))
        shared = exact.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("c", "h")))
        ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("freq"), F.asc_nulls_last("value"))))
        ranked = ranked.withColumn("most", F.max("texts").over(Window.partitionBy("c")))
        for r in ranked.where(F.col("rank") <= n).collect():
            left.update([r.c] if r.most > 1 else [])
            rows.append((r.c, r.value, r.freq, r.rank))
    out = spark.createDataFrame([(names[i], *rest) for i, *rest in rows if i not in left], SCHEMA)
    if left:
        out = out.unionByName(pr.top_values(pr.value_frequency(df, [names[i] for i in sorted(left)]), n))
    return out
