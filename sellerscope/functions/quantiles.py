"""Exact quantiles (linear interpolation, like ``quantile_cont`` / numpy) computed
without ever holding a whole group in one task.

Spark's ``percentile``/``median`` aggregate keeps every distinct value of a
group in one buffer, and the final merge of a global aggregate runs in one
task.  On a 100 TB table that is the whole column in one task.  This module
does a distributed selection instead:

1. per (group, column): ``count`` and a grid of ``percentile_approx`` values
   (a mergeable sketch of bounded size, ``G+1`` grid points);
2. the target ranks ``floor(h)`` and ``ceil(h)`` with ``h = p (n-1)`` are
   bracketed by two grid values ``[lo, hi]``; rows below ``lo`` are counted,
   rows inside the bracket are kept.  The bracket is *verified* by counting, so
   correctness never depends on the sketch's error bound;
3. while a bracket still holds more than ``max_bracket`` rows, the grid is
   recomputed over the bracket rows only (each round shrinks it ~G/3 times);
   where the sketch can't shrink it, the bracket is halved between its bounds,
   so every round makes progress until it fits or holds one value only;
4. the bracket rows are reduced to (value, count) and a running count inside
   each (group, column, p) bracket picks the two order statistics; a bracket of
   one value is one such row.

Every pass is a partial-aggregated shuffle; the only per-group work in one task
is the final bracket, bounded by ``max_bracket`` rows.  Only one row of sizes
reaches the driver per round.

Fact rows never move to meet the brackets of their group: up to ``SMALL`` brackets
are broadcast (their number is checked first); of more, those of groups with more
than one in ``HOT`` of all values are (fewer than ``HOT`` groups a column can be),
and only the rows of the other, small groups are dealt out by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

GRID = 200             # grid intervals per refinement round
ACCURACY = 20000       # percentile_approx accuracy (>> GRID so the grid is well resolved)
MAX_BRACKET = 200_000  # rows of different values a final bracket may hold
SMALL = 10_000         # brackets that are broadcast without looking at their groups' sizes
HOT = 1000             # a group with more than one in HOT of all values is hot


def _long(df: DataFrame, columns, by) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    return (df.select(*by, F.inline(F.array(*parts)))
              .where(F.col("v").isNotNull() & ~F.isnan("v")))


def exact_quantiles(df: DataFrame, columns, probs, by=(), *, grid: int = GRID,
                    accuracy: int = ACCURACY, max_bracket: int = MAX_BRACKET, small: int = SMALL) -> DataFrame:
    """Long table ``(*by, column, p, quantile)`` of exact linear-interpolated quantiles.

    NULL and NaN inputs are ignored (pandas / SQL semantics); a group with no
    value yields a NULL quantile.
    """
    by = list(by)
    columns = list(columns)
    probs = [float(p) for p in probs]
    keys = by + ["column"]
    long = _long(df, columns, by)

    # Per key: n, then per p the target ranks (0-based) and interpolation weight.
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    targets = (counts
               .select(*keys, "n", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
               .withColumn("h", F.col("p") * (F.col("n") - 1))
               .withColumn("r1", F.floor("h"))
               .withColumn("r2", F.ceil("h")))
    tkeys = keys + ["p"]

    # state: bracket [lo, hi] (inclusive, NULL = unbounded), rows strictly below
    # lo ("below") and rows inside ("inside").
    state = targets.select(*tkeys, "n", "h", "r1", "r2",
                           F.lit(None).cast("double").alias("lo"),
                           F.lit(None).cast("double").alias("hi"),
                           F.lit(0).cast("bigint").alias("below"),
                           F.col("n").alias("inside"),
                           F.lit(None).cast("double").alias("a1"),   # the two order statistics, once known
                           F.lit(None).cast("double").alias("a2"),
                           F.lit(True).alias("open"))
    # the state table has one row per (group, column, p)
    state = state.cache()
    size = state.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values")).first()
    hot = None if size["rows"] <= small else max(1, int(size["values"]) // (len(probs) * HOT))

    grid_probs = [i / grid for i in range(grid + 1)]
    while True:
        todo = state.where(F.col("open") & (F.col("inside") > max_bracket))
        if todo.isEmpty():
            break
        # targets with one bracket (all of a key at first) share its sketch: that of the least p
        todo = todo.withColumn("at", F.min("p").over(Window.partitionBy(*keys, "lo", "hi"))).cache()
        akeys = keys + ["at"]
        rows = _in_bracket(long, todo.where(F.col("p") == F.col("at")), keys, akeys, hot=hot)
        g = (rows.groupBy(*akeys)
                 .agg(F.percentile_approx("v", grid_probs, accuracy).alias("grid")))
        # relative ranks of the two targets inside the bracket, mapped to grid cells
        cand = (_join(todo, g, akeys).drop("at")
                    .withColumn("i_lo", F.greatest(F.floor((F.col("r1") - F.col("below")) / F.col("inside") * grid) - 1, F.lit(0)))
                    .withColumn("i_hi", F.least(F.ceil((F.col("r2") - F.col("below") + 1) / F.col("inside") * grid) + 1, F.lit(grid)))
                    .withColumn("g_lo", F.element_at("grid", (F.col("i_lo") + 1).cast("int")))
                    .withColumn("g_hi", F.element_at("grid", (F.col("i_hi") + 1).cast("int")))
                    .withColumn("v_lo", F.element_at("grid", 1)).withColumn("v_hi", F.element_at("grid", -1))
                    .withColumn("mid", F.when(F.col("v_lo") < F.col("v_hi"), F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) / 2)
                                .otherwise(F.coalesce(F.col("lo") + (F.col("hi") - F.col("lo")) / 2, "v_lo")))
                    .drop("grid").cache())  # read by the count and by the update: the sketches are made once
        # one count inside the old bracket: of the grid's bracket, and of the halves below and above the middle
        extra, v = ["g_lo", "g_hi", "mid"], F.col("v")
        chk = (_in_bracket(long, cand.select(*tkeys, "n", "lo", "hi", *extra), keys, tkeys, extra=extra, hot=hot)
               .groupBy(*tkeys)
               .agg(F.count_if(v < F.col("g_lo")).alias("g_below"), F.count_if((v >= F.col("g_lo")) & (v <= F.col("g_hi"))).alias("g_inside"),
                    F.count_if(v <= F.col("mid")).alias("m_low"), F.min("v").alias("least"), F.max("v").alias("most"),
                    F.max(F.when(v <= F.col("mid"), v)).alias("low_end"), F.min(F.when(v > F.col("mid"), v)).alias("high_end")))
        below, inside = F.col("below"), F.col("inside")
        ok = ((below + F.col("g_below") <= F.col("r1")) & (F.col("r2") < below + F.col("g_below") + F.col("g_inside")) & (F.col("g_inside") < inside))
        one = F.col("least") == F.col("most")
        lower = F.col("r2") < below + F.col("m_low")       # both targets in the lower half
        upper = F.col("r1") >= below + F.col("m_low")      # both in the upper half; else they are the values next to the middle
        pick = lambda g, lo, up: F.when(ok, g).when(one, F.lit(None)).when(lower, lo).when(upper, up)
        known = lambda both: F.when(ok, F.lit(None)).when(one, F.col("least")).when(lower | upper, F.lit(None)).otherwise(both)
        upd = _join(cand, chk, tkeys, "left").select(
            *tkeys, pick(F.col("g_lo"), F.col("least"), F.col("high_end")).alias("lo2"), pick(F.col("g_hi"), F.col("low_end"), F.col("most")).alias("hi2"),
            F.coalesce(pick(below + F.col("g_below"), below, below + F.col("m_low")), below).alias("below2"),
            F.coalesce(pick(F.col("g_inside"), F.col("m_low"), inside - F.col("m_low")), F.lit(0)).alias("inside2"),
            known(F.col("low_end")).alias("k1"), known(F.col("high_end")).alias("k2"), inside.alias("was"))
        new_state = (_join(state, upd, tkeys, "left")
                          .select(*tkeys, "n", "h", "r1", "r2",
                                  F.coalesce("lo2", "lo").alias("lo"),
                                  F.coalesce("hi2", "hi").alias("hi"),
                                  F.coalesce("below2", "below").alias("below"),
                                  F.coalesce("inside2", "inside").alias("inside"),
                                  F.coalesce("a1", "k1").alias("a1"), F.coalesce("a2", "k2").alias("a2"),
                                  # a bracket that can't shrink holds two neighbouring doubles: two rows of (value, count)
                                  F.coalesce(F.col("inside2") < F.col("was"), F.col("open")).alias("open")))
        ensure_checkpoint_dir(df.sparkSession)
        new_state = new_state.checkpoint()  # so that plans don't grow from round to round
        for done in (state, todo, cand):
            done.unpersist()
        state = new_state

    # final: order statistics inside each bracket
    rows = _in_bracket(long, state.where(F.col("a1").isNull()), keys, tkeys, extra=["below", "r1", "r2", "h"], hot=hot)
    vc = rows.groupBy(*tkeys, "below", "r1", "r2", "h", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*tkeys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vc = vc.withColumn("cum", F.col("below") + F.sum("c").over(w))
    picked = (vc.groupBy(*tkeys, "h", "r1")
                .agg(F.min(F.when(F.col("cum") > F.col("r1"), F.col("v"))).alias("v1"),
                     F.min(F.when(F.col("cum") > F.col("r2"), F.col("v"))).alias("v2")))
    picked = picked.unionByName(state.where(F.col("a1").isNotNull()).select(*tkeys, "h", "r1", F.col("a1").alias("v1"), F.col("a2").alias("v2")))
    res = picked.select(*tkeys, (F.col("v1") + (F.col("h") - F.col("r1")) * (F.col("v2") - F.col("v1"))).alias("quantile"))
    # every requested key, also those whose values are all NULL (-> NULL quantile)
    spark = df.sparkSession
    params = spark.createDataFrame([(c, p) for c in columns for p in probs], "column string, p double")
    if by:
        all_keys = (df.select(*by).distinct()
                      .withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
                      .withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs]))))
    else:
        all_keys = params
    return _join(all_keys, res, tkeys, "left").select(*tkeys, "quantile")


def _join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating NULL = NULL (a NULL group is a group, as in SQL GROUP BY).

    Spark plans ``<=>`` keys as ordinary hash/sort join keys."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = e if cond is None else cond & e
    j = left.join(r, cond, how)
    return j if how == "left_anti" else j.drop(*[f"__r_{k}" for k in keys])


def _in_bracket(long: DataFrame, bounds: DataFrame, keys, tkeys, extra=(), hot: int | None = None) -> DataFrame:
    """The values within the bounds of their key.  ``hot`` None: the bounds are few, checked, and all broadcast; else those of
    keys with more than ``hot`` values are, and the rows of the other keys meet theirs by key."""
    b = bounds.select(*tkeys, "n", "lo", "hi", *extra)
    if hot is None:
        j = _join(long, F.broadcast(b.drop("n")), keys)
    else:
        large, rest = b.where(F.col("n") > hot).drop("n"), b.where(F.col("n") <= hot).drop("n")
        others = _join(long, F.broadcast(large.select(*keys).distinct()), keys, "left_anti")
        j = _join(long, F.broadcast(large), keys).unionByName(_join(others, rest, keys))
    return j.where((F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) &
                   (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))


def quantile_row(df: DataFrame, column: str, probs, names=None) -> DataFrame:
    """One-row DataFrame with one column per probability (e.g. ``p75``)."""
    q = exact_quantiles(df, [column], probs)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    return q.groupBy().agg(*[F.first(F.when(F.col("p") == float(p), F.col("quantile")), ignorenulls=True).alias(nm)
                             for p, nm in zip(probs, names)])
