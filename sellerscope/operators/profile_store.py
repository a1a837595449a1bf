"""A column profile that can be continued: mergeable summaries per period and column.

``column_sketches`` scans a table once and gives one row per (period, column):
exact row and NULL counts, least and greatest text, count, mean and centred
square sum of numbers, and three sketches of fixed size: HyperLogLog of the
distinct values' hashes, KLL of the numbers, frequent items of the texts.  The rows of
a period are written once and replace an earlier write of that period, so a
replayed period changes nothing; ``merge_sketches`` profiles any set of
periods without reading the facts.  Facts are pre-aggregated in tasks and only
sketches are shuffled, so neither a unique column nor a hot value or period
moves more than one row per task.

Stated errors (at ``lg_k`` 12, ``kll_k`` 400, ``tracked`` 1024): distinct
values 3 x 1.04 / sqrt(2^lg_k) = 4.9 % (99.7 % of the time); rank of a quantile
0.7 %; count of a top value at most 3.5 x rows / 1024 (0.34 % of the rows), and
values above that share are all found.  Columns with fewer than 768 distinct
values have exact top counts.  NULL is one of the top values (as in
``profile.top_values``) and enters no other sketch; the empty text is a value;
NaN counts as text but is no number.  A text of more than 512 code points is
listed among the top values by its first 448, a tilde and its SHA-256, so that a
sketch stays small.  An empty table gives no period and no column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import as_text, numeric_columns

LG_K, KLL_K, TRACKED = 12, 400, 1024
LONGEST, SHOWN = 512, 448


def listed(text):
    """The form of a text in the sketch of top values."""
    return F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, SHOWN), F.lit("~"), F.sha2(text, 256))).otherwise(text)


def column_sketches(df: DataFrame, period: str, columns=None, lg_k: int = LG_K, kll_k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """``(period, column_name, rows, nulls, least, greatest, n, mean, m2, distinct_sketch, quantile_sketch, top_sketch)``."""
    columns = [c for c in df.columns if c != period] if columns is None else list(columns)
    numbers = set(numeric_columns(df, columns))
    facts = df.select(F.col(period).alias("_period"), *[as_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)],
                      *[listed(as_text(df, c)).alias(f"v{i}") for i, c in enumerate(columns)],
                      *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                        for i, c in enumerate(columns) if c in numbers])
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        text, x = F.col(f"t{i}"), F.col(f"x{i}")
        aggregates += [F.count(text).alias(f"filled{i}"), F.min(text).alias(f"least{i}"), F.max(text).alias(f"greatest{i}"),
                       F.hll_sketch_agg(F.when(text.isNotNull(), F.xxhash64(text)), F.lit(lg_k)).alias(f"distinct{i}"),
                       F.expr(f"approx_top_k_accumulate(v{i}, {int(tracked)})").alias(f"top{i}")]
        number = (F.lit(0).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("binary"))
        if c in numbers:
            aggregates += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"),
                           F.kll_sketch_agg_double(x, F.lit(kll_k)).alias(f"quantile{i}")]
            number = (F.col(f"n{i}"), F.col(f"mean{i}"), F.col(f"var{i}") * F.col(f"n{i}"), F.col(f"quantile{i}"))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"filled{i}")).alias("nulls"),
                             F.col(f"least{i}").alias("least"), F.col(f"greatest{i}").alias("greatest"), number[0].alias("n"),
                             number[1].alias("mean"), number[2].alias("m2"), F.col(f"distinct{i}").alias("distinct_sketch"),
                             number[3].alias("quantile_sketch"), F.col(f"top{i}").alias("top_sketch")))
    return facts.groupBy("_period").agg(*aggregates).select(F.col("_period").alias("period"), F.inline(F.array(*rows)))


def merge_sketches(store: DataFrame, by=("column_name",)) -> DataFrame:
    """The stored rows of any periods as one row per column (or per ``by``), of the same shape and so mergeable again.

    Means and square sums merge around the mean of all, found in a first pass over the store, so nothing cancels."""
    by = list(by)
    whole = store.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    joined = store.join(whole.select(*[F.col(c).alias(f"_{c}") for c in by], "_mean"),
                        [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    apart = F.col("mean") - F.col("_mean")
    return joined.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr("approx_top_k_combine(top_sketch)").alias("top_sketch"))


def exact_part(merged: DataFrame, by=("column_name",)) -> DataFrame:
    """What the store holds exactly: counts, least and greatest text, mean and standard deviation."""
    return merged.select(*by, "rows", "nulls", "least", "greatest", F.col("n").alias("numbers"), "mean",
                         F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)).alias("stddev"))


def estimates(merged: DataFrame, by=("column_name",), points=(0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """Distinct values, quantiles (NULL for texts) and the ``top`` values with their counts, within the stated errors."""
    sketch = F.col("quantile_sketch")
    number = F.col("n") > 0
    return merged.select(*by, "rows", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
                         *[F.when(number, F.kll_sketch_get_quantile_double(sketch, F.lit(p))).alias(f"q{round(100 * p)}") for p in points],
                         F.expr(f"approx_top_k_estimate(top_sketch, {int(top)})").alias("top_estimate"))
