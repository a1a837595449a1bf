"""Column profiling in one pass.

The central table is the value-frequency table ``vf(column_name, value, freq)``:
every profiled column is cast to string, the row is unpivoted (NULLs kept) and
``groupBy(column_name, value).count()`` runs with map-side partial
aggregation.  A column with one hot value (a third of all rows) therefore
sends one partial row per map task, not its rows.  Distinct counts, NULL
counts, top-N, dominance, entropy and the two-valued check are small
aggregations of ``vf`` (one row per column), so the table is scanned once
instead of once per column and statistic.

Per-column top-N uses ``row_number`` over ``column_name``; Spark plans it as a
``WindowGroupLimit`` that keeps only N rows per column in every partition
*before* the shuffle, so a column with billions of distinct values never sends
them all to one task.  A column whose ``vf`` would be as large as itself (e.g.
a unique URL) can be left out by ``columns`` and summarised by
``approx_column_summary`` instead, without a shuffle of its values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(df: DataFrame, columns=None):
    return list(columns) if columns is not None else list(df.columns)


def as_text(df: DataFrame, c: str):
    """String form of a value as SQL's CAST(... AS VARCHAR) gives it."""
    return F.col(c).cast("string")


def value_frequency(df: DataFrame, columns=None) -> DataFrame:
    cols = _cols(df, columns)
    parts = [F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*parts)))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq"))


def column_types(df: DataFrame, columns=None) -> DataFrame:
    """``(column_name, column_position, column_type, nullable)`` from the schema (driver-side metadata)."""
    cols = _cols(df, columns)
    fields = {f.name: f for f in df.schema.fields}
    rows = [(c, i, fields[c].dataType.simpleString(), bool(fields[c].nullable)) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, column_position int, column_type string, nullable boolean")


def table_dimensions(df: DataFrame) -> DataFrame:
    return df.select(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def type_counts(df: DataFrame, columns=None) -> DataFrame:
    return column_types(df, columns).groupBy("column_type").agg(F.count(F.lit(1)).alias("n_columns"))


def column_summary(vf: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``(column_name, total_rows, distinct_values, null_count)``; distinct excludes NULL.

    With ``types`` (one row per column) an empty table gives a row of zeros per column, not no rows."""
    out = vf.groupBy("column_name").agg(
        F.sum("freq").alias("total_rows"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("freq"))), F.lit(0)).cast("bigint").alias("null_count"))
    if types is None:
        return out
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return types.select("column_name").join(out, "column_name", "left").select(
        "column_name", zero("total_rows"), zero("distinct_values"), zero("null_count"))


def approx_column_summary(df: DataFrame, columns=None, rsd: float = 0.05) -> DataFrame:
    """Same shape as ``column_summary`` with HyperLogLog distinct counts (no vf shuffle)."""
    cols = _cols(df, columns)
    aggs = []
    for c in cols:
        aggs += [F.approx_count_distinct(c, rsd).alias(f"d__{c}"), F.count_if(F.col(c).isNull()).alias(f"n__{c}")]
    row = df.agg(F.count(F.lit(1)).alias("__total"), *aggs)
    parts = [F.struct(F.lit(c).alias("column_name"), F.col("__total").alias("total_rows"),
                      F.col(f"d__{c}").alias("distinct_values"), F.col(f"n__{c}").cast("bigint").alias("null_count"))
             for c in cols]
    return row.select(F.inline(F.array(*parts)))


def null_fraction(summary: DataFrame, percent: bool = False) -> DataFrame:
    """NULL share as a 0-1 fraction, or (``percent=True``) as 0-100 sorted descending."""
    frac = F.try_divide(F.col("null_count").cast("double"), F.col("total_rows").cast("double"))
    if percent:
        return summary.select("column_name", (frac * 100).alias("null_percent")).orderBy(F.desc("null_percent"))
    return summary.select("column_name", frac.alias("null_fraction"))


def constant_columns(summary: DataFrame, max_distinct: int | None = None) -> DataFrame:
    """Columns with exactly one distinct non-NULL value, or with at most
    ``max_distinct`` (then an all-NULL column qualifies too)."""
    cond = (F.col("distinct_values") == 1) if max_distinct is None else (F.col("distinct_values") <= max_distinct)
    return summary.where(cond).select("column_name", "distinct_values")


def numeric_columns(df: DataFrame, columns=None):
    fields = {f.name: f for f in df.schema.fields}
    return [c for c in _cols(df, columns) if isinstance(fields[c].dataType, T.NumericType)]


def numeric_stats(df: DataFrame, columns=None) -> DataFrame | None:
    """Long ``(column_name, min_value, max_value, mean_value, stddev_value)`` for numeric columns, one scan."""
    cols = numeric_columns(df, columns)
    if not cols:
        return None
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn__{c}"), F.max(x).alias(f"mx__{c}"), F.avg(x).alias(f"av__{c}"),
                 F.stddev_samp(x).alias(f"sd__{c}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"mn__{c}").alias("min_value"),
                      F.col(f"mx__{c}").alias("max_value"), F.col(f"av__{c}").alias("mean_value"),
                      F.col(f"sd__{c}").alias("stddev_value")) for c in cols]
    return row.select(F.inline(F.array(*parts)))


def numeric_whiskers(stats: DataFrame) -> DataFrame:
    """Mean +- one standard deviation per numeric column, ordered by mean descending."""
    return stats.select("column_name", "min_value", "max_value", "mean_value",
                        (F.col("mean_value") - F.col("stddev_value")).alias("mean_minus_std"),
                        (F.col("mean_value") + F.col("stddev_value")).alias("mean_plus_std")).orderBy(F.desc("mean_value"))


def top_values(vf: DataFrame, n: int = 10, columns=None) -> DataFrame:
    """Top-``n`` values per column by frequency (ties: value ascending, NULL last)."""
    v = vf if columns is None else vf.where(F.col("column_name").isin(list(columns)))
    w = Window.partitionBy("column_name").orderBy(F.desc("freq"), F.asc_nulls_last("value"))
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def categorical_columns(df: DataFrame, columns=None):
    fields = {f.name: f for f in df.schema.fields}
    return [c for c in _cols(df, columns) if not isinstance(fields[c].dataType, T.NumericType)]


def dominant_columns(vf: DataFrame, row_count, threshold: float = 0.95) -> DataFrame:
    """Columns whose most frequent value (NULL included) covers >= ``threshold`` of the rows."""
    share = F.max("freq") / row_count
    return (vf.groupBy("column_name").agg(share.alias("share"))
              .where(F.col("share") >= threshold)
              .select("column_name", F.round("share", 3).alias("dominance")))


def column_entropy(vf: DataFrame, row_count) -> DataFrame:
    """Shannon entropy in bits, ``-sum p log2(p + 1e-9)``, NULL counted as a value."""
    p = F.col("freq") / row_count
    return vf.groupBy("column_name").agg(F.round(-F.sum(p * F.log2(p + F.lit(1e-9))), 3).alias("entropy"))


def two_valued_columns(vf: DataFrame) -> DataFrame:
    """Columns with one or two distinct values counting NULL as a value."""
    g = vf.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("lo"),
                                      F.max("value").alias("hi"),
                                      F.max(F.col("value").isNull()).alias("includes_null"))
    return (g.where(F.col("n_values").between(1, 2))
             .select("column_name", "n_values",
                     F.col("lo").alias("first_value"), F.when(F.col("hi") != F.col("lo"), F.col("hi")).alias("second_value"),
                     "includes_null"))


# The text forms accepted as dates (regex gate + strict parse).
DATE_FORMATS = [
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss"),
]


def parses_as_date(c: str):
    conds = [F.col(c).rlike(rx) & F.try_to_timestamp(F.col(c), F.lit(fmt)).isNotNull() for rx, fmt in DATE_FORMATS]
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def partial_date_columns(df: DataFrame, columns=None) -> DataFrame:
    """Text columns where some but not all non-NULL values parse as dates (full scan)."""
    fields = {f.name: f for f in df.schema.fields}
    cols = [c for c in _cols(df, columns) if isinstance(fields[c].dataType, T.StringType)]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, parseable double")
    aggs = []
    for c in cols:
        aggs += [F.count_if(parses_as_date(c)).alias(f"ok__{c}"), F.count(c).alias(f"nn__{c}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column_name"),
                      F.try_divide(F.col(f"ok__{c}").cast("double"), F.col(f"nn__{c}").cast("double")).alias("share"))
             for c in cols]
    long = row.select(F.inline(F.array(*parts)))
    return long.where((F.col("share") > 0) & (F.col("share") < 1)).select(
        "column_name", F.round("share", 2).alias("parseable"))


def quality_score(null_count="null_count", distinct="distinct_values", column_type="column_type"):
    """1.0; -0.2 with NULLs; -0.5 when constant; -0.1 for text with > 100 distinct; floor 0; 1 decimal."""
    s = (F.lit(1.0)
         - F.when(F.col(null_count) > 0, 0.2).otherwise(0.0)
         - F.when(F.col(distinct) == 1, 0.5).otherwise(0.0)
         - F.when((F.lower(F.col(column_type)).contains("char") | (F.lower(F.col(column_type)) == "string"))
                  & (F.col(distinct) > 100), 0.1).otherwise(0.0))
    return F.round(F.greatest(s, F.lit(0.0)), 1)


def column_profile(summary: DataFrame, types: DataFrame) -> DataFrame:
    """Summary joined with types and NULL share, plus the quality score, worst first.

    Both inputs have one row per column; the type table is broadcast (its size
    is the schema width, a proven bound)."""
    j = summary.join(F.broadcast(types), "column_name")
    j = j.withColumn("null_fraction", F.try_divide(F.col("null_count").cast("double"), F.col("total_rows").cast("double")))
    return j.select("column_name", "column_position", "column_type", "total_rows", "distinct_values", "null_count",
                    "null_fraction", quality_score().alias("quality_score"))


def data_problems(summary: DataFrame, null_threshold: float = 0.20) -> DataFrame:
    """``(column_name, problem, value)``: high NULL share (0-1 fraction) and constant columns."""
    nf = null_fraction(summary).where(F.col("null_fraction") > null_threshold).select(
        "column_name", F.lit("high_null_share").alias("problem"), F.col("null_fraction").alias("value"))
    const = constant_columns(summary).select("column_name", F.lit("constant").alias("problem"),
                                             F.col("distinct_values").cast("double").alias("value"))
    return nf.unionByName(const)


def columns_with_nulls(summary: DataFrame) -> DataFrame:
    return null_fraction(summary).where(F.col("null_fraction") > 0).orderBy(F.desc("null_fraction"))


def top_entropy(entropy: DataFrame, n: int = 10) -> DataFrame:
    return entropy.orderBy(F.desc("entropy"), "column_name").limit(n)


def top_value_grid(top: DataFrame, types: DataFrame, n_columns: int = 5, n_values: int = 5) -> DataFrame:
    """The ``n_columns`` columns with most rows in the top-value table (ties by
    column position), each with its first ``n_values`` values."""
    per_col = (top.groupBy("column_name").agg(F.count(F.lit(1)).alias("listed"))
                  .join(F.broadcast(types.select("column_name", "column_position")), "column_name"))
    w = Window.orderBy(F.desc("listed"), "column_position")  # one row per column: bounded
    chosen = per_col.withColumn("col_rank", F.row_number().over(w)).where(F.col("col_rank") <= n_columns)
    return (top.where(F.col("rank") <= n_values)
               .join(F.broadcast(chosen.select("column_name", "col_rank")), "column_name"))
