"""Pairwise-complete Pearson correlation and sample covariance, long form.

One aggregate computes every pair i <= j in a single scan; the rest is mirrored.
Spark's built-in ``corr`` raises DIVIDE_BY_ZERO under ANSI for a constant
column; here the ratio goes through ``try_divide`` and a constant column
yields NULL.  Standard deviations are restricted to rows where the partner is
also non-NULL, which is what pairwise-complete correlation means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import numeric_columns


def _half(cols):
    """Index pairs i <= j: the matrix is symmetric, so these are computed and mirrored."""
    return [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]


def _mirrored(cols, name):
    return [F.struct(F.lit(cols[i]).alias("col_x"), F.lit(cols[j]).alias("col_y"), F.lit(i).alias("x_position"),
                     F.lit(j).alias("y_position"), F.col(f"c_{min(i, j)}_{max(i, j)}").alias(name))
            for i in range(len(cols)) for j in range(len(cols))]


def correlation_matrix(df: DataFrame, columns=None, decimals: int | None = 2) -> DataFrame | None:
    """``(col_x, col_y, x_position, y_position, corr)`` for every ordered pair."""
    cols = numeric_columns(df, columns)
    if not cols:
        return None
    aggs = []
    for i, j in _half(cols):
        x, y = F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")
        both = x.isNotNull() & y.isNotNull()
        sx = F.stddev_samp(F.when(both, x))
        sy = F.stddev_samp(F.when(both, y))
        aggs.append(F.try_divide(F.covar_samp(x, y), sx * sy).alias(f"c_{i}_{j}"))
    row = df.agg(*aggs)
    out = row.select(F.inline(F.array(*_mirrored(cols, "corr"))))
    if decimals is not None:
        out = out.withColumn("corr", F.round("corr", decimals))
    return out


def correlation_lower(corr: DataFrame) -> DataFrame:
    """Strict lower triangle (diagonal excluded)."""
    return corr.where(F.col("x_position") > F.col("y_position"))


def covariance_matrix(df: DataFrame, columns) -> DataFrame:
    """``(col_x, col_y, x_position, y_position, covariance)`` sample covariance for every ordered pair."""
    cols = list(columns)
    row = df.agg(*[F.covar_samp(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"c_{i}_{j}")
                   for i, j in _half(cols)])
    return row.select(F.inline(F.array(*_mirrored(cols, "covariance"))))
