"""Exploratory relations named in the saved analysis output (grouped statistics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .features import listing_features


def quartiles_by(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, n, mean, q25, median, q75)`` with exact quantiles per group (distributed selection)."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = exact_quantiles(df, [value], [0.25, 0.5, 0.75], by=[group])
    wide = q.groupBy(group).agg(*[F.first(F.when(F.col("p") == p, F.col("quantile")), ignorenulls=True).alias(n)
                                  for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return g.join(wide, g[group].eqNullSafe(wide[group])).select(g[group], "n", "mean", "q25", "median", "q75")


def anova_f(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way ANOVA F statistic of ``value`` across ``group`` (NULL groups kept as a level).

    Per-group count, mean and population variance are one partial aggregate (one
    row per group); the squares are of deviations from means, never of the raw
    values, so large values lose no digits."""
    v = F.col(value).cast("double")
    g = df.where(v.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("vp"))
    mean = g.agg(F.try_divide(F.sum(F.col("m") * F.col("n")), F.sum("n"))).scalar()
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("vp") * F.col("n")).alias("ssw"),
              F.sum(F.col("n") * (F.col("m") - mean) * (F.col("m") - mean)).alias("ssb"))
    between, within = F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("k"))
    return t.select(F.col("k").cast("int").alias("groups"), F.col("N").alias("n"), F.try_divide(between, within).alias("f_statistic"))


def median_by(df: DataFrame, value: str, group: str) -> DataFrame:
    q = exact_quantiles(df, [value], [0.5], by=[group])
    return q.select(group, F.col("quantile").alias(f"median_{value}"))


def mean_by(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("listings"), F.avg(value).alias(f"mean_{value}"))


def discount_by(df: DataFrame, group: str) -> DataFrame:
    lf = listing_features(df)
    return lf.groupBy(group).agg(F.count(F.lit(1)).alias("listings"), F.avg("discount_pct").alias("mean_discount"))


def variety_by_reputation(variety: DataFrame, features: DataFrame, key="seller_nickname") -> DataFrame:
    """Mean variety index by the seller's (mean) reputation score."""
    j = variety.join(features.select(key, "rep_score"), key)
    return j.groupBy("rep_score").agg(F.count(F.lit(1)).alias("sellers"), F.avg("variety_index").alias("mean_variety"))
