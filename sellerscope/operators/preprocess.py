"""Median imputation and robust scaling with exact quantiles, plus the
declared-only transforms (winsorising, regular-price fill, rare-category
grouping, minority oversampling, constant-column drop).

The scaler parameters are a tiny table (one row per feature, a proven
bound).  They are collected once, like a fitted model, and applied as
literals, so scaling is a projection and the seller table is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .features import FEATURES


def scaler_params(features: DataFrame, columns=FEATURES) -> DataFrame:
    """``(feature, median, q25, q75, scale)``; scale = IQR, or 1 when the IQR is 0
    (a zero IQR keeps the feature instead of erasing it)."""
    q = exact_quantiles(features, list(columns), [0.25, 0.5, 0.75])
    wide = (q.groupBy("column")
              .agg(F.first(F.when(F.col("p") == 0.5, F.col("quantile")), ignorenulls=True).alias("median"),
                   F.first(F.when(F.col("p") == 0.25, F.col("quantile")), ignorenulls=True).alias("q25"),
                   F.first(F.when(F.col("p") == 0.75, F.col("quantile")), ignorenulls=True).alias("q75")))
    iqr = F.col("q75") - F.col("q25")
    return wide.select(F.col("column").alias("feature"), "median", "q25", "q75",
                       F.when(iqr.isNull() | (iqr == 0), F.lit(1.0)).otherwise(iqr).alias("scale"))


MAX_PARAM_ROWS = 10_000


def fitted_params(params: DataFrame, columns=FEATURES) -> dict:
    """Collect the fitted scaler (one row per feature, a proven bound) as constants.

    Like a fitted model, the parameters become literals of the transform, so
    scaling is a pure projection: no join, no shuffle of the seller table.
    """
    rows = params.limit(MAX_PARAM_ROWS + 1).collect()
    if len(rows) > MAX_PARAM_ROWS:
        raise ValueError("scaler parameter table is not a per-feature table")
    got = {r["feature"]: r for r in rows}
    missing = [c for c in columns if c not in got]
    if missing:
        raise ValueError(f"no scaler parameters for {missing}")
    empty = [c for c in columns if got[c]["median"] is None]
    if empty:
        raise ValueError(f"no value to fit the scaler on in {empty}")
    return {c: (got[c]["median"], got[c]["scale"]) for c in columns}


def impute_median(features: DataFrame, params: DataFrame, columns=FEATURES, key="seller_nickname") -> DataFrame:
    fp = fitted_params(params, columns)
    return features.select(key, *[F.coalesce(F.col(c), F.lit(fp[c][0]).cast("double")).alias(c) for c in columns])


def robust_scale(features: DataFrame, params: DataFrame, columns=FEATURES, key="seller_nickname",
                 impute: bool = True) -> DataFrame:
    """``(x - median) / scale`` after (optional) median imputation; ``key`` is one column kept as it is, or several."""
    fp = fitted_params(params, columns)
    out = []
    for c in columns:
        med, scale = F.lit(fp[c][0]).cast("double"), F.lit(fp[c][1]).cast("double")
        x = F.coalesce(F.col(c), med) if impute else F.col(c)
        out.append(((x - med) / scale).alias(c))
    return features.select(*([key] if isinstance(key, str) else key or []), *out)


def inverse_scale(scaled: DataFrame, params: DataFrame, columns=FEATURES, key="cluster_id") -> DataFrame:
    fp = fitted_params(params, columns)
    return scaled.select(key, *[(F.col(c) * F.lit(fp[c][1]) + F.lit(fp[c][0])).alias(c) for c in columns])


# ---- declared-only transforms ------------------------------------------------

def winsorize(df: DataFrame, column: str, lower: float | None = None, upper: float = 0.999) -> DataFrame:
    """Clip ``column`` to its exact [lower, upper] quantiles (NULL stays NULL)."""
    probs = [p for p in (lower, upper) if p is not None]
    q = exact_quantiles(df, [column], probs)

    def bound(p):
        return q.where(F.col("p") == float(p)).select("quantile").scalar()

    x = F.least(F.col(column), bound(upper))
    if lower is not None:
        x = F.greatest(x, bound(lower))
    return df.withColumn(column, x)


def impute_regular_price(df: DataFrame, price="price", regular="regular_price", multiplier: float = 1.2) -> DataFrame:
    return df.withColumn(regular, F.coalesce(F.col(regular), F.col(price) * F.lit(multiplier)))


def group_rare(df: DataFrame, column: str, min_share: float = 0.01, other: str = "OTHER") -> DataFrame:
    """Replace values whose share of rows is below ``min_share`` by ``other``.

    At most 1 / min_share values reach that share, so the frequent side is the
    one with a proven bound: it is broadcast, and the rows are never shuffled.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    kept = (df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
              .where(F.col("__c") >= F.lit(min_share) * total)
              .select("__v", F.lit(True).alias("__kept")))
    j = df.join(F.broadcast(kept) if min_share > 0 else kept, df[column].eqNullSafe(kept["__v"]), "left")
    return j.withColumn(column, F.when(F.col("__kept"), F.col(column)).otherwise(F.lit(other))).drop("__v", "__kept")


def oversample_minority(df: DataFrame, flag: str, target_ratio: float = 0.1, block: int = 1000) -> DataFrame:
    """Replicate minority rows (``flag`` true) deterministically so that they reach
    about ``target_ratio`` of the majority: each minority row is repeated
    ``max(1, round(target_ratio * n_major / n_minor))`` times (column ``replica``).

    Replicas are made in two steps, blocks and the rows in them, so an array of
    row numbers is never longer than ``block``."""
    n_min = df.select(F.count_if(F.col(flag))).scalar()
    n_maj = df.select(F.count_if(~F.col(flag))).scalar()
    reps = F.greatest(F.lit(1), F.coalesce(F.round(F.try_divide(F.lit(target_ratio) * n_maj, n_min)).cast("long"), F.lit(1)))
    n = F.when(F.col(flag), reps).otherwise(F.lit(1).cast("long"))
    blocks = df.withColumn("__n", n).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / block))))
    last = F.least(F.lit(block).cast("long"), F.col("__n") - F.col("__b") * block)
    out = blocks.withColumn("__r", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    return out.withColumn("replica", (F.col("__r") + F.col("__b") * block).cast("int")).drop("__n", "__b", "__r")


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)
