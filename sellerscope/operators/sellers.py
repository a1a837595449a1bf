"""Per-seller descriptive metrics (``GROUP BY seller``; a NULL seller is kept as a group, like SQL).

All metrics come from one hash aggregate per seller after at most one global
statistics pass.  Global statistics (price mean, exact p75) are scalar
subqueries: one value computed once and inlined into the aggregate's
expressions, no join.  The aggregate is partial (map-side) so a seller with a
third of all listings costs one partial row per map task; the distinct counts
are planned as (seller, title) / (seller, category) partial aggregates that are
shuffled on both keys, so a hot seller's distinct values are spread too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import safe_div
from ..functions.quantiles import exact_quantiles


def _n():
    return F.count(F.lit(1))


def global_mean(df: DataFrame, column: str) -> Column:
    return df.select(F.avg(column)).scalar()


def global_quantile(df: DataFrame, column: str, p: float) -> Column:
    """Exact linear-interpolated quantile as a scalar subquery (distributed selection)."""
    return exact_quantiles(df, [column], [p]).select("quantile").scalar()


def seller_variety(df: DataFrame, seller="seller_nickname", title="titulo") -> DataFrame:
    return df.groupBy(seller).agg(_n().alias("listings"), F.count_distinct(title).alias("distinct_titles")).select(
        seller, "listings", "distinct_titles", safe_div("distinct_titles", "listings").alias("variety_index"))


def seller_price_stddev(df: DataFrame, seller="seller_nickname", price="price") -> DataFrame:
    return df.groupBy(seller).agg(F.stddev_samp(price).alias("price_stddev"))


def seller_premium_share(df: DataFrame, seller="seller_nickname", price="price", p: float = 0.75, quantile: float | None = None) -> DataFrame:
    """Share of a seller's listings priced above the global exact ``p`` quantile
    (``quantile``: its value, where the caller has it already)."""
    q = global_quantile(df, price, p) if quantile is None else F.lit(float(quantile))
    premium = F.count_if(F.col(price) > q)
    return df.groupBy(seller).agg(_n().alias("listings"), premium.alias("premium")).select(
        seller, "listings", "premium", safe_div("premium", "listings").alias("premium_share"))


def seller_category_density(df: DataFrame, seller="seller_nickname", category="category_id") -> DataFrame:
    """Listings per distinct category (NULL when the seller has no non-NULL category)."""
    return df.groupBy(seller).agg(_n().alias("listings"), F.count_distinct(category).alias("categories")).select(
        seller, "listings", "categories", safe_div("listings", "categories").alias("category_density"))


def seller_stock_ratio(df: DataFrame, seller="seller_nickname", stock="stock") -> DataFrame:
    """AVG(stock) / COUNT(*) (the reference formula, which divides twice)."""
    return df.groupBy(seller).agg(F.avg(stock).alias("avg_stock"), _n().alias("listings")).select(
        seller, "avg_stock", "listings", safe_div("avg_stock", "listings").alias("stock_ratio"))


def seller_low_price_share(df: DataFrame, seller="seller_nickname", price="price") -> DataFrame:
    m = global_mean(df, price)
    low = F.count_if(F.col(price) < m)
    return df.groupBy(seller).agg(_n().alias("listings"), low.alias("below_mean")).select(
        seller, "listings", "below_mean", safe_div("below_mean", "listings").alias("low_price_share"))


def seller_new_used_ratio(df: DataFrame, seller="seller_nickname", condition="condition") -> DataFrame:
    """new / used listing counts (case-insensitive); NULL when the seller has no used listing."""
    c = F.lower(F.col(condition))
    return df.groupBy(seller).agg(F.count_if(c == "new").alias("new"), F.count_if(c == "used").alias("used")).select(
        seller, "new", "used", safe_div("new", "used").alias("new_used_ratio"))


def seller_turnover(df: DataFrame, seller="seller_nickname", sales="ventas", stock="stock") -> DataFrame:
    """Sum(sales) / sum(stock); NULL when the stock sum is not positive."""
    g = df.groupBy(seller).agg(F.sum(sales).alias("total_sales"), F.sum(stock).alias("total_stock"))
    return g.select(seller, "total_sales", "total_stock",
                    F.when(F.col("total_stock") > 0, safe_div("total_sales", "total_stock")).alias("turnover"))


def seller_renewal_rate(df: DataFrame, seller="seller_nickname", published="published_on", as_of=None,
                        days: int = 30) -> DataFrame:
    """Share of a seller's listings published in the ``days`` before ``as_of``
    (default: the latest publication date in the data, a scalar subquery)."""
    ref = F.lit(as_of).cast("date") if as_of is not None else df.select(F.max(published)).scalar()
    recent = F.count_if(F.col(published) >= F.date_sub(ref, days))
    return df.groupBy(seller).agg(_n().alias("listings"), recent.alias("recent")).select(
        seller, "listings", "recent", safe_div("recent", "listings").alias("renewal_rate"))


def seller_weekly_frequency(df: DataFrame, seller="seller_nickname", published="published_on") -> DataFrame:
    """Listings per week over the seller's publication span; NULL for a zero span."""
    g = df.groupBy(seller).agg(_n().alias("listings"), F.min(published).alias("first_date"),
                               F.max(published).alias("last_date"))
    span = F.datediff("last_date", "first_date")
    return g.select(seller, "listings", "first_date", "last_date",
                    F.when(span > 0, F.col("listings") * 7.0 / span).alias("listings_per_week"))


METRICS = ["variety_index", "price_stddev", "premium_share", "category_density", "stock_ratio",
           "new_used_ratio", "low_price_share"]


def seller_metrics(df: DataFrame, seller="seller_nickname", title="titulo", price="price",
                   category="category_id", stock="stock", condition="condition", sales: str | None = None,
                   p75: float | None = None) -> DataFrame:
    """All seller metrics in one aggregate (the reference runs seven scans)."""
    p75 = global_quantile(df, price, 0.75) if p75 is None else F.lit(float(p75))
    mean = global_mean(df, price)
    c = F.lower(F.col(condition))
    aggs = [_n().alias("listings"), F.count_distinct(title).alias("distinct_titles"),
            F.stddev_samp(price).alias("price_stddev"), F.count_if(F.col(price) > p75).alias("premium"),
            F.count_distinct(category).alias("categories"), F.avg(stock).alias("avg_stock"),
            F.count_if(c == "new").alias("new"), F.count_if(c == "used").alias("used"),
            F.count_if(F.col(price) < mean).alias("below_mean")]
    if sales:
        aggs += [F.sum(sales).alias("total_sales"), F.sum(stock).alias("total_stock")]
    g = df.groupBy(seller).agg(*aggs)
    out = [seller, "listings",
           safe_div("distinct_titles", "listings").alias("variety_index"),
           "price_stddev",
           safe_div("premium", "listings").alias("premium_share"),
           safe_div("listings", "categories").alias("category_density"),
           safe_div("avg_stock", "listings").alias("stock_ratio"),
           safe_div("new", "used").alias("new_used_ratio"),
           safe_div("below_mean", "listings").alias("low_price_share")]
    if sales:
        out.append(F.when(F.col("total_stock") > 0, safe_div("total_sales", "total_stock")).alias("turnover"))
    return g.select(*out)


def top_sellers_by_metric(metrics: DataFrame, n: int = 10, seller="seller_nickname", names=None) -> DataFrame:
    """Top-``n`` sellers per metric, value descending (NULLs last, ties by seller).

    The long form is ``(metric, seller, value)``; ``row_number`` per metric is
    planned with a partial ``WindowGroupLimit`` before the shuffle, so each
    metric's window sees at most n rows per input partition."""
    names = list(names or [c for c in METRICS if c in metrics.columns] +
                 (["turnover"] if "turnover" in metrics.columns else []))
    long = metrics.select(seller, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))
    w = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), F.asc_nulls_last(seller))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
