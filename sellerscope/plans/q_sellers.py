"""Registered per-seller metric queries (ops 5.x)."""

from __future__ import annotations

from ..operators import sellers as sm
from .oracle_sql import rnd, with_ctes
from .registry import ctx, register

S = "seller_nickname"
EXTRA = [
    ("p75", "SELECT quantile_cont(price, 0.75) AS v FROM listings"),
    ("pmean", "SELECT AVG(price) AS v FROM listings"),
    ("maxpub", "SELECT MAX(published_on) AS v FROM listings"),
    ("smetrics", f"""SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings,
  CAST(COUNT(DISTINCT titulo) AS DOUBLE) / COUNT(*) AS variety_index,
  STDDEV_SAMP(price) AS price_stddev,
  CAST(COUNT(*) FILTER (WHERE price > (SELECT v FROM p75)) AS DOUBLE) / COUNT(*) AS premium_share,
  CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(DISTINCT category_id), 0) AS category_density,
  AVG(stock) / COUNT(*) AS stock_ratio,
  CAST(COUNT(*) FILTER (WHERE lower(condition) = 'new') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE lower(condition) = 'used'), 0) AS new_used_ratio,
  CAST(COUNT(*) FILTER (WHERE price < (SELECT v FROM pmean)) AS DOUBLE) / COUNT(*) AS low_price_share,
  CASE WHEN SUM(stock) > 0 THEN CAST(SUM(ventas) AS DOUBLE) / SUM(stock) END AS turnover
FROM listings GROUP BY {S}"""),
]


def Q(body: str) -> str:
    return with_ctes(body, *EXTRA)


@register("seller_variety", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, CAST(COUNT(DISTINCT titulo) AS BIGINT) AS distinct_titles, "
    + rnd("CAST(COUNT(DISTINCT titulo) AS DOUBLE) / COUNT(*)", "variety_index") + f" FROM listings GROUP BY {S}"))
def q_variety(spark, sf_dir):
    """5.1: distinct titles per listing."""
    return sm.seller_variety(ctx(spark, sf_dir).listings)


@register("seller_price_stddev", Q(f"SELECT {S}, " + rnd("STDDEV_SAMP(price)", "price_stddev") + f" FROM listings GROUP BY {S}"))
def q_price_std(spark, sf_dir):
    """5.2: sample standard deviation of price (NULL for one listing)."""
    return sm.seller_price_stddev(ctx(spark, sf_dir).listings)


@register("seller_premium_share", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, CAST(COUNT(*) FILTER (WHERE price > (SELECT v FROM p75)) AS BIGINT) AS premium, "
    + rnd("CAST(COUNT(*) FILTER (WHERE price > (SELECT v FROM p75)) AS DOUBLE) / COUNT(*)", "premium_share")
    + f" FROM listings GROUP BY {S}"))
def q_premium(spark, sf_dir):
    """5.3: share above the global exact p75 price."""
    c = ctx(spark, sf_dir)
    return sm.seller_premium_share(c.listings, quantile=c.p75)


@register("seller_category_density", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, CAST(COUNT(DISTINCT category_id) AS BIGINT) AS categories, "
    + rnd("CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(DISTINCT category_id), 0)", "category_density")
    + f" FROM listings GROUP BY {S}"))
def q_density(spark, sf_dir):
    """5.4: listings per distinct category."""
    return sm.seller_category_density(ctx(spark, sf_dir).listings)


@register("seller_stock_ratio", Q(
    f"SELECT {S}, " + rnd("AVG(stock)", "avg_stock") + ", CAST(COUNT(*) AS BIGINT) AS listings, "
    + rnd("AVG(stock) / COUNT(*)", "stock_ratio") + f" FROM listings GROUP BY {S}"))
def q_stock_ratio(spark, sf_dir):
    """5.5: AVG(stock) / COUNT(*)."""
    return sm.seller_stock_ratio(ctx(spark, sf_dir).listings)


@register("seller_low_price_share", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, CAST(COUNT(*) FILTER (WHERE price < (SELECT v FROM pmean)) AS BIGINT) AS below_mean, "
    + rnd("CAST(COUNT(*) FILTER (WHERE price < (SELECT v FROM pmean)) AS DOUBLE) / COUNT(*)", "low_price_share")
    + f" FROM listings GROUP BY {S}"))
def q_low_price(spark, sf_dir):
    """5.6: share below the global mean price."""
    return sm.seller_low_price_share(ctx(spark, sf_dir).listings)


@register("seller_new_used_ratio", Q(
    f"SELECT {S}, CAST(COUNT(*) FILTER (WHERE lower(condition) = 'new') AS BIGINT) AS new, "
    "CAST(COUNT(*) FILTER (WHERE lower(condition) = 'used') AS BIGINT) AS used, "
    + rnd("CAST(COUNT(*) FILTER (WHERE lower(condition) = 'new') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE lower(condition) = 'used'), 0)", "new_used_ratio")
    + f" FROM listings GROUP BY {S}"))
def q_new_used(spark, sf_dir):
    """5.7: new / used counts."""
    return sm.seller_new_used_ratio(ctx(spark, sf_dir).listings)


@register("seller_metrics", Q(
    f"SELECT {S}, listings, " + ", ".join(rnd(m, m) for m in sm.METRICS + ["turnover"]) + " FROM smetrics"))
def q_metrics(spark, sf_dir):
    """5.8: every seller metric from one aggregate."""
    c = ctx(spark, sf_dir)
    return sm.seller_metrics(c.listings, sales="ventas", p75=c.p75)


@register("seller_turnover", Q(
    f"SELECT {S}, CAST(SUM(ventas) AS BIGINT) AS total_sales, CAST(SUM(stock) AS BIGINT) AS total_stock, "
    + rnd("CASE WHEN SUM(stock) > 0 THEN CAST(SUM(ventas) AS DOUBLE) / SUM(stock) END", "turnover")
    + f" FROM listings GROUP BY {S}"))
def q_turnover(spark, sf_dir):
    """5.9: sales / stock."""
    return sm.seller_turnover(ctx(spark, sf_dir).listings)


@register("seller_renewal_rate", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, "
    "CAST(COUNT(*) FILTER (WHERE published_on >= CAST((SELECT v FROM maxpub) - INTERVAL 30 DAY AS DATE)) AS BIGINT) AS recent, "
    + rnd("CAST(COUNT(*) FILTER (WHERE published_on >= CAST((SELECT v FROM maxpub) - INTERVAL 30 DAY AS DATE)) AS DOUBLE) / COUNT(*)", "renewal_rate")
    + f" FROM listings GROUP BY {S}"))
def q_renewal(spark, sf_dir):
    """5.10: share published in the 30 days before the latest publication date."""
    return sm.seller_renewal_rate(ctx(spark, sf_dir).listings)


@register("seller_weekly_frequency", Q(
    f"SELECT {S}, CAST(COUNT(*) AS BIGINT) AS listings, CAST(MIN(published_on) AS VARCHAR) AS first_date, CAST(MAX(published_on) AS VARCHAR) AS last_date, "
    + rnd("CASE WHEN date_diff('day', MIN(published_on), MAX(published_on)) > 0 THEN COUNT(*) * 7.0 / "
          "date_diff('day', MIN(published_on), MAX(published_on)) END", "listings_per_week")
    + f" FROM listings GROUP BY {S}"))
def q_weekly(spark, sf_dir):
    """5.11: listings per week over the seller's publication span."""
    return sm.seller_weekly_frequency(ctx(spark, sf_dir).listings)


@register("top_sellers_by_metric", Q(
    "SELECT metric, seller_nickname, value, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT metric, seller_nickname, value, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, "
    "seller_nickname ASC NULLS LAST) AS rank FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, seller_nickname, {rnd(m, 'value')}, {m} AS raw FROM smetrics"
        for m in sm.METRICS + ["turnover"]) + ") u) r WHERE rank <= 10"))
def q_top_sellers(spark, sf_dir):
    """5.12: top ten sellers per metric."""
    c = ctx(spark, sf_dir)
    return sm.top_sellers_by_metric(sm.seller_metrics(c.listings, sales="ventas", p75=c.p75), 10)
