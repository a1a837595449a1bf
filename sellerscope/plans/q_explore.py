"""Registered exploratory and declared-preprocessing queries (ops 7.5-7.10, 14.x)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import REPUTATION_SCORES_ALT, reputation_score
from ..operators import explore as ex
from ..operators import preprocess as pp
from ..operators import profile as pr
from ..operators.sellers import seller_variety
from ..sources.listings import SOURCE_COLUMNS
from .oracle_sql import rnd, with_ctes
from .registry import ctx, register


def X(body: str) -> str:
    return with_ctes(body)


@register("price_by_reputation", X(
    "SELECT seller_reputation, CAST(COUNT(price) AS BIGINT) AS n, " + rnd("AVG(price)", "mean", 12) + ", " +
    rnd("quantile_cont(price, 0.25)", "q25", 12) + ", " + rnd("quantile_cont(price, 0.5)", "median", 12) + ", " +
    rnd("quantile_cont(price, 0.75)", "q75", 12) + " FROM listings GROUP BY seller_reputation"), bits=12)
def q_price_rep(spark, sf_dir):
    """14.1: price quartiles by reputation tier (NULL tier kept)."""
    return ex.quartiles_by(ctx(spark, sf_dir).listings, "price", "seller_reputation")


@register("price_anova", X(
    "SELECT CAST(COUNT(*) AS INTEGER) AS groups, CAST(SUM(n) AS BIGINT) AS n, " + rnd(
        "(SUM(n * (m - gm) * (m - gm)) / (COUNT(*) - 1)) / (SUM(vp * n) / (SUM(n) - COUNT(*)))", "f_statistic", 10) +
    " FROM (SELECT *, SUM(m * n) OVER () / SUM(n) OVER () AS gm FROM (SELECT seller_reputation, COUNT(*) AS n, AVG(price) AS m, "
    "VAR_POP(price) AS vp FROM listings WHERE price IS NOT NULL GROUP BY seller_reputation) g) h"), bits=10)
def q_anova(spark, sf_dir):
    """14.1: one-way ANOVA F of price across reputation tiers."""
    return ex.anova_f(ctx(spark, sf_dir).listings, "price", "seller_reputation")


@register("stock_by_logistics", X(
    "SELECT logistic_type, " + rnd("quantile_cont(stock, 0.5)", "median_stock") + " FROM listings GROUP BY logistic_type"))
def q_stock_logistics(spark, sf_dir):
    """14.2: exact median stock by logistic type."""
    return ex.median_by(ctx(spark, sf_dir).listings, "stock", "logistic_type")


@register("price_by_category", X(
    "SELECT category_id, CAST(COUNT(*) AS BIGINT) AS listings, " + rnd("AVG(price)", "mean_price", 12) +
    " FROM listings GROUP BY category_id"), bits=12)
def q_price_cat(spark, sf_dir):
    """14.3: mean price by category."""
    return ex.mean_by(ctx(spark, sf_dir).listings, "price", "category_id")


@register("discount_by_category", X(
    "SELECT category_id, CAST(COUNT(*) AS BIGINT) AS listings, " + rnd("AVG(discount_pct)", "mean_discount") +
    " FROM lf GROUP BY category_id"))
def q_disc_cat(spark, sf_dir):
    """14.5: mean discount by category."""
    return ex.discount_by(ctx(spark, sf_dir).listings, "category_id")


@register("variety_by_reputation", X(
    "SELECT f.rep_score, CAST(COUNT(*) AS BIGINT) AS sellers, " + rnd("AVG(v.variety_index)", "mean_variety") +
    " FROM (SELECT seller_nickname, CAST(COUNT(DISTINCT titulo) AS DOUBLE) / COUNT(*) AS variety_index FROM listings "
    "GROUP BY seller_nickname) v JOIN sf f ON v.seller_nickname = f.seller_nickname GROUP BY f.rep_score"))
def q_var_rep(spark, sf_dir):
    """14.4: mean variety index by seller reputation score."""
    c = ctx(spark, sf_dir)
    return ex.variety_by_reputation(seller_variety(c.listings), c.model.features)


# ---- declared preprocessing (7.5-7.10) ------------------------------------------

@register("winsorize", X(
    "SELECT url, seller_nickname, " + rnd("LEAST(price, (SELECT quantile_cont(price, 0.999) FROM listings))", "price", 12) +
    " FROM listings"), bits=12)
def q_winsorize(spark, sf_dir):
    """7.5: price clipped at its exact 99.9th percentile."""
    df = pp.winsorize(ctx(spark, sf_dir).listings, "price", upper=0.999)
    return df.select("url", "seller_nickname", "price")


@register("impute_regular_price", X(
    "SELECT url, seller_nickname, " + rnd("COALESCE(regular_price, price * 1.2)", "regular_price", 12) + " FROM listings"),
    bits=12)
def q_impute_regular(spark, sf_dir):
    """7.6: regular price filled with price x 1.2."""
    df = pp.impute_regular_price(ctx(spark, sf_dir).listings)
    return df.select("url", "seller_nickname", "regular_price")


@register("reputation_score_alt", X(
    "SELECT seller_reputation, CAST(COALESCE(CASE seller_reputation " + " ".join(
        f"WHEN '{k}' THEN {float(v)}" for k, v in REPUTATION_SCORES_ALT.items()) +
    " END, 0) AS DOUBLE) AS rep_score_alt, CAST(COUNT(*) AS BIGINT) AS listings FROM listings GROUP BY seller_reputation"))
def q_rep_alt(spark, sf_dir):
    """7.8: alternative ordinal reputation encoding (listings per tier)."""
    df = ctx(spark, sf_dir).listings.withColumn("rep_score_alt", reputation_score("seller_reputation", REPUTATION_SCORES_ALT))
    return df.groupBy("seller_reputation", "rep_score_alt").agg(F.count(F.lit(1)).alias("listings"))


@register("oversample_minority", X(
    "SELECT url, seller_nickname, is_refurbished, CAST(unnest(range(1, r + 1)) AS INTEGER) AS replica FROM ("
    "SELECT url, seller_nickname, is_refurbished, CASE WHEN is_refurbished THEN "
    "GREATEST(1, CAST(ROUND(0.1 * (SELECT COUNT(*) FILTER (WHERE NOT is_refurbished) FROM listings) / "
    "NULLIF((SELECT COUNT(*) FILTER (WHERE is_refurbished) FROM listings), 0)) AS INTEGER)) ELSE 1 END AS r FROM listings) t"))
def q_oversample(spark, sf_dir):
    """7.9: deterministic replication of refurbished listings towards a 10 % ratio."""
    df = pp.oversample_minority(ctx(spark, sf_dir).listings.select("url", "seller_nickname", "is_refurbished"), "is_refurbished", 0.1)
    return df.select("url", "seller_nickname", "is_refurbished", "replica")


@register("group_rare", X(
    "SELECT l.url, l.seller_nickname, CASE WHEN c.n < 0.05 * (SELECT COUNT(*) FROM listings) THEN 'OTHER' ELSE l.logistic_type END AS logistic_type "
    "FROM listings l JOIN (SELECT logistic_type, COUNT(*) AS n FROM listings "
    "GROUP BY logistic_type) c ON l.logistic_type IS NOT DISTINCT FROM c.logistic_type"))
def q_group_rare(spark, sf_dir):
    """7.10: logistic types under 5 % of listings grouped as OTHER."""
    df = ctx(spark, sf_dir).listings.select("url", "seller_nickname", "logistic_type")
    return pp.group_rare(df, "logistic_type", 0.05)


#: Columns of the listings that the fixture makes constant at any scale.
_CONSTANT = ("tim_day",)


@register("drop_constant_columns", X("SELECT " + ", ".join(
    rnd(x, x, 12) if x in ("price", "regular_price") else x for x in SOURCE_COLUMNS if x not in _CONSTANT) + " FROM listings"), bits=12)
def q_drop_constant(spark, sf_dir):
    """7.7: the source rows without the columns that the profile finds constant."""
    c = ctx(spark, sf_dir)
    const = [r["column_name"] for r in pr.constant_columns(c.summary).collect()]  # column names only
    return pp.drop_columns(c.source, const)
