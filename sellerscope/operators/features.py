"""Listing-level features (discount, title length, reputation score) and the
nine-feature seller table (one ``groupBy(seller).agg``).

Scale: the seller aggregate is a single hash aggregate with map-side partial
aggregation, so a seller holding a third of all listings contributes one
partial row per map task.  The single ``count_distinct`` is planned as a
(seller, category) partial aggregate shuffled on both keys before the final
per-seller count, so a hot seller's distinct categories are spread as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import discount_pct, indicator, reputation_score, text_length

# Feature order: alphabetical, as the saved scaler expects.
FEATURES = [
    "categorias_distintas", "log_price_avg", "log_stock_avg", "num_publicaciones",
    "porc_descuento", "proporcion_refurb", "proporcion_usados", "rep_score", "titulo_length_avg",
]


def listing_features(listings: DataFrame, *, seller="seller_nickname", price="price",
                     regular_price="regular_price", title="titulo", reputation="seller_reputation",
                     rep_map: dict | None = None) -> DataFrame:
    """Row-level features: ``discount_pct``, ``title_len``, ``rep_score``."""
    return listings.withColumns({
        "discount_pct": discount_pct(price, regular_price),
        "title_len": text_length(title),
        "rep_score": reputation_score(reputation, rep_map),
    })


def seller_features(listings: DataFrame, *, seller="seller_nickname", stock="stock", price="price",
                    category="category_id", condition="condition", refurbished="is_refurbished",
                    approx_distinct: bool = False, by=()) -> DataFrame:
    """``(seller, *by, nine doubles)``; sellers with a NULL key are dropped (pandas groupby).
    ``by`` adds grouping keys (e.g. a snapshot period)."""
    lf = listing_features(listings)
    distinct = (F.approx_count_distinct(category) if approx_distinct else F.count_distinct(category))
    return (lf.where(F.col(seller).isNotNull())
              .groupBy(seller, *by)
              .agg(distinct.cast("double").alias("categorias_distintas"),
                   F.avg(F.log1p(F.col(price).cast("double"))).alias("log_price_avg"),
                   F.avg(F.log1p(F.col(stock).cast("double"))).alias("log_stock_avg"),
                   F.count(F.lit(1)).cast("double").alias("num_publicaciones"),
                   F.avg("discount_pct").alias("porc_descuento"),
                   F.avg(F.col(refurbished).cast("double")).alias("proporcion_refurb"),
                   F.avg(indicator(F.col(condition) == "used")).alias("proporcion_usados"),
                   F.avg("rep_score").alias("rep_score"),
                   F.avg("title_len").alias("titulo_length_avg")))
