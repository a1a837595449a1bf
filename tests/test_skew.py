"""One key holding a third of all rows: results must stay exact and whole."""
import math

from pyspark.sql import functions as F

from sellerscope.functions.quantiles import exact_quantiles
from sellerscope.operators.features import seller_features
from sellerscope.operators.sellers import seller_metrics


def _skewed(spark, n=30000):
    base = spark.range(n)
    seller = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 997).cast("string")))
    return base.select(
        seller.alias("seller_nickname"),
        F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")).alias("titulo"),
        F.lit("green").alias("seller_reputation"),
        (F.col("id") % 50).alias("stock"),
        F.when(F.col("id") % 7 == 0, "used").otherwise("new").alias("condition"),
        (F.col("id") % 11 == 0).alias("is_refurbished"),
        ((F.col("id") * 37) % 1000 + 1).cast("double").alias("price"),
        F.lit(None).cast("double").alias("regular_price"),
        F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("category_id"))


def test_hot_seller_features_exact(spark):
    df = _skewed(spark)
    hot = {r["seller_nickname"]: r for r in seller_features(df).collect()}["hot"]
    pdf = df.where(F.col("seller_nickname") == "hot").toPandas()
    assert hot["num_publicaciones"] == len(pdf) == 10000
    assert hot["categorias_distintas"] == pdf["category_id"].nunique()
    assert math.isclose(hot["proporcion_usados"], (pdf["condition"] == "used").mean(), rel_tol=1e-12)
    m = {r["seller_nickname"]: r for r in seller_metrics(df).collect()}["hot"]
    assert math.isclose(m["variety_index"], pdf["titulo"].nunique() / len(pdf), rel_tol=1e-12)


def test_hot_group_quantiles_exact(spark):
    df = _skewed(spark)
    got = {r["seller_nickname"]: r["quantile"] for r in
           exact_quantiles(df, ["price"], [0.5], by=["seller_nickname"], max_bracket=500).collect()}
    ref = {r["seller_nickname"]: r["m"] for r in df.groupBy("seller_nickname").agg(F.percentile("price", 0.5).alias("m")).collect()}
    assert got == ref
