import math

from pyspark.sql import functions as F

from sellerscope.operators.features import FEATURES, listing_features, seller_features
from sellerscope.operators.preprocess import robust_scale, scaler_params

SCHEMA = ("seller_nickname string, titulo string, seller_reputation string, stock bigint, condition string, "
          "is_refurbished boolean, price double, regular_price double, category_id string")


def test_listing_feature_null_rules(spark):
    df = spark.createDataFrame([
        ("a", "Generación", "green", 3, "new", False, 80.0, 100.0, "c1"),
        ("a", "x", None, 0, "used", True, None, 100.0, "c1"),
        ("a", "y", "unknown", 1, None, False, 50.0, 0.0, "c2"),
        ("a", "z", "red", 1, "used", False, 50.0, None, "c2"),
    ], SCHEMA)
    rows = listing_features(df).select("discount_pct", "title_len", "rep_score").collect()
    assert rows[0]["discount_pct"] == 0.2 and rows[0]["title_len"] == 10.0 and rows[0]["rep_score"] == 3.0
    assert rows[1]["discount_pct"] is None and rows[1]["rep_score"] == 0.0   # only price NULL -> NULL
    assert rows[2]["discount_pct"] == 0.0 and rows[2]["rep_score"] == 0.0    # regular 0 -> 0, unknown tier -> 0
    assert rows[3]["discount_pct"] == 0.0                                     # regular NULL -> 0


def test_seller_features_groups(spark):
    df = spark.createDataFrame([
        ("a", "t1", "green", 3, "used", True, 10.0, None, "c1"),
        ("a", "t2", "green", 0, None, False, None, None, "c2"),
        ("b", "t1", "newbie", 5, "new", False, None, None, "c1"),
        (None, "t1", "red", 5, "new", False, 1.0, None, "c1"),
    ], SCHEMA)
    out = {r["seller_nickname"]: r for r in seller_features(df).collect()}
    assert set(out) == {"a", "b"}                                   # NULL seller dropped (pandas groupby)
    a, b = out["a"], out["b"]
    assert a["num_publicaciones"] == 2.0 and a["categorias_distintas"] == 2.0
    assert a["proporcion_usados"] == 0.5                            # NULL condition counts as not used
    assert a["proporcion_refurb"] == 0.5
    assert math.isclose(a["log_price_avg"], math.log1p(10.0))     # NULL price ignored
    assert b["log_price_avg"] is None                               # all prices NULL -> NULL
    assert math.isclose(a["log_stock_avg"], (math.log1p(3) + math.log1p(0)) / 2)


def test_zero_iqr_keeps_feature(spark):
    # 1 of 8 sellers non-zero: q25 = q75 = 0 -> IQR 0 -> scale 1, value kept
    rows = [(f"s{i}", *[float(i)] * 8, 1.0 if i == 7 else 0.0) for i in range(8)]
    cols = [c for c in FEATURES if c != "proporcion_refurb"] + ["proporcion_refurb"]
    df = spark.createDataFrame(rows, "seller_nickname string, " + ", ".join(f"{c} double" for c in cols))
    params = {r["feature"]: r for r in scaler_params(df).collect()}
    assert params["proporcion_refurb"]["scale"] == 1.0
    assert params["num_publicaciones"]["median"] == 3.5 and params["num_publicaciones"]["scale"] == 3.5
    scaled = {r["seller_nickname"]: r for r in robust_scale(df, scaler_params(df)).collect()}
    assert scaled["s7"]["proporcion_refurb"] == 1.0 and scaled["s0"]["proporcion_refurb"] == 0.0


def test_imputation_uses_median(spark):
    rows = [("a", *[1.0] * 9), ("b", *[3.0] * 9), ("c", *[None] * 9)]
    df = spark.createDataFrame(rows, "seller_nickname string, " + ", ".join(f"{c} double" for c in FEATURES))
    out = {r["seller_nickname"]: r for r in robust_scale(df, scaler_params(df)).collect()}
    assert out["c"]["rep_score"] == 0.0                             # NULL -> median -> 0 after centring
    assert F is not None
