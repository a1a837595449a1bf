"""The *listings* fact table (one row per publication) derived from the supplied tables.

Sellers are customers; a listing is a line item.  The mapping is fixed by
FIXTURES.md so that the DuckDB oracle can build the same rows.  All joins are
plain equi-joins: Catalyst picks sort-merge or (size-checked, via AQE and
``autoBroadcastJoinThreshold``) broadcast at run time; nothing is hinted,
because customer and part grow with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# The 14 source columns (profiled); the rest are extensions for operators whose
# inputs the source lacks (turnover, renewal, GMV, alerts).
SOURCE_COLUMNS = [
    "tim_day", "seller_nickname", "titulo", "seller_reputation", "stock", "logistic_type",
    "condition", "is_refurbished", "price", "regular_price", "categoria", "url",
    "category_id", "category_name",
]
EXTENSION_COLUMNS = ["published_on", "ventas", "gmv", "snapshot_on", "snapshot_rep"]

# Reputation tier by c_nationkey % 10 (9 -> NULL).
_TIERS = ["green_platinum", "green_gold", "green_silver", "green", "light_green",
          "yellow", "orange", "red", "newbie"]
# Logistic type by order priority (anything else -> FLEX).
_LOGISTICS = {"1-URGENT": "FBM", "2-HIGH": "DS", "3-MEDIUM": "XD", "4-NOT SPECIFIED": "Otro"}


def build_listings(lineitem: DataFrame, orders: DataFrame, customer: DataFrame,
                   part: DataFrame) -> DataFrame:
    l = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    c = customer.select("c_custkey", "c_name", "c_nationkey")
    p = part.select("p_partkey", "p_name", "p_brand", "p_type")
    # orders meet their customer first, parts come last: where no table is small enough to be broadcast, line items are
    # shuffled twice, not three times, and never with the title's text
    oc = o.join(c, o.o_custkey == c.c_custkey).drop("o_custkey", "c_custkey")
    j = l.join(oc, l.l_orderkey == oc.o_orderkey).join(p, l.l_partkey == p.p_partkey)

    nk = F.col("c_nationkey") % 10
    tier_expr = F.when(nk == 0, _TIERS[0])
    for i, t in enumerate(_TIERS[1:], start=1):
        tier_expr = tier_expr.when(nk == i, t)
    logistic = F.when(F.col("o_orderpriority") == "1-URGENT", _LOGISTICS["1-URGENT"])
    for k in list(_LOGISTICS)[1:]:
        logistic = logistic.when(F.col("o_orderpriority") == k, _LOGISTICS[k])
    logistic = logistic.otherwise("FLEX")
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")

    return j.select(
        F.lit("2024-08-01").cast("date").alias("tim_day"),
        F.col("c_name").alias("seller_nickname"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("titulo"),
        tier_expr.alias("seller_reputation"),
        F.col("l_quantity").cast("bigint").alias("stock"),
        logistic.alias("logistic_type"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") >= 6), "not_specified")
         .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "used")
         .otherwise("new").alias("condition"),
        ((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.075)).alias("is_refurbished"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("double")).otherwise(unit_price).alias("price"),
        F.when(F.col("l_orderkey") % 89 == 0, F.lit(0.0))
         .when(F.col("l_discount") > 0.075, unit_price / (1 - F.col("l_discount"))).alias("regular_price"),
        F.col("p_brand").alias("categoria"),
        F.concat(F.lit("https://listing.example/"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("p_brand").alias("category_id"),
        F.upper("p_brand").alias("category_name"),
        F.col("l_shipdate").cast("date").alias("published_on"),
        F.col("l_linenumber").cast("bigint").alias("ventas"),
        F.col("l_extendedprice").alias("gmv"),
        F.col("o_orderdate").cast("date").alias("snapshot_on"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("snapshot_rep"),
    )


def load_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = build_listings(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"),
                        read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "part"))
    return df


# The same fixture as DuckDB/ANSI SQL, used as a CTE by every oracle query.
LISTINGS_SQL = """
SELECT
  DATE '2024-08-01' AS tim_day,
  c.c_name AS seller_nickname,
  concat_ws(' ', p.p_name, p.p_brand, p.p_type) AS titulo,
  CASE c.c_nationkey % 10 WHEN 0 THEN 'green_platinum' WHEN 1 THEN 'green_gold' WHEN 2 THEN 'green_silver'
    WHEN 3 THEN 'green' WHEN 4 THEN 'light_green' WHEN 5 THEN 'yellow' WHEN 6 THEN 'orange' WHEN 7 THEN 'red'
    WHEN 8 THEN 'newbie' END AS seller_reputation,
  CAST(l.l_quantity AS BIGINT) AS stock,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'FBM' WHEN '2-HIGH' THEN 'DS' WHEN '3-MEDIUM' THEN 'XD'
    WHEN '4-NOT SPECIFIED' THEN 'Otro' ELSE 'FLEX' END AS logistic_type,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber >= 6 THEN 'not_specified'
       WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'used' ELSE 'new' END AS condition,
  (l.l_returnflag = 'A' AND l.l_tax > 0.075) AS is_refurbished,
  CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END AS price,
  CASE WHEN l.l_orderkey % 89 = 0 THEN CAST(0 AS DOUBLE)
       WHEN l.l_discount > 0.075 THEN (l.l_extendedprice / l.l_quantity) / (1 - l.l_discount) END AS regular_price,
  p.p_brand AS categoria,
  concat('https://listing.example/', CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20)), '-', CAST(l.l_partkey AS VARCHAR(20))) AS url,
  p.p_brand AS category_id,
  upper(p.p_brand) AS category_name,
  CAST(l.l_shipdate AS DATE) AS published_on,
  CAST(l.l_linenumber AS BIGINT) AS ventas,
  l.l_extendedprice AS gmv,
  CAST(o.o_orderdate AS DATE) AS snapshot_on,
  6 - CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS snapshot_rep
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
"""
