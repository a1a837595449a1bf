"""Sinks: tables (Parquet/CSV, optional partitioning), the text report, scaler/centroid parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, header: bool = True) -> None:
    """Write a DataFrame as a table folder (the writers run on the executors)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", str(header).lower())
    w.format(fmt).save(path)


def append_snapshot(df: DataFrame, path: str, date_col: str) -> None:
    """Add the dates of ``df`` to a history table partitioned by ``date_col``; a date already there is replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def save_params(df: DataFrame, path: str) -> None:
    """Persist a small parameter table (scaler parameters, centroids) as Parquet."""
    write_table(df.coalesce(1), path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Scoring input: one JSON object per line with the nine seller metrics.
METRICS_SCHEMA = T.StructType([
    T.StructField("seller_nickname", T.StringType()),
    T.StructField("categorias_distintas", T.DoubleType()),
    T.StructField("log_price_avg", T.DoubleType()),
    T.StructField("log_stock_avg", T.DoubleType()),
    T.StructField("num_publicaciones", T.DoubleType()),
    T.StructField("porc_descuento", T.DoubleType()),
    T.StructField("proporcion_refurb", T.DoubleType()),
    T.StructField("proporcion_usados", T.DoubleType()),
    T.StructField("rep_score", T.DoubleType()),
    T.StructField("titulo_length_avg", T.DoubleType()),
])


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Seller metric records (JSON lines) with an explicit schema (no inference pass)."""
    return spark.read.schema(METRICS_SCHEMA).json(path)
