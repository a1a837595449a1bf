"""Folder catalog: register every file of a folder as a temp view, list views.

File discovery uses Spark's ``binaryFile`` source with only the ``path``
column selected, so no file content is read and it works on any Hadoop file
system (local, HDFS, object stores).  Only file paths (metadata) reach the
driver.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, ext: str) -> list[str]:
    """Tables of a folder: its files ``*.{ext}``, and its sub-folders of that name (a table stored as part files)."""
    base = folder.rstrip("/")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", "true")
                  .load(base).select("path"))
    inner = F.regexp_extract("path", r"^(.*?/" + re.escape(base.rsplit("/", 1)[-1]) + r"/[^/]+\." + re.escape(ext) + r")(/.*)?$", 1)
    return sorted(r["t"] for r in found.select(inner.alias("t")).where("t <> ''").distinct().collect())


def view_name(path: str, prefix: str = "data", sep: str = "_") -> str:
    stem = os.path.basename(path.rstrip("/"))
    stem = stem.rsplit(".", 1)[0].replace("-", "_")
    return f"{prefix}{sep}{stem}" if prefix else stem


def read_any(spark: SparkSession, path: str, fmt: str, schema=None, infer_schema: bool = True) -> DataFrame:
    if fmt == "csv":
        r = spark.read.option("header", "true")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", str(infer_schema).lower())
        return r.csv(path)
    return spark.read.format(fmt).load(path)


def register_folder(spark: SparkSession, folder: str, fmt: str = "csv", prefix: str = "data",
                    schemas: dict | None = None) -> DataFrame:
    """Register each ``*.{fmt}`` file as a temp view ``{prefix}_{stem}`` (``-`` -> ``_``).

    Returns ``(view_name, path, format, n_columns)``.  Views are lazy: nothing
    is scanned until a query uses them (CSV schema inference aside; pass
    ``schemas`` to avoid the inference pass)."""
    rows = []
    for path in list_files(spark, folder, fmt):
        name = view_name(path, prefix)
        df = read_any(spark, path, fmt, (schemas or {}).get(name))
        df.createOrReplaceTempView(name)
        rows.append((name, path, fmt, len(df.columns)))
    return spark.createDataFrame(rows, "view_name string, path string, format string, n_columns int")


def list_views(spark: SparkSession, prefix: str = "data") -> DataFrame:
    """Temp views whose name starts with ``prefix``."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(prefix)]
    return spark.createDataFrame(sorted(rows), "view_name string, view_type string").where(F.lit(True))
