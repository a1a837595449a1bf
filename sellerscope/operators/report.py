"""Text report of a profile: one ``(section, line_no, line)`` DataFrame.

Every section is a small table (one row per column, or the top rows per
metric), formatted with built-in string functions; the union is written as
text with one task (its size is bounded by schema width x top-N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import snap


def _lines(df: DataFrame, section: int, order_cols, text) -> DataFrame:
    w = Window.orderBy(*order_cols)  # bounded section tables
    return df.select(F.lit(section).alias("section"), F.row_number().over(w).alias("line_no"), text.alias("line"))


def _num(c):
    """Six decimals, halves away from zero, of the value on the grid of ``snap``; NULL by name."""
    return F.coalesce(snap(c).cast("decimal(30,6)").cast("string"), F.lit("NULL"))


def profile_report(dims: DataFrame, profile: DataFrame, numeric: DataFrame | None, top: DataFrame,
                   problems: DataFrame, top_sellers: DataFrame) -> DataFrame:
    secs = [
        _lines(dims, 1, [F.lit(1)], F.concat(F.lit("rows: "), F.col("row_count").cast("string"),
                                             F.lit(" | columns: "), F.col("column_count").cast("string"))),
        _lines(profile, 2, ["column_position"], F.concat_ws(
            " | ", "column_name", "column_type", F.col("total_rows").cast("string"),
            F.col("distinct_values").cast("string"), F.col("null_count").cast("string"),
            _num("null_fraction"), F.format_string("%.1f", F.col("quality_score")))),
        _lines(top, 4, ["column_name", "rank"], F.concat_ws(
            " | ", "column_name", F.coalesce(F.col("value"), F.lit("NULL")), F.col("freq").cast("string"))),
        _lines(problems, 5, ["problem", "column_name"], F.concat_ws(" | ", "problem", "column_name", _num("value"))),
        _lines(top_sellers, 6, ["metric", "rank"], F.concat_ws(
            " | ", "metric", F.col("rank").cast("string"), F.coalesce(F.col("seller_nickname"), F.lit("NULL")),
            _num("value"))),
    ]
    if numeric is not None:
        secs.append(_lines(numeric, 3, ["column_name"], F.concat_ws(
            " | ", "column_name", _num("min_value"), _num("max_value"), _num("mean_value"), _num("stddev_value"))))
    out = secs[0]
    for s in secs[1:]:
        out = out.unionByName(s)
    return out


def read_report(spark, path: str) -> DataFrame:
    """The lines of a written report: section, line_no, line."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).select(parts[0].cast("int").alias("section"), parts[1].cast("int").alias("line_no"), parts[2].alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    (lines.orderBy("section", "line_no")
          .select(F.concat_ws("\t", F.col("section").cast("string"), F.col("line_no").cast("string"), F.regexp_replace("line", "[\\n\\r]", " ")).alias("value"))
          .coalesce(1).write.mode("overwrite").text(path))
