"""Registered profiling queries (ops 2.x, 3.x) over the 14 source columns of the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as corr
from ..operators import profile as pr
from ..operators import profile_store as ps
from ..operators import top_values as tv
from ..sources import sinks
from ..sources.listings import SOURCE_COLUMNS
from .oracle_sql import rnd, with_ctes
from .registry import ctx, register

# The listings fixture schema as the oracle sees it.
SOURCE_TYPES = [("tim_day", "date"), ("seller_nickname", "string"), ("titulo", "string"),
                ("seller_reputation", "string"), ("stock", "bigint"), ("logistic_type", "string"),
                ("condition", "string"), ("is_refurbished", "boolean"), ("price", "double"),
                ("regular_price", "double"), ("categoria", "string"), ("url", "string"),
                ("category_id", "string"), ("category_name", "string")]
NUMERIC = [c for c, t in SOURCE_TYPES if t in ("bigint", "double")]
TYPES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, '{t}')" for i, (c, t) in enumerate(SOURCE_TYPES)) + ") AS t(column_name, column_position, column_type)"

EXTRA = [
    ("vf", "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS freq FROM listings GROUP BY 2"
        for c in SOURCE_COLUMNS)),
    ("summ", "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) AS BIGINT) AS total_rows, CAST(COUNT(DISTINCT {c}) AS BIGINT) "
        f"AS distinct_values, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM listings"
        for c in SOURCE_COLUMNS)),
    ("ctypes", TYPES_SQL),
    ("nrows", "SELECT COUNT(*) AS n FROM listings"),
    ("topv", "SELECT column_name, value, CAST(freq AS BIGINT) AS freq, CAST(ROW_NUMBER() OVER (PARTITION BY column_name "
             "ORDER BY freq DESC, value ASC NULLS LAST) AS INTEGER) AS rank FROM vf"),
    ("entr", "SELECT column_name, ROUND(-SUM((freq / (SELECT n FROM nrows)) * log2(freq / (SELECT n FROM nrows) + 1e-9)), 3) "
             "AS entropy FROM vf GROUP BY column_name"),
    ("corrm", "\nUNION ALL\n".join(
        f"SELECT '{x}' AS col_x, '{y}' AS col_y, {i} AS x_position, {j} AS y_position, "
        f"ROUND(covar_samp({x}, {y}) / NULLIF(stddev_samp(CASE WHEN {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END) * "
        f"stddev_samp(CASE WHEN {x} IS NOT NULL THEN CAST({y} AS DOUBLE) END), 0), 2) AS corr FROM listings"
        for i, x in enumerate(NUMERIC) for j, y in enumerate(NUMERIC))),
]


def P(body: str) -> str:
    return with_ctes(body, *EXTRA)


def _vf(c):
    return c.vf


@register("table_dimensions", P("SELECT CAST(COUNT(*) AS BIGINT) AS row_count, CAST(14 AS INTEGER) AS column_count FROM listings"))
def q_dims(spark, sf_dir):
    """2.3: rows and columns."""
    return pr.table_dimensions(ctx(spark, sf_dir).source)


@register("table_schema")
def q_schema(spark, sf_dir):
    """2.1/2.2: column name, position, type, nullability (schema metadata)."""
    return pr.column_types(ctx(spark, sf_dir).source)


@register("type_counts")
def q_type_counts(spark, sf_dir):
    """2.4: number of columns per type."""
    return pr.type_counts(ctx(spark, sf_dir).source)


@register("value_frequency", P("SELECT column_name, value, CAST(freq AS BIGINT) AS freq FROM vf"))
def q_vf(spark, sf_dir):
    """The one-pass value-frequency table behind ops 3.1, 3.5-3.8."""
    return ctx(spark, sf_dir).vf


@register("column_summary", P("SELECT * FROM summ"))
def q_summary(spark, sf_dir):
    """3.1: total, distinct non-NULL, NULL count per column."""
    return ctx(spark, sf_dir).summary


@register("column_summary_approx")
def q_summary_approx(spark, sf_dir):
    """3.1 (approximate option): HyperLogLog distinct counts, no value-frequency shuffle (5 % rsd)."""
    return pr.approx_column_summary(ctx(spark, sf_dir).source)


@register("numeric_stats", P("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {rnd(f'MIN({c})', 'min_value')}, {rnd(f'MAX({c})', 'max_value')}, "
    f"{rnd(f'AVG({c})', 'mean_value')}, {rnd(f'STDDEV_SAMP({c})', 'stddev_value')} FROM listings" for c in NUMERIC)))
def q_numeric_stats(spark, sf_dir):
    """3.2/3.2b: min, max, mean, sample stddev of numeric columns (long form)."""
    return pr.numeric_stats(ctx(spark, sf_dir).source)


@register("numeric_whiskers", P("SELECT column_name, min_value, max_value, mean_value, " +
    rnd("ms - sd", "mean_minus_std") + ", " + rnd("ms + sd", "mean_plus_std") + " FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {rnd(f'MIN({c})', 'min_value')}, {rnd(f'MAX({c})', 'max_value')}, "
    f"{rnd(f'AVG({c})', 'mean_value')}, AVG({c}) AS ms, STDDEV_SAMP({c}) AS sd FROM listings" for c in NUMERIC) + ") t"))
def q_whiskers(spark, sf_dir):
    """3.19: mean +- std per numeric column, ordered by mean."""
    return pr.numeric_whiskers(pr.numeric_stats(ctx(spark, sf_dir).source))


@register("constant_columns", P("SELECT column_name, distinct_values FROM summ WHERE distinct_values = 1"))
def q_constant(spark, sf_dir):
    """3.3: columns with exactly one distinct non-NULL value."""
    return pr.constant_columns(ctx(spark, sf_dir).summary)


@register("constant_columns_threshold", P("SELECT column_name, distinct_values FROM summ WHERE distinct_values <= 5"))
def q_constant_threshold(spark, sf_dir):
    """3.3b: columns with at most five distinct non-NULL values."""
    return pr.constant_columns(ctx(spark, sf_dir).summary, max_distinct=5)


@register("null_fraction", P("SELECT column_name, " + rnd("CAST(null_count AS DOUBLE) / total_rows", "null_fraction") + " FROM summ"))
def q_null_fraction(spark, sf_dir):
    """3.4: NULL share (0-1) per column."""
    return pr.null_fraction(ctx(spark, sf_dir).summary)


@register("null_percent", P("SELECT column_name, " + rnd("100.0 * CAST(null_count AS DOUBLE) / total_rows", "null_percent") + " FROM summ"))
def q_null_percent(spark, sf_dir):
    """3.4b: NULL share as 0-100, descending."""
    return pr.null_fraction(ctx(spark, sf_dir).summary, percent=True)


@register("columns_with_nulls", P("SELECT column_name, " + rnd("CAST(null_count AS DOUBLE) / total_rows", "null_fraction") +
                                  " FROM summ WHERE null_count > 0"))
def q_cols_nulls(spark, sf_dir):
    """3.15: columns with any NULL, by share descending."""
    return pr.columns_with_nulls(ctx(spark, sf_dir).summary)


@register("top_values", P("SELECT * FROM topv WHERE rank <= 5"))
def q_top_values(spark, sf_dir):
    """3.5: top-5 values of every column (as the full profile calls it)."""
    return pr.top_values(ctx(spark, sf_dir).vf, 5)


@register("top_values_categorical", P(
    "SELECT * FROM topv WHERE rank <= 10 AND column_name IN (" +
    ", ".join(f"'{c}'" for c, t in SOURCE_TYPES if t not in ("bigint", "double")) + ")"))
def q_top_values_cat(spark, sf_dir):
    """3.5b: top-10 values of the non-numeric columns only."""
    c = ctx(spark, sf_dir)
    return pr.top_values(c.vf, 10, columns=pr.categorical_columns(c.source))


@register("top_values_column", P("SELECT * FROM topv WHERE rank <= 10 AND column_name = 'logistic_type'"))
def q_top_values_col(spark, sf_dir):
    """3.5b: top-10 values of one named column."""
    return pr.top_values(ctx(spark, sf_dir).vf, 10, columns=["logistic_type"])


@register("dominant_columns", P(
    "SELECT column_name, ROUND(MAX(freq) / (SELECT n FROM nrows), 3) AS dominance FROM vf GROUP BY column_name "
    "HAVING MAX(freq) / (SELECT n FROM nrows) >= 0.95"), keep=('dominance',))
def q_dominant(spark, sf_dir):
    """3.6: columns whose top value (NULL included) covers >= 95 % of rows."""
    c = ctx(spark, sf_dir)
    return pr.dominant_columns(c.vf, c.row_count, 0.95)


@register("column_entropy", P("SELECT * FROM entr"), keep=('entropy',))
def q_entropy(spark, sf_dir):
    """3.7: Shannon entropy (bits) per column, NULL as a value."""
    c = ctx(spark, sf_dir)
    return pr.column_entropy(c.vf, c.row_count)


@register("top_entropy", P("SELECT * FROM entr ORDER BY entropy DESC, column_name LIMIT 10"), keep=('entropy',))
def q_top_entropy(spark, sf_dir):
    """3.17: the ten columns of highest entropy."""
    c = ctx(spark, sf_dir)
    return pr.top_entropy(pr.column_entropy(c.vf, c.row_count), 10)


@register("two_valued_columns", P(
    "SELECT column_name, CAST(COUNT(*) AS BIGINT) AS n_values, MIN(value) AS first_value, "
    "CASE WHEN MAX(value) <> MIN(value) THEN MAX(value) END AS second_value, "
    "bool_or(value IS NULL) AS includes_null FROM vf GROUP BY column_name HAVING COUNT(*) BETWEEN 1 AND 2"))
def q_two_valued(spark, sf_dir):
    """3.8: columns with one or two distinct values (NULL counted)."""
    return pr.two_valued_columns(ctx(spark, sf_dir).vf)


_DATE_OK = ("((regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime({c}, '%Y-%m-%d') IS NOT NULL) OR "
            "(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND "
            "try_strptime({c}, '%Y-%m-%d %H:%M:%S') IS NOT NULL))")


@register("partial_date_columns", P(
    "SELECT column_name, ROUND(share, 2) AS parseable FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) FILTER (WHERE {_DATE_OK.format(c=c)}) AS DOUBLE) / "
        f"NULLIF(COUNT({c}), 0) AS share FROM listings" for c, t in SOURCE_TYPES if t == "string") +
    ") t WHERE share > 0 AND share < 1"))
def q_partial_dates(spark, sf_dir):
    """3.9: text columns partly parseable as dates (full scan, declared formats)."""
    return pr.partial_date_columns(ctx(spark, sf_dir).source)


PROFILE_SQL = ("SELECT s.column_name, CAST(t.column_position AS INTEGER) AS column_position, t.column_type, s.total_rows, "
               "s.distinct_values, s.null_count, " + rnd("CAST(s.null_count AS DOUBLE) / s.total_rows", "null_fraction") + ", "
               "ROUND(GREATEST(1.0 - CASE WHEN s.null_count > 0 THEN 0.2 ELSE 0.0 END "
               "- CASE WHEN s.distinct_values = 1 THEN 0.5 ELSE 0.0 END "
               "- CASE WHEN t.column_type = 'string' AND s.distinct_values > 100 THEN 0.1 ELSE 0.0 END, 0.0), 1) AS quality_score "
               "FROM summ s JOIN ctypes t ON s.column_name = t.column_name")


@register("column_profile", P(PROFILE_SQL.replace("ROUND(GREATEST(", "CAST(ROUND(GREATEST(").replace(", 1) AS quality_score", ", 1) AS DOUBLE) AS quality_score")), keep=('quality_score',))
def q_profile(spark, sf_dir):
    """3.10/3.11/3.20: summary + type + NULL share + quality score per column."""
    return ctx(spark, sf_dir).profile


@register("column_quality_score", P(
    "SELECT column_name, quality_score FROM (" +
    PROFILE_SQL.replace("ROUND(GREATEST(", "CAST(ROUND(GREATEST(").replace(", 1) AS quality_score", ", 1) AS DOUBLE) AS quality_score") +
    ") p"), keep=('quality_score',))
def q_quality(spark, sf_dir):
    """3.10: quality score per column, lowest first."""
    return ctx(spark, sf_dir).profile.select("column_name", "quality_score").orderBy("quality_score", "column_name")


@register("data_problems", P(
    "SELECT column_name, 'high_null_share' AS problem, " + rnd("CAST(null_count AS DOUBLE) / total_rows", "value") +
    " FROM summ WHERE CAST(null_count AS DOUBLE) / total_rows > 0.2 UNION ALL "
    "SELECT column_name, 'constant' AS problem, CAST(distinct_values AS DOUBLE) AS value FROM summ WHERE distinct_values = 1"))
def q_problems(spark, sf_dir):
    """3.14: high NULL share (> 20 %) and constant columns."""
    return pr.data_problems(ctx(spark, sf_dir).summary, 0.20)


@register("top_value_grid", P(
    "SELECT v.column_name, v.value, v.freq, v.rank, CAST(c.col_rank AS INTEGER) AS col_rank FROM topv v JOIN ("
    "SELECT column_name, ROW_NUMBER() OVER (ORDER BY listed DESC, column_position) AS col_rank FROM ("
    "SELECT t.column_name, COUNT(*) AS listed, MIN(ct.column_position) AS column_position FROM topv t "
    "JOIN ctypes ct ON t.column_name = ct.column_name WHERE t.rank <= 5 GROUP BY t.column_name) x) c "
    "ON v.column_name = c.column_name WHERE c.col_rank <= 5 AND v.rank <= 5"))
def q_grid(spark, sf_dir):
    """3.16: five columns with most listed values x their top five values."""
    c = ctx(spark, sf_dir)
    return pr.top_value_grid(pr.top_values(c.vf, 5), c.types, 5, 5)


@register("correlation_matrix", P("SELECT * FROM corrm"), keep=('corr',))
def q_corr(spark, sf_dir):
    """3.13: pairwise-complete Pearson correlation of numeric columns, 2 decimals."""
    return corr.correlation_matrix(ctx(spark, sf_dir).facts.select(*SOURCE_COLUMNS))


@register("correlation_lower", P("SELECT * FROM corrm WHERE x_position > y_position"), keep=('corr',))
def q_corr_lower(spark, sf_dir):
    """3.18: strict lower triangle of the correlation matrix."""
    return corr.correlation_lower(corr.correlation_matrix(ctx(spark, sf_dir).facts.select(*SOURCE_COLUMNS)))


def _stored_profile(c):
    """Sketches of the listings per month of publication, written once per data set; a second write replaces the months."""
    if getattr(c, "_profile_store", None) is None:
        path = c.path("profile-months")
        months = c.listings.withColumn("month", F.date_format("published_on", "yyyy-MM"))
        sinks.append_snapshot(ps.column_sketches(months, "month", SOURCE_COLUMNS), path, "period")
        c._profile_store = path
    return c.spark.read.parquet(c._profile_store)


def _exact_sql(c):
    number = c in NUMERIC
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, " +
            (f"COUNT({c}) AS numbers, {rnd(f'AVG({x})', 'mean', 8)}, {rnd(f'STDDEV_SAMP({x})', 'stddev', 8)}" if number else
             "0 AS numbers, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev") + " FROM listings")


@register("profile_from_stored_months", P("\nUNION ALL\n".join(map(_exact_sql, SOURCE_COLUMNS))), bits=8)
def q_stored_profile(spark, sf_dir):
    """3.12: the exact part of a profile merged from summaries stored per month, without reading the listings again."""
    return ps.exact_part(ps.merge_sketches(_stored_profile(ctx(spark, sf_dir)))).drop("least", "greatest")


@register("profile_estimates_of_stored_months", bits=8)
def q_stored_estimates(spark, sf_dir):
    """3.12: distinct values, quartiles and top values from the same store, within the stated errors (tests hold them to the facts)."""
    return ps.estimates(ps.merge_sketches(_stored_profile(ctx(spark, sf_dir))))


@register("top_values_by_digest", P("SELECT * FROM topv WHERE rank <= 10"))
def q_top_by_digest(spark, sf_dir):
    """3.5: the ten most frequent values of every column; only digests and listed texts are shuffled."""
    return tv.top_values_by_digest(ctx(spark, sf_dir).source, 10)
