from pyspark.sql import functions as F

from sellerscope.operators import correlation as corr
from sellerscope.operators import profile as pr

SCHEMA = "k string, const string, withnull string, flag string, wide string, maybe_date string, n double, c double"


def _df(spark):
    rows = []
    for i in range(200):
        rows.append((f"k{i % 3}", "same", None if i % 10 == 0 else ("v" if i % 2 else "u"),
                     None if i % 10 == 0 else "v", f"w{i}",
                     "2024-01-05" if i % 2 else "banana", float(i), 5.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_and_quality(spark):
    df = _df(spark)
    vf = pr.value_frequency(df)
    prof = {r["column_name"]: r for r in pr.column_profile(pr.column_summary(vf), pr.column_types(df)).collect()}
    assert prof["const"]["distinct_values"] == 1 and prof["const"]["quality_score"] == 0.5
    assert prof["withnull"]["null_count"] == 20 and prof["withnull"]["quality_score"] == 0.8
    assert prof["wide"]["quality_score"] == 0.9                      # text with > 100 distinct
    assert prof["withnull"]["null_fraction"] == 0.1
    const = [r["column_name"] for r in pr.constant_columns(pr.column_summary(vf)).collect()]
    assert sorted(const) == ["c", "const", "flag"]                   # one distinct non-NULL value


def test_dominance_entropy_two_valued(spark):
    df = _df(spark)
    vf = pr.value_frequency(df)
    n = df.select(F.count(F.lit(1))).scalar()
    dom = {r["column_name"]: r["dominance"] for r in pr.dominant_columns(vf, n, 0.95).collect()}
    assert dom == {"const": 1.0, "c": 1.0}
    ent = {r["column_name"]: r["entropy"] for r in pr.column_entropy(vf, n).collect()}
    assert ent["const"] == 0.0 and ent["maybe_date"] == 1.0
    two = {r["column_name"]: r for r in pr.two_valued_columns(vf).collect()}
    assert two["flag"]["n_values"] == 2 and two["flag"]["includes_null"]     # NULL counts as a value
    assert "withnull" not in two                                              # u, v and NULL
    assert (two["maybe_date"]["first_value"], two["maybe_date"]["second_value"]) == ("2024-01-05", "banana")


def test_top_values_ties_and_window_limit(spark):
    df = _df(spark)
    vf = pr.value_frequency(df)
    top = pr.top_values(vf, 2, columns=["k"]).orderBy("rank").collect()
    assert [(r["value"], r["freq"]) for r in top] == [("k0", 67), ("k1", 67)]
    plan = pr.top_values(vf, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_partial_dates_full_scan(spark):
    out = {r["column_name"]: r["parseable"] for r in pr.partial_date_columns(_df(spark)).collect()}
    assert out == {"maybe_date": 0.5}


def test_constant_column_correlation_is_null(spark):
    rows = {(r["col_x"], r["col_y"]): r["corr"] for r in corr.correlation_matrix(_df(spark)).collect()}
    assert rows[("n", "n")] == 1.0
    assert rows[("n", "c")] is None and rows[("c", "c")] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    vf = pr.value_frequency(df)
    rows = pr.column_summary(vf, pr.column_types(df)).collect()
    assert len(rows) == len(df.columns) and all((r["total_rows"], r["distinct_values"], r["null_count"]) == (0, 0, 0) for r in rows)
    assert pr.table_dimensions(df).collect()[0]["row_count"] == 0
    assert pr.numeric_stats(df).collect()[0]["mean_value"] is None
