from pyspark.sql import functions as F

from sellerscope.functions.quantiles import exact_quantiles


def test_exact_matches_percentile_with_refinement(spark):
    df = spark.range(0, 20011).select((F.col("id") % 5).alias("g"),
                                      ((F.col("id") * 7919) % 20011 / 7.0).alias("x"),
                                      (F.col("id") % 13).cast("double").alias("y"))
    got = {(r.g, r.column, r.p): r.quantile for r in
           exact_quantiles(df, ["x", "y"], [0.1, 0.5, 0.75], by=["g"], max_bracket=300).collect()}
    ref = df.groupBy("g").agg(*[F.percentile(c, p).alias(f"{c}_{p}") for c in "xy" for p in (0.1, 0.5, 0.75)]).collect()
    for r in ref:
        for c in "xy":
            for p in (0.1, 0.5, 0.75):
                assert abs(got[(r.g, c, p)] - r[f"{c}_{p}"]) < 1e-9


def test_null_group_and_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", 2.0, None)], "g string, x double, z double")
    got = {(r.g, r.column): r.quantile for r in exact_quantiles(df, ["x", "z"], [0.5], by=["g"]).collect()}
    assert got[(None, "x")] == 2.0 and got[("a", "x")] == 2.0
    assert got[(None, "z")] is None and got[("a", "z")] is None


def test_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    got = {r.p: r.quantile for r in exact_quantiles(df, ["x"], [0.5, 0.25, 0.75]).collect()}
    assert got == {0.5: 2.5, 0.25: 1.75, 0.75: 3.25}


def test_many_groups_with_hot_ones(spark):
    """Beyond ``small`` brackets: hot groups by broadcast, the others by key; NULL groups too."""
    df = spark.range(0, 9000).select(F.when(F.col("id") < 4000, F.lit(None).cast("long")).otherwise(F.col("id") % 700).alias("g"), ((F.col("id") * 7919) % 9001 / 3.0).alias("x"))
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.9).alias("b")).collect()}
    got = {}
    for r in exact_quantiles(df, ["x"], [0.5, 0.9], by=["g"], max_bracket=300, small=0).collect():
        got.setdefault(r.g, {})[r.p] = r.quantile
    assert set(got) == set(want) and all(abs(got[g][0.5] - a) < 1e-9 and abs(got[g][0.9] - b) < 1e-9 for g, (a, b) in want.items())


def test_fact_rows_are_not_dealt_by_group(spark):
    """With automatic broadcast off, brackets of few groups still meet the rows without an exchange of the rows."""
    from sellerscope.functions import quantiles as q
    df = spark.range(0, 1000).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        long = q._long(df, ["x"], ["g"])
        bounds = long.groupBy("g", "column").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("p", F.lit(0.5))
        plan = q._in_bracket(long, bounds, ["g", "column"], ["g", "column", "p"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan  # that of the bounds' own aggregate
