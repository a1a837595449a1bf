"""What the shared inputs move: facts by pruned joins, sketches once per bracket."""
from pyspark.sql import functions as F

from sellerscope.functions import quantiles as q
from sellerscope.plans import registry
from sellerscope.sources.listings import build_listings


def tables(spark):
    l = spark.createDataFrame([(1, 10, 1, 2.0, 30.0, 0.08, 0.01, "R", "F", "1996-01-01"), (1, 11, 2, 1.0, 5.0, 0.0, 0.08, "A", "F", "1996-01-02"),
                               (1, 10, 1, 2.0, 30.0, 0.08, 0.01, "R", "F", "1996-01-01"), (9, 10, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", "1996-01-03"),
                               (None, 10, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", "1996-01-03")],
                              "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                              "l_returnflag string, l_linestatus string, l_shipdate string")
    o = spark.createDataFrame([(1, 5, "1-URGENT", "1996-01-01"), (1, 6, "5-LOW", "1996-01-01"), (9, 99, "2-HIGH", "1996-01-01"), (None, 5, "2-HIGH", "1996-01-01")],
                              "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string")
    c = spark.createDataFrame([(5, "five", 0), (6, "six", 9), (None, "none", 1)], "c_custkey long, c_name string, c_nationkey int")
    p = spark.createDataFrame([(10, "ten", "B1", "T"), (11, None, "B2", "T"), (None, "none", "B3", "T")], "p_partkey long, p_name string, p_brand string, p_type string")
    return l, o, c, p


def test_listings_keep_repeated_keys_and_drop_unmatched_ones(spark):
    got = sorted((r.seller_nickname, r.titulo, r.price) for r in build_listings(*tables(spark)).collect())
    # order 1 is there twice, its first line too; order 9 has no customer, the NULL order no line
    assert got == sorted((s, *x) for s in ("five", "six") for x in (("ten B1 T", 15.0), ("ten B1 T", 15.0), ("B2 T", 5.0)))


def test_line_items_are_shuffled_once_before_parts(spark):
    """With nothing broadcast, customers meet the orders: line items meet the joined orders, then the parts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = build_listings(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert [next(k for k in ("l_partkey", "l_orderkey", "o_custkey") if k in x) for x in joins] == ["l_partkey", "l_orderkey", "o_custkey"]


def test_the_model_and_correlations_write_no_fixture(spark):
    c = registry.Context(spark, "/root/testdata/sf0.001")
    assert c.model.scaled.count() > 0 and getattr(c, "_listings_path", None) is None  # before: all columns of all listings written first
    c.close()
    assert sorted(c.facts.columns) == sorted(c.listings.columns) and c.facts.inputFiles() == c.listings.inputFiles()


def test_targets_of_one_bracket_share_its_sketch(spark, monkeypatch):
    sketched, plain = [], q._in_bracket

    def seen(long, bounds, keys, tkeys, extra=(), hot=None):
        if "at" in tkeys:
            sketched.append(bounds.count())
        return plain(long, bounds, keys, tkeys, extra, hot)
    monkeypatch.setattr(q, "_in_bracket", seen)
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).cast("double").alias("x"))
    got = {r.p: r.quantile for r in q.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], max_bracket=1000).collect()}
    assert sketched[0] == 1  # three before, each over all rows
    for p, v in got.items():
        assert abs(v - df.select(F.percentile("x", p)).first()[0]) < 1e-9
