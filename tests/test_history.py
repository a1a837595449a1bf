"""Label intervals, as-of labels, the strict funnel, dated campaigns and campaigns over the turn of the year."""
import datetime as dt

from pyspark.sql import functions as F

from sellerscope.operators import segments as sg

D = lambda s: dt.date.fromisoformat(s)


def test_label_intervals(spark):
    rows = [("a", 0, D("2020-01-01")), ("a", 0, D("2021-01-01")), ("a", 2, D("2022-01-01")), ("a", 0, D("2023-01-01")), ("b", None, D("2020-01-01")), ("b", 1, D("2021-01-01"))]
    got = {tuple(r) for r in sg.label_intervals(spark.createDataFrame(rows, "seller_nickname string, cluster_id int, label_date date")).collect()}
    assert got == {("a", 0, D("2020-01-01"), D("2022-01-01"), 2), ("a", 2, D("2022-01-01"), D("2023-01-01"), 1), ("a", 0, D("2023-01-01"), None, 1),
                   ("b", None, D("2020-01-01"), D("2021-01-01"), 1), ("b", 1, D("2021-01-01"), None, 1)}


def test_as_of_labels(spark):
    spans = spark.createDataFrame([("a", 1, D("2020-01-10")), ("a", None, D("2020-02-01")), ("a", 2, D("2020-03-01"))], "seller_nickname string, cluster_id int, valid_from date")
    days = ["2020-01-09", "2020-01-10", "2020-01-31", "2020-02-01", "2020-04-01"]
    events = spark.createDataFrame([("a", D(d)) for d in days] + [("zz", D("2020-05-01"))], "seller_nickname string, snapshot_on date")
    out = sg.as_of_labels(events, spans)
    assert [r.cluster_id for r in out.orderBy("seller_nickname", "snapshot_on").collect()] == [None, 1, 1, None, 2, None]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_strict_funnel(spark):
    paths = {"a": [0, 0, 2, 2, 1], "b": [0, 1, 2], "c": [2, 0, 2, 0, 1], "d": [1, 1], "e": [0, 2, 0, 2, 1]}
    rows = [(s, p, c) for s, path in paths.items() for p, c in enumerate(path)]
    got = [(r.step, r.cluster_id, r.sellers) for r in sg.migration_funnel(spark.createDataFrame(rows, "seller_nickname string, period int, cluster_id int"), (0, 2, 1)).orderBy("step").collect()]
    assert got == [(1, 0, 4), (2, 2, 3), (3, 1, 2)]
    empty = spark.createDataFrame([], "seller_nickname string, period int, cluster_id int")
    assert [r.sellers for r in sg.migration_funnel(empty, (0, 1)).collect()] == [0, 0]


def test_campaigns_over_the_turn_of_the_year(spark):
    calendar = [("turn", 12, 27, 1, 10, 1), ("long", 1, 5, 6, 30, 2)]
    days = ["1999-12-26", "1999-12-27", "2000-01-01", "2000-01-10", "2000-01-11", "2000-06-30", "2000-07-01"]
    want = [sg.NO_CAMPAIGN, "turn", "turn", "turn", "long", "long", sg.NO_CAMPAIGN]
    dates = spark.createDataFrame([(D(d),) for d in days], "d date")
    dated = sg.season_by_interval(dates, "d", sg.dated_calendar(spark, [1999, 2000], calendar), bucket_days=7)
    assert [r.season for r in dated.orderBy("date").collect()] == want
    assert [r.season for r in sg.season_context(dates, "d", calendar).orderBy("date").collect()] == want == [sg.season_of(d, calendar) for d in days]
    assert "NestedLoop" not in dated._jdf.queryExecution().executedPlan().toString()


def test_playbook_comes_from_the_caller(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 9)], "seller_nickname string, cluster_id int")
    got = {r.cluster_id: (r.action, r.kpi, r.sellers) for r in sg.segment_playbook(labels, {0: ("call", "calls")}).collect()}
    assert got == {0: ("call", "calls", 2), 9: (None, None, 1)}
    assert sg.segment_playbook(labels).where(F.col("cluster_id") == 0).first().action == "A0"
