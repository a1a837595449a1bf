"""Covariance from stored partials: any split of the rows gives the batch covariance, far from zero too."""
import numpy as np

from sellerscope.operators import gram
from sellerscope.operators.pca import fit_pca
from sellerscope.sources.sinks import append_snapshot

NAMES = ["a", "b", "c"]


def rows(n=500, offset=1e7, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, 3)) @ np.array([[1, .4, 0], [0, 1, .2], [0, 0, .5]]) + offset
    return x, [(f"2024-0{i % 3 + 1}", *map(float, r)) for i, r in enumerate(x)]


def frame(spark, data):
    return spark.createDataFrame(data, "month string, a double, b double, c double")


def matrix(df):
    out = np.zeros((3, 3))
    for r in df.collect():
        out[r.x_position, r.y_position] = r.covariance
    return out


def test_any_layout_equals_the_batch_covariance_far_from_zero(spark):
    x, data = rows()
    want = np.cov((x - 1e7).T)
    for parts in (1, 7):
        got = gram.merge_partials(gram.gram_partials(frame(spark, data).repartition(parts), NAMES))
        assert np.allclose(matrix(gram.covariance_from_partials(got, NAMES)), want, rtol=1e-9, atol=1e-9)
        assert np.allclose(got.first().means, x.mean(0), rtol=1e-15)
    fit = fit_pca(frame(spark, data), NAMES, 3)
    assert np.allclose(fit.explained_variance, np.sort(np.linalg.eigvalsh(want))[::-1], rtol=1e-8)


def test_months_stored_replaced_and_merged(spark, tmp_path):
    x, data = rows()
    path = str(tmp_path / "partials")
    wrong = [(m, a + 1, b, c) for m, a, b, c in data if m == "2024-02"]
    for batch in (data[:1], wrong, data):  # a later write of a month replaces it
        part = gram.gram_partials(frame(spark, batch).repartition(3), NAMES, ["month"])
        append_snapshot(gram.merge_partials(part, ["month"]), path, "month")
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    months = gram.covariance_from_partials(gram.merge_partials(stored, ["month"]), NAMES, ["month"])
    one = np.cov(np.array([r[1:] for r in data if r[0] == "2024-02"]).T - 1e7)
    assert np.allclose(matrix(months.where("month = '2024-02'")), one, rtol=1e-9, atol=1e-9)
    assert np.allclose(matrix(gram.covariance_from_partials(gram.merge_partials(stored), NAMES)), np.cov((x - 1e7).T), rtol=1e-9, atol=1e-9)


def test_nulls_are_skipped_empty_and_single_rows(spark):
    data = [("m", 1.0, 2.0, None), (None, 1.0, 2.0, 3.0), ("m", 2.0, 4.0, 1.0), ("m", float("nan"), 0.0, 0.0)]
    got = {r.month: r for r in gram.merge_partials(gram.gram_partials(frame(spark, data), NAMES, ["month"]), ["month"]).collect()}
    assert (got["m"].n, got["m"].skipped) == (1, 2) and got[None].n == 1
    single = gram.covariance_from_partials(gram.merge_partials(gram.gram_partials(frame(spark, data[1:2]), NAMES)), NAMES)
    assert all(r.covariance is None for r in single.collect())
    assert gram.merge_partials(gram.gram_partials(frame(spark, []), NAMES)).count() == 0
    assert gram.means_and_covariance(frame(spark, []), NAMES)[0] == 0


def test_many_keys_leave_a_task_in_batches(spark, monkeypatch):
    data = [(str(i % 50), float(i), 1.0, 2.0) for i in range(400)]
    monkeypatch.setattr(gram, "KEYS_HELD", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        part = gram.gram_partials(frame(spark, data).coalesce(1), NAMES, ["month"])
        got = gram.merge_partials(part, ["month"])
        assert part.count() > 50 and got.count() == 50 and all(r.n == 8 for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_scan_and_no_fact_rows_shuffled(spark):
    part = gram.gram_partials(frame(spark, rows(20)[1]), NAMES)
    assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
