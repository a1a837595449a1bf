"""The knee of a fixed curve by hand, features rebuilt from components, and the report's numbers."""
import numpy as np
import pytest

from sellerscope.operators import pca, report
from sellerscope.operators.elbow import kneedle


def knee_by_hand(ys, fallback=3):
    """The rule in plain Python over k = 1..n."""
    n, lo, hi = len(ys), min(ys), max(ys)
    if n < 2 or hi == lo:
        return fallback, False
    d = [1 - (y - lo) / (hi - lo) - i / (n - 1) for i, y in enumerate(ys)]
    limit = knee = None
    for i in range(n - 1):
        before, after = d[max(i - 1, 0)], d[i + 1]
        if d[i] >= before and d[i] >= after:
            knee, limit = i + 1, d[i] - 1 / (n - 1)
        if d[i] <= before and d[i] <= after:
            limit = 0.0
        if knee is not None and after < limit:
            return knee, True
    return fallback, False


CURVES = [[100, 40, 15, 12, 10, 9, 8.5], [10, 9, 8, 7, 6, 5, 4], [100, 99, 40, 39, 10, 9, 8, 7.5, 7], [5, 5, 5], [7], [1000 / k for k in range(1, 15)],
          [1000 / k ** 2 for k in range(1, 15)], [64, 32, 31, 8, 7.75, 2, 1.5, 1]]


@pytest.mark.parametrize("ys", CURVES)
def test_knee_of_a_fixed_curve(spark, ys):
    got = kneedle(spark.createDataFrame([(i + 1, float(y)) for i, y in enumerate(ys)], "k int, inertia double").repartition(3)).first()
    assert (got.elbow_k, got.found) == knee_by_hand([float(y) for y in ys])


def test_features_from_components(spark):
    x = np.random.default_rng(5).normal(size=(80, 3)) @ np.array([[3, 1, 0], [0, 1, 2], [0, 0, 0.1]]) + 1e4
    df = spark.createDataFrame([(f"s{i}", *map(float, v)) for i, v in enumerate(x)], "seller_nickname string, a double, b double, c double")
    full = pca.fit_pca(df, ["a", "b", "c"], 3)
    back = pca.pca_inverse(pca.pca_projection(df, full), full).toPandas().set_index("seller_nickname").loc[[f"s{i}" for i in range(80)]].to_numpy()
    assert np.abs(back - x).max() < 1e-8
    two = pca.fit_pca(df, ["a", "b", "c"], 2)
    rest = pca.pca_inverse(pca.pca_projection(df, two), two).toPandas().set_index("seller_nickname").loc[[f"s{i}" for i in range(80)]].to_numpy()
    assert abs(((rest - x) ** 2).sum() / 79 - full.explained_variance[2]) < 1e-6 * full.total_variance


def test_numbers_of_the_report(spark):
    rows = [(0.0078125,), (-0.0078125,), (None,), (0.1 + 0.2,), (12345678.9,), (0.0,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double").coalesce(1).select(report._num("v")).collect()]
    assert got == ["0.007813", "-0.007813", "NULL", "0.300000", "12345678.900000", "0.000000"]
