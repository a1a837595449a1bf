"""Euclidean silhouette against anchors and mini-batch k-means, held against brute force and the full fit."""
import numpy as np
import pytest

from sellerscope.operators import kmeans as km
from sellerscope.operators.euclidean import euclidean_silhouette
from sellerscope.operators.minibatch import fit_minibatch

NAMES = "seller_nickname string, cluster_id int, a double, b double"


def points(n=600, seed=3):
    r = np.random.default_rng(seed)
    return [(f"s{i}", i % 3, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(n, 2)) * 1.2 + np.array([[0, 0], [3, 1], [1, 4]])[np.arange(n) % 3])]


def silhouette_by_hand(rows):
    x, c = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(rows)):
        own = (c == c[i]).sum()
        if own == 1:
            s.append(0.0)
            continue
        a, b = d[i, c == c[i]].sum() / (own - 1), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(s))


def test_exact_where_all_members_are_anchors(spark):
    rows = points(90) + [("alone", 7, 9.0, 9.0)]
    r = euclidean_silhouette(spark.createDataFrame(rows, NAMES).repartition(4), ["a", "b"]).first()
    assert abs(r.silhouette_euclidean - silhouette_by_hand(rows)) < 1e-9 and r.standard_error == 0 and r.anchors == 91 and r.n_clusters == 4


@pytest.mark.parametrize("anchors", [32, 100])
def test_within_the_stated_error(spark, anchors):
    rows = points()
    r = euclidean_silhouette(spark.createDataFrame(rows, NAMES).repartition(3), ["a", "b"], anchors=anchors).first()
    assert r.anchors == 3 * anchors and 0 < r.standard_error < 0.05
    assert abs(r.silhouette_euclidean - silhouette_by_hand(rows)) < 3 * r.standard_error


def test_one_cluster_and_nulls(spark):
    one = euclidean_silhouette(spark.createDataFrame([("x", 0, 1.0, 2.0)], NAMES), ["a", "b"]).first()
    assert one.n_clusters == 1 and one.silhouette_euclidean is None
    rows = points(60)
    df = spark.createDataFrame(rows + [("n", 1, None, 2.0)], NAMES)
    assert abs(euclidean_silhouette(df, ["a", "b"]).first().silhouette_euclidean - silhouette_by_hand(rows)) < 1e-9


def test_minibatch_is_near_the_full_fit_in_any_layout(spark):
    df = spark.createDataFrame(points(900), NAMES).select("seller_nickname", "a", "b")
    full = km.fit_sweep(df, [2, 3], ["a", "b"], n_init=3, max_iter=50)
    one, other = (fit_minibatch(df.repartition(n), [2, 3], ["a", "b"]) for n in (1, 7))
    for k in (2, 3):
        assert one[k][1] <= 1.03 * full[k][1] and abs(one[k][1] - other[k][1]) < 1e-6 * one[k][1]
        assert np.allclose(one[k][0], other[k][0])
    with pytest.raises(ValueError):
        fit_minibatch(spark.createDataFrame([("x", None, 1.0)], "seller_nickname string, a double, b double"), [1], ["a", "b"])
