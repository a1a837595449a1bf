import numpy as np
from pyspark.sql import functions as F

from sellerscope.operators import pca
from sellerscope.operators import segments as sg


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4)) @ np.array([[3, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0.5, 0], [0, 0, 0, 0.1]])
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(f"s{i}", *map(float, r)) for i, r in enumerate(x)],
                               "seller_nickname string, " + ", ".join(f"{c} double" for c in cols))
    fit = pca.fit_pca(df, cols, 2)
    comps = fit.components
    assert np.allclose(comps @ comps.T, np.eye(2), atol=1e-9)
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    for i in range(2):
        v = vt[i] * np.sign(vt[i][np.argmax(np.abs(vt[i]))])
        assert np.allclose(comps[i], v, atol=1e-8)
    proj = pca.pca_projection(df, fit).toPandas()
    assert np.allclose(proj[["pc1", "pc2"]].var(ddof=1).to_numpy(), fit.explained_variance, rtol=1e-8)


def test_canonical_relabel_stable_under_permutation(spark):
    scaled = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate([0, 0, 0, 0, 5, 5, 9])],
                                   "seller_nickname string, num_publicaciones double")
    base = [0, 0, 0, 0, 1, 1, 2]
    for perm in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        labels = spark.createDataFrame([(f"s{i}", perm[c]) for i, c in enumerate(base)], "seller_nickname string, cluster_id int")
        out = {r["seller_nickname"]: r["cluster_id"] for r in sg.relabel(labels, sg.canonical_ids(labels, scaled)).collect()}
        assert out["s6"] == 1 and out["s4"] == 2 and out["s0"] == 0     # power, growing, occasional


def test_season_context_and_prompt(spark):
    dates = spark.createDataFrame([("2024-11-25",), ("2024-11-21",), ("2024-10-10",), ("2024-08-01",)], "d string") \
        .select(F.col("d").cast("date").alias("d"))
    got = {str(r["date"]): r["season"] for r in sg.season_context(dates, "d").collect()}
    assert got == {"2024-11-25": "Cyberlunes", "2024-11-21": "Black Sale", "2024-10-10": sg.NO_CAMPAIGN,
                   "2024-08-01": "Temporada baja"}
    payload = spark.createDataFrame(
        [("2024-08-01", "s", "Power Sellers", 120, 15, 124.0, 105000, 0.27, 4.1, None)],
        "fecha_actual string, seller_nickname string, cluster_name string, publicaciones long, "
        "categorias_distintas long, stock_promedio double, precio_medio_cop long, descuento_pct double, "
        "rep_score double, tasa_cancelacion double")
    text = sg.strategy_prompts(payload).collect()[0]["prompt"]
    assert "price, mean = 105,000" in text and "discount, mean = 27%" in text and "cancelled = n/d" in text
