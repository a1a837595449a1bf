"""Principal components of the scaled seller matrix.

Means and sample covariance come from one scan (``gram``: centred partials,
merged pairwise); only that p x p matrix (p = 9) reaches the driver, where its
eigen-decomposition is computed.  Projection is then a projection (centred
dot products with literal loadings): no shuffle.  Spark ML's PCA does not
centre in ``transform``; this does, like scikit-learn.  Component signs are
fixed so that the largest absolute loading of each component is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import FEATURES
from .gram import means_and_covariance


@dataclass
class PCAFit:
    columns: list
    means: list
    components: np.ndarray      # n_components x p
    explained_variance: np.ndarray
    total_variance: float


def fit_pca(df: DataFrame, columns=FEATURES, n_components: int = 2) -> PCAFit:
    cols = list(columns)
    _, means, cov = means_and_covariance(df, cols)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:n_components]
    comps = vecs[:, order].T.copy()
    for i in range(comps.shape[0]):
        j = int(np.argmax(np.abs(comps[i])))
        if comps[i, j] < 0:
            comps[i] = -comps[i]
    return PCAFit(cols, means.tolist(), comps, vals[order], float(np.trace(cov)))


def pca_projection(df: DataFrame, fit: PCAFit, key="seller_nickname") -> DataFrame:
    outs = []
    for i, comp in enumerate(fit.components):
        acc = None
        for c, m, w in zip(fit.columns, fit.means, comp):
            t = (F.col(c) - F.lit(m)) * F.lit(float(w))
            acc = t if acc is None else acc + t
        outs.append(acc.alias(f"pc{i + 1}"))
    return df.select(*([key] if key else []), *outs)


def pca_inverse(projected: DataFrame, fit: PCAFit, key="seller_nickname") -> DataFrame:
    """Features from component coordinates: means plus loadings times coordinates (a projection: no shuffle).

    With fewer components than columns this is the nearest table of that rank; with all of them, the table itself."""
    outs = []
    for j, (c, m) in enumerate(zip(fit.columns, fit.means)):
        back = sum((F.col(f"pc{i + 1}") * F.lit(float(v[j])) for i, v in enumerate(fit.components)), F.lit(float(m)))
        outs.append(back.alias(c))
    return projected.select(*([key] if key else []), *outs)


def pca_loadings(spark, fit: PCAFit, decimals: int = 3) -> DataFrame:
    rows = [(c, *[round(float(fit.components[i, j]), decimals) for i in range(fit.components.shape[0])])
            for j, c in enumerate(fit.columns)]
    schema = "feature string, " + ", ".join(f"pc{i + 1} double" for i in range(fit.components.shape[0]))
    return spark.createDataFrame(rows, schema)


def pca_top_features(loadings: DataFrame, n: int = 5) -> DataFrame:
    """Top-``n`` features by absolute loading for each component (9 x 2 rows: bounded)."""
    pcs = [c for c in loadings.columns if c.startswith("pc")]
    long = loadings.select("feature", F.inline(F.array(*[
        F.struct(F.lit(pc).alias("component"), F.abs(F.col(pc)).alias("abs_loading")) for pc in pcs])))
    w = Window.partitionBy("component").orderBy(F.desc("abs_loading"), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def explained_variance(spark, fit: PCAFit) -> DataFrame:
    rows = [(f"pc{i + 1}", float(v), float(v) / fit.total_variance if fit.total_variance else None)
            for i, v in enumerate(fit.explained_variance)]
    return spark.createDataFrame(rows, "component string, variance double, ratio double")
