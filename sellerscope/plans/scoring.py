"""End-to-end seller model: features -> exact scaler -> scaled matrix -> segments.

Physical notes: the seller table is the only wide intermediate; it is
persisted (MEMORY_AND_DISK, recomputable from lineage if an executor is lost)
because the scaler fit, the transform and k-means all read it.  Scaler
parameters and centroids are per-feature / per-cluster constants (collected,
bounded), so scaling and assignment are map-only projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators.features import FEATURES, seller_features
from ..operators.kmeans import assign_segments, fit_kmeans, quantile_profile_centroids
from ..operators.preprocess import robust_scale, scaler_params
from ..sources import sinks
from ..operators.segments import canonical_ids, name_segments, relabel, relabel_centroids


@dataclass
class SellerModel:
    features: DataFrame   # seller_nickname + nine raw features
    params: DataFrame     # feature, median, q25, q75, scale
    scaled: DataFrame     # seller_nickname + nine scaled features


def build_seller_model(listings: DataFrame, persist: bool = True) -> SellerModel:
    feats = seller_features(listings)
    if persist:
        feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    params = scaler_params(feats)
    if persist:
        params = params.persist(StorageLevel.MEMORY_AND_DISK)
    scaled = robust_scale(feats, params)
    if persist:
        scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    return SellerModel(feats, params, scaled)


def reference_centroids(model: SellerModel) -> DataFrame:
    """Deterministic 3-centroid model (per-feature quantile profiles 0.1/0.5/0.9)."""
    return quantile_profile_centroids(model.scaled)


def save_model(path: str, params: DataFrame, centroids: DataFrame) -> None:
    """Write a fitted model: scaler parameters, and centroids under their canonical ids, so that
    later scorings use the ids of the fit and never number the clusters anew."""
    sinks.save_params(params, f"{path}/scaler")
    sinks.save_params(centroids, f"{path}/centroids")


def load_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(scaler parameters, centroids) of a saved model."""
    return sinks.load_params(spark, f"{path}/scaler"), sinks.load_params(spark, f"{path}/centroids")


def segment_sellers(model: SellerModel, k: int = 3, *, n_init: int = 10, max_iter: int = 300, seed: int = 42,
                    fits: dict | None = None):
    """Fit k-means (or take k's best run from a sweep), relabel canonically, name.
    Returns (labels, centroids, cost)."""
    if fits is not None and k in fits:
        from ..operators.kmeans import _centroid_frame
        cents, cost = _centroid_frame(model.scaled.sparkSession, fits[k][0], FEATURES), fits[k][1]
    else:
        cents, cost = fit_kmeans(model.scaled, k, FEATURES, n_init=n_init, max_iter=max_iter, seed=seed)
    raw = assign_segments(model.scaled, cents)
    mapping = canonical_ids(raw, model.scaled)
    labels = name_segments(relabel(raw, mapping))
    return labels, relabel_centroids(cents, mapping), cost
