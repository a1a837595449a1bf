"""Stream scoring: JSON seller-metric records -> impute/scale -> nearest centroid -> segment name.

The fitted model (per-feature median/scale, k centroids) is compiled into
literal expressions, so every micro-batch is a stateless projection: no
state store, no stream-static join, no shuffle.  Progress and exactly-once
file output come from the checkpoint location, which must be on a shared file
system on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import FEATURES
from ..operators.kmeans import assign_expr, collect_centroids
from ..operators.preprocess import robust_scale
from ..operators.segments import segment_name
from ..sources.sinks import METRICS_SCHEMA


def score_frame(records: DataFrame, params: DataFrame, centroids: DataFrame, key="seller_nickname") -> DataFrame:
    """Works on batch and streaming DataFrames alike."""
    scaled = robust_scale(records, params, key=key)
    cid, dist = assign_expr(collect_centroids(centroids, FEATURES), FEATURES)
    return scaled.select(key, cid.alias("cluster_id"), dist.alias("distance2")).withColumn(
        "segment_name", segment_name("cluster_id"))


def start_scoring_stream(spark: SparkSession, source_dir: str, params: DataFrame, centroids: DataFrame,
                         sink_dir: str, checkpoint_dir: str, available_now: bool = False,
                         max_files_per_trigger: int = 100):
    stream = (spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                   .json(source_dir))
    scored = score_frame(stream, params, centroids)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
               .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
