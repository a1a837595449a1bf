"""Elbow (knee) of a decreasing convex curve with the Kneedle rule
(Satopaa et al., 2011), offline variant, sensitivity S.

The curve is a small table ``(k, inertia)`` (one row per tried k, bounded by
the sweep); the rule is written as window expressions over it:

1. normalise x and y to [0, 1]; for a convex decreasing curve use y' = 1 - y_n;
2. difference curve d = y' - x_n;
3. local maxima / minima of d (>= / <= both neighbours, edges compared with
   themselves);
4. threshold at a maximum: d - S * mean(diff(x_n)); after a minimum: 0;
5. the knee is the last maximum before the first point whose successor's d
   falls below the current threshold.  No knee -> ``fallback``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kneedle(curve: DataFrame, x="k", y="inertia", sensitivity: float = 1.0, fallback: int | None = 3) -> DataFrame:
    """One row ``(elbow_k, found)``."""
    w_all = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = Window.orderBy("x")
    c = (curve.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
              .withColumn("i", F.row_number().over(w) - 1)
              .withColumn("n", F.count(F.lit(1)).over(w_all))
              .withColumn("xmin", F.min("x").over(w_all)).withColumn("xmax", F.max("x").over(w_all))
              .withColumn("ymin", F.min("y").over(w_all)).withColumn("ymax", F.max("y").over(w_all))
              .withColumn("xn", F.try_divide(F.col("x") - F.col("xmin"), F.col("xmax") - F.col("xmin")))
              .withColumn("yn", F.try_divide(F.col("y") - F.col("ymin"), F.col("ymax") - F.col("ymin")))
              .withColumn("d", (F.lit(1.0) - F.col("yn")) - F.col("xn")))
    prev_d = F.coalesce(F.lag("d").over(w), F.col("d"))
    next_d = F.coalesce(F.lead("d").over(w), F.col("d"))
    c = (c.withColumn("is_max", (F.col("d") >= prev_d) & (F.col("d") >= next_d))
          .withColumn("is_min", (F.col("d") <= prev_d) & (F.col("d") <= next_d))
          .withColumn("next_d", F.lead("d").over(w))
          .withColumn("step", F.try_divide(F.lit(1.0), F.col("n") - 1)))
    # threshold in force at i: set by the latest max or min at or before i (a min wins at the same i)
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.col("is_min"), F.lit(0.0)).when(F.col("is_max"), F.col("d") - F.lit(sensitivity) * F.col("step"))
    c = (c.withColumn("threshold", F.last(event, ignorenulls=True).over(upto))
          .withColumn("max_x", F.last(F.when(F.col("is_max"), F.col("x")), ignorenulls=True).over(upto))
          .withColumn("seen_max", F.max(F.col("is_max").cast("int")).over(upto)))
    hits = c.where((F.col("seen_max") == 1) & (F.col("i") < F.col("n") - 1) & (F.col("next_d") < F.col("threshold")))
    first = hits.agg(F.min_by("max_x", "i").alias("knee"))
    out = first.select(F.coalesce(F.col("knee").cast("int"), F.lit(fallback).cast("int")).alias("elbow_k"),
                       F.col("knee").isNotNull().alias("found"))
    return out
