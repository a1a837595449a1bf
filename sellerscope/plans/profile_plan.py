"""Full profile of a table (op 3.12) as a bundle of lazy DataFrames over one persisted vf."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation as corr
from ..operators import profile as pr
from ..operators import report as rp
from ..operators import sellers as sm


@dataclass
class Profile:
    dimensions: DataFrame
    schema: DataFrame
    summary: DataFrame
    numeric_stats: DataFrame | None
    constant_columns: DataFrame
    null_fraction: DataFrame
    top_values: DataFrame
    dominant_columns: DataFrame
    entropy: DataFrame
    two_valued: DataFrame
    partial_dates: DataFrame
    correlation: DataFrame | None
    profile: DataFrame
    problems: DataFrame
    seller_metrics: DataFrame | None
    vf: DataFrame

    def report(self, top_sellers_n: int = 10) -> DataFrame:
        ts = sm.top_sellers_by_metric(self.seller_metrics, top_sellers_n) if self.seller_metrics is not None else \
            self.top_values.limit(0).select(F.lit("").alias("metric"), F.lit("").alias("seller_nickname"),
                                            F.lit(0.0).alias("value"), F.lit(0).alias("rank"))
        return rp.profile_report(self.dimensions, self.profile, self.numeric_stats, self.top_values, self.problems, ts)

    def unpersist(self):
        self.vf.unpersist()


def profile(df: DataFrame, top_n: int = 5, seller_df: DataFrame | None = None, columns=None,
            vf: DataFrame | None = None) -> Profile:
    """``vf``: the value-frequency table, where the caller holds it already (else one is persisted here; see ``unpersist``)."""
    cols = list(columns) if columns is not None else list(df.columns)
    d = df.select(*cols)
    vf = pr.value_frequency(d).persist(StorageLevel.MEMORY_AND_DISK) if vf is None else vf
    types = pr.column_types(d)
    summary = pr.column_summary(vf, types)
    n = d.select(F.count(F.lit(1))).scalar()
    return Profile(
        dimensions=pr.table_dimensions(d), schema=types, summary=summary, numeric_stats=pr.numeric_stats(d),
        constant_columns=pr.constant_columns(summary), null_fraction=pr.null_fraction(summary),
        top_values=pr.top_values(vf, top_n), dominant_columns=pr.dominant_columns(vf, n),
        entropy=pr.column_entropy(vf, n), two_valued=pr.two_valued_columns(vf),
        partial_dates=pr.partial_date_columns(d), correlation=corr.correlation_matrix(d),
        profile=pr.column_profile(summary, types), problems=pr.data_problems(summary),
        seller_metrics=sm.seller_metrics(seller_df) if seller_df is not None else None, vf=vf)
