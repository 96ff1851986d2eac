"""Rank and rescale within groups.

Both run on aggregated tables (one row per team, season and the like): the
size of a window partition follows the number of teams, not of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile_ranks(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Percentile (0..100, rounded half-even) of each metric within its group.

    Ties take the lowest rank; unknown values get NULL and do not count; a
    group with a single known value has no percentile. The other columns must
    identify a row: the metrics are ranked as rows, all by one sort that is
    spread by (group, metric), and become columns again.
    """
    ids = [c for c in df.columns if c not in metrics]
    long = df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    group = Window.partitionBy(*by, "metric")
    position = F.rank().over(group.orderBy(F.col("value").asc_nulls_last())) - 1
    others = F.count("value").over(group) - 1
    share = F.when(F.col("value").isNotNull() & (others > 0), position.cast("double") / others)
    ranked = long.withColumn("percentile", F.bround(share * 100, 0))
    return ranked.groupBy(*ids).agg(
        *(F.max(F.when(F.col("metric") == m, F.col("percentile"))).alias(m) for m in metrics)
    )


def rescale_unit(df: DataFrame, value: str, by: list[str], into: str) -> DataFrame:
    """Min-max rescale to 0..1 within a group; a group without spread gives 0.5."""
    group = Window.partitionBy(*by)
    low, high = F.min(value).over(group), F.max(value).over(group)
    scaled = F.when(high == low, F.lit(0.5)).when(high > low, (F.col(value) - low) / (high - low))
    return df.withColumn(into, scaled)
