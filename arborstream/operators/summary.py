"""Weighted summaries and one step of soft assignment to centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .near import small


def weighted_percentile(df: DataFrame, group: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """For each group and (name: share): the first value, ascending, whose cumulative weight reaches the share.

    Equal values are summed before the running sum, so hot groups shrink in the
    map-side combine.
    """
    totals = df.groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    w = W.partitionBy(*group)
    running = F.sum("__w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    marked = totals.withColumn("__r", running).withColumn("__t", F.sum("__w").over(w))
    return marked.groupBy(*group).agg(*[F.min(F.when(F.col("__r") >= p * F.col("__t"), F.col(value))).alias(n) for n, p in shares.items()])


def weighted_moments(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Total weight, weighted mean and deviation of each group."""
    sums = df.groupBy(*group).agg(F.sum(weight).alias("total"), F.sum(F.col(weight) * F.col(value)).alias("__s"), F.sum(F.col(weight) * F.col(value) * F.col(value)).alias("__q"))
    mean = F.col("__s") / F.col("total")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("total") - mean * mean))
    return sums.select(*group, "total", mean.alias("mean"), spread.alias("deviation"))


def soft_assign(points: DataFrame, centres: DataFrame, distance: Column, ratio: float = 1.25) -> DataFrame:
    """Shares of each point (point_id) among the centres (centre_id) no farther than `ratio` times its nearest.

    `centres` is sent to every executor if it is counted to be small.  A point on a centre belongs to it
    alone; otherwise shares fall with the distance.
    """
    pairs = points.join(small(centres)).withColumn("distance", distance)
    near = F.min("distance").over(W.partitionBy("point_id"))
    close = pairs.withColumn("__n", near).where(F.col("distance") <= ratio * F.col("__n"))
    raw = F.when(F.col("__n") == 0, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.col("__n") / F.col("distance"))
    return close.withColumn("__raw", raw).withColumn("share", F.col("__raw") / F.sum("__raw").over(W.partitionBy("point_id"))).drop("__n", "__raw")
