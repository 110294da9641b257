"""Static fills of missing values and gaps in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METHODS = ("ZERO", "FIXED_VALUES", "PREVIOUS", "NEXT", "LINEAR")


def fill(df: DataFrame, key: str, order: list[str], value: str, method: str, fixed: float = 0.0, name: str = "filled") -> DataFrame:
    """Fill nulls and NaNs: by zero, a fixed value, the previous or next value, or linearly between them by row.

    PREVIOUS before the first value and NEXT after the last give 0; LINEAR
    there gives the one neighbour.
    """
    if method not in METHODS:
        raise ValueError(f"unknown fill {method}")
    x = F.when(F.col(value).isNull() | F.isnan(value), None).otherwise(F.col(value).cast("double"))
    if method in ("ZERO", "FIXED_VALUES"):
        return df.withColumn(name, F.coalesce(x, F.lit(0.0 if method == "ZERO" else float(fixed))))
    past = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    future = W.partitionBy(key).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    previous, following = F.last(x, ignorenulls=True).over(past), F.first(x, ignorenulls=True).over(future)
    if method == "PREVIOUS":
        return df.withColumn(name, F.coalesce(previous, F.lit(0.0)))
    if method == "NEXT":
        return df.withColumn(name, F.coalesce(following, F.lit(0.0)))
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    rows = df.withColumn("__n", n).withColumn("__x", x)
    at = F.when(F.col("__x").isNotNull(), F.col("__n"))
    rows = rows.withColumn("__p", F.last("__x", ignorenulls=True).over(past)).withColumn("__f", F.first("__x", ignorenulls=True).over(future))
    rows = rows.withColumn("__pn", F.last(at, ignorenulls=True).over(past)).withColumn("__fn", F.first(at, ignorenulls=True).over(future))
    between = F.col("__p") + (F.col("__f") - F.col("__p")) * (F.col("__n") - F.col("__pn")) / (F.col("__fn") - F.col("__pn"))
    filled = F.coalesce("__x", between, "__p", "__f", F.lit(0.0))
    return rows.withColumn(name, filled).drop("__n", "__x", "__p", "__f", "__pn", "__fn")


def gaps(df: DataFrame, key: str, time: str, factor: float = 1.5) -> DataFrame:
    """Rows after a gap of `factor` mean steps or more, with `steps`: how many steps the gap holds.

    The mean is that of the key's steps before the row.
    """
    order = W.partitionBy(key).orderBy(time)
    stepped = df.withColumn("step", F.col(time) - F.lag(time).over(order))
    stepped = stepped.withColumn("mean_step", F.avg("step").over(order.rowsBetween(W.unboundedPreceding, -1)))
    return stepped.where(F.col("step") >= factor * F.col("mean_step")).withColumn("steps", F.ceil(F.col("step") / F.col("mean_step")).cast("long"))


def insert_missing(found: DataFrame, time: str) -> DataFrame:
    """The rows that a gap lacks: one for each step but the last, at equal times."""
    inner = found.where("steps > 1").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps") - 1)))
    at = F.col(time) - F.col("step") + F.floor(F.col("step") * F.col("__i") / F.col("steps"))
    return inner.withColumn(time, at.cast("long")).drop("__i")
