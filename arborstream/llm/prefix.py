"""Global prefix sums without a single-task window.

Rows are dealt to ranges of the order columns, each range is summed, the few
range totals are summed in order, and each row adds its range's offset to the
running sum inside its range.  Only built-in functions: no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hold, parts


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """Add, for each (new column: summed column), the sum over all rows before this one in `order`.

    With `group`, sums start again at each group; `order` must then begin with
    the group's columns, so that a hot group spreads over many ranges.  Rows
    equal in every order column come in an arbitrary but fixed order.  Each
    new column has a companion `<name>_total`: the sum over the whole group.
    The dealt rows are held, so that all steps see the same ranges.
    """
    group = group or []
    spark = df.sparkSession
    ranged = hold(df.repartitionByRange(parts(spark), *order).withColumn("__part", F.spark_partition_id()))
    keys = ["__part", *group]
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{new}") for new, c in sums.items()])
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = totals.select(
        F.col("__part").alias("__op"),
        *[F.col(g).alias(f"__og{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums],
        *[F.sum(f"__t_{new}").over(whole).alias(f"{new}_total") for new in sums],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__r_{new}") for new, c in sums.items()])
    on = [F.col("__part") == F.col("__op"), *[F.col(g).eqNullSafe(F.col(f"__og{i}")) for i, g in enumerate(group)]]
    return running.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"__r_{new}") + F.col(f"__o_{new}")).alias(new) for new in sums],
        *[f"{new}_total" for new in sums],
    )
