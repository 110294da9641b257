"""Shingles: sliding windows of a keyed stream's last inputs as one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: str, order: list[str], number: str = "rn") -> DataFrame:
    """Number each key's rows from 1 in the given total order."""
    return df.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def linear(df: DataFrame, key: str, order: list[str], values: list[str], size: int, name: str = "shingle") -> DataFrame:
    """Oldest to newest concatenation of the last `size` inputs; rows with fewer before them are left out."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    packed = F.array(*[F.col(v).cast("double") for v in values])
    whole = df.withColumn("__last", F.collect_list(packed).over(w)).where(F.size("__last") == size)
    return whole.withColumn(name, F.flatten("__last")).drop("__last")


def rotating(df: DataFrame, key: str, order: list[str], values: list[str], size: int, name: str = "shingle") -> DataFrame:
    """The same window as a ring buffer shows it: input n (from 0) stands in slot n mod `size`."""
    base = len(values)
    flat = linear(ordered(df, key, order, "__n"), key, order, values, size, "__flat")
    first = F.col("__n") - size  # number from 0 of the window's oldest input
    slots = F.sequence(F.lit(0), F.lit(size * base - 1))

    def at(i: Column) -> Column:
        place = F.pmod(F.floor(i / base) - first, F.lit(size))
        return F.get(F.col("__flat"), (place * base + i % base).cast("int"))

    return flat.withColumn(name, F.transform(slots, at)).drop("__flat", "__n")


def complete_query(queries: DataFrame, shingles: DataFrame, key: str, order: str, values: list[str], name: str = "shingle") -> DataFrame:
    """Lift base-width queries to full shingles: the key's latest window moved on by one input, ended by the query."""
    latest = shingles.groupBy(F.col(key).alias("__k")).agg(F.max_by(name, order).alias("__w"))
    tail = F.array(*[F.col(v).cast("double") for v in values])
    joined = queries.join(latest, F.col(key) == F.col("__k"))
    moved = F.concat(F.slice("__w", len(values) + 1, F.size("__w") - len(values)), tail)
    return joined.withColumn(name, moved).drop("__k", "__w")
