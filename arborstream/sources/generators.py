"""Synthetic streams made by Spark expressions: the same rows on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.uniforms import uniform


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal by Box and Muller from two uniforms."""
    a, b = uniform(seed, *parts), uniform(seed + 1_000_003, *parts)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b)


def normal_mixture(spark: SparkSession, rows: int, dimensions: int, seed: int = 0, enter: float = 0.01, leave: float = 0.3, mean: float = 4.0, deviation: float = 2.0) -> DataFrame:
    """seq, v, anomalous, changed: a two-state chain, entered and left at random; v is i.i.d. in each state.

    The state at a row is that of the last row whose draw forces one: a draw
    below `enter` enters, one above 1 - `leave` leaves, others keep it.
    """
    df = spark.range(rows).withColumnRenamed("id", "seq").withColumn("u", uniform(seed, "seq"))
    forced = F.when(F.col("u") < enter, True).when(F.col("u") > 1 - leave, False)
    w = W.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    state = F.coalesce(F.last(forced, ignorenulls=True).over(w), F.lit(False))
    df = df.withColumn("anomalous", state).withColumn("changed", F.col("anomalous") != F.coalesce(F.lag("anomalous").over(W.orderBy("seq")), F.lit(False)))
    each = [F.when(F.col("anomalous"), normal(seed + 7 + i, "seq") * deviation + mean).otherwise(normal(seed + 7 + i, "seq")) for i in range(dimensions)]
    return df.select("seq", F.array(*each).alias("v"), "anomalous", "changed")


def multi_cosine(spark: SparkSession, rows: int, base: int, period: int = 60, amplitude: float = 100.0, noise: float = 5.0, seed: int = 0, rate: float = 0.01, slope: float = 0.0, factor: float = 5.0) -> DataFrame:
    """seq, v, is_anomaly, change: noisy cosines with planted jumps, each dimension hit with probability 0.3."""
    n = F.col("seq")
    df = spark.range(rows).withColumnRenamed("id", "seq").withColumn("is_anomaly", uniform(seed + 11, "seq") < rate)
    values, changes = [], []
    for i in range(base):
        phase, amp = uniform(seed + 13, F.lit(i)) * 2 * math.pi, amplitude * (1 + 0.2 * uniform(seed + 17, F.lit(i)))
        wave = amp * F.cos(2 * math.pi * n / period + phase) + slope * n + noise * (2 * uniform(seed + 19, n, F.lit(i)) - 1)
        hit = F.col("is_anomaly") & (uniform(seed + 23, n, F.lit(i)) < 0.3)
        sign = F.when(uniform(seed + 29, n, F.lit(i)) < 0.5, -1.0).otherwise(1.0)
        change = F.when(hit, sign * factor * (1 + uniform(seed + 31, n, F.lit(i))) * noise).otherwise(0.0)
        values.append(wave + change)
        changes.append(change)
    return df.select("seq", F.array(*values).alias("v"), "is_anomaly", F.array(*changes).alias("change"))


def single_cosine(spark: SparkSession, rows: int, period: int = 50, seed: int = 0) -> DataFrame:
    """seq, value: one cosine of amplitude 100 with noise and one per cent of spikes of 50."""
    n = F.col("seq")
    spike = F.when(uniform(seed + 3, "seq") < 0.01, F.when(uniform(seed + 5, "seq") < 0.5, -50.0).otherwise(50.0)).otherwise(0.0)
    return spark.range(rows).withColumnRenamed("id", "seq").select("seq", (100.0 * F.cos(2 * math.pi * (n + 50) / period) + 5.0 * uniform(seed, "seq") + spike).alias("value"))


def fan(spark: SparkSession, rows: int, blades: int = 3, angle: float = 0.0, seed: int = 0) -> DataFrame:
    """seq, blade, v: points on turning blades around the origin."""
    df = spark.range(rows).withColumnRenamed("id", "seq").withColumn("blade", (F.col("seq") % blades).cast("int"))
    x, y = 0.05 * normal(seed, "seq"), 0.2 * normal(seed + 1, "seq") + 0.6
    turn = F.lit(angle) + 2 * math.pi * F.col("blade") / blades
    return df.select("seq", "blade", F.array(x * F.cos(turn) - y * F.sin(turn), x * F.sin(turn) + y * F.cos(turn)).alias("v"))


def two_letter_strings(spark: SparkSession, rows: int, seed: int = 0, length: int = 70) -> DataFrame:
    """seq, s, injected: strings of two letters, mostly one or mostly the other; one in twenty is even."""
    df = spark.range(rows).withColumnRenamed("id", "seq").withColumn("injected", uniform(seed + 1, "seq") < 0.05)
    p = F.when(F.col("injected"), 0.5).when(uniform(seed + 2, "seq") < 0.5, 0.85).otherwise(0.15)
    size = (F.lit(length) + F.floor(uniform(seed + 3, "seq") * 15)).cast("int")
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(uniform(seed + 4, F.col("seq"), i) < p, "-").otherwise("_"))
    return df.select("seq", F.array_join(letters, "").alias("s"), "injected")
