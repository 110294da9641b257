"""Time-decayed weighted reservoirs as top-k queries.

The sample after n rows is the rows with the smallest keys
-(sequence) * decay + ln(-ln u / weight): a row's key never changes, so the
sample of a union is the top-k of the samples: partitions keep their own
smallest keys in one pass, and a final top-k merges what they kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.uniforms import uniform
from . import slices


def sample_key(u: Column, sequence: Column, decay: float | Column, weight: Column | None = None) -> Column:
    """Key of a row; with a decay schedule pass the accumulated decay of the row as `decay` and 1 as `sequence`."""
    e = -F.log(u)
    return F.log(e / weight if weight is not None else e) - sequence * decay


def reservoir(df: DataFrame, trees: int, capacity: int, sequence: str, decay: float | Column, seed: int = 0, weight: Column | None = None, identity: str | None = None) -> DataFrame:
    """The sample of each tree: df's columns, tree and sample_key. Rows of weight 0 are never taken.

    `identity` is the column that seeds a row's uniforms (default: the
    sequence).  Each partition keeps `capacity` rows a tree as its rows pass,
    so a row is never repeated for the trees that do not take it; the few that
    are left meet in one top-k.
    """
    rows = df.where(weight > 0) if weight is not None else df
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    keys = F.transform(every, lambda t: sample_key(uniform(seed, t, identity or sequence), F.col(sequence), decay, weight))
    names = [f"c{i}" for i in range(len(rows.columns))]
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    sent = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)], keys.alias("keys"), F.col(sequence).cast("long").alias("at"))
    schema = "".join(f"{n} {k}, " for n, k in zip(names, kinds, strict=True)) + "tree int, sample_key double"
    kept = sent.mapInArrow(_kept(trees, capacity), schema).toDF(*rows.columns, "tree", "sample_key")
    return smallest(kept, capacity, sequence)


def _kept(trees: int, capacity: int):
    """Rows (columns, keys, at) to (columns, tree, key): of each tree the partition's `capacity` smallest keys, ties to the earlier row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows that some tree keeps
        own = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(trees)]  # key, sequence, row in held
        for batch in batches:
            keys = batch.column(batch.num_columns - 2).flatten().to_numpy().reshape(-1, trees)
            at = batch.column(batch.num_columns - 1).to_numpy()
            base = held.num_rows if held is not None else 0
            for t in range(trees):
                k, s, r = own[t]
                near = np.arange(len(at)) if len(k) < capacity else np.flatnonzero(keys[:, t] <= k[-1])
                if len(near):
                    k, s, r = np.append(k, keys[near, t]), np.append(s, at[near]), np.append(r, base + near)
                    order = np.lexsort((s, k))[:capacity]
                    own[t] = k[order], s[order], r[order]
            rows = pa.Table.from_batches([batch.select(range(batch.num_columns - 2))])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            used, place = np.unique(np.concatenate([r for *_, r in own]), return_inverse=True)
            held = held.take(pa.array(used)).combine_chunks()
            for t, (k, s, r) in enumerate(own):
                own[t], place = (k, s, place[: len(r)]), place[len(r) :]
        if held is not None:
            table = held.take(pa.array(np.concatenate([r for *_, r in own])))
            table = table.append_column("tree", pa.array(np.repeat(np.arange(trees, dtype=np.int32), [len(k) for k, *_ in own])))
            yield from table.append_column("sample_key", pa.array(np.concatenate([k for k, *_ in own]))).combine_chunks().to_batches()

    return run


def smallest(keyed: DataFrame, capacity: int, sequence: str) -> DataFrame:
    """Rows with a tree's `capacity` smallest keys, ties to the earlier row; Spark limits each partition's groups first."""
    w = W.partitionBy("tree").orderBy("sample_key", sequence)
    return keyed.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= capacity).drop("__rank")


def merge(first: DataFrame, second: DataFrame, capacity: int, sequence: str) -> DataFrame:
    """The sample of the union of two streams from their samples."""
    return smallest(first.unionByName(second), capacity, sequence)


def accumulated_decay(df: DataFrame, key: str, order: str, decay: Column) -> DataFrame:
    """Add `decay_sum`: the decay up to each row under a schedule that changes on the way."""
    return df.withColumn("decay_sum", F.sum(decay).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def initial_admission(size: Column, capacity: int, fraction: float) -> Column:
    """Probability of taking a row while the reservoir fills: 1 up to the fraction, then falling linearly to 0."""
    full = size / F.lit(float(capacity))
    if fraction >= 1:
        return F.when(full < 1, 1.0).otherwise(0.0)
    return F.when(full < fraction, 1.0).when(full >= 1, 0.0).otherwise(1.0 - (full - fraction) / (1.0 - fraction))


def downsample(df: DataFrame, weight: str, identity: str, force: float, keep: float, seed: int = 0) -> DataFrame:
    """Keep rows heavier than `force` of the total weight; keep others with probability `keep` and scale their weights up."""
    total = df.agg(F.sum(weight).alias("t")).first()["t"] or 0.0
    heavy = F.col(weight) > F.lit(force * total)
    taken = df.where(heavy | (uniform(seed, identity) < keep))
    return taken.withColumn(weight, F.when(heavy, F.col(weight)).otherwise(F.col(weight) / keep))


def prefix_pick(df: DataFrame, group: str, order: list[str], weight: str, share: float) -> DataFrame:
    """Each group's first row, in order, at which the running weight reaches `share` of the group's weight.

    A long group is cut into slices by its first column of `order` (a number):
    each is summed where it lies, and begins with what those before it add up to.
    """
    seq = slices.sliced(df, group, order)
    own = seq.rows.withColumn("__slice", F.col(slices.SLICE) if seq.cut else F.lit(0))
    sums = own.groupBy(F.col(group).alias("__g"), F.col("__slice").alias("__s")).agg(F.sum(weight).alias("__sum"))
    every = W.partitionBy("__g")
    before = sums.withColumn("__before", F.sum("__sum").over(every.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))).withColumn("whole", F.sum("__sum").over(every)).drop("__sum")
    running = F.sum(weight).over(W.partitionBy(group, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    met = own.withColumn("__own", running).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s")))
    total = F.when(F.col("__before").isNull(), F.col("__own")).otherwise(F.col("__before") + F.coalesce("__own", F.lit(0)))
    reached = met.withColumn("running", total).where(F.col("running") >= share * F.col("whole"))
    names = [*df.columns, "running", "whole"]
    first = reached.groupBy("__g").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__first"))
    return first.select(*[F.col("__first")[n].alias(n) for n in names])
