"""Rows next to each other in a global order, without a single-task window.

The order is cut into ranges whose first and last keys are known; the rows at
a range's edges are sent to the adjoining ranges as well, so that every row
meets its neighbours in one task while the payload is shuffled once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, parts

#: Values of __edge: a row of the range itself; the last row of the range before; the first row of the range after.
OWN, BEFORE, AFTER = 0, 1, 2


def _order(key: tuple) -> tuple:
    """Nulls first."""
    return tuple((x is not None, x if x is not None else 0) for x in key)


def ranges(keys: DataFrame, n: int | None = None) -> list[tuple[tuple, tuple]]:
    """First and last key of each of about n equal ranges of the rows, ascending; at most n pairs come back.

    n: by default as many as the input has partitions, or shuffles have if they
    are more, so that a range's payload stays near the size of a split.
    """
    cols = keys.columns
    n = n or max(parts(keys.sparkSession), keys.rdd.getNumPartitions())
    order = [F.col(c).asc_nulls_first() for c in cols]
    dealt = hold(keys.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    ends = dealt.groupBy("__part").agg(F.min(F.struct(*cols)).alias("first"), F.max(F.struct(*cols)).alias("last")).collect()
    return sorted(((tuple(r["first"]), tuple(r["last"])) for r in ends), key=lambda e: _order(e[1]))


def squeeze(texts: pa.Array) -> pa.Array:
    """Each text as zstd bytes (null: null): what a shuffle moves is smaller by half."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())


def unsqueeze(packed: pa.Array) -> list[str | None]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [None if b is None else unpack(b).decode("utf-8", "surrogatepass") for b in packed.to_pylist()]


def deal(df: DataFrame, key_cols: list[str], edges: list[tuple[tuple, tuple]], text_col: str, beside: list[tuple[tuple | None, tuple | None]] | None = None) -> DataFrame:
    """df with __part (its range) and __edge; edge rows stand in the adjoining ranges too, the order taken as a ring.

    With `beside`, the keys of the rows that stand before and after each range
    (None: no row) take the place of the edge rows.
    A range is never split over partitions; the caller sorts within them.
    `text_col` comes as squeezed bytes.
    """
    last = [_order(e[1]) for e in edges]
    first = [_order(e[0]) for e in edges]
    n = len(edges)
    at = [df.columns.index(c) for c in key_cols]
    sent: dict[tuple, list[tuple[int, int]]] = {}
    for p, pair in enumerate(beside or []):
        for kind, key in zip((BEFORE, AFTER), pair, strict=True):
            if key is not None:
                sent.setdefault(_order(key), []).append((p, kind))
    body = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_order(k) for k in zip(*[batch.column(j).to_pylist() for j in at], strict=True)]
            part = [bisect_left(last, k) for k in keys]
            rows, where, edge = list(range(len(keys))), list(part), [OWN] * len(keys)
            for i, (k, p) in enumerate(zip(keys, part, strict=True)):
                if beside is None:
                    goes = [((p + step) % n, kind) for hit, step, kind in ((k == last[p], 1, BEFORE), (k == first[p], -1, AFTER)) if hit]
                else:
                    goes = sent.get(k, [])
                for to, kind in goes:
                    rows.append(i)
                    where.append(to)
                    edge.append(kind)
            take = pa.array(rows, pa.int64())
            cols = [(squeeze(c) if j == body else c).take(take) for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where, pa.int32()), pa.array(edge, pa.int32())], names=[*batch.schema.names, "__part", "__edge"])

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema.fields) + ", __part int, __edge int"
    if not edges:
        return df.sparkSession.createDataFrame([], schema)
    # by number, not by its hash: every range has a partition of its own
    return df.mapInArrow(run, schema).repartitionById(max(1, n), F.col("__part"))
