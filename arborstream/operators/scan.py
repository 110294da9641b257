"""Ordered scans: one Python state a key, rows streamed past it.

Rows are dealt by key, sorted, and handed over in Arrow batches, so a key's
history never has to fit in memory; the step functions are the ones that the
streaming operators run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[tuple], list[tuple]]


def scan(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[Any], Step], schema: str) -> DataFrame:
    """For each key in order: start(key) gives a step; step(row of `columns`) gives output rows of `schema`."""

    def play(batches: Iterator[tuple[list, list[tuple]]]) -> Iterator[list[tuple]]:
        now, step, begun = None, None, False
        for keys, rows in batches:
            out: list[tuple] = []
            for k, row in zip(keys, rows, strict=True):
                if not begun or k != now:
                    now, step, begun = k, start(k), True
                out += step(row)
            yield out

    return dealt(df, key, order, columns, play, schema)


def dealt(df: DataFrame, key: str, order: list[str], columns: list[str], play: Callable[[Iterator[tuple[list, list[tuple]]]], Iterator[list[tuple]]], schema: str, parts: int | None = None, numbered: bool = False) -> DataFrame:
    """Rows dealt by key and sorted: play takes (keys, rows of `columns`) batch by batch and gives lists of output rows.

    Keys are dealt by a hash, or, where few long ones would meet in a task by it, `numbered` ones by themselves.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list, list[tuple]]]:
            for batch in batches:
                keys, *values = [c.to_pylist() for c in batch.columns]
                yield keys, list(zip(*values, strict=True))

        for out in play(rows()):
            cols = list(zip(*out, strict=True)) if out else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    sent = df.select(F.col(key).alias("__key"), *columns, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    # a stated number: the work of a row is in its state, so small partitions must not be joined by their bytes
    n = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    spread = sent.repartitionById(n, F.col("__key").cast("int")) if numbered else sent.repartition(n, "__key")
    dealt = spread.sortWithinPartitions("__key", *[f"__o{i}" for i in range(len(order))])
    return dealt.select("__key", *columns).mapInArrow(run, schema)
