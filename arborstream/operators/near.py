"""Rows near a stated query set, and sides that are small enough to be sent everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast.
SMALL_ROWS = 4096
#: Bytes of a block of queries, which is broadcast at once, and rows of a tile that it meets.
BLOCK_BYTES = 8 << 20
TILE = 1024


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df marked for a broadcast if it is counted to have `limit` rows at most; else as it is, for Spark to choose the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def within(rows: DataFrame, is_query: Column, radius: float, id_col: str, vec_col: str) -> DataFrame:
    """(query, near, d) for every row at a Euclidean distance below `radius` from a query, but for the query itself.

    Queries are taken in blocks of bounded size; each block meets every tile of
    rows where they lie.  A matrix product drops what is clearly too far, and
    the distances of the rest are summed component by component.
    """
    points = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    queries = points.where(is_query & F.col("v").isNotNull()).persist()
    n, d = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * max(1, d or 1) * 8 // BLOCK_BYTES))
    found = None
    for b in range(blocks if n else 0):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # a block
        part = points.where(F.col("v").isNotNull()).mapInArrow(_tiles(own, radius), "query long, near long, d double")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], "query long, near long, d double")


def _tiles(block: pa.Table, radius: float):
    qid = block.column("id").to_numpy()
    q = np.array(block.column("v").to_pylist(), float).reshape(len(qid), -1)
    squares = (q * q).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                tile = batch.slice(a, TILE)
                ids, x = tile.column(0).to_numpy(), np.array(tile.column(1).to_pylist(), float)
                if not len(qid) or x.shape[1] != q.shape[1]:
                    continue
                own = (x * x).sum(axis=1)
                far = squares[:, None] + own[None, :] - 2 * (q @ x.T)
                i, j = np.nonzero((far < radius * radius + 1e-9 * (squares[:, None] + own[None, :] + 1)) & (qid[:, None] != ids[None, :]))
                # in the order of the components, as any engine sums them
                exact = np.sqrt(np.cumsum((q[i] - x[j]) ** 2, axis=1)[:, -1]) if len(i) else np.empty(0)
                ok = exact < radius
                yield pa.RecordBatch.from_arrays([pa.array(qid[i[ok]]), pa.array(ids[j[ok]]), pa.array(exact[ok])], names=["query", "near", "d"])

    return run
