"""Exact top-k inner-product search by tiled matrix products.

Queries are taken in blocks of bounded size; every block is multiplied with
every tile of candidates, each tile keeps its best k a query, and the lists of
tiles are merged in a tree until one list a query is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, cut, hold

#: Bytes of a block of queries (as doubles): what is broadcast at once.
BLOCK_BYTES = 32 << 20
TILE = 2048
FAN_IN = 16
_LIMIT = 1 << 53


def _vectors(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Quantised vectors, None for those that take no part."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    q = np.floor(flat * 256.0)
    ok = np.isfinite(q)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    starts = ends - np.maximum(sizes, 0)
    valid = (sizes >= 0) & (bad[ends] == bad[starts])
    return valid, [q[a:b] if v else None for a, b, v in zip(starts, ends, valid, strict=True)]


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2**53, Python's integers serve beyond."""
    if not queries.size or not tile.size:
        return np.zeros((len(queries), len(tile)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(tile).max()) * queries.shape[1] < _LIMIT:
        return (queries @ tile.T).astype(np.int64)
    big = [[int(x) for x in row] for row in queries.tolist()], [[int(x) for x in row] for row in tile.tolist()]
    return np.array([[sum(x * y for x, y in zip(a, b, strict=True)) for b in big[1]] for a in big[0]], dtype=object)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) rows each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (query[j], -scores[j], ids[j])), np.int64)
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], ids[kept], scores[kept]


def _tile_best(qids: np.ndarray, tids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) rows of a tile of products: each query's k best, but for itself; ties at the k-th place may add rows."""
    other = tids[None, :] != qids[:, None]
    if scores.dtype != object and scores.shape[1] > k + 1:
        least = np.partition(np.where(other, scores, np.iinfo(np.int64).min), scores.shape[1] - k, axis=1)[:, -k]
        other &= scores >= least[:, None]
    i, j = np.nonzero(other)
    return qids[i], tids[j], scores[i, j]


def _search(block: list[tuple[int, np.ndarray]], k: int):
    """Arrow batches (vec_id, embedding) to (query_id, part, vec_id, score): the best k of the partition."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(v) for _, v in block}:
        own = [(i, v) for i, v in block if len(v) == d]
        by_dim[d] = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own]).reshape(len(own), d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            ids = batch.column(0)
            valid, vectors = _vectors(batch.column(1))
            valid &= ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for d, (qids, queries) in by_dim.items():
                own = [j for j in np.flatnonzero(valid) if len(vectors[j]) == d]
                for t in range(0, len(own), TILE):
                    rows = own[t : t + TILE]
                    tile, tids = np.array([vectors[j] for j in rows]).reshape(len(rows), d), ids[rows]
                    found = [kept] if kept else []
                    for a in range(0, len(qids), TILE // 2):
                        near = qids[a : a + TILE // 2]
                        found.append(_best(*_tile_best(near, tids, _products(queries[a : a + TILE // 2], tile), k), k))
                    kept = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        if kept:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            query, ids, scores = kept
            cols = [pa.array(query), pa.array(np.full(len(query), part, np.int32)), pa.array(ids), pa.array([int(x) for x in scores], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "part", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows.

    Components become floor(256 * x) and the score is their integer inner
    product; ties go to the smaller id.  Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; only vectors
    of the query's length are its candidates.  Several query rows with one id
    count once (the smallest vector); a repeated candidate row may be listed
    as often as it stands there.  With fewer than k candidates all are listed;
    an empty table gives no rows.  Scores must fit a long.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    queries = hold(rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & is_query))
    stats = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_blocks = max(1, -(-stats[0] * max(1, stats[1] or 1) * 8 // BLOCK_BYTES))
    found = None
    for b in range(n_blocks if stats[0] else 0):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        table = own.toArrow()  # a block: BLOCK_BYTES on average, whatever the number of queries
        valid, quantised = _vectors(table.column("embedding"))
        block = [(i, v) for i, v in zip(table.column("vec_id").to_pylist(), quantised, strict=True) if v is not None]
        if block:
            lists = rows.mapInArrow(_search(block, k), "query_id long, part int, vec_id long, score long")
            lists = cut(lists) if n_blocks > 1 else lists
            found = lists if found is None else found.unionByName(lists)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = rows.rdd.getNumPartitions()
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(shards)))
        rank = F.row_number().over(W.partitionBy("query_id", "part").orderBy(*best))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
