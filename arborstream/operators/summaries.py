"""Mergeable summaries of vectors: weighted representatives with the radius and spread of what they stand for.

A part of at most PART summaries is covered by KEPT of them, taken one by one
where what is taken is farthest away: every summary is then no farther from a
kept one than twice the best that any choice of as many could do.  Parts are
summarised where rows lie, and the summaries of parts are summarised again,
level by level, until few enough for one clustering are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Cluster, cluster, l2
from .workspace import cut

#: Summaries that are covered together, how many of them are kept, and the most that one clustering takes.
PART, KEPT, CLUSTERED = 1024, 64, 256
_SCHEMA = "v array<double>, w double, radius double, spread double"


def covered(x: np.ndarray, w: np.ndarray, radius: np.ndarray, spread: np.ndarray, kept: int) -> tuple[np.ndarray, ...]:
    """At most `kept` of the summaries, with the weights, radii and spreads (mean distances) of all."""
    first = int(np.lexsort((*x.T[::-1], -w))[0])
    chosen, near = [first], np.zeros(len(x), int)
    away = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
    while len(chosen) < kept and away.max() > 0:
        chosen.append(int(away.argmax()))
        new = np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1))
        near[new < away] = len(chosen) - 1
        away = np.minimum(away, new)
    weight = np.bincount(near, w, len(chosen))
    wide = np.zeros(len(chosen))
    np.maximum.at(wide, near, away + radius)
    return x[chosen], weight, wide, np.bincount(near, w * (away + spread), len(chosen)) / weight


def _condensed(most: int, kept: int):
    """Batches of (v, w, radius, spread) to their summaries, `most` rows at a time."""

    def part(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        x = table.column(0).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        got, *rest = covered(x, *(table.column(i).to_numpy() for i in (1, 2, 3)), kept)
        points = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)), pa.array(got.reshape(-1)))
        return pa.RecordBatch.from_arrays([points, *[pa.array(r) for r in rest]], names=["v", "w", "radius", "spread"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own = batch.slice(at, most - size)
                waiting.append(own)
                at, size = at + own.num_rows, size + own.num_rows
                if size == most:
                    yield part(waiting)
                    waiting, size = [], 0
        if waiting:
            yield part(waiting)

    return run


def condense(points: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
    """v, w, radius, spread: at most CLUSTERED summaries of all vectors; their weights add up to those of the rows.

    Vectors must have one length; null ones, those with null or non-finite
    components and those without a positive weight take no part.
    """
    v = F.col(vector).cast("array<double>")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = points.select(v.alias("v"), w.alias("w"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("spread")).where(v.isNotNull() & finite & (w > 0))
    got, before = cut(rows.mapInArrow(_condensed(PART, KEPT), _SCHEMA)), None
    # a level leaves at most KEPT a part; at the end one part takes all
    while (n := got.count()) > CLUSTERED:
        parts = -(-n // PART) if before is None or n <= before / 2 else 1
        got, before = cut(got.repartition(parts, F.xxhash64("v")).mapInArrow(_condensed(max(PART, n) if parts == 1 else PART, KEPT), _SCHEMA)), n
    return got


def clusters(points: DataFrame, vector: str, most: int, representatives: int = 1, shrinkage: float = 0.0, seed: int = 0) -> list[Cluster]:
    """Clusters of all vectors from their summaries; the weights of all clusters add up to the number of vectors."""
    rows = condense(points, vector).orderBy("v").collect()  # CLUSTERED at most
    return cluster([(np.array(r.v), r.w) for r in rows], most, l2, representatives=representatives, shrinkage=shrinkage, seed=seed)


def assigned(points: DataFrame, vector: str, found: list[Cluster], keep: list[str]) -> DataFrame:
    """keep, cluster (its place in `found`) and distance of every row to its nearest cluster; null for rows that took no part."""
    kinds = dict(points.dtypes)
    bases = [np.array([r for r, _ in c.representatives]) for c in found]
    primary = np.array([c.primary for c in found]) if found else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            for i, v in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found and v is not None and len(v) == primary.shape[1] and all(c is not None and np.isfinite(c) for c in v):
                    x = np.array(v)
                    main = np.sqrt(((primary - x) ** 2).sum(axis=1))
                    near = np.array([np.sqrt(((b - x) ** 2).sum(axis=1).min()) for b in bases])
                    d = near * (1 - found[0].shrinkage) + main * found[0].shrinkage
                    at[i], far[i] = d.argmin(), d.min()
            none = at < 0
            cols = [pa.array(at, pa.int32(), mask=none), pa.array(far, mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keep, "cluster", "distance"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "cluster int, distance double"])
    return points.select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, schema)
