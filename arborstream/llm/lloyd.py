"""Exact Lloyd rounds by dual-tree assignment.

Vectors are gathered into tiles where they lie, and each tile keeps a cover
tree that is built once.  In each round the few centroids get a tree of their
own, and pairs of a vector node and a centroid node are pruned by distance
bounds: a node whose vectors can have only one nearest centroid is assigned
whole, leaves compare their vectors with the centroids left over exactly.
Vectors never move: a partition sends one row of sums a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, hold

#: Vectors of a tile, and of a leaf of its tree.
TILE = 4096
LEAF = 32
#: A node whose first children cover fewer vectors than this each stays a leaf: its vectors are too far apart to share bounds.
LEAST_COVERED = 3
#: Most centroids: they are held by every task and, with their sums, by the driver.
MOST = 4096
#: Integers up to here are exact as doubles.
_LIMIT = 1 << 53
#: Slack of bounds against the rounding of roots and sums.
_SLACK = 1e-9


def _fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows are exact as doubles."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 4.0 * most * most * max((a.shape[1] for a in arrays), default=1) < _LIMIT


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y: exact integers, as doubles where these hold them."""
    if _fits(x, y):
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    a, b = ([[int(v) for v in row] for row in m.tolist()] for m in (x, y))
    return np.array([[sum((p - q) ** 2 for p, q in zip(r, s, strict=True)) for s in b] for r in a], dtype=object).reshape(len(a), len(b))


@dataclass
class CoverTree:
    """Nodes in breadth-first order over points in tree order; a node's points are begin to end, the first of them its centre.

    Every point of a node lies within `radius` of its centre.  Children are
    contiguous; their centres are more than half the node's radius apart and
    cover its points within that.  first[i] is -1 for leaves.
    """

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray


def cover_tree(x: np.ndarray, leaf: int, least: float = LEAST_COVERED) -> CoverTree:
    """Cover tree of the rows of x, whose squared distances must be exact as doubles."""
    order = np.arange(len(x))
    begin, end, radius, first, count = [0], [len(x)], [0.0], [-1], [0]
    at = 0
    while at < len(begin):
        a, b = begin[at], end[at]
        points = order[a:b]
        away = np.sqrt(squared(x[points[:1]], x[points])[0])
        radius[at] = float(away.max()) * (1 + _SLACK)
        if radius[at] > 0 and b - a > leaf:
            half = radius[at] / 2
            groups, left = [points[away <= half]], points[away > half]
            covered = len(groups[0])
            while len(left):
                near = squared(x[left[:1]], x[left])[0] <= half * half
                groups.append(left[near])
                left = left[~near]
                covered += len(groups[-1])
                if len(groups) % 16 == 0 and covered < least * len(groups):
                    groups = []
                    break
            if groups:
                first[at], count[at] = len(begin), len(groups)
                order[a:b] = np.concatenate(groups)
                for g in groups:
                    begin.append(a)
                    a += len(g)
                    end.append(a)
                    radius.append(0.0)
                    first.append(-1)
                    count.append(0)
        at += 1
    return CoverTree(order, *(np.array(v, np.int64) for v in (begin, end)), np.array(radius), *(np.array(v, np.int64) for v in (first, count)))


def _children(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of nodes, and for each the place of its parent in `nodes`."""
    n = tree.count[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    return tree.first[nodes][parent] + np.arange(len(parent)) - (np.cumsum(n) - n)[parent], parent


class Centroids:
    """Centroids with their tree; equal ones are one point, of the smallest number."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.exact = _fits(rows)
        if self.exact:
            distinct, number = np.unique(rows, axis=0, return_index=True)
            self.tree = cover_tree(distinct, 1, 0)
            self.points, self.number = distinct[self.tree.order], number[self.tree.order]


def _leaf(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Nearest of some centroids for each row, ties to the smaller number."""
    numbers = np.sort(numbers)
    return numbers[np.argmin(squared(x, centroids[numbers]), axis=1)]


def nearest(x: np.ndarray, tree: CoverTree, to: Centroids) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row of x (in tree order), ties to the smaller number; and how many distances were taken."""
    label = np.full(len(x), -1, np.int64)
    own = to.tree
    q, g = np.zeros(1, np.int64), np.zeros(1, np.int64)
    taken = 0
    while len(q):
        diff = x[tree.begin[q]] - to.points[own.begin[g]]
        away = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        taken += len(q)
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(q)]))
        # the centre of a centroid node is a centroid: no vector of the other node is farther from its nearest than this
        best = np.minimum.reduceat(away + tree.radius[q], starts)
        keep = away - tree.radius[q] - own.radius[g] <= best[group] * (1 + _SLACK) + _SLACK * away
        q, g = q[keep], g[keep]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[starts, len(q)])
        group = np.repeat(np.arange(len(starts)), size)
        node = q[starts]
        wide = np.where(own.first[g] >= 0, own.radius[g], -1.0)
        widest = np.maximum.reduceat(wide, starts)
        open_g = (widest >= 0) & ((tree.first[node] < 0) | (widest >= tree.radius[node]))
        whole = ~open_g & (size == 1) & (widest < 0)
        leaf = ~open_g & ~whole & (tree.first[node] < 0)
        for i in np.flatnonzero(whole):
            label[tree.begin[node[i]] : tree.end[node[i]]] = to.number[own.begin[g[starts[i]]]]
        for i in np.flatnonzero(leaf):
            rows = slice(tree.begin[node[i]], tree.end[node[i]])
            near = g[starts[i] : starts[i] + size[i]]
            label[rows] = _leaf(x[rows], to.rows, to.number[own.begin[near]])
            taken += (rows.stop - rows.start) * len(near)
        # centroid nodes of opened groups give way to their children, vector nodes of the others to theirs
        opened = open_g[group]
        stay = opened & (own.first[g] < 0)
        inner = np.flatnonzero(opened & (own.first[g] >= 0))
        below, parent = _children(own, g[inner])
        rest = np.flatnonzero(~(open_g | whole | leaf)[group])
        under, above = _children(tree, q[rest])
        q, g = np.r_[q[stay], q[inner][parent], under], np.r_[g[stay], below, g[rest][above]]
        by = np.lexsort((g, q))
        q, g = q[by], g[by]
    return label, taken


_TILE = "ids array<long>, x binary, begin array<long>, end array<long>, radius array<double>, first array<long>, count array<long>"


def _tiles(dims: int, scale: float):
    """Arrow batches (vec_id, embedding) to tiles of quantised vectors in tree order, with the tree."""

    def tile(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        t = cover_tree(x, LEAF) if _fits(x) else CoverTree(np.arange(len(x)), *(np.array([v]) for v in (0, len(x), np.inf, -1, 0)))
        cols = [pa.array([ids.take(pa.array(t.order)).to_pylist()], pa.list_(pa.int64())), pa.array([x[t.order].tobytes()], pa.binary())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        cols += [pa.array([v], pa.list_(k)) for v, k in zip((t.begin, t.end, t.radius, t.first, t.count), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["ids", "x", "begin", "end", "radius", "first", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ids.append(batch.column(0))
            xs.append(np.floor(flat * scale).reshape(-1, dims))
            n += len(ids[-1])
            if n >= TILE:
                yield tile(pa.concat_arrays(ids), np.concatenate(xs))
                ids, xs, n = [], [], 0
        if n:
            yield tile(pa.concat_arrays(ids), np.concatenate(xs))

    return run


def _labels(batches: Iterator[pa.RecordBatch], to: Centroids) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, vectors, nearest centroid) of each tile."""
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["x"], np.float64).reshape(-1, to.rows.shape[1])
            if to.exact and _fits(x):
                tree = CoverTree(np.empty(0), *(np.array(row[c]) for c in ("begin", "end", "radius", "first", "count")))
                yield row["ids"], x, nearest(x, tree, to)[0]
            else:
                yield row["ids"], x, _leaf(x, to.rows, np.arange(len(to.rows)))


def _sums(centroids: np.ndarray):
    """Tiles to (cluster, n, sums): one row for each centroid that has vectors in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Centroids(centroids)
        total: dict[int, list[int]] = {}
        for _, x, label in _labels(batches, to):
            by = np.argsort(label, kind="stable")
            found, starts = np.unique(label[by], return_index=True)
            ends = np.r_[starts[1:], len(by)]
            exact = float(np.abs(x).max()) * len(x) < _LIMIT
            for c, a, b in zip(found.tolist(), starts, ends, strict=True):
                rows = x[by[a:b]]
                add = [int(v) for v in rows.sum(0)] if exact else [sum(int(v) for v in col) for col in rows.T.tolist()]
                have = total.setdefault(c, [0] * (1 + x.shape[1]))
                total[c] = [p + q for p, q in zip(have, [int(b - a), *add], strict=True)]
        cols = [list(total), [v[0] for v in total.values()], [v[1:] for v in total.values()]]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    """Tiles to (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Centroids(centroids)
        for ids, x, label in _labels(batches, to):
            own = to.rows[label]
            if to.exact and _fits(x):
                far = ((x - own) ** 2).sum(1).astype(np.int64).tolist()
            else:
                far = [sum((int(p) - int(q)) ** 2 for p, q in zip(r, s, strict=True)) for r, s in zip(x.tolist(), own.tolist(), strict=True)]
            cols = [pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance"])

    return run


_CENTROID = "cluster int, centroid array<long>, n long, inertia long, total long"


@dataclass
class Clusters:
    """assigned: vec_id, cluster, distance (squared) of every kept vector; centroids: cluster, centroid, n, inertia, total (of all inertias), one row each."""

    assigned: DataFrame
    centroids: DataFrame


def lloyd(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding"
) -> Clusters:
    """Lloyd's rounds over floor(scale * x), all in integers.

    Vectors of another length, null ones and those with null or non-finite
    components take no part.  Centroids start as the k kept vectors with the
    smallest sha256 of `<seed>:<id>` (a null id has no digits; of equal ids
    the smaller vector first), fewer if there are fewer.  A round assigns each
    vector to the nearest centroid by squared distance, ties to the smaller
    number, and replaces each centroid that has vectors by the floor of their
    mean.  Then vectors are assigned once more.  Repeated rows are separate
    vectors; an empty table gives no rows; other columns are ignored.  Squared
    distances and their sums must fit a long: beyond, the query fails.
    """
    if not 0 < k <= MOST:
        raise ValueError(f"k must be from 1 to {MOST}")
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    x = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    kept = rows.where((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(drawn, x).limit(k).collect()  # k rows
    if not start:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], _CENTROID))
    centroids = np.floor(np.array([r.embedding for r in start]) * scale)
    tiles = hold(kept.mapInArrow(_tiles(dims, scale), _TILE))
    for _ in range(rounds):
        sums = tiles.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        parts = sums.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
        means = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s"))
        moved = centroids.copy()
        for r in means.collect():  # k times dims rows
            moved[r.cluster, r.place] = int(r.s) // r.n
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    assigned = hold(tiles.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    of = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}  # k rows
    total = sum(r.inertia for r in of.values())
    table = [(c, [int(v) for v in row], of[c].n if c in of else 0, of[c].inertia if c in of else 0, total) for c, row in enumerate(centroids.tolist())]
    return Clusters(assigned, spark.createDataFrame(table, _CENTROID))
