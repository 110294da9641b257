"""The forest façade: fit a frozen model on a table, then ask it many questions.

Fitting draws each tree's sample as a top-k query and sends the samples (trees
x capacity points: a fixed size) to the driver; the frozen model is broadcast
and queried over Arrow batches, so queries scale with the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds
from .sampler import reservoir
from .trees import Tree, build

#: Most values that a model may hold on the driver and in a broadcast: 64 million doubles.
MODEL_LIMIT = 64_000_000


@dataclass
class Forest:
    """Trees over one set of sample points; point_ids[t] are the ids of tree t's points."""

    trees: list[Tree]
    point_ids: list[np.ndarray]
    capacity: int
    seed: int = 0
    updates: int = 0

    @property
    def dimensions(self) -> int:
        return self.trees[0].points.shape[1] if self.trees and self.trees[0].points.ndim == 2 else 0

    @property
    def ready(self) -> bool:
        """Whether a quarter of the sample size has been seen."""
        return self.updates > max(1, self.capacity // 4)

    # -- over a batch of queries (numpy) -----------------------------------------------------------

    def fold(self, queries: np.ndarray, make: Callable[[], folds.TreeFold], ignore_mass: int = 0) -> np.ndarray:
        """Mean over trees of any fold."""
        total = None
        for t in self.trees:
            r = folds.traverse(t, queries, make(), ignore_mass)
            total = r if total is None else total + r
        return total / len(self.trees)

    def accumulate(self, queries: np.ndarray, make: Callable[[], folds.TreeFold], combine: Callable, each: Callable | None = None, finish: Callable | None = None, done: Callable | None = None) -> np.ndarray:
        """Trees' results put together by any accumulator: `each` maps a tree's result, `combine` joins two, `done` may end the trees early, `finish` ends."""
        total = None
        for t in self.trees:
            r = folds.traverse(t, queries, make())
            r = r if each is None else each(r)
            total = r if total is None else combine(total, r)
            if done is not None and done(total):
                break
        return total if finish is None else finish(total)

    def branch(self, query: np.ndarray, make: Callable[[], folds.BranchFold]) -> list:
        """Each tree's value of a fold that may go down both sides of a cut."""
        return [folds.branch(t, query, make()) for t in self.trees]

    def per_tree(self, queries: np.ndarray, make: Callable[[], folds.TreeFold]) -> np.ndarray:
        return np.stack([folds.traverse(t, queries, make()) for t in self.trees], axis=1)

    def score(self, queries: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(queries))
        return sum(folds.scores(t, queries) for t in self.trees) / len(self.trees)

    def attribution(self, queries: np.ndarray) -> np.ndarray:
        return self.fold(queries, folds.Attribution) if self.ready else np.zeros((len(queries), 2 * queries.shape[1]))

    def density(self, queries: np.ndarray) -> np.ndarray:
        return self.fold(queries, folds.Density)

    def scalar_density(self, queries: np.ndarray, q: float = 0.001, manifold: int | None = None) -> np.ndarray:
        m, d, p = np.moveaxis(self.density(queries), 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(p > 0, d / p, 0.0) ** (manifold or queries.shape[1])
            total = m.sum(axis=1) / self.capacity
            return np.where(total > 0, total / (q * total + (t * p).sum(axis=1)), 0.0)

    def approximate(self, queries: np.ndarray, make: Callable[[], folds.TreeFold] = folds.Score, precision: float = 0.1, least: int = 5, high_is_critical: bool = True, ignore_mass: int = 0, known: list[np.ndarray] | None = None) -> np.ndarray:
        """Mean over the leading trees, stopped once 1/precision of them are witnesses.

        A witness's total lies half a deviation beyond the running mean on the
        critical side; each query stops on its own. `known`: what each tree gives
        for every query, if that is at hand.
        """
        n = len(queries)
        left = np.arange(n)
        total: np.ndarray | None = None
        count, hits = np.zeros(n), np.zeros(n)
        sums, squares = np.zeros(n), np.zeros(n)
        for i, t in enumerate(self.trees):
            if known is not None:
                r = known[i][left]
            else:
                r = folds.scores(t, queries[left]) if make is folds.Score and not ignore_mass else folds.traverse(t, queries[left], make(), ignore_mass)
            if total is None:
                total = np.zeros((n, *r.shape[1:]))
            total[left] += r
            v = r.reshape(len(left), -1).sum(axis=1)
            count[left] += 1
            sums[left] += v
            squares[left] += v * v
            k = count[left]
            mean = sums[left] / k
            spread = np.sqrt(np.maximum(0, squares[left] / k - mean**2) * k / np.maximum(1, k - 1))
            side = (v - mean) if high_is_critical else (mean - v)
            hits[left] += (k >= least) & (side + 1e-6 > 0.5 * spread)
            left = left[hits[left] < 1 / precision]
            if not len(left):
                break
        return total / count.reshape(n, *[1] * (total.ndim - 1))

    def near(self, query: np.ndarray, threshold: float = np.inf) -> list[tuple[int, float, int, tuple]]:
        """(point id, distance, trees, coordinates) of leaf points nearer than the threshold, by distance."""
        found: dict[tuple, list] = {}
        for t, ids in zip(self.trees, self.point_ids, strict=True):
            p, far = folds.neighbours(t, query[None, :])
            if far[0] < threshold:
                key = tuple(t.points[p[0]].tolist())
                entry = found.setdefault(key, [int(ids[p[0]]), float(far[0]), 0])
                entry[0] = min(entry[0], int(ids[p[0]]))
                entry[2] += 1
        return sorted(((i, f, n, k) for k, (i, f, n) in found.items()), key=lambda x: (x[1], x[0]))

    def near_list(self, query: np.ndarray, percentile: float = 1.0) -> list[tuple[float, tuple, float]]:
        """(score in the tree, point, distance) of each tree's leaf, nearest first, up to the percentile of distances."""
        rows = []
        for t in self.trees:
            p, far = folds.neighbours(t, query[None, :])
            rows.append((float(folds.scores(t, query[None, :])[0]), tuple(t.points[p[0]].tolist()), float(far[0])))
        rows.sort(key=lambda r: r[2])
        return rows[: max(1, int(np.ceil(percentile * len(rows))))]

    def conditional_samples(self, query: np.ndarray, missing: list[int], centrality: float = 1.0) -> pd.DataFrame:
        """One sample a tree: tree, point_id, distance, and the point's coordinates."""
        rng = np.random.default_rng(self.seed)
        rows = []
        for i, (t, ids) in enumerate(zip(self.trees, self.point_ids, strict=True)):
            p, far = folds.conditional(t, query, missing, centrality, rng.random)
            rows.append((i, int(ids[p]), far, *t.points[p].tolist()))
        return pd.DataFrame(rows, columns=["tree", "point_id", "distance", *[f"x{j}" for j in range(len(query))]])

    def impute(self, query: np.ndarray, missing: list[int], shares: tuple[float, ...] = (0.5,), centrality: float = 1.0) -> np.ndarray:
        """For each share, the query with its missing coordinates at that percentile of the trees' samples."""
        if not missing:
            return np.repeat(query[None, :].astype(float), len(shares), axis=0)
        got = self.conditional_samples(query, missing, centrality)
        values = np.sort(got[[f"x{j}" for j in missing]].to_numpy(), axis=0)
        out = np.repeat(query[None, :].astype(float), len(shares), axis=0)
        for k, s in enumerate(shares):
            out[k, missing] = values[min(len(values) - 1, max(0, int(np.ceil(s * len(values))) - 1))]
        return out

    def impute_many(self, queries: np.ndarray, missing: list[int], shares: tuple[float, ...] = (0.5,)) -> np.ndarray:
        """impute() by rank for many queries that lack the same coordinates: queries x shares x dimensions."""
        queries = np.asarray(queries, float)
        out = np.repeat(queries[:, None, :], len(shares), axis=1)
        if not missing:
            return out
        got = np.stack([t.points[folds.conditionals(t, queries, missing)][:, missing] for t in self.trees], axis=1)
        values = np.sort(got, axis=1)
        for k, s in enumerate(shares):
            out[:, k, missing] = values[:, min(len(self.trees) - 1, max(0, int(np.ceil(s * len(self.trees))) - 1))]
        return out

    def extrapolate_many(self, shingles: np.ndarray, base: int, horizon: int, shares: tuple[float, float, float] = (0.5, 0.1, 0.9)) -> np.ndarray:
        """extrapolate() of many windows at once: windows x horizon x base x 3."""
        window = np.asarray(shingles, float)
        out = np.zeros((len(window), horizon, base, 3))
        missing = list(range(window.shape[1] - base, window.shape[1]))
        for h in range(horizon):
            window = np.concatenate([window[:, base:], np.zeros((len(window), base))], axis=1)
            got = self.impute_many(window, missing, shares)
            window[:, missing] = got[:, 0, missing]
            out[:, h] = np.swapaxes(got[:, :, missing], 1, 2)
            out[:, h, :, 1] = np.minimum(out[:, h, :, 0], out[:, h, :, 1])
            out[:, h, :, 2] = np.maximum(out[:, h, :, 0], out[:, h, :, 2])
        return out

    def extrapolate(self, shingle: np.ndarray, base: int, horizon: int, shares: tuple[float, float, float] = (0.5, 0.1, 0.9), cyclic_at: int | None = None) -> np.ndarray:
        """Forecast (horizon x base x 3): impute the next block from the window, feed the median back, repeat.

        A sliding window moves on by a block; with `cyclic_at` the window is a
        ring buffer and the block stands in slot `cyclic_at`, then the next.
        """
        window = shingle.astype(float).copy()
        slots = len(window) // base
        out = np.zeros((horizon, base, 3))
        for h in range(horizon):
            if cyclic_at is None:
                window = np.concatenate([window[base:], np.zeros(base)])
                missing = list(range(len(window) - base, len(window)))
            else:
                at = (cyclic_at + h) % slots
                missing = list(range(at * base, (at + 1) * base))
            got = self.impute(window, missing, shares)
            window[missing] = got[0, missing]
            out[h] = got[:, missing].T
            out[h, :, 1] = np.minimum(out[h, :, 0], out[h, :, 1])
            out[h, :, 2] = np.maximum(out[h, :, 0], out[h, :, 2])
        return out


def vector_column(columns: list[str] | Column) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns]) if isinstance(columns, list) else columns.cast("array<double>")


def fit(df: DataFrame, vector: list[str] | Column, sequence: str, trees: int = 50, capacity: int = 256, decay: float | None = None, seed: int = 0, weight: Column | None = None) -> Forest:
    """Fit on all rows of df in the order of the long column `sequence`."""
    points = df.select(F.col(sequence).cast("long").alias("seq"), vector_column(vector).alias("v"), *([weight.alias("w")] if weight is not None else []))
    decay = 1 / (10 * capacity) if decay is None else decay
    sample = reservoir(points, trees, capacity, "seq", decay, seed, F.col("w") if weight is not None else None).select("tree", "seq", "v")
    updates = df.count()
    table = sample.toPandas()  # trees x capacity rows, whatever the input
    if table["v"].map(len).sum() > MODEL_LIMIT:
        raise ValueError("the model is larger than MODEL_LIMIT values")
    return from_sample(table, trees, capacity, seed, updates)


def from_sample(sample: pd.DataFrame, trees: int, capacity: int, seed: int, updates: int) -> Forest:
    """Trees over a sample table (tree, seq, v); rebuilt from the same table they are the same."""
    built, ids = [], []
    ordered = sample.sort_values(["tree", "seq"])
    for t in range(trees):
        own = ordered[ordered["tree"] == t]
        if len(own):
            built.append(build(np.array(own["v"].tolist(), float), t, seed))
            ids.append(own["seq"].to_numpy())
    return Forest(built, ids, capacity, seed, updates)


def ask(df: DataFrame, forest: Forest, vector: list[str] | Column, answer: Callable[[Forest, np.ndarray], np.ndarray], keep: list[str], schema: str, names: list[str]) -> DataFrame:
    """Columns of `keep` and the answers, a column each of `names`, for every row: the model is broadcast, rows stay where they are."""
    held = df.sparkSession.sparkContext.broadcast(forest)
    sent = df.select(*keep, vector_column(vector).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            d = held.value.dimensions
            queries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            got = answer(held.value, queries) if len(queries) else np.zeros((0, len(names)))
            got = got.reshape(len(queries), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[:, j]) for j in range(len(names))]], names=[*keep, *names])

    return sent.mapInArrow(run, schema)


def keep_schema(df: DataFrame, keep: list[str], names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`{n}` double" for n in names]])


def score(df: DataFrame, forest: Forest, vector: list[str] | Column, keep: list[str]) -> DataFrame:
    return ask(df, forest, vector, lambda f, q: f.score(q), keep, keep_schema(df, keep, ["score"]), ["score"])


def attribute(df: DataFrame, forest: Forest, vector: list[str] | Column, keep: list[str]) -> DataFrame:
    """high0.., low0..: the score's parts above and below."""
    names = [*[f"high{i}" for i in range(forest.dimensions)], *[f"low{i}" for i in range(forest.dimensions)]]
    return ask(df, forest, vector, lambda f, q: f.attribution(q), keep, keep_schema(df, keep, names), names)


def replay(df: DataFrame, vector: list[str], sequence: str, trees: int, capacity: int, decay: float, block: int, seed: int = 0) -> DataFrame:
    """Score each row against the model as of its block's start: sequence (a distinct long), score.

    One stream of all rows in the order of `sequence`, as `blocks.replay` plays it.
    """
    from . import blocks, slices

    points = df.select(F.lit(0).alias("stream"), F.col(sequence).cast("long").alias("seq"), vector_column(vector).alias("v"))
    every = slices.sliced(points, "stream", ["seq"])
    return blocks.replay(every, "v", ["seq"], trees, capacity, decay, block, seed, F.col("seq"), F.col("seq")).toDF(sequence, "score")
