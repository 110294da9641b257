"""Forests over keyed streams, block by block: what is learnt depends on inputs alone, so blocks need no order of execution.

A block's rows are scored against the sample of its key's rows before the
block.  A row's sample key never changes, so that sample is the top-k of the
samples of what lies before: a long key is cut into units of whole blocks,
each unit gives the smallest keys of each tree, and a tree of merges over the
units, up and down, gives every unit the sample that it starts with.  Rows
move once to be scored, those of long keys once more for their units' samples,
whatever the number of trees; no task holds more than a block, its samples, or
the samples of FAN_IN units of one tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uniforms import uniform, uniform_of
from .sampler import sample_key
from .slices import Sequences, numbered
from .workspace import hold

#: Most and least rows of a unit of a long key; between, units are as many as two a task of the session.
UNIT_ROWS, LEAST_UNIT_ROWS = 1 << 16, 1 << 11
#: Units (or groups of units) whose samples one task merges.
FAN_IN = 16
#: Sample points and queries of the blocks that a task scores together.
TOGETHER = 1 << 16


def grown_scores(points: np.ndarray, group: np.ndarray, number: np.ndarray, queries: np.ndarray, asked: np.ndarray, seed: int) -> np.ndarray:
    """Scores of queries by trees that are grown for them alone: all trees' levels side by side.

    points, group: sample points and their tree (0, 1, ...); number: what each
    tree draws its cuts by; queries, asked: queries and the tree that each
    walks.  The trees are those of `trees.build`.
    """
    mass = np.bincount(group, minlength=len(number))
    whole = mass[asked]
    score, stay = np.zeros(len(queries)), np.ones(len(queries))
    at, own = np.arange(len(points)), group
    left, walk = np.arange(len(queries)), asked
    owner, path = np.arange(len(number)), np.full(len(number), "", dtype=object)
    depth = 0
    while len(at):
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        node = own[starts]
        x = points[at]
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        size = np.diff(np.r_[starts, len(at)])
        place = np.full(len(owner), -1)
        place[node] = np.arange(len(node))
        width = high - low
        total = width.sum(axis=1)
        here = place[walk]
        q = queries[left]
        gap = np.maximum(np.maximum(q - high[here], low[here] - q), 0.0).sum(axis=1)
        out = gap > 0
        p = np.where(out, gap / np.where(out, gap + total[here], 1.0), 0.0)
        score[left] += stay[left] * p / (depth + 1.0)
        stay[left] *= 1 - p
        end = total[here] == 0
        same = end & ~out
        m = size[here[same]]
        rows = left[same]
        score[rows] += stay[rows] * (1 - m / (2 * whole[rows])) / (depth + np.log2(m + 1.0))
        left, walk, here = left[~end], walk[~end], here[~end]
        inner = np.flatnonzero(total > 0)
        if not len(inner):
            break
        tree, name = owner[node[inner]], path[node[inner]]
        u = np.array([uniform_of(seed, int(number[t]), s) for t, s in zip(tree, name, strict=True)])
        rest, dim = u * total[inner], np.full(len(inner), -1)
        for d in range(points.shape[1]):
            r = width[inner, d]
            hit = (dim < 0) & (r > 0) & (rest <= r)
            dim[hit] = d
            rest = np.where(dim < 0, rest - r, rest)
        over = np.flatnonzero(dim < 0)  # rounding used the ranges up: the last one that is not empty
        for i in over:
            dim[i] = np.flatnonzero(width[inner[i]] > 0)[-1]
            rest[i] = width[inner[i], dim[i]]
        cut, top = low[inner, dim] + rest, high[inner, dim]
        cut = np.where(cut < top, cut, np.nextafter(top, low[inner, dim]))
        below = np.full(len(node), -1)
        below[inner] = np.arange(len(inner))
        split = below[place[own]]
        at, split = at[split >= 0], split[split >= 0]
        own = 2 * split + (points[at, dim[split]] > cut[split])
        split = below[here]
        walk = 2 * split + (queries[left, dim[split]] > cut[split])
        owner = np.repeat(tree, 2)
        path = np.array([s + c for s in name for c in "LR"], dtype=object)
        depth += 1
    return score * np.log2(whole + 1.0)


@dataclass
class _Sample:
    """Each tree's smallest keys with their rows' numbers and points, ascending: arrays of trees x rows."""

    key: np.ndarray
    number: np.ndarray
    point: np.ndarray

    @classmethod
    def empty(cls, trees: int, d: int) -> _Sample:
        return cls(np.empty((trees, 0)), np.empty((trees, 0), np.int64), np.empty((trees, 0, d)))

    def absorbed(self, keys: np.ndarray, numbers: np.ndarray, points: np.ndarray, capacity: int) -> _Sample:
        """With rows added: keys rows x trees."""
        trees, n = self.key.shape[0], len(numbers)
        key = np.concatenate([self.key, keys.T], axis=1)
        number = np.concatenate([self.number, np.broadcast_to(numbers, (trees, n))], axis=1)
        order = np.argsort(key, axis=1, kind="stable")[:, :capacity]
        point = np.concatenate([self.point, np.broadcast_to(points, (trees, *points.shape))], axis=1)
        return _Sample(np.take_along_axis(key, order, 1), np.take_along_axis(number, order, 1), np.take_along_axis(point, order[:, :, None], 1))


@dataclass
class _Pending:
    """Blocks that wait to be scored together."""

    trees: int
    seed: int
    jobs: list[tuple[_Sample | None, np.ndarray, pa.RecordBatch]] = field(default_factory=list)
    size: int = 0

    def add(self, sample: _Sample | None, queries: np.ndarray, rows: pa.RecordBatch) -> None:
        self.jobs.append((sample, queries, rows))
        self.size += len(queries) * self.trees + (sample.key.size if sample else 0)

    def scored(self) -> Iterator[pa.RecordBatch]:
        """The rows with their scores; blocks without a ready sample score 0."""
        if not self.jobs:
            return
        points, group, queries, asked = [], [], [], []
        for j, (s, q, _) in enumerate(self.jobs):
            if s is not None:
                trees, m, d = s.point.shape
                points.append(s.point.reshape(-1, d))
                group.append(np.repeat(j * self.trees + np.arange(trees), m))
                queries.append(np.tile(q, (trees, 1)))
                asked.append(np.repeat(j * self.trees + np.arange(trees), len(q)))
        if points:
            number = np.tile(np.arange(self.trees), len(self.jobs))
            # trees of blocks that are not ready have no points and no queries
            got = grown_scores(np.concatenate(points), np.concatenate(group), number, np.concatenate(queries), np.concatenate(asked), self.seed)
        done = 0
        for s, q, rows in self.jobs:
            if s is None:
                out = np.zeros(len(q))
            else:
                out = got[done : done + len(q) * self.trees].reshape(self.trees, -1).mean(axis=0)
                done += len(q) * self.trees
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=[*rows.schema.names, "score"])
        self.jobs, self.size = [], 0


#: Columns ahead of those that are kept: key, unit, kind (0: of the sample at the unit's start, 1: a row), number, tree, sample key, point, keys.
_AHEAD = 8


def _parts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows with one key, unit, kind and block, and whether a run begins a unit."""
    last = None
    for batch in batches:
        key, unit, kind, number = (batch.column(i).to_pylist() for i in range(4))
        marks = [(k, u, c, (n - 1) // block if c else -1) for k, u, c, n in zip(key, unit, kind, number, strict=True)]
        a = 0
        for b in range(1, len(marks) + 1):
            if b == len(marks) or marks[b] != marks[a]:
                yield last is None or marks[a][:2] != last, batch.slice(a, b - a)
                last, a = marks[a][:2], b


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _begun(batch: pa.RecordBatch, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(3).to_numpy(), _points(batch)


def _states(batches: Iterator[pa.RecordBatch], trees: int, capacity: int, block: int) -> Iterator[tuple[_Sample, pa.RecordBatch, bool]]:
    """(the sample that a run of rows is scored by, the run, whether it is a unit's last) in order; the sample changes between blocks."""
    sample: _Sample | None = None
    waiting: list[pa.RecordBatch] = []  # runs of the open block
    begun: list[tuple] = []
    now = None

    def learnt() -> _Sample:
        keys = np.concatenate([b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in waiting])
        numbers, points = np.concatenate([b.column(3).to_numpy() for b in waiting]), np.concatenate([_points(b) for b in waiting])
        return sample.absorbed(keys, numbers, points, capacity)

    for first, run in _parts(batches, block):
        if first:
            if waiting:
                yield learnt(), run.slice(0, 0), True
            sample, waiting, begun, now = None, [], [], None
        if run.column(2)[0].as_py() == 0:
            begun.append(_begun(run, trees))
            continue
        if sample is None:
            d = _points(run).shape[1]
            sample = _Sample.empty(trees, d)
            if begun:
                tree, key, number, point = (np.concatenate(c) for c in zip(*begun, strict=True))
                order = np.lexsort((number, key, tree))
                sample = _Sample(key[order].reshape(trees, -1), number[order].reshape(trees, -1), point[order].reshape(trees, -1, d))
        at = (run.column(3)[0].as_py() - 1) // block
        if waiting and at != now:
            sample, waiting = learnt(), []
        now = at
        waiting.append(run)
        yield sample, run, False
    if waiting:
        yield learnt(), waiting[-1].slice(0, 0), True


def _scored(trees: int, capacity: int, block: int, judge: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = judge()
        for sample, rows, end in _states(batches, trees, capacity, block):
            if not end:
                ready = sample.key.shape[1] > max(1, capacity // 4)
                pending.add(sample if ready else None, _points(rows), rows.select(range(_AHEAD, rows.num_columns)))
                if pending.size > TOGETHER:
                    yield from pending.scored()
        yield from pending.scored()

    return run


def _candidates(trees: int, capacity: int, block: int):
    """Rows to the samples of each unit by itself: key, unit, tree, skey, number, point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for sample, rows, end in _states(batches, trees, capacity, block):
            if end:
                m = sample.key.shape[1]
                n = trees * m
                d = sample.point.shape[2]
                points = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(sample.point.reshape(-1)))
                cols = [pa.concat_arrays([last.column(i).slice(0, 1)] * n) for i in (0, 1)]
                cols += [pa.array(np.repeat(np.arange(trees, dtype=np.int32), m)), pa.array(sample.key.reshape(-1)), pa.array(sample.number.reshape(-1)), points]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "unit", "tree", "skey", "number", "point"])
            else:
                last = rows

    return run


def _starts(candidates: DataFrame, units: int, capacity: int) -> DataFrame:
    """What each unit of a key but the first starts with: the top-k of the units before, by merges of FAN_IN up and down."""
    schema = candidates.schema
    best = lambda t: t.sort_values(["skey", "number"]).head(capacity)

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        return best(rows).assign(unit=rows["unit"].iloc[0] // FAN_IN)

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = rows[rows["side"] == 0], []
        own = rows[rows["side"] == 1]
        for unit, more in own.groupby("unit", sort=True):
            out.append(held.assign(unit=unit))
            held = best(pd.concat([held, more]))
        return pd.concat(out)[[f.name for f in schema.fields]]

    levels = [candidates]
    while units > FAN_IN ** len(levels):
        levels.append(hold(levels[-1].groupBy("key", F.floor(F.col("unit") / FAN_IN), "tree").applyInPandas(up, schema)))
    before = None
    for own in reversed(levels):
        both = own.withColumn("side", F.lit(1))
        if before is not None:
            # a group's start is that of its first unit, and is seen by all of them
            both = both.unionByName(before.withColumn("unit", (F.col("unit") * FAN_IN).cast("int")).withColumn("side", F.lit(0)))
        before = both.groupBy("key", F.floor(F.col("unit") / FAN_IN), "tree").applyInPandas(down, schema)
    return before


def replay(
    seq: Sequences,
    point: str,
    keep: list[str],
    trees: int,
    capacity: int,
    decay: float,
    block: int,
    seed: int = 0,
    identity: Column | None = None,
    sequence: Column | None = None,
    judge: Callable | None = None,
    answer: str = "score double",
) -> DataFrame:
    """keep and score: each row by the forest of its key's rows before the row's block (`block` rows each, in order).

    point: an array column, of one length and without nulls; rows without one
    take no part.  A row's sample key is drawn by `identity` (a long; default:
    its number within the key) and decays by `sequence` (default: that
    number).  A forest that has learnt no more than a quarter of its capacity
    scores 0.  judge, answer: what takes blocks with their samples instead of a
    forest (as `_Pending` does), and the columns that it adds.
    """
    rows = numbered(Sequences(seq.rows.where(F.col(point).isNotNull()), seq.key, seq.order, seq.longest, seq.cut), "__number")
    spark = seq.rows.sparkSession
    # a stated number: a row's work lies in its trees, so partitions must not be joined by their bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    per_unit = max(1, min(UNIT_ROWS, max(LEAST_UNIT_ROWS, seq.longest // (2 * n))) // block) * block
    number = F.col("__number")
    at = number if sequence is None else sequence.cast("long")
    who = number if identity is None else identity.cast("long")
    ahead = [F.col(seq.key).alias("key"), F.floor((number - 1) / per_unit).cast("int").alias("unit"), number.alias("number"), F.col(point).cast("array<double>").alias("point")]
    sent = rows.rows.select(*ahead, at.alias("at"), who.alias("who"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = [f"k{i}" for i in range(len(keep))]
    keys = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: sample_key(uniform(seed, t, "who"), F.col("at"), decay))
    none = {"tree": F.lit(None).cast("int"), "skey": F.lit(None).cast("double"), "kind": F.lit(1)}
    names = ["key", "unit", "kind", "number", "tree", "skey", "point", "keys", *kept]
    own = sent.withColumns(none)
    units = -(-seq.longest // per_unit)
    if units > 1:
        dealt = own.repartition(n, "key", "unit").sortWithinPartitions("key", "unit", "number").withColumn("keys", keys).select(*names)
        kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
        schema = f"key {kinds['key']}, unit int, tree int, skey double, number long, point array<double>"
        starts = _starts(hold(dealt.mapInArrow(_candidates(trees, capacity, block), schema)), units, capacity)
        missing = {c: F.lit(None).cast(kinds[c]) for c in ("at", "who", *kept)}
        own = own.unionByName(starts.withColumns({**missing, "kind": F.lit(0)}))
    dealt = own.repartition(n, "key", "unit").sortWithinPartitions("key", "unit", "kind", "number")
    # keys are drawn after rows have moved
    ready = dealt.withColumn("keys", F.when(F.col("kind") == 1, keys)).select(*names)
    out = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in sent.select(*kept).schema.fields], answer])
    got = ready.mapInArrow(_scored(trees, capacity, block, judge or (lambda: _Pending(trees, seed))), out)
    return got.toDF(*keep, *got.columns[len(keep) :])
