"""Global-local detection over whole keyed tables: merged reservoirs, covered by representatives, block by block.

A key's reservoir depends on its rows alone and is mergeable, so blocks of a
hot key are judged in any order (`blocks.replay`): a block's reservoir is
covered by representatives where it lies, and each row gets its distance to
them over their radii.  Representatives that a nearer one hides do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, slices, thresholder
from .glocal import IGNORE_BELOW, SCORE_CAP
from .summaries import covered
from .workspace import hold

ANSWER = "score double, near int, representative array<double>, share double"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def judged(representatives: np.ndarray, weight: np.ndarray, radius: np.ndarray, rows: np.ndarray, occlusion: bool = True) -> tuple[np.ndarray, ...]:
    """Of each row: its score, how many representatives count, the one with the largest share, and that share."""
    use = weight > IGNORE_BELOW * weight.sum()
    reps, radius = representatives[use], radius[use]
    far = _apart(rows, reps)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    between = _apart(reps, reps)
    kept = np.ones(far.shape, bool)
    for s in range(1, far.shape[1] if occlusion else 0):
        for p in range(s):
            b = between[order[:, p], order[:, s]]
            kept[:, s] &= ~(kept[:, p] & (b < far[:, s]) & (far[:, s] > np.sqrt(far[:, p] ** 2 + b * b)))
    same = far[:, 0] == 0
    kept[same, 1:] = False
    wide = radius[order]
    measure = np.where(wide > 0, far / np.where(wide > 0, wide, 1.0), np.inf)
    measure[same, 0] = 0.0
    measure[~kept] = np.inf
    soft = np.where(kept, np.exp(-measure * measure), 0.0)
    total, count = soft.sum(axis=1), kept.sum(axis=1)
    # where none is within reach the nearest speaks for all
    best = measure.argmin(axis=1)
    each = np.arange(len(rows))
    share = np.where(total > 0, soft[each, best] / np.where(total > 0, total, 1.0), 1 / count)
    return np.minimum(measure[each, best], SCORE_CAP), count, reps[order[each, best]], share


@dataclass
class _Covers:
    """Blocks that are judged by the representatives of their samples."""

    most: int
    occlusion: bool
    jobs: list[tuple] = field(default_factory=list)
    size: int = 0

    def add(self, sample, queries: np.ndarray, rows: pa.RecordBatch) -> None:
        self.jobs.append((sample, queries, rows))
        self.size += queries.size + (sample.point.size if sample else 0)

    def scored(self) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for sample, queries, rows in self.jobs:
            n = len(queries)
            if sample is None:
                got = [pa.nulls(n, t) for t in (pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.float64())]
            else:
                points = sample.point[0]
                reps, weight, _, spread = covered(points, np.ones(len(points)), np.zeros(len(points)), np.zeros(len(points)), self.most)
                # one member more, at the mean distance of all: a representative of few has no radius of its own
                radius = (spread * weight + (spread * weight).sum() / weight.sum()) / (weight + 1)
                score, near, best, share = judged(reps, weight, radius, queries, self.occlusion)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)), pa.array(best.reshape(-1)))
                got = [pa.array(score), pa.array(near.astype(np.int32)), lists, pa.array(share)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *got], names=[*rows.schema.names, *names])
        self.jobs, self.size = [], 0


def detect(
    df: DataFrame,
    key: str,
    order: list[str],
    point: str,
    keep: list[str],
    capacity: int = 256,
    decay: float | None = None,
    most: int = 10,
    block: int = 64,
    z: float = thresholder.Z_FACTOR,
    occlusion: bool = True,
    seed: int = 0,
    identity: Column | None = None,
) -> DataFrame:
    """keep, score, threshold, grade, near, representative and share of every row of every key.

    A row's score is its least distance to a representative of its key's rows
    before its block, over the mean distance of what that one stands for, with
    one member more at the mean distance of the whole reservoir: 0 where it
    equals one, at most SCORE_CAP.  near: how many representatives no
    nearer one hides; representative, share: the one that fits best and its
    part.  Threshold and grade are the primary ones of the key's scores before
    the row.  `point` is an array column of one length.  Rows before the
    reservoir holds more than a quarter of its capacity score 0 without a
    representative, and do not count in thresholds; so do rows whose point is
    null or has null or non-finite components, which are not learnt either.
    The order must be total within a key.
    """
    columns = list(dict.fromkeys([key, *order, *keep]))
    x = F.col(point).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    seq = slices.sliced(df.withColumn("__point", F.when(whole, x)), key, order)
    place = [slices.SLICE] if seq.cut else []
    decay = 1 / (10 * capacity) if decay is None else decay
    scored = hold(blocks.replay(seq, "__point", [*columns, *place], 1, capacity, decay, block, seed, identity, judge=lambda: _Covers(most, occlusion), answer=ANSWER))
    rate = 1 / (10 * capacity)
    graded = slices.discounted(replace(seq, rows=scored.where(F.col("score").isNotNull())), {"__s": ("score", rate)}).rows
    threshold, grade = thresholder.primary(F.col("score"), F.col("before___s_count"), F.col("before___s_mean"), F.col("before___s_deviation"), z)
    names = [*keep, "score", "threshold", "grade", "near", "representative", "share"]
    graded = graded.withColumns({"threshold": threshold, "grade": grade}).select(*names)
    zero = {"score": F.lit(0.0), "threshold": F.lit(0.0), "grade": F.lit(0.0), "near": F.lit(0)}
    early = scored.where(F.col("score").isNull()).withColumns(zero).select(*names)
    none = {"representative": F.lit(None).cast("array<double>"), "share": F.lit(None).cast("double")}
    odd = seq.rows.where(F.col("__point").isNull()).withColumns({**zero, **none}).select(*names)
    return graded.unionByName(early).unionByName(odd)
