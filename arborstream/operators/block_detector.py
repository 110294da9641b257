"""Standard-mode detection over whole tables: windows, forests by blocks, thresholds as window scans.

Without fills by the model, what is learnt depends on inputs alone: transforms
and windows are affine scans, samples are mergeable, and only thresholds and
grades depend on earlier scores, which are affine scans again.  So a hot key
is spread over tasks in every step.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, slices, thresholder, transforms
from .workspace import hold


def detect(
    df: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    keep: list[str],
    shingle: int = 4,
    trees: int = 20,
    capacity: int = 64,
    decay: float | None = None,
    block: int = 32,
    seed: int = 0,
    transform: str = "NONE",
    weight: float = 1.0,
    rate: float = 1 / 2560,
    z: float = thresholder.Z_FACTOR,
    alert_once: bool = False,
    identity: Column | None = None,
) -> DataFrame:
    """keep, score, threshold, grade and correction of every row of every key.

    A row's window is its key's last `shingle` rows of the transformed values;
    it is scored by the forest of the windows before its block of `block`
    windows, and graded against the scores before it.  Rows without a whole
    window, or before the forest has learnt more than a quarter of its
    capacity, score 0 and have no threshold.  alert_once: in a run of rows with
    a grade only every `shingle`-th keeps it, and the others say ALERT_ONCE.
    Values must not be null; the order must be total within a key.
    """
    columns = list(dict.fromkeys([key, *order, *keep]))
    seq = slices.sliced(df, key, order)
    for i, value in enumerate(values):
        seq = transforms.transformed(seq, value, transform, f"__y{i}", weight, 1 / capacity)
    seq = slices.recent(seq, "__window", [f"__y{i}" for i in range(len(values))], shingle)
    place = [slices.SLICE] if seq.cut else []
    early = seq.rows.where(F.col("__window").isNull()).select(*columns, *place, F.lit(0.0).alias("score"))
    decay = 1 / (10 * capacity) if decay is None else decay
    scored = blocks.replay(seq, "__window", [*columns, *place], trees, capacity, decay, block, seed, identity)
    scored = hold(scored.unionByName(early))
    rows = max(2, shingle) if transform in (transforms.DIFFERENCE, transforms.NORMALIZE_DIFFERENCE) else shingle
    graded = thresholder.graded(replace(seq, rows=scored.where("score > 0")), "score", rate, rows, z, transformed=transform != transforms.NONE)
    rest = scored.where("score <= 0").select("*", F.lit(0.0).alias("threshold"), F.lit(0.0).alias("grade"))
    every = replace(seq, rows=graded.unionByName(rest).withColumn("correction", F.lit("NONE")))
    if alert_once:
        every = slices.numbered(every, "__n")
        every = slices.latest(every.add(__calm=F.when(F.col("grade") == 0, F.col("__n"))), "__last", "__calm")
        again = (F.col("grade") > 0) & ((F.col("__n") - F.coalesce("__last", F.lit(0)) - 1) % shingle != 0)
        every = every.add(grade=F.when(again, 0.0).otherwise(F.col("grade")), correction=F.when(again, "ALERT_ONCE").otherwise("NONE"))
    return every.rows.select(*keep, "score", "threshold", "grade", "correction")
