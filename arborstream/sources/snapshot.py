"""Model snapshots: a Parquet table of the sample, from which the trees are rebuilt; and older JSON states."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deviation import Deviation
from ..operators.forest import Forest, from_sample

VERSION = "4.0"


def to_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """One row a sample point: tree, seq, v, and the settings in every row."""
    rows = [(t, int(s), p.tolist()) for t, (tree, ids) in enumerate(zip(forest.trees, forest.point_ids, strict=True)) for s, p in zip(ids, tree.points, strict=True)]
    df = spark.createDataFrame(rows, "tree int, seq long, v array<double>")
    settings = {"capacity": forest.capacity, "seed": forest.seed, "updates": forest.updates, "version": VERSION}
    return df.withColumns({k: F.lit(v) for k, v in settings.items()})


def write(spark: SparkSession, forest: Forest, path: str) -> None:
    to_table(spark, forest).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> Forest:
    """The forest that was written: rebuilt from its sample, its trees are the same."""
    return from_table(spark.read.parquet(path))


def from_table(df: DataFrame) -> Forest:
    pdf = df.toPandas()  # trees x capacity rows
    if pdf.empty:
        raise ValueError("an empty snapshot")
    one = pdf.iloc[0]
    return from_sample(pdf, int(pdf["tree"].max()) + 1, int(one["capacity"]), int(one["seed"]), int(one["updates"]))


def _points_of(state: dict) -> tuple[list[list[float]], int]:
    store = state.get("pointStoreState") or state.get("pointStore") or {}
    data = store.get("pointData") or store.get("store") or []
    if isinstance(data, str):
        raise ValueError("points as packed text are not read: write the state with plain lists")
    d = int(state.get("dimensions") or store.get("dimensions") or 1)
    return [list(map(float, data[i : i + d])) for i in range(0, len(data) - d + 1, d)], d


def from_json(states: str | list[str], trees: int | None = None, seed: int = 0) -> Forest:
    """A forest from one or several older JSON states.

    Each state gives its samplers' point indexes (`compactSamplerStates` or
    `executor.treeUpdaters` with weighted points); several states' trees are put
    together, the first `trees` kept.  Trees are rebuilt from the samples.
    """
    rows: list[tuple[int, int, list[float]]] = []
    capacity, updates, n = 0, 0, 0
    for text in [states] if isinstance(states, str) else states:
        state = json.loads(text)
        capacity = max(capacity, int(state.get("sampleSize", 256)))
        updates = max(updates, int(state.get("totalUpdates") or (state.get("executor") or {}).get("totalUpdates") or 0))
        if "compactSamplerStates" in state:
            points, _ = _points_of(state)
            if not points and any(sampler.get("pointIndex") for sampler in state["compactSamplerStates"]):
                raise ValueError("a state with samples, but no points that can be read")
            for sampler in state["compactSamplerStates"]:
                for i, p in enumerate(sampler.get("pointIndex", [])):
                    seqs = sampler.get("sequenceIndexes") or sampler.get("sequenceIndex") or []
                    rows.append((n, int(seqs[i]) if i < len(seqs) else i, points[p]))
                n += 1
        else:
            if "treeUpdaters" not in (state.get("executor") or {}):
                raise ValueError(f"no forest in a state with the fields {sorted(state)[:8]}")
            for updater in state["executor"]["treeUpdaters"]:
                for i, w in enumerate((updater.get("sampler") or {}).get("weightedSamples", [])):
                    rows.append((n, int(w.get("sequenceIndex", i)), list(map(float, w["point"]))))
                n += 1
    keep = min(n, trees or n)
    table = pd.DataFrame([r for r in rows if r[0] < keep], columns=["tree", "seq", "v"])
    return from_sample(table, keep, capacity, seed, updates)


@dataclass
class Preprocessor:
    """What stands in front of a forest, as an older state has it.

    window: the last rows as they were read, oldest first; times: their times.
    quality: of values that were not missing; gaps: of the time between rows.
    """

    version: str
    mode: str
    transform: str
    imputation: str
    shingle: int
    base: int
    weights: list[float]
    window: list[list[float]]
    times: list[int]
    seen: int
    quality: Deviation
    gaps: Deviation


def _statistics(state: dict) -> Deviation:
    return Deviation(*(float(state[k]) for k in ("discount", "weight", "sum", "sumSquared")), int(state["count"]))


def preprocessor_from_json(text: str) -> Preprocessor:
    """The preprocessor of a state of version 2; a ValueError says what another layout lacks."""
    state = json.loads(text)
    if not isinstance(state, dict) or not str(state.get("version", "")).startswith("2"):
        raise ValueError("not a preprocessor state of version 2")
    needed = ["forestMode", "transformMethod", "imputationMethod", "shingleSize", "dimensions", "lastShingledInput", "previousTimeStamps", "valuesSeen", "dataQualityState", "timeStampDeviationState"]
    if lacking := [k for k in needed if state.get(k) is None]:
        raise ValueError(f"a preprocessor state without {', '.join(lacking)}")
    shingle, flat = int(state["shingleSize"]), [float(v) for v in state["lastShingledInput"]]
    base = int(state["dimensions"]) // shingle
    if base * shingle != len(flat):
        raise ValueError(f"{len(flat)} values are not {shingle} rows of {base}")
    window = [flat[i : i + base] for i in range(0, len(flat), base)]
    return Preprocessor(
        str(state["version"]), state["forestMode"], state["transformMethod"], state["imputationMethod"], shingle, base, [float(w) for w in state.get("weights") or [1.0] * (base + 1)],
        window, [int(t) for t in state["previousTimeStamps"]], int(state["valuesSeen"]), _statistics(state["dataQualityState"]), _statistics(state["timeStampDeviationState"]),
    )
