"""Structured Streaming: one detector a key, its state in the state store.

Keys are dealt into buckets. Rows of a micro-batch are sorted by time within each
key, stepped through the detector that the batch scan uses, many keys of a bucket
side by side (`operators.lockstep`), and rows that come too late go to the output
marked as such.  States are versioned (`sources.state`), so a stream resumes
under newer code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..operators import lockstep
from ..operators.detector import Detector, Steps, run
from ..operators.multi import MultiSeries
from ..sources import state

SCHEMA = "key long, time long, score double, threshold double, grade double, correction string, late boolean"


#: Buckets of keys of a stream, and the keys and rows of a bucket that go side by side. A stream keeps its buckets: a key's state is found by them.
BUCKETS, LANES, ROWS = 96, 2048, 262_144
#: The fewest keys of a set that go side by side, and the last of a set that do not: a forest that leaves its seat costs as much as some 20 rows.
FEW, LAST = 112, 32
#: Numbers of partitions that divide it get buckets as evenly as can be.
EVEN = 4800


class DetectorProcessor(StatefulProcessor):
    """settings: arguments of Detector; value columns v0..v(base - 1), and t. The keys of a bucket are stepped side by side."""

    def __init__(self, settings: dict[str, Any], columns: list[str], time: str):
        self.settings, self.columns, self.time = settings, columns, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("keyless", BooleanType()), StructField("key", LongType())])
        self.state = handle.getMapState("detectors", key, StructType([StructField("blob", BinaryType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["keyless", "key", self.time], kind="stable")
        known = self.state.exists()
        names = list(zip(pdf["keyless"].tolist(), pdf["key"].tolist(), strict=True))
        starts = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
        ends = [*starts[1:], len(names)]
        for own in _shared(starts, ends):
            first, last = starts[own[0]], ends[own[-1]]
            times = pdf[self.time].iloc[first:last].tolist()
            cells = zip(*[pdf[c].iloc[first:last].tolist() for c in self.columns], strict=True)
            held = [(int(t), [None if v != v or v is None else float(v) for v in values]) for t, values in zip(times, cells, strict=True)]
            keys = [names[starts[i]] for i in own]
            models: list[Detector] = []

            def begun(keys: list = keys, models: list = models) -> Iterator[Detector]:
                for k in keys:
                    blob = self.state.getValue(k) if known else None
                    models.append(state.load(blob[0]) if blob is not None else Detector(**self.settings))
                    yield models[-1]

            found = _seated(begun(), [held[starts[i] - first : ends[i] - first] for i in own])
            for k, model in zip(keys, models, strict=True):
                self.state.updateValue(k, (state.dump(model),))
            out = [(None if keyless else name, *r) for (keyless, name), own_rows in zip(keys, found, strict=True) for r in own_rows]
            done = pd.DataFrame(out, columns=["key", "time", "score", "threshold", "grade", "correction", "late"])
            yield done.astype({"key": "Int64"})

    def close(self) -> None:
        pass


def _shared(starts: list[int], ends: list[int]) -> Iterator[list[int]]:
    """Keys (by number) that go side by side: as alike in number as LANES allows, with ROWS rows or a key more."""
    size = math.ceil(len(starts) / math.ceil(len(starts) / LANES))
    own: list[int] = []
    for i in range(len(starts)):
        if own and (len(own) == size or ends[i - 1] - starts[own[0]] >= ROWS):
            yield own
            own = []
        own.append(i)
    yield own


def _stepped(models: list[Detector], rows: list[list[tuple]]) -> list[list[tuple]]:
    """Output rows (without the key) of each detector's (time, values); the detectors have forests of their own before and after."""
    out = _seated(models, rows)
    for d in models:
        if isinstance(d.forest, lockstep.Seat):
            d.forest = d.forest.forest()
    return out


def _seated(models: Iterable[Detector], rows: list[list[tuple]]) -> list[list[tuple]]:
    """The same, but detectors may keep their seats: as objects, the forests of many keys take some six times as much memory."""

    def stepping(d: Detector) -> Callable[[tuple], Steps]:
        def step(row: tuple) -> Steps:
            t, values = row
            before = d.early[-1][0] if d.early else d.last_time
            if before is not None and t <= before:
                return [(t, 0.0, 0.0, 0.0, "NONE", True)]
            r = yield from d.asking(values, t)
            return [(t, r.score, r.threshold, r.grade, r.correction, False)]

        return step

    wide = len(rows) > min(FEW, lockstep.THIN)
    hall = lockstep.Hall(len(rows))
    steps, held = [], []
    for d in models:  # one by one: a state that is loaded takes its seat before the next one is
        if wide and lockstep.seated(d.forest):
            d.forest = hall.seat(d.forest)
        steps.append(stepping(d))
        held.append(d)
    out: list[list[tuple]] = [[] for _ in rows]
    place, on = lockstep.abreast(list(range(len(rows))), steps, rows, out, min(LAST, lockstep.THIN)) if wide else (0, list(range(len(rows))))
    for i in on:
        if isinstance(held[i].forest, lockstep.Seat):
            held[i].forest = held[i].forest.forest()
        for row in rows[i][place:]:
            out[i] += run(steps[i](row))
    return out


def bucket_names(spark: SparkSession) -> list[int]:
    """The first number whose hash leaves 0, the first that leaves 1, and so on up to BUCKETS: a few names at random would meet in some tasks and leave others idle."""
    left = F.pmod(F.hash("id"), F.lit(EVEN))
    found = spark.range(0, 40 * EVEN, 1, 4).select("id", left.alias("left")).where(F.col("left") < BUCKETS).groupBy("left").agg(F.min("id").alias("id"))
    names = [r.id for r in found.orderBy("left").collect()]
    if len(names) < BUCKETS:
        raise RuntimeError("a bucket has no name")
    return names


def detect_stream(stream: DataFrame, key: str, time: str, columns: list[str], **settings: Any) -> DataFrame:
    """A streaming DataFrame of SCHEMA (long keys, null is one of its own); needs the RocksDB state store provider."""
    own = F.col(key).cast("long")
    bucket = F.get(F.array(*[F.lit(n) for n in bucket_names(stream.sparkSession)]), F.pmod(F.xxhash64(own), F.lit(BUCKETS)).cast("int"))
    rows = stream.select(bucket.alias("bucket"), own.isNull().alias("keyless"), F.coalesce(own, F.lit(0)).alias("key"), F.col(time).alias("time"), *columns)
    processor = DetectorProcessor({"base": len(columns), **settings}, columns, "time")
    return rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=SCHEMA, outputMode="Update", timeMode="None")


MULTI_SCHEMA = "group long, key long, time long, score double, threshold double, grade double, late boolean"


class MultiProcessor(StatefulProcessor):
    """Series of a group over the group's shared models; rows of one time are a micro-batch of theirs."""

    def __init__(self, settings: dict[str, Any], key: str, time: str, value: str):
        self.settings, self.columns = settings, [time, key, value]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("models", StructType([StructField("blob", BinaryType()), StructField("time", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        blob, last = self.state.get() if self.state.exists() else (None, None)
        models = state.load(blob) if blob is not None else MultiSeries(**self.settings, seed=int(key[0]))
        pdf = pd.concat(rows)[self.columns].sort_values(self.columns[:2], kind="stable")
        out = []
        for t, own in pdf.groupby(self.columns[0], sort=True):
            late = last is not None and t <= last
            # a series that has several rows of one time is stepped through them, one micro-batch after the other
            for _, batch in own.groupby(own.groupby(self.columns[1]).cumcount()):
                ids = batch[self.columns[1]].tolist()
                found = {} if late else models.process(dict(zip(ids, batch[self.columns[2]].astype(float).tolist(), strict=True)))
                for i in ids:
                    r = found.get(i)
                    out.append((key[0], i, int(t), *((r.score, r.threshold, r.grade) if r else (0.0, 0.0, 0.0)), late))
            last = t if last is None else max(last, t)
        self.state.update((state.dump(models), int(last)))
        yield pd.DataFrame(out, columns=["group", "key", "time", "score", "threshold", "grade", "late"])

    def close(self) -> None:
        pass


def detect_many_stream(stream: DataFrame, key: str, time: str, value: str, groups: int = 16, **settings: Any) -> DataFrame:
    """A streaming DataFrame of MULTI_SCHEMA: series (long ids) are dealt into `groups` groups by a hash, each with shared models (arguments of MultiSeries)."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).alias("time"), F.col(value).alias("value"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(groups)).alias("group"))
    processor = MultiProcessor(settings, "key", "time", "value")
    return rows.groupBy("group").transformWithStateInPandas(processor, outputStructType=MULTI_SCHEMA, outputMode="Update", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
