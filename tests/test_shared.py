"""Many series over shared forests: a brute-force version, late rows, nulls, batches that run again."""

import json
import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from arborstream.functions.uniforms import uniform_of
from arborstream.operators import folds
from arborstream.operators.trees import build
from arborstream.streaming.shared import SharedForests, backfill

MODELS, WIDTH, TREES, CAPACITY, SEED, RATE = 2, 2, 3, 8, 5, 0.1
SETTINGS = dict(models=MODELS, shingle=WIDTH, trees=TREES, capacity=CAPACITY, seed=SEED, rate=RATE, share=0.8, explore=0.2, compact=3)
SCHEMA = "key long, time long, id long, value double"


def _batches(count: int = 8) -> list[list[tuple]]:
    rng = np.random.default_rng(1)
    out = []
    for b in range(count):
        rows = [(int(k), 10 * b + int(t), i, float(rng.normal() + (9 if rng.random() < 0.05 else 0))) for i, (k, t) in enumerate(zip(rng.integers(0, 6, 60) ** 2 // 6, rng.integers(0, 10, 60), strict=True))]
        if b == 3:
            rows += [(1, 2, 900, 1.0), (1, None, 901, 1.0), (2, 35, 902, None), (None, 36, 903, 0.5)]
        if b == 4:
            rows += [(None, 45, 904, 0.7), (None, 45, 905, 0.7)]
        out.append(rows)
    return out


def _brute(batches: list[list[tuple]]) -> dict[tuple, tuple]:
    samples = [[[] for _ in range(TREES)] for _ in range(MODELS)]
    learnt, series, out = [0] * MODELS, {}, {}
    for version, rows in enumerate(batches):
        text = lambda x: str(-1 if x is None else x)
        forests = [[build(np.array([p for *_, p in tree]), t, SEED + a) for t, tree in enumerate(samples[a])] if learnt[a] > max(1, CAPACITY // 4) else None for a in range(MODELS)]
        new, born = [], list(learnt)
        for key in {r[0] for r in rows}:
            s = series.setdefault(key, {"last": None, "tail": [None] * (WIDTH - 1), "tries": [0.0] * MODELS, "losses": [0.0] * MODELS, "n": 0, "w": 0.0, "s": 0.0, "q": 0.0})
            first = zlib.crc32(text(key).encode()) % MODELS
            untried = [(first + i) % MODELS for i in range(MODELS) if s["tries"][(first + i) % MODELS] == 0]
            named = [] if key is None else [key]
            if untried:
                arm = untried[0]
            elif uniform_of(SEED, "explore", *named, version) < SETTINGS["explore"]:
                arm = int(uniform_of(SEED, "arm", *named, version) * MODELS)
            else:
                arm = min((s["losses"][a] / s["tries"][a], a) for a in range(MODELS))[1]
            mean = s["s"] / s["w"] if s["w"] else 0.0
            spread = math.sqrt(max(0.0, s["q"] / s["w"] - mean**2)) if s["w"] else 0.0
            own = [r for r in rows if r[0] == key]
            late = [r for r in own if r[1] is None or (s["last"] is not None and r[1] <= s["last"])]
            for r in late:
                out[r[0], r[1], r[2]] = (True, arm, 0.0, 0.0, 0.0)
            live = sorted((r for r in own if r not in late), key=lambda r: (r[1], r[2]))
            window, found, n = list(s["tail"]), [], s["n"]
            for r in live:
                window = [*window, r[3]]
                point, window = window, window[1:]
                whole = all(x is not None for x in point)
                score = float(np.mean([folds.scores(t, np.array([point]))[0] for t in forests[arm]])) if whole and forests[arm] else 0.0
                limit = mean + 3 * spread if n >= 10 and score > 0 else 0.0
                grade = max(0.0, (min(6.0, (score - mean) / spread) - 3) / 3) if 0 < limit < score and spread else 0.0
                out[r[0], r[1], r[2]] = (False, arm, score, limit, grade)
                if whole and uniform_of(SEED, "learn", *map(text, r[:3])) < SETTINGS["share"]:
                    new.append((arm, "|".join(map(text, r[:3])), point))
                if score > 0:
                    found.append(score)
            if live:
                s["last"], s["tail"] = live[-1][1], window
            for x in found:
                s["w"], s["s"], s["q"] = (v * (1 - RATE) + g for v, g in ((s["w"], 1), (s["s"], x), (s["q"], x * x)))
            s["n"] += len(found)
            if found:
                s["tries"][arm] = s["tries"][arm] * 0.95 + 1
                s["losses"][arm] = s["losses"][arm] * 0.95 + float(np.mean(found))
        for arm, name, point in new:
            learnt[arm] += 1
            for t in range(TREES):
                key = math.log(-math.log(uniform_of(SEED + arm, t, name))) - born[arm] / (10 * CAPACITY)
                samples[arm][t].append((key, name, point))
        samples = [[sorted(tree)[:CAPACITY] for tree in arm] for arm in samples]
    return out


def _feed(spark, models: SharedForests, batches: list[list[tuple]], first: int = 0) -> dict[tuple, tuple]:
    out = {}
    for v, rows in enumerate(batches, first):
        models(spark.createDataFrame(rows, SCHEMA).repartition(3), v)
        for r in models.rows(spark, v).collect():
            assert (r.key, r.time, r.id) not in out
            out[r.key, r.time, r.id] = (r.late, r.arm, r.score, r.threshold, r.grade)
    return out


def test_batches_equal_brute_force(spark, tmp_path):
    batches = _batches()
    got, want = _feed(spark, SharedForests(str(tmp_path), **SETTINGS), batches), _brute(batches)
    assert got.keys() == want.keys()
    for name, row in want.items():
        assert got[name][:2] == row[:2], name
        assert got[name][2:] == pytest.approx(row[2:], abs=1e-9), name
    assert {r[1] for r in got.values()} == {0, 1} and any(r[0] for r in got.values()) and any(r[4] > 0 for r in got.values())


def _held(spark, models: SharedForests, version: int) -> tuple:
    rows = [sorted(map(str, f(spark, version).collect())) for f in (models.samples, models.rows)]
    return *rows, models.updates(spark, version), sorted((str(r.key), r["last"], r.tail, r.scores, *[round(x, 9) for x in (r.weight, r["sum"], r.squares)]) for r in models.series(spark, version).collect())


def test_a_batch_that_runs_again_leaves_the_same_model(spark, tmp_path):
    batches = _batches(4)
    models = SharedForests(str(tmp_path), **SETTINGS)
    _feed(spark, models, batches)
    before = _held(spark, models, 3)
    again = spark.createDataFrame(batches[3], SCHEMA)
    models._grow(models.rows(spark, 3).where("not late"), 3, models.updates(spark, 2))  # a batch that failed half-way
    models(again, 3)
    assert _held(spark, models, 3) == before


def test_only_changed_series_are_written(spark, tmp_path):
    models = SharedForests(str(tmp_path), **SETTINGS)
    rows = lambda v, keys: [(k, v, k, float(k)) for k in keys]
    _feed(spark, models, [rows(0, range(40)), rows(1, [3]), rows(2, [5]), rows(3, [7])])
    written = [spark.read.parquet(f"{tmp_path}/series/v{v}").count() for v in range(4)]
    assert written == [40, 1, 1, 40]
    assert [models.series(spark, v).count() for v in range(4)] == [40] * 4
    assert {r.key: r["last"] for r in models.series(spark, 3).where("key in (3, 4, 7)").collect()} == {3: 1, 4: 0, 7: 3}


def test_an_empty_batch_and_an_empty_table(spark, tmp_path):
    models = SharedForests(f"{tmp_path}/a", **SETTINGS)
    _feed(spark, models, [_batches(1)[0], []])
    assert models.updates(spark, 1) == models.updates(spark, 0) and models.series(spark, 1).count() == models.series(spark, 0).count()
    assert backfill(spark.createDataFrame([], SCHEMA), SharedForests(f"{tmp_path}/b", **SETTINGS), 4).collect() == []


def test_as_a_stream_that_restarts(spark, tmp_path):
    """Files come in between runs; the models go on from the checkpoint, and equal those of one run."""
    batches = _batches(4)
    models = SharedForests(f"{tmp_path}/models", **SETTINGS)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(models).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    whole = SharedForests(f"{tmp_path}/whole", **SETTINGS)
    _feed(spark, whole, batches)
    assert _held(spark, models, 3) == _held(spark, whole, 3)
    assert json.loads(next(Path(f"{tmp_path}/models/done/v3").glob("part-*")).read_text())["updates"] == whole.updates(spark, 3)
