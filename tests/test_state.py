"""Versioned states, micro-batches of many series, and streams of them."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from arborstream.operators.detector import Detector
from arborstream.operators.multi import MultiSeries
from arborstream.sources import state
from arborstream.streaming.processor import ROCKSDB, detect_many_stream


def rows(n, base=1, seed=2):
    rng = random.Random(seed)
    return [[10 * math.sin(i / 4 + j) + rng.gauss(0, 0.3) for j in range(base)] for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize(
    "settings",
    [{}, {"mode": "TIME_AUGMENTED"}, {"transform": "NORMALIZE", "auto_adjust": True, "base": 2}, {"strategy": "MULTI_MODE"}, {"mode": "STREAMING_IMPUTE", "initial": 60}],
)
def test_a_restored_detector_goes_on_as_before(settings, compress):
    whole, again, data = Detector(trees=10, capacity=32, seed=5, **settings), Detector(trees=10, capacity=32, seed=5, **settings), rows(200, settings.get("base", 1))
    data[120][0] = 60.0
    for i, values in enumerate(data):
        if i % 40 == 30:
            again = state.load(state.dump(again, compress))
        a, b = whole.step(values, 10 * i), again.step(values, 10 * i)
        assert a == b
    assert whole.extrapolate(3) == again.extrapolate(3)


def test_older_states_are_brought_up_to_date():
    d = Detector(trees=5, capacity=16, seed=1)
    for i, values in enumerate(rows(60)):
        d.step(values, i)
    new = json.loads(state.dump(d, compress=False))
    old = json.loads(json.dumps(new))
    old["version"] = 1
    fields = old["model"]["fields"]
    forest = fields["forest"]["fields"]
    forest["samples"] = [[[-k, n, p] for k, n, p in reversed(s)] for s in forest["samples"]]
    for later in ("fast_forward", "initial", "early", "foretold"):
        del fields[later]
    got = state.load(json.dumps(old).encode())
    assert got.fast_forward is False and got.early == []
    got.initial = 0
    for i, values in enumerate(rows(40, seed=9)):
        a, b = d.step(values, 60 + i), got.step(values, 60 + i)
        assert a.score == b.score
    with pytest.raises(ValueError):
        state.load(json.dumps({"version": state.VERSION + 1, "model": None}).encode())
    with pytest.raises(TypeError):
        state.dump(object())


def test_a_micro_batch_is_scored_by_the_models_at_its_start():
    m = MultiSeries(2, 2, 5, 16, seed=1)
    for i, values in enumerate(rows(60, 3)):
        m.process(dict(enumerate(values)))
    again = state.load(state.dump(m))
    batch = {0: 3.0, 1: 90.0, 2: -4.0}
    before = [f.updates for f in m.forests]
    alone = {k: state.load(state.dump(m)).step(k, v).score for k, v in batch.items()}
    got = m.process(batch)
    assert {k: r.score for k, r in got.items()} == alone
    assert sum(f.updates for f in m.forests) == sum(before) + 3
    assert {k: r.score for k, r in again.process(batch).items()} == alone


def test_many_series_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    data = [(k, t, float(v)) for t, own in enumerate(rows(60, 5)) for k, v in enumerate(own)]
    halves = [[r for r in data if r[1] < 30], [r for r in data if r[1] >= 30] + [(2, 5, 1.0)]]
    schema = "id long, t long, v double"
    for i, half in enumerate(halves):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = detect_many_stream(stream, "id", "t", "v", groups=2, models=2, shingle=2, trees=5, capacity=16).writeStream
        query = query.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
        query.foreachBatch(lambda df, epoch, i=i: df.write.mode("append").parquet(f"{tmp_path}/out{i}")).start().awaitTermination()
    got = [r for i in (0, 1) for r in spark.read.parquet(f"{tmp_path}/out{i}").collect()]
    assert len(got) == 301 and [(r.key, r.time) for r in got if r.late] == [(2, 5)]
    groups = {r.k: r.g for r in spark.range(5).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("g")).collect()}
    want = {}
    for g in set(groups.values()):
        m = MultiSeries(models=2, shingle=2, trees=5, capacity=16, seed=g)
        for t in range(60):
            found = m.process({k: v for k, at, v in data if at == t and groups[k] == g})
            want |= {(k, t): r.score for k, r in found.items()}
    assert {(r.key, r.time): r.score for r in got if not r.late} == want
