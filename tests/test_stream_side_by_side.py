"""A stream's keys side by side give what each gives alone, also after their states were saved."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborstream.operators import lockstep
from arborstream.operators.detector import Detector
from arborstream.sources import state
from arborstream.streaming import processor

SMALL = {"base": 1, "trees": 5, "capacity": 12, "shingle": 3}


def _halves(keys: int) -> list[list[list[tuple]]]:
    rng = random.Random(2)
    out = [[], []]
    for k in range(keys):
        rows = [(3 * i, [float(rng.randrange(3)) if k == 1 else rng.gauss(5, 1) + (30 if rng.random() < 0.05 else 0)]) for i in range(70 - 5 * k)]
        rows.insert(40 - k, (3, [1.0]))  # late
        out[0].append(rows[:30])
        out[1].append(rows[30:])
    return out


def _plain(d: Detector) -> dict:
    """A detector's state; a sample's rows in any order."""
    d = state.load(state.dump(d))
    d.forest.samples = [sorted(s) for s in d.forest.samples]
    return state._plain(d)


@pytest.mark.parametrize("settings", [{}, {"strategy": "MULTI_MODE", "transform": "NORMALIZE"}, {"accept": 0.25}])
def test_detectors_side_by_side_go_on_after_a_restart(monkeypatch, settings):
    monkeypatch.setattr(lockstep, "THIN", 2)
    together, alone = [[Detector(**SMALL, **settings) for _ in range(7)] for _ in range(2)]
    for half in _halves(7):
        together = [state.load(state.dump(d)) for d in together]
        got = processor._stepped(together, half)
        want = [processor._stepped([d], [rows])[0] for d, rows in zip(alone, half, strict=True)]
        assert got == want
        assert [_plain(d) for d in together] == [_plain(d) for d in alone]
    assert sum(r[-1] for rows in got for r in rows) == 7


def test_keys_are_shared_out_whole(monkeypatch):
    monkeypatch.setattr(processor, "LANES", 4)
    monkeypatch.setattr(processor, "ROWS", 100)
    ends = [10, 20, 30, 40, 50, 60, 70, 270, 280]
    own = list(processor._shared([0, *ends[:-1]], ends))
    assert [k for s in own for k in s] == list(range(9)) and max(map(len, own)) == 3
    assert own == [[0, 1, 2], [3, 4, 5], [6, 7], [8]]


@pytest.mark.parametrize("parts", [4, 12, 16, 24, 32, 48, 200])
def test_buckets_are_spread_evenly(spark, parts):
    names = processor.bucket_names(spark)
    assert len(set(names)) == processor.BUCKETS
    tasks = spark.createDataFrame([(n,) for n in names], "n long").select(F.pmod(F.hash("n"), F.lit(parts))).collect()
    assert max(Counter(r[0] for r in tasks).values()) == -(-processor.BUCKETS // parts)


def test_a_missing_key_is_a_key(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processor.ROCKSDB)
    big = 2**53 + 1  # beyond what a double tells from its neighbour
    rows = [(k, t, float(t % 5)) for t in range(20) for k in (None, 0, big)]
    spark.createDataFrame(rows, "k long, t long, v0 double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t long, v0 double").parquet(f"{tmp_path}/in")
    out = processor.detect_stream(stream, "k", "t", ["v0"], trees=5, capacity=16, shingle=2).writeStream.outputMode("update")
    out = out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
    out.foreachBatch(lambda b, e: b.write.parquet(f"{tmp_path}/out/e={e}")).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.key, {})[r.time] = (r.score, r.late)
    assert got.keys() == {None, 0, big}
    assert got[None] == got[0] == got[big] and len(got[0]) == 20 and not any(late for _, late in got[0].values())
