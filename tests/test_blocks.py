import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstream.functions.uniforms import uniform_of
from arborstream.operators import blocks, folds, slices
from arborstream.operators.trees import build

ORDER = ["t", "i"]


def brute(data, trees, capacity, decay, block, seed):
    """Each row by trees that are built for its block alone."""
    out, keys = {}, {}
    for r in sorted(data, key=lambda r: r[1:3]):
        if r[3] is not None:
            keys.setdefault(r[0], []).append(r)
    for own in keys.values():
        x = np.array([r[3] for r in own], float)
        for a in range(0, len(own), block):
            b = min(a + block, len(own))
            total = np.zeros(b - a)
            if min(a, capacity) > max(1, capacity // 4):
                for t in range(trees):
                    drawn = sorted((math.log(-math.log(uniform_of(seed, t, n))) - n * decay, n) for n in range(1, a + 1))[:capacity]
                    total += folds.scores(build(x[[n - 1 for _, n in drawn]], t, seed), x[a:b])
            for r, s in zip(own[a:b], total / trees, strict=True):
                out[r[2]] = s
    return out


def rows(seed, hot, keys=6, each=70, d=3):
    rng = random.Random(seed)
    ks = ["hot"] * hot + [None] * each + [f"k{j}" for j in range(keys) for _ in range(each)]
    rng.shuffle(ks)
    return [(k, i // 4, i, None if i % 17 == 0 else [float(rng.randrange(6)) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(d)], "x") for i, k in enumerate(ks)]


def play(spark, data, *settings, parts=5):
    df = spark.createDataFrame(data, "k string, t long, i long, p array<double>, score string").repartition(parts)
    got = blocks.replay(slices.sliced(df, "k", ORDER), "p", ["i"], *settings).collect()
    assert len(got) == len({r.i for r in got})
    return {r.i: r.score for r in got}


@pytest.mark.parametrize(("unit", "fan", "together"), [(1 << 16, 16, 1 << 16), (24, 3, 300), (40, 16, 1)])
def test_matches_trees_built_for_each_block(spark, monkeypatch, unit, fan, together):
    monkeypatch.setattr(blocks, "UNIT_ROWS", unit)
    monkeypatch.setattr(blocks, "LEAST_UNIT_ROWS", unit)
    monkeypatch.setattr(blocks, "FAN_IN", fan)
    monkeypatch.setattr(blocks, "TOGETHER", together)
    monkeypatch.setattr(slices, "SLICE_ROWS", 150 if unit == 24 else 1 << 18)
    data = rows(unit, 700)
    got, want = play(spark, data, 4, 20, 1 / 60, 8, 3), brute(data, 4, 20, 1 / 60, 8, 3)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)


def test_grown_scores_are_those_of_built_trees():
    rng = np.random.default_rng(1)
    for d in (1, 2, 9):
        points = np.round(rng.normal(size=(60, d)), 1)
        queries = np.concatenate([points[:20], rng.normal(size=(30, d)) * 3])
        got = blocks.grown_scores(np.tile(points, (3, 1)), np.repeat([0, 1, 2], 60), np.array([5, 0, 9]), np.tile(queries, (3, 1)), np.repeat([0, 1, 2], 50), 4)
        want = np.concatenate([folds.scores(build(points, t, 4), queries) for t in (5, 0, 9)])
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    alone = blocks.grown_scores(np.zeros((3, 2)), np.zeros(3, int), np.array([0]), np.array([[0.0, 0.0], [1.0, 0.0]]), np.zeros(2, int), 0)
    assert np.allclose(alone, folds.scores(build(np.zeros((3, 2)), 0, 0), np.array([[0.0, 0.0], [1.0, 0.0]])))


def test_a_hot_key_is_spread_and_samples_are_bounded(spark, monkeypatch):
    """On shuffled input too the candidates that move are bounded by units x trees x capacity, not by rows x trees."""
    monkeypatch.setattr(blocks, "UNIT_ROWS", 64)
    monkeypatch.setattr(blocks, "LEAST_UNIT_ROWS", 64)
    data = [("hot", i, i, [float(i % 7), float(i % 11)], "x") for i in range(3200)]
    random.Random(1).shuffle(data)
    seen = []
    inner = blocks._starts
    monkeypatch.setattr(blocks, "_starts", lambda c, *a: seen.append(c) or inner(c, *a))
    play(spark, data, 10, 8, 1 / 80, 16, 1, parts=20)
    assert seen[0].count() == 50 * 10 * 8  # units x trees x capacity; rows x trees are 32,000
    low, high = seen[0].where("unit = 7 and tree = 3").agg(F.min("number"), F.max("number")).first()
    assert 7 * 64 < low <= high <= 8 * 64
    assert seen[0].select("unit").distinct().count() == 50


def test_edges(spark):
    df = spark.createDataFrame([], "k string, t long, i long, p array<double>")
    assert blocks.replay(slices.sliced(df, "k", ORDER), "p", ["i"], 3, 8, 0.1, 4).count() == 0
    assert play(spark, [("a", 1, 1, [1.0], "x"), ("a", 2, 2, None, "x")], 3, 8, 0.1, 4) == {1: 0.0}
    same = play(spark, [("a", i, i, [1.0], "x") for i in range(40)], 3, 8, 0.1, 4)
    assert len(same) == 40 and same[39] > 0


def test_recent_numbered_and_latest_cross_slices(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 30)
    data = [(k, t, i, float(i), None if i % 7 else i) for k, t, i, *_ in rows(9, 300)]
    seq = slices.sliced(spark.createDataFrame(data, "k string, t long, i long, v double, w long").repartition(4), "k", ORDER)
    got = {r.i: r for r in slices.latest(slices.recent(slices.numbered(seq, "n"), "window", ["v", "i"], 5), "top", "w").rows.collect()}
    keys = {}
    for r in sorted(data, key=lambda r: r[1:3]):
        own = keys.setdefault(r[0], [])
        own.append(r)
        g = got[r[2]]
        assert g.n == len(own)
        assert g.window == ([v for s in own[-5:] for v in (s[3], float(s[2]))] if len(own) >= 5 else None)
        assert g.top == max((s[4] for s in own if s[4] is not None), default=None)
