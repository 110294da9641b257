import hashlib
import math
import random

import numpy as np
import pytest

from arborstream.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, n int"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def check(spark, rows, k=5, rounds=3, dims=4, parts=6):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    got = lloyd.lloyd(df, k, rounds, dims)
    want, centroids = brute(rows, k, rounds, dims)
    assert sorted((tuple(r) for r in got.assigned.select("vec_id", "cluster", "distance").collect()), key=repr) == want
    table = {r.cluster: r for r in got.centroids.collect()}
    assert [table[j].centroid for j in range(len(centroids))] == centroids
    for j in range(len(centroids)):
        assert table[j].n == sum(c == j for _, c, _ in want)
        assert table[j].inertia == sum(d for _, c, d in want if c == j)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_matches_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(lloyd, "LEAF", leaf)
    rng = random.Random(leaf)
    rows = [(i, [rng.gauss(10 * (i % 7), 1) / 8 for _ in range(4)]) for i in range(900)]
    check(spark, rows)
    check(spark, [(i, [rng.randrange(3) / 256 for _ in range(4)]) for i in range(400)])  # ties, equal centroids, empty clusters


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0]), (3, [1.0, None, 0.0, 0.0]), (4, [nan, 0.0, 0.0, 0.0]), (5, [0.0, -inf, 0.0, 0.0]), (6, []), (None, [0.25] * 4), (7, [0.5] * 4), (7, [0.5] * 4), (7, [0.25] * 4)]
    check(spark, odd, k=3)
    check(spark, odd, k=40)
    check(spark, odd, k=1, rounds=0)
    check(spark, [(i, [1e-9 * i] * 4) for i in range(50)])
    none = lloyd.lloyd(spark.createDataFrame([], SCHEMA), 5, 3, 4)
    assert (none.assigned.count(), none.centroids.count()) == (0, 0)
    with pytest.raises(ValueError):
        lloyd.lloyd(spark.createDataFrame([], SCHEMA), 0, 3, 4)


def test_values_beyond_exact_doubles(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.uniform(-2e5, 2e5) for _ in range(3)]) for i in range(120)], dims=3)


def test_one_point_holds_a_third(spark):
    rng = random.Random(6)
    rows = [(i, [0.5] * 4 if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(900)]
    check(spark, rows, parts=40)


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(600, 3)) * 5) + 40.0 * rng.integers(0, 4, (600, 1))
    t = lloyd.cover_tree(x, 4, 0)
    y = x[t.order]
    assert sorted(t.order) == list(range(600))
    for i in range(len(t.begin)):
        away = np.sqrt(lloyd.squared(y[t.begin[i] : t.begin[i] + 1], y[t.begin[i] : t.end[i]])[0])
        assert away.max() <= t.radius[i]
        if t.first[i] >= 0:
            below = range(t.first[i], t.first[i] + t.count[i])
            assert [t.begin[j] for j in below] == [t.begin[i], *[t.end[j] for j in below][:-1]] and t.end[below[-1]] == t.end[i]
            centres = y[t.begin[list(below)]]
            d = np.sqrt(lloyd.squared(centres, centres))
            assert (d[~np.eye(len(centres), dtype=bool)] > t.radius[i] / 2 * (1 - 1e-6)).all()


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 8)) * 20 + 1000 * rng.integers(0, 20, (3000, 1)))
    c = x[rng.choice(3000, 40, replace=False)]
    t = lloyd.cover_tree(x, lloyd.LEAF)
    label, taken = lloyd.nearest(x[t.order], t, lloyd.Centroids(c))
    assert (label == np.argmin(lloyd.squared(x[t.order], c), axis=1)).all()
    assert taken < 3000 * 40 / 4
