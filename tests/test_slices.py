import math
import random

import pytest
from pyspark.sql import functions as F

from arborstream.operators import slices, thresholder, transforms
from arborstream.operators.deviation import Deviation
from arborstream.operators.thresholder import Thresholder
from arborstream.operators.transforms import Stats, Transform

ORDER = ["t", "i"]
STATS = {"a": ("x", 0.0), "b": ("x", 0.05), "c": ("y", 0.5), "d": ("y", 0.9), "e": ("y", 1 / 2560)}


def rows(seed, hot, keys=20, each=15):
    """A hot key, a null one and short ones; ties in t, nulls in x and y."""
    rng = random.Random(seed)
    ks = ["hot"] * hot + [None] * each + [f"k{j}" for j in range(keys) for _ in range(each)]
    rng.shuffle(ks)
    out = []
    for i, k in enumerate(ks):
        x = None if rng.random() < 0.2 else rng.gauss(50, 10)
        out.append((k, i // 3, i, x, rng.uniform(-5, 5) if i % 5 else None, 1, 2))
    return out


def frame(spark, data, parts=7):
    return spark.createDataFrame(data, "k string, t long, i long, x double, y double, n int, chunk int").repartition(parts)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1:3]):
        out.setdefault(r[0], []).append(r)
    return out


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("slice_rows", [1 << 20, 61])
def test_discounted_matches_row_by_row(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(slices, "SLICE_ROWS", slice_rows)
    data = rows(slice_rows, 3000)
    seq = slices.sliced(frame(spark, data), "k", ORDER)
    assert seq.cut == (slice_rows < 3000)
    got = {r.i: r for r in slices.discounted(seq, STATS).rows.collect()}
    assert len(got) == len(data)
    for own in by_key(data).values():
        state = {n: Deviation(f) for n, (_, f) in STATS.items()}
        for r in own:
            for n, d in state.items():
                g, v = got[r[2]], r[3] if STATS[n][0] == "x" else r[4]
                assert (g[f"before_{n}_count"], close(g[f"before_{n}_mean"], d.mean), close(g[f"before_{n}_deviation"], d.deviation)) == (d.count, True, True)
                if v is not None:
                    d.update(v)
                assert (g[f"{n}_count"], close(g[f"{n}_mean"], d.mean), close(g[f"{n}_deviation"], d.deviation)) == (d.count, True, True)


def test_a_hot_key_is_spread_over_many_tasks_without_python(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 300)
    data = rows(3, 30_000)
    seq = slices.sliced(frame(spark, data, 100), "k", ORDER)
    sizes = [r["count"] for r in seq.rows.where("k = 'hot'").groupBy(slices.SLICE).count().collect()]
    assert len(sizes) >= 95
    assert max(sizes) <= 2 * 300
    plan = slices.discounted(seq, STATS).rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "InArrow" not in plan


@pytest.mark.parametrize("slice_rows", [1 << 20, 90])
def test_previous_crosses_slices(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(slices, "SLICE_ROWS", slice_rows)
    data = rows(4, 2000)
    got = {r.i: r for r in slices.previous(slices.sliced(frame(spark, data), "k", ORDER), {"px": "x", "pi": "i"}).rows.collect()}
    for own in by_key(data).values():
        last = (None, None)
        for r in own:
            assert (got[r[2]].px, got[r[2]].pi) == last
            last = (r[3], r[2])


@pytest.mark.parametrize("method", ["DIFFERENCE", "NORMALIZE"])
def test_transforms_match_row_by_row_and_return(spark, monkeypatch, method):
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    data = [(k, t, i, float(i % 37) + (x or 0), *rest) for k, t, i, x, *rest in rows(5, 1500, 5)]
    seq = slices.sliced(frame(spark, data), "k", ORDER)
    got = {r.i: r.z for r in transforms.transformed(seq, "x", method, "z", 2.0, 0.05).rows.collect()}
    full = transforms.statistics(seq, "x", 0.05).rows
    back = {r.i: r.back for r in full.select("i", transforms.inverse(method, transforms.forward(method, "x", 2.0, 1e12), 2.0).alias("back")).collect()}
    for own in by_key(data).values():
        t = Transform(method, 2.0, 0.05)
        for j, r in enumerate(own):
            assert math.isclose(got[r[2]], t.forward(r[3]), rel_tol=1e-6, abs_tol=1e-6)
            assert j == 0 or math.isclose(back[r[2]], r[3], rel_tol=1e-6, abs_tol=1e-6)
            t.update(r[3])


def test_statistics_match_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    data = [(k, t, i, float(i % 37) + (x or 0), *rest) for k, t, i, x, *rest in rows(6, 1500, 5)]
    got = {r.i: r for r in transforms.statistics(slices.sliced(frame(spark, data), "k", ORDER), "x", 0.05).rows.collect()}
    for own in by_key(data).values():
        s, last = Stats(0.05), None
        for r in own:
            s.update(r[3], last)
            last, g = r[3], got[r[2]]
            assert all(close(a, b.mean) for a, b in [(g.value_mean, s.value), (g.step_mean, s.step), (g.spread_mean, s.spread), (g.drift_mean, s.drift), (g.step_spread_mean, s.step_spread)])


@pytest.mark.parametrize(("shingle", "transformed", "auto"), [(1, False, True), (4, True, False)])
def test_grades_match_row_by_row(spark, monkeypatch, shingle, transformed, auto):
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    rng = random.Random(7)
    data = [(k, t, i, None if y is None else abs(rng.gauss(0.6, 0.3)) + 3 * (rng.random() < 0.02), y, *rest) for k, t, i, x, y, *rest in rows(7, 1500, 5)]
    got = {r.i: r for r in thresholder.graded(slices.sliced(frame(spark, data), "k", ORDER), "x", 0.01, shingle, auto=auto, transformed=transformed).collect()}
    assert len(got) == sum(r[3] is not None for r in data)
    for own in by_key(data).values():
        t, last = Thresholder(discount=0.01, auto=auto), 0.0
        for r in own:
            if r[3] is None:
                continue
            limit, grade = t.grade(r[3], transformed, False, shingle)
            assert close(got[r[2]].threshold, limit)
            assert close(got[r[2]].grade, grade)
            t.observe(r[3], r[3], last)
            last = r[3]


def test_edges(spark):
    none = frame(spark, []).where("false")
    assert slices.discounted(slices.sliced(none, "k", ORDER), STATS).rows.count() == 0
    one = slices.discounted(slices.sliced(frame(spark, [("a", 1, 1, None, 2.0, 1, 1)]), "k", ORDER), STATS).rows.first()
    assert (one.a_count, one.a_mean, one.c_count, one.c_mean, one.c_deviation, one.before_c_count, one.n, one.chunk) == (0, 0.0, 1, 2.0, 0.0, 0, 1, 1)
    with pytest.raises(ValueError, match="discount"):
        slices.discounted(slices.sliced(none, "k", ORDER), {"a": ("x", 1.0)})
    assert slices.sliced(none, "k", ORDER).rows.select(F.col("x")).count() == 0
