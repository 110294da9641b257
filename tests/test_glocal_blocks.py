import math
import random

import pytest

from arborstream.functions.uniforms import uniform_of
from arborstream.operators import blocks, glocal_blocks, slices

ORDER = ["t", "i"]
CAPACITY, MOST, BLOCK, SEED = 16, 4, 8, 3


def data(hot=300, d=2):
    """A hot key of three groups with a few strangers, and short keys."""
    rng = random.Random(4)
    centres = [[rng.uniform(-50, 50) for _ in range(d)] for _ in range(3)]
    out, n = [], 0
    for k, size in [("hot", hot), *[(f"k{j}", rng.randrange(0, 40)) for j in range(4)]]:
        for t in range(size):
            c = rng.choice(centres)
            x = [v + rng.gauss(0, 1) for v in c] if t % 67 else [500.0 + t] * d
            out.append((k, t, n, x))
            n += 1
    rng.shuffle(out)
    return out


def plain(rows):
    """The contract, a row at a time: (key, number) to (score, near, representative, share)."""
    got = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        keyed = [(math.log(-math.log(uniform_of(SEED, 0, n))) - n / (10 * CAPACITY), n, r[3]) for n, r in enumerate(own, 1)]
        for n, r in enumerate(own):
            sample = [x for *_, x in sorted(keyed[: n // BLOCK * BLOCK])[:CAPACITY]]
            if len(sample) <= CAPACITY // 4:
                got[key, r[1]] = (0.0, 0, None, None)
                continue
            reps = [min(sample)]
            while len(reps) < MOST:
                away = [min(math.dist(x, p) for p in reps) for x in sample]
                if max(away) == 0:
                    break
                reps.append(sample[away.index(max(away))])
            held = [[] for _ in reps]
            for x in sample:
                far = [math.dist(x, p) for p in reps]
                held[far.index(min(far))].append(min(far))
            found = sorted((math.dist(r[3], p), i) for i, p in enumerate(reps))
            kept = []
            for far, i in found:
                if not any((b := math.dist(reps[j], reps[i])) < far and far > math.hypot(f, b) for f, j in kept):
                    kept.append((far, i))
            if kept[0][0] == 0:
                kept = kept[:1]
            typical = sum(map(sum, held)) / len(sample)
            radius = [(sum(h) + typical) / (len(h) + 1) for h in held]
            m = [0.0 if f == 0 else f / radius[i] if radius[i] else math.inf for f, i in kept]
            soft = [math.exp(-v * v) for v in m]
            best = m.index(min(m))
            share = soft[best] / sum(soft) if sum(soft) else 1 / len(kept)
            got[key, r[1]] = (min(10.0, m[best]), len(kept), reps[kept[best][1]], share)
    return got


def detect(spark, rows, parts=5, **settings):
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, t long, i long, v array<double>, score string").repartition(parts)
    got = glocal_blocks.detect(df, "k", ORDER, "v", ["k", "t"], CAPACITY, None, MOST, BLOCK, seed=SEED, **settings).collect()
    assert len(got) == len(rows)
    return {(r.k, r.t): r for r in got}


@pytest.mark.parametrize("d", [1, 3])
def test_every_row_as_one_row_at_a_time_gives_it(spark, d):
    rows = data(200, d)
    got, want = detect(spark, rows), plain(rows)
    assert got.keys() == want.keys()
    for k, (score, near, representative, share) in want.items():
        r = got[k]
        assert r.score == pytest.approx(score, abs=1e-9), k
        assert (r.near, r.representative) == (near, representative), k
        assert share is None and r.share is None or r.share == pytest.approx(share, abs=1e-9)
    assert len({v[1] for v in want.values()}) > 2


def test_a_hot_key_in_slices_and_units_has_the_same_result(spark, monkeypatch):
    rows = data()
    whole = detect(spark, rows)
    monkeypatch.setattr(slices, "SLICE_ROWS", 80)
    monkeypatch.setattr(blocks, "UNIT_ROWS", 16)
    monkeypatch.setattr(blocks, "LEAST_UNIT_ROWS", 16)
    parts = detect(spark, rows, 9)
    for k, r in whole.items():
        assert all(r[c] == pytest.approx(parts[k][c], abs=1e-6) for c in ("score", "threshold", "grade", "near")), k
        assert r.representative == parts[k].representative


def test_strangers_are_graded_and_members_are_not(spark):
    rng = random.Random(1)
    rows = [("a", t, t, [rng.choice([0.0, 100.0]) + rng.gauss(0, 1)]) for t in range(400)]
    rows[390] = ("a", 390, 390, [50.0])
    got = detect(spark, rows, occlusion=True)
    assert got["a", 390].score == 10 and got["a", 390].grade > 0.5
    assert sum(r.grade > 0 for r in got.values()) < 20


def test_without_occlusion_every_representative_counts(spark):
    got = detect(spark, data(), occlusion=False)
    assert {r.near for r in got.values()} <= {0, 1, MOST}


def test_edges(spark):
    none = spark.createDataFrame([], "k string, t long, i long, v array<double>")
    assert glocal_blocks.detect(none, "k", ORDER, "v", ["k", "t"], CAPACITY).count() == 0
    rows = [(None, t, t, [1.0]) for t in range(40)] + [("a", 0, 50, None), ("a", 1, 51, [None]), ("a", 2, 52, [float("nan")])]
    got = detect(spark, rows)
    assert got["a", 0].representative is None and got["a", 2].score == 0
    # equal values are one representative, which each of them equals
    assert (got[None, 39].score, got[None, 39].near, got[None, 39].share) == (0, 1, 1)
