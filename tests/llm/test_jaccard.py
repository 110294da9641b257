import random

import numpy as np
import pytest

from arborstream.llm import jaccard

from .conftest import SCHEMA, TAIL, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    """component of each row index by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = [None] * len(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = min(ids) if ids else None
    return [len(s) for s in sets], out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None, *TAIL) for i, t in rows], SCHEMA).repartition(3)
    sizes, groups = brute(rows)
    for exact in (False, True):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, exact=exact).collect()), key=repr)
        assert got == sorted(((i, n, c) for (i, _), n, c in zip(rows, sizes, groups)), key=repr)


def variants(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(1, 80), 40)) for i in range(120)]
    for i in range(120, 200):  # a passage that many hold, from little to most of the text
        rows.append((i, prose(rng, rng.randrange(3, 150)) + " " + passage))
    for g in range(8):  # chains of edits around the threshold
        text = prose(rng, 120)
        for i in range(12):
            rows.append((1000 * (g + 1) - i, text))
            text = variants(rng, text, rng.randrange(0, 4))
    rows += [(1, rows[0][1]), (5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5004, "one two three four five")]
    check(spark, rows)


def test_hot_keys_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    rng = random.Random(6)
    base = prose(rng, 150)
    rows = [(i, variants(rng, base, rng.randrange(0, 6))) for i in range(90)]
    rows += [(i, base + " " + prose(rng, rng.randrange(5, 200))) for i in range(90, 150)]
    check(spark, rows)


def test_units_bounded_by_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_PRODUCT", 20_000)
    rng = random.Random(8)
    base = prose(rng, 400)
    rows = [(i, variants(rng, base, rng.randrange(0, 9))) for i in range(60)] + [(70, base)] * 5
    check(spark, rows)


def test_hot_group_at_production_values(spark):
    """6,000 different near copies of one text, more than HOT and CHUNK, beside pairs at the very threshold."""
    rng = random.Random(12)
    base = prose(rng, 100, 10**6)
    words = base.split()
    rows = []
    for i in range(6000):  # two words beside each other: 90 of 102 shingles or so stay
        own = list(words)
        at = rng.randrange(5, 94)
        own[at : at + 2] = [f"p{i}", f"q{i}"]
        rows.append((i, " ".join(own)))
    group = len(rows)
    for i in range(200):  # 80 of 100 shingles shared: just linked; 79: just not
        text = prose(rng, 94, 10**9).split()
        cut_at = 10 if i % 2 else 11
        rows += [(10_000 + 2 * i, " ".join(text)), (10_001 + 2 * i, " ".join(text[cut_at:] + [f"n{i}_{k}" for k in range(cut_at)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = {i: shingles(t) for i, t in rows}
    want = {}
    for i in range(200):
        a, b = 10_000 + 2 * i, 10_001 + 2 * i
        want[a], want[b] = a, a if linked(sets[a], sets[b]) else b
    assert {want[10_001 + 2 * i] == 10_000 + 2 * i for i in range(200)} == {True, False}
    assert all(linked(sets[0], sets[i]) or any(linked(sets[i], sets[j]) for j in range(50)) for i in range(0, group, 97))
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, exact=exact).collect()}
        assert {got[i] for i in range(group)} == {0}
        assert {i: c for i, c in got.items() if i >= 10_000} == want


def test_unit_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        core = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(core, rng.integers(20, 200), replace=False), rng.integers(0, 1 << 62, 5, dtype=np.uint64)])) for _ in range(70)]
        got = jaccard.unit_links(sets)
        want = jaccard.Links(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if linked(set(sets[i].tolist()), set(sets[j].tolist())):
                    want.join(i, j)
        assert [got.root(i) for i in range(70)] == [want.root(i) for i in range(70)]


def test_edges(spark, edge, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    got = jaccard.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 2, 3) for r in by[i]} == {1}
    assert {r.component_id for i in (7, 8, 9) for r in by[i]} == {7}
    assert [by[i][0].component_id for i in (4, 5, 6)] == [4, 5, 6]
    assert {r.component_id for r in by[None]} == {None}


@pytest.mark.parametrize("texts", [[None], ["a"], ["a", "a"]])
def test_tiny_tables(spark, texts):
    check(spark, list(enumerate(texts)))
