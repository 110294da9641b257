import random
import re

import pytest

from arborstream.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        ws = words(t)
        n = min(window, len(ws))
        for s in range(len(ws) - n + 1) if n else ():
            wins.setdefault(tuple(ws[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        ws = words(t)
        hit, found = set(), set()
        for n in {len(w) for w in wins}:
            for s in range(len(ws) - n + 1):
                own = wins.get(tuple(ws[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((i, len(ws), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items, window=10, parts=5):
    d = spark.createDataFrame([(*r, 1, "p", 3) for r in docs], "doc_id long, text string, n int, place string, item long").repartition(parts)
    b = spark.createDataFrame([(*r, 1, "w") for r in items], "item_id long, text string, n int, window string").repartition(3)
    got = decontam.decontaminate(d, b, window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, window)
    return got


def prose(rng, n, vocabulary):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("vocabulary", [2, 5, 500])
def test_matches_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    items = [(i, prose(rng, rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 25]) if vocabulary == 500 else rng.randrange(7, 16), vocabulary)) for i in range(30)]
    docs = [(i, prose(rng, rng.randrange(0, 60), vocabulary)) for i in range(120)]
    for i in range(120, 200):
        text = prose(rng, rng.randrange(0, 20), vocabulary).split()
        for _ in range(rng.randrange(1, 4)):
            own = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(own))
            text += own[a : a + rng.randrange(5, 20)] + prose(rng, rng.randrange(0, 4), vocabulary).split()
        docs.append((i, ", ".join(w.upper() if rng.random() < 0.3 else w for w in text)))
    got = check(spark, docs, items)
    assert any(r.contaminated for r in got)


def test_edges(spark):
    rng = random.Random(1)
    base = "Ä naïve 中文 café, to-be İs 12 of 3 things_that come 🙂 last in this long item"
    items = [(1, base), (1, base), (2, base.upper()), (None, "null id"), (3, None), (4, ""), (5, " .,; "), (6, "x" * 3000), (10, "the"), (11, "the of")]
    docs = [(1, None), (2, ""), (3, "..."), (4, base), (4, base), (4, "other"), (None, base), (None, None), (5, "null  ID"), (6, "x" * 3000), (7, "x" * 2999), (8, "The THE of the")]
    docs += [(9, prose(rng, 30_000, 900) + " " + base + " " + prose(rng, 30_000, 900))]
    check(spark, docs, items)
    check(spark, docs, items, 5)
    check(spark, docs, [])
    check(spark, [], items)
    with pytest.raises(ValueError):
        check(spark, docs, items, 4)


def test_a_passage_in_a_third_of_documents_and_of_items(spark):
    rng = random.Random(2)
    passage = prose(rng, 14, 10**6)
    items = [(i, prose(rng, 12, 10**6) + (" " + passage if i % 3 == 0 else "")) for i in range(60)]
    docs = [(i, prose(rng, 20, 10**6) + (" " + passage if i % 3 == 0 else "") + " " + items[i % 60][1][: 40 * (i % 4)]) for i in range(1500)]
    check(spark, docs, items, parts=40)


def test_a_full_filter_only_adds_candidates(spark, monkeypatch):
    monkeypatch.setattr(decontam, "LEAST_BITS", 6)
    monkeypatch.setattr(decontam, "MOST_BITS", 6)
    monkeypatch.setattr(decontam, "COUNTED", 10)
    rng = random.Random(3)
    items = [(i, prose(rng, 15, 300)) for i in range(20)]
    check(spark, [(i, prose(rng, 30, 300) + " " + items[i % 20][1][i % 9 :]) for i in range(100)], items)


def test_rarest_shingle_is_the_one_that_is_joined(spark):
    """Hot words around a rare one: only the places of the rare shingle become candidates."""
    hot = " ".join(["so it goes on and"] * 3)
    docs = [(i, hot) for i in range(300)] + [(999, hot + " rare " + hot)]
    check(spark, docs, [(1, "it goes on and so rare so it goes on"), (2, "goes on and rare so it goes on and so")])
