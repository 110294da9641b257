import hashlib
import math
import random
import re
import sys

import numpy as np
import pytest

from arborstream.llm import fingerprints as fp
from arborstream.llm.common import Words, mix64


def test_matches_brute_force(spark, edge):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[7].fingerprint == got[8].fingerprint
    prints = {i: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint64) for i, r in got.items()}
    for i, r in got.items():
        far = {j: int(np.bitwise_count(prints[i] ^ p).sum()) for j, p in prints.items() if j != i}
        assert r.copies == sum(d == 0 for d in far.values())
        assert r.near_rows == sum(0 < d <= fp.RADIUS for d in far.values())


def test_block_tables_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    rows = []
    for i in range(60):
        bits = np.unpackbits(base)
        bits[rng.choice(256, i % 12, replace=False)] ^= 1
        rows.append((np.packbits(bits).tobytes().hex(),))
    df = spark.createDataFrame(rows, "fingerprint string")
    got = {bytes(r.fp).hex(): r.others for r in fp.count_near(df).collect()}
    prints = [np.frombuffer(bytes.fromhex(r[0]), np.uint64) for r in rows]
    for (text,), p in zip(rows, prints):
        n = sum(0 < int(np.bitwise_count(p ^ q).sum()) <= fp.RADIUS for q in prints)
        assert got.get(text, 0) == n


@pytest.mark.parametrize("parts", [0, 1 << 20])
def test_hot_keys_are_cut(spark, monkeypatch, parts):
    """Keys of many times CHUNK fingerprints give the counts of brute force, keyed by blocks or by bytes."""
    monkeypatch.setattr(fp, "CHUNK", 64)
    monkeypatch.setattr(fp, "WIDE_PARTS", parts)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, 256, dtype=np.uint8)
    bits = np.repeat(base[None, :], 500, axis=0)
    for row in bits:
        row[rng.choice(256, rng.integers(0, 24), replace=False)] ^= 1
    raw = np.packbits(bits, axis=1)
    rows = [(r.tobytes().hex(),) for r in raw] + [(raw[0].tobytes().hex(),)] * 3
    got = {bytes(r.fp).hex(): r.others for r in fp.count_near(spark.createDataFrame(rows, "fingerprint string")).collect()}
    wide = np.stack([np.frombuffer(bytes.fromhex(r[0]), np.uint64) for r in rows])
    for (text,), p in zip(rows, wide):
        far = np.bitwise_count(wide ^ p).sum(axis=1)
        assert got.get(text, 0) == ((far > 0) & (far <= fp.RADIUS)).sum()


def brute_print(text):
    """The fingerprint by its definition: every distinct word votes with its weight on each of 256 signed bits."""
    words = [w.encode() for w in re.split("[\x20\x09-\x0d]+", text.translate({i: i + 32 for i in range(65, 91)})) if w]
    votes = [0.0] * fp.BITS
    for w in set(words):
        own = Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        weight = round((1 + math.log(words.count(w))) * min(len(w), 16) * 16)
        h = int(own.hash[0])
        for lane in range(4):
            x = int(mix64(np.array([(h + ((2 * lane + 1) * 0x9E3779B97F4A7C15)) % 2**64], np.uint64))[0]).to_bytes(8, sys.byteorder)
            for k in range(64):
                votes[64 * lane + k] += weight if x[k // 8] >> (7 - k % 8) & 1 else -weight
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(32, "big").hex()


def test_fingerprints_match_brute_force(spark, edge):
    docs = edge.where("doc_id is not null and doc_id <> 10").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs).collect()}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        new = fp.edited(text, following)
        own, edited, after = (brute_print(t) for t in (text, new, following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, edited)
        alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 256
        assert (got[i].near_edited, got[i].near_next) == (alike(own, edited), alike(own, after))


def test_edges(spark, edge, empty):
    assert fp.fingerprint_documents(empty).count() == 0
    assert fp.fingerprint_documents(edge).count() == edge.count()
    one = fp.fingerprint_documents(edge.where("doc_id = 1")).first()
    assert one.near_next == 1.0
    blank = fp.fingerprint_documents(edge.where("doc_id = 4")).first()
    assert blank.fingerprint == "0" * 64 and blank.n_chars == 0


def test_copies_around_four_fifths_alike_are_near(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11))) for _ in range(3000)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in range(25, 300, 50):  # 2 % of the words, each in 5 shingles: 266 of 326 stay
            words[at] = rng.choice(vocabulary)
        rows.append((2 * i + 1, " ".join(words)))
    got = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.near_rows == 1 for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("parts", [0, 5])
def test_pairs_at_every_distance_are_counted_once(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "WIDE_PARTS", parts)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        bits = rng.integers(0, 2, 256, dtype=np.uint8)
        other = bits.copy()
        # spread evenly over the bytes, the hardest case
        places = 8 * rng.permutation(32) + rng.integers(0, 8, 32)
        other[places[: rng.integers(28, 33)]] ^= 1
        rows += [(np.packbits(b).tobytes().hex(),) for b in (bits, other, other)]
    got = {bytes(r.fp).hex(): r.others for r in fp.count_near(spark.createDataFrame(rows, "fingerprint string")).collect()}
    prints = [np.frombuffer(bytes.fromhex(r[0]), np.uint64) for r in rows]
    for (text,), p in zip(rows, prints):
        assert got.get(text, 0) == sum(0 < int(np.bitwise_count(p ^ q).sum()) <= fp.RADIUS for q in prints)


def test_copies_of_a_fingerprint_do_not_grow_with_the_table(spark, monkeypatch):
    """Tables whose bytes' keys need some 5 and some 20 parts: blocks keep the copies near 144, bytes take 32 a part."""
    monkeypatch.setattr(fp, "CHUNK", 8)
    rng = np.random.default_rng(4)

    def copies(n: int, wide_parts: int) -> float:
        monkeypatch.setattr(fp, "WIDE_PARTS", wide_parts)
        rows = [(r.tobytes().hex(), 1) for r in rng.integers(0, 256, (n, 32), dtype=np.uint8)]
        units, _ = fp._dealt(spark.createDataFrame(rows, "fingerprint string, copies long"))
        return units.count() / n

    small, large = copies(10_000, 4), copies(40_000, 4)
    assert 140 < small < 150 and large < 1.3 * small
    assert copies(40_000, 1 << 20) > 3 * large
