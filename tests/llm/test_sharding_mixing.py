import math
import zlib
from collections import defaultdict

import pytest

from arborstream.llm import mixing, sharding

from .conftest import SCHEMA, TAIL


def test_shards(spark, edge, empty):
    got = sharding.shard_documents(edge, 7).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in edge.collect()))
    total, before, want = sum(r[3] for r in rows), 0, []
    first = {}
    for n, (known, i, crc, size) in enumerate(rows):
        shard = (2 * before + size) * 7 // (2 * total)
        first.setdefault(shard, n)
        want.append((i if known else None, size, crc, "bytes", shard, n - first[shard], None))
        before += size
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sharding.shard_documents(empty, 7).count() == 0


def test_shards_are_balanced(spark, sf):
    from arborstream.llm.common import load

    got = sharding.shard_documents(load(spark, "/root/testdata/sf0.01", "documents"), 40).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() <= 2 * got["size"].max()
    assert (got.groupby("shard").slot.max() + 1 == got.groupby("shard").slot.count()).all()
    assert got.sort_values("doc_id").shard.is_monotonic_increasing


def make(spark, sizes):
    rows = [(n * 1000 + i, "w " * (1 + i % 7), None, f"s{n}", None, *TAIL) for n, k in enumerate(sizes) for i in range(k)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("limit", [1.0, 2.0, 3.5])
def test_repetition_limit(spark, limit):
    docs = make(spark, [400, 60, 20, 5])
    got = mixing.mix(docs, max_repeat=limit).toPandas()
    tokens = docs.select("source", "doc_id", mixing.word_count("text").alias("n")).toPandas().groupby("source").n.sum()
    weight = got.groupby("source").mix_weight.first()
    ratio = (weight / tokens).max() / (weight / tokens).min()
    assert ratio <= limit * (1 + 1e-9)
    used = got.groupby("source").mix_tokens.sum()
    for s in tokens.index:
        want = weight[s] * tokens.sum() / (weight / tokens * tokens.sum()).min()
        assert abs(used[s] - want) <= 7
    assert got.doc_id.nunique() == docs.count()  # no document is left out
    for (_, e), g in got.groupby(["source", "mix_epoch"]):
        assert g.doc_id.is_unique
        assert e == 0 or len(g) > 0


def test_bisection_finds_the_entropy(spark):
    docs = make(spark, [300, 100, 30])
    target = 1.0
    got = mixing.mix(docs, max_repeat=None, entropy=target).toPandas()
    w = got.groupby("source").mix_weight.first()
    assert abs(-(w * w.map(math.log)).sum() - target) < 1e-6 and abs(w.sum() - 1) < 1e-9


def test_budget_and_blocks(spark):
    docs = make(spark, [400, 60, 20])
    got = mixing.mix(docs, max_repeat=2.0, budget=500, n_blocks=8).toPandas()
    assert abs(got.mix_tokens.sum() - 500) <= 3 * 7 and set(got.mix_block) == set(range(8))
    share = got[got.source == "s0"].groupby("mix_block").mix_tokens.sum()
    assert share.max() - share.min() <= 16


def test_mixing_edges(spark, edge, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(edge, keep=edge.columns)
    rows = got.collect()
    assert got.columns[: len(edge.columns)] == edge.columns
    have = defaultdict(int)
    for r in rows:
        if r.mix_epoch == 0:
            have[(r.doc_id, r.text)] += 1
    want = defaultdict(int)
    for r in edge.collect():
        want[(r.doc_id, r.text)] += 1
    assert have == want
    blank = edge.where("doc_id in (4, 5, 6)")
    assert mixing.mix(blank).count() == 3
    with pytest.raises(ValueError):
        mixing.mix(edge, max_repeat=2.0, entropy=1.0)
