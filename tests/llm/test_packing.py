import random
import zlib
from collections import defaultdict

import numpy as np

from arborstream.llm import common, packing
from arborstream.llm.queries import tokenizer_path


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    own = packing.WordTokenizer(tokenizer_path())
    rng = random.Random(2)
    letters = "aB'sTreé ß× İŉ 12½²\n\t!?.,Σς中🙂<|endoftext|>\x1c\x85ǅ"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
        assert own(s).tolist() == tok.encode(s, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(edge, tokenizer_path(), slack=4).collect()
    want = defaultdict(int)
    for r in edge.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(r.doc_id, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    have = defaultdict(int)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    assert have == want
    gapless(got)


def gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_rounds_come_near_the_bound(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), 1500])) for i in range(4000)]
    df = spark.createDataFrame(sizes, "item long, length int").repartition(9)
    placed = packing.pack(df, "item", "length").join(df, "item").withColumnRenamed("item", "doc_id")
    rows = placed.collect()
    assert len(rows) == 4000
    bins = gapless(rows)
    one = packing.BestFit(2048)  # best fit by falling size in a single task
    for _, size in sorted(sizes, key=lambda x: -x[1]):
        one.put(size)
    assert bins <= 1.01 * len(one.fill)


def test_items_that_do_not_fit_together_end_the_rounds(spark):
    """20,000 items over half a bin: no round frees a bin, so they never meet in one task."""
    df = spark.range(20_000, numPartitions=16).selectExpr("id as item", "cast(1030 + id % 500 as int) as length")
    before = len(common._HELD)
    placed = packing.pack(df, "item", "length")
    rounds = common._HELD[before:]
    assert len(rounds) == 2 and rounds[-1].rdd.getNumPartitions() > 1
    assert placed.count() == 20_000 == placed.select("sequence_id").distinct().count()
    assert placed.where("offset <> 0").count() == 0


def test_edges(spark, empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
