import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from arborstream.llm.common import shingle_hashes, word_chunks
from arborstream.llm.letters import letter_chunks


def words(text):
    return text.encode().lower().split() if text else []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c Z", max_size=40)), max_size=8))
def test_words_and_shingles_match_python(texts):
    seen = {}
    for lo, hi, w in word_chunks(pa.array(texts, pa.string()), most=16):
        for i in range(hi - lo):
            want = words(texts[lo + i])
            got = [bytes(w.low[a:b]) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            assert got == want
            for word, h in zip(want, w.hash[w.first[i] : w.first[i + 1]]):
                assert seen.setdefault(word, h) == h
            n = len({tuple(want[j : j + 5]) for j in range(len(want) - 4)}) if len(want) >= 5 else bool(want)
            assert len(shingle_hashes(w, i)) == n
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_letter_words_match_python(texts):
    for lo, hi, w in letter_chunks(pa.array(texts, pa.string()), most=20):
        for i in range(hi - lo):
            low = (texts[lo + i] or "").lower()
            want = "".join(c if c.isalpha() else " " for c in low).split(" ")
            got = ["".join(map(chr, w.code[a:b])) for a, b, r in zip(w.starts, w.ends, w.row) if r == i]
            assert got == [x for x in want if x]


def test_shared_folder(spark):
    from arborstream.llm.common import cut, shared_dir, sweep

    first = shared_dir(spark)
    assert first == shared_dir(spark) and first.startswith("file:///")
    assert cut(spark.range(5)).count() == 5
    sweep(spark)
    assert cut(spark.range(6)).count() == 6
