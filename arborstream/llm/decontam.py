"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of an item, and the set of its five-word
shingles is wholly in every document that holds it.  So one necessary shingle
is enough to find it: the rarest, by counts over all documents.  A first pass
counts the shingles of the benchmark in the documents; a second gives the
places of each window's rarest one, which are joined with the windows, bounded
by position and length, and verified word by word.  Texts are read where they
lie; what is shuffled is the few places that hold a rarest shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _K, U64, Words, arrow_rows, hold, mix64, word_chunks

WINDOW = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 5
#: Bits of a filter: 32 a shingle, within these bounds (of powers of two), four of them set by each.
LEAST_BITS, MOST_BITS = 16, 28
#: Shingles that a task counts before it sends what it has.
COUNTED = 1 << 17
_PROBES = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)]
# bytes between words: all of ASCII but digits and (lower-case) letters
_BETWEEN = np.zeros(256, bool)
_BETWEEN[0x00:0x30] = _BETWEEN[0x3A:0x61] = _BETWEEN[0x7B:0x80] = True


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of the first word) and hashes of all runs of k words inside a row."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    total = np.full(len(at), k, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words.hash[at + j] * _K[j]
        return at, mix64(total)


def _text(words: Words, a: int, b: int) -> str:
    """Words a to b, joined by spaces."""
    return b" ".join(words.low[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)).decode("utf-8", "replace")


def _windows(window: int):
    """Item rows (item, text) to all their windows: item, window, n (words), shingles (hash by place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for lo, hi, words in word_chunks(batch.column(1), 1 << 16, _BETWEEN):
                hashed = {}
                for k in range(1, SHINGLE + 1):
                    hashed[k] = np.zeros(len(words.hash), U64)
                    at, h = _shingles(words, k)
                    hashed[k][at] = h
                rows = []
                for i in range(lo, hi):
                    a, b = (int(words.first[i - lo + d]) for d in (0, 1))
                    n = min(window, b - a)
                    k = min(SHINGLE, n)
                    rows += [(items[i], _text(words, s, s + n), n, hashed[k][s : s + n - k + 1].view(np.int64)) for s in range(a, b - n + 1) if n]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["item", "window", "n", "shingles"])

    return run


class Filter:
    """Bits set by shingles of some lengths: what has one of its bits unset is none of them."""

    def __init__(self, bits: int, lengths: list[int], words: np.ndarray):
        self.bits, self.lengths, self.words = bits, lengths, words

    def places(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) of the shingles that pass."""
        for k in self.lengths:
            at, h = _shingles(words, k)
            with np.errstate(over="ignore"):
                for p in _PROBES:
                    bit = (h * p) >> U64(64 - self.bits)
                    on = (self.words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1
                    at, h = at[on], h[on]
            yield k, at, h


def _bits(bits: int):
    """Shingle hashes to the words of the filter that they set bits of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(U64)
            with np.errstate(over="ignore"):
                at = np.concatenate([(h * p) >> U64(64 - bits) for p in _PROBES])
                one = U64(1) << (at & U64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array(one.view(np.int64))], names=["word", "bits"])

    return run


def filter_of(shingles: DataFrame) -> Filter:
    """The filter of rows (shingle, k); its words, at most 32 MB whatever the rows, are made by the executors."""
    stats = shingles.agg(F.count("*").alias("n"), F.collect_set("k").alias("k")).first()  # at most SHINGLE lengths
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * stats.n).bit_length()))
    words = np.zeros(1 << (bits - 6), U64)
    if stats.n:
        table = shingles.select("shingle").mapInArrow(_bits(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(U64)
    return Filter(bits, sorted(stats.k), words)


def _counts(passing: Filter):
    """Texts to (shingle, n): occurrences of the shingles that pass, added up within the task."""

    def rows(total: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), between=_BETWEEN):
                found = [h for _, _, h in passing.places(words)]
                for h, n in zip(*(v.tolist() for v in np.unique(np.concatenate(found).view(np.int64), return_counts=True)), strict=True) if found else ():
                    total[h] = total.get(h, 0) + n
                if len(total) > COUNTED:
                    yield rows(total)
                    total = {}
        yield rows(total)

    return run


def _places(passing: Filter, window: int):
    """Rows (doc_id, text_hash, text) to doc_id, text_hash, n_words and the places of passing shingles with the words around them."""
    place = pa.struct([("shingle", pa.int64()), ("place", pa.int64()), ("from", pa.int64()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_chunks(batch.column(2), between=_BETWEEN):
                size = np.diff(words.first)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for k, at, h in passing.places(words):
                    around = window - k if k == SHINGLE else 0
                    row = words.row[at]
                    a = np.maximum(at - around, words.first[row])
                    b = np.minimum(at + k + around, words.first[row + 1])
                    for r, s, p, x, y in zip(row.tolist(), h.view(np.int64).tolist(), at.tolist(), a.tolist(), b.tolist(), strict=True):
                        first = int(words.first[r])
                        found[r].append({"shingle": s, "place": p - first, "from": x - first, "near": _text(words, x, y)})
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(found, pa.list_(place))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n_words", "places"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for every document.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A
    document's word inside any occurrence of a window (`window` consecutive
    words of an item, or all words of a shorter one) is hit.  items: the ids,
    as sorted strings, of items with a window in the document (empty: none).
    A null text has no words; an item without words no windows; items with one
    id are one item, and a null id is the empty string.  Repeated documents
    each get their row; an empty benchmark hits nothing; an empty table gives
    no rows; other columns are ignored.  Texts are matched whole; a document's
    hits are gathered in one row, which its own length bounds, and an item
    list is as long as the items that share its windows.
    """
    if window < SHINGLE:
        raise ValueError(f"a window has at least {SHINGLE} words")
    arrow_rows(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    occurrences = hold(items.mapInArrow(_windows(window), "item string, window string, n int, shingles array<long>"))
    windows = occurrences.select("window", "n", "shingles").dropDuplicates(["window"])
    length = F.least(F.col("n"), F.lit(SHINGLE)).alias("k")
    of_benchmark = hold(windows.select(F.explode("shingles").alias("shingle"), length).distinct())
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(filter_of(of_benchmark)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count"))
    # a window with a shingle that no document holds is in none
    counted = windows.select("window", "n", F.size("shingles").alias("needed"), F.posexplode("shingles").alias("place", "shingle")).join(counts, "shingle")
    rarest = F.min(F.struct("count", "shingle", "place")).alias("rarest")
    chosen = counted.groupBy("window", "n", "needed").agg(F.count("*").alias("have"), rarest).where("have = needed")
    index = hold(chosen.select("window", "n", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("offset")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    kind = "array<struct<shingle:long,place:long,from:long,near:string>>"
    found = hold(rows.mapInArrow(_places(filter_of(index.select("shingle", length)), window), f"doc_id long, text_hash long, n_words long, places {kind}"))
    # equal rows have equal hits, so (doc_id, text_hash) may stand for a row
    candidates = found.select("doc_id", "text_hash", "n_words", F.explode("places").alias("p")).select("doc_id", "text_hash", "n_words", "p.*")
    start = F.col("place") - F.col("offset")
    bounded = (start >= F.col("from")) & (start + F.col("n") <= F.col("n_words"))
    inside = F.slice(F.split("near", " "), (start - F.col("from") + 1).cast("int"), F.col("n"))
    verified = candidates.join(index, "shingle").where(bounded).where(F.array_join(inside, " ") == F.col("window"))
    # windows with the same items share one list, and documents with the same lists are resolved once
    lists = occurrences.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("list", F.md5(F.to_json("items")))
    of_window = hold(lists.join(index.select("window"), "window", "left_semi"))
    span = F.struct(start.alias("a"), (start + F.col("n")).alias("b"))
    hits = verified.select("doc_id", "text_hash", span.alias("span"), "window").join(of_window.select("window", "list"), "window")
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["hit"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("hit"), F.greatest(s["end"], x["b"]).alias("end")),
    )
    per_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("list")).alias("lists"))
    per_doc = hold(per_doc.select("doc_id", "text_hash", merged["hit"].alias("n_hit"), "lists", F.md5(F.array_join("lists", ",")).alias("set")))
    sets = per_doc.groupBy("set").agg(F.first("lists").alias("lists")).select("set", F.explode("lists").alias("list"))
    resolved = sets.join(of_window.select("list", "items").dropDuplicates(["list"]), "list").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    of_doc = per_doc.join(resolved, "set").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_hit", "items")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return found.select("doc_id", "text_hash", "n_words").join(of_doc, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated")
    )
