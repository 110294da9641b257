"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Each distinct word votes with its weight on the signed bits of its hash; the
sign of each sum is a bit of the fingerprint.  For the search, fingerprints
are cut into 16 blocks of two bytes: two within the radius of 31 differ by one
bit at most in one block at least, and so agree in one of its bytes.  Tables
keyed by each byte in turn bring them together; within a key only rows whose
other byte of the block differs by a bit at most are compared.  Where these
tables' keys would be cut into many parts, the tables are keyed by whole blocks
instead: a row goes to its own value and to each with one of its set bits
cleared, so that its copies do not grow with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_rows, cut, hold, mix64, word_chunks
from .neighbours import AFTER, BEFORE, OWN, deal, ranges, unsqueeze

BITS = 256
#: Of copies with a 5-word Jaccard similarity of 0.78 to 0.82, 99 % lie within it (sf0.1; see the README).
RADIUS = 31
#: Fingerprints of a key that one task compares; more are cut into chunks of about so many that meet pairwise.
CHUNK = 1 << 15
#: Parts of a byte's key beyond which tables are keyed by whole blocks: 32 copies a part there, 16 x 9 on average here.
WIDE_PARTS = 5
#: Pairs of rows of a key that are compared at once.
STRIP = 1 << 19
_LANES = BITS // 64
_BYTES = BITS // 8
_BLOCKS = BITS // 16
assert RADIUS < _BYTES  # else a block's two bytes may both differ


def _votes(h: np.ndarray, weight: np.ndarray) -> bytes:
    """The fingerprint of weighted term hashes."""
    with np.errstate(over="ignore"):
        lanes = np.stack([mix64(h + U64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(_LANES)], axis=1)
    signs = np.unpackbits(lanes.view(np.uint8).reshape(len(h), BITS // 8), axis=1).astype(np.float32)
    total = (2.0 * (weight.astype(np.float32) @ signs) - weight.sum()) if len(h) else np.zeros(BITS)
    return np.packbits(total > 0).tobytes()


def fingerprint_rows(words: Words, rows: int) -> list[bytes]:
    """A fingerprint a row: terms are its distinct words, weighted by (1 + ln count) times length.

    Long words are rare, so their length stands for the weight that a corpus
    count would give, and a fingerprint depends on its text alone.  A text
    without words has the fingerprint 0.
    """
    out = []
    for i in range(rows):
        a, b = words.first[i], words.first[i + 1]
        h, at, count = np.unique(words.hash[a:b], return_index=True, return_counts=True)
        length = (words.ends[a:b] - words.starts[a:b])[at] if b > a else np.empty(0)
        # rounded, so that the sums do not depend on the order of the terms
        out.append(_votes(h, np.round((1 + np.log(count)) * np.minimum(length, 16) * 16)))
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many first ones of the following text (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _prints(texts: list[str]) -> list[bytes]:
    out = []
    for lo, hi, words in word_chunks(pa.array(texts, pa.large_string())):
        out += fingerprint_rows(words, hi - lo)
    return out


def _ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, __part, __edge) by range and falling id: each with the row after it."""

    def finish(rows: list[tuple[int | None, str, bytes, str, bytes]]) -> pa.RecordBatch:
        new = [edited(t, nt) for _, t, _, nt, _ in rows]
        prints = _prints(new)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                pa.array([r[2].hex() for r in rows], pa.string()),
                pa.array([p.hex() for p in prints], pa.string()),
                pa.array([likeness(r[2], p) for r, p in zip(rows, prints, strict=True)], pa.float64()),
                pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    part, held, out, size = None, None, [], 0
    for batch in batches:
        texts = [t or "" for t in unsqueeze(batch.column(1))]
        for i, p, edge, text, fp in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts, _prints(texts), strict=True):
            if p != part:
                part, held = p, None
            if held is not None:
                out.append((held[0], held[1], held[2], text, fp))
                size += len(held[1]) + len(text)
            held = (i, text, fp) if edge == OWN else None
            if size > 1 << 20:
                yield finish(out)
                out, size = [], 0
    if out:
        yield finish(out)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fingerprint, copies) to a row for each table: (byte's place and value, fingerprint, copies)."""
    for batch in batches:
        raw = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), np.uint8).reshape(batch.num_rows, _BYTES)
        fps = pa.array([r.tobytes() for r in raw], pa.binary())
        for b in range(_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array((b << 8) + raw[:, b].astype(np.int32), pa.int32()), fps, batch.column(1)], names=["key", "fp", "copies"])


def _met(raw: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray, side: np.ndarray | None, new: Callable[[np.ndarray], np.ndarray], near: np.ndarray) -> None:
    """Compare each row x with rows first[x] to last[x]; add the copies of pairs within the radius to `near`, where `new` (of their differing bits) says so.

    With `side`, only rows of different sides meet.
    """
    wide = raw.view(np.uint64)
    here = np.arange(len(raw))
    ends = np.cumsum(last - first)
    lo = 0
    while lo < len(raw):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + STRIP, "right")))
        count = (last - first)[lo:hi]
        x = np.repeat(here[lo:hi], count)
        y = np.arange(len(x)) + np.repeat(first[lo:hi] - (ends[lo:hi] - count - done), count)
        if side is not None:
            apart = side[x] != side[y]
            x, y = x[apart], y[apart]
        far = np.zeros(len(x), np.int64)
        for k in range(_LANES):
            far += np.bitwise_count(wide[x, k] ^ wide[y, k])
            some = far <= RADIUS
            x, y, far = x[some], y[some], far[some]
        counts = new(raw[x] ^ raw[y])
        np.add.at(near, x[counts], weight[y[counts]])
        np.add.at(near, y[counts], weight[x[counts]])
        lo = hi


def _close(key: int, raw: np.ndarray, weight: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For rows that agree in a byte: the copies within the radius that no earlier table has brought together.

    Sides: -1, or only rows of different sides meet.
    """
    place = key >> 8
    other = raw[:, place ^ 1].astype(np.int64)
    order = np.argsort(other, kind="stable")
    raw, weight, other = raw[order], weight[order], other[order]
    sides = None if side[0] < 0 else side[order]
    start = np.searchsorted(other, np.arange(257))
    near = np.zeros(len(raw), np.int64)

    def new(differing: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(differing)
        meets = (apart == 0) & (apart[:, np.arange(_BYTES) ^ 1] <= 1)
        return meets.argmax(axis=1) == place

    for flip in (0, *(1 << k for k in range(8))):
        # each pair once: later rows of the same byte, or rows where the flipped bit is set
        first = np.where(other & flip == 0, start[other ^ flip], 0) if flip else np.arange(len(raw)) + 1
        last = np.where(other & flip == 0, start[(other ^ flip) + 1], 0) if flip else start[other + 1]
        _met(raw, weight, first, last, sides, new, near)
    out = np.empty_like(near)
    out[order] = near
    return out


def _close_blocks(key: int, raw: np.ndarray, weight: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For rows of a block's value, their own or with a bit cleared: the copies within the radius that no earlier block has brought together.

    Sides as for `_close`, times 2, plus 1 for rows whose own value it is; of
    these each meets all others, and rows with a cleared bit do not meet.
    """
    place = key >> 16
    order = np.argsort(1 - (side & 1), kind="stable")
    raw, weight, side = raw[order], weight[order], side[order]
    own = int((side & 1).sum())
    here = np.arange(len(raw))
    near = np.zeros(len(raw), np.int64)

    def new(differing: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(differing).reshape(len(differing), _BLOCKS, 2).sum(axis=2)
        return (apart <= 1).argmax(axis=1) == place

    sides = None if side[0] < 0 else side >> 1
    _met(raw, weight, np.where(here < own, here + 1, 0), np.full(len(raw), own), sides, new, near)
    out = np.empty_like(near)
    out[order] = near
    return out


def _block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fingerprint, copies) to rows for each block: (block's place and value, fingerprint, copies, own), with the value itself, then with each set bit cleared."""
    for batch in batches:
        raw = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), np.uint8).reshape(batch.num_rows, _BYTES)
        fps = pa.array([r.tobytes() for r in raw], pa.binary())
        for b in range(_BLOCKS):
            value = (raw[:, 2 * b].astype(np.int32) << 8) + raw[:, 2 * b + 1]
            for bit in (0, *(1 << k for k in range(16))):
                some = pa.array(np.flatnonzero(value & bit) if bit else np.arange(len(value)))
                key = (b << 16) + (value[some.to_numpy()] ^ bit)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), fps.take(some), batch.column(1).take(some), pa.array(np.full(len(key), int(not bit)), pa.int32())], names=["key", "fp", "copies", "own"])


def _within(batches: Iterator[pa.RecordBatch], close: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, key, fp, copies, side) by unit to (fp, near), where there are any."""

    def finish(key: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[bytes], list[int]]:
        raw, weight, side = (np.concatenate([h[j] for h in held]) for j in (0, 1, 2))
        near = close(key, raw, weight, side)
        some = np.flatnonzero(near)
        return [raw[i].tobytes() for i in some], near[some].tolist()

    unit, key, held = None, 0, []
    for batch in batches:
        out: tuple[list[bytes], list[int]] = ([], [])
        units, keys, weight, side = (batch.column(j).to_numpy() for j in (0, 1, 3, 4))
        raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(keys), _BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if units[a] != unit:
                if held:
                    for mine, new in zip(out, finish(key, held), strict=True):
                        mine += new
                unit, key, held = units[a], int(keys[a]), []
            held.append((raw[a:b], weight[a:b], side[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], names=["fp", "near"])
    if held:
        f, n = finish(key, held)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(n, pa.int64())], names=["fp", "near"])


def _units(tables: DataFrame, cuts: DataFrame | None, keys: int) -> DataFrame:
    """Rows (unit, key, fp, copies, side, and own where it is given): keys with `parts` in `cuts` are dealt to the pairs of their chunks; side -1: all rows of the unit meet."""
    own = ["own"] if "own" in tables.columns else []
    if cuts is None:
        return tables.select(F.col("key").cast("long").alias("unit"), "key", "fp", "copies", F.lit(-1).alias("side"), *own)
    dealt = tables.join(F.broadcast(cuts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    unit = F.col("key").cast("long") + ((low * F.col("parts") + high).cast("long") + F.when(F.col("parts") > 1, 1).otherwise(0)) * keys
    side = F.when(F.col("i") == F.col("j"), -1).otherwise((F.col("i") > F.col("j")).cast("int"))
    return dealt.select(unit.alias("unit"), "key", "fp", "copies", side.cast("int").alias("side"), *own)


def _dealt(distinct: DataFrame) -> tuple[DataFrame, Callable[..., np.ndarray]]:
    """Distinct fingerprints (fingerprint, copies) to the units in which they meet, and how those of a unit are compared."""
    tables, close, keys = distinct.mapInArrow(_tables, "key int, fp binary, copies long"), _close, _BYTES << 8
    parts = F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")
    cuts = hold(tables.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("key", parts))  # 8,192 keys at most
    most = cuts.agg(F.max("parts")).first()[0] or 1
    if most > WIDE_PARTS:
        tables, close, keys = distinct.mapInArrow(_block_tables, "key int, fp binary, copies long, own int"), _close_blocks, _BLOCKS << 16
        cuts = tables.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("key", parts)  # 1,048,576 keys at most
    units = _units(tables, cuts if most > 1 else None, keys)
    if close is _close_blocks:
        units = units.withColumn("side", (F.col("side") * 2 + F.col("own")).cast("int")).drop("own")
    return units, close


def count_near(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(fp, others): for each distinct fingerprint the rows with another fingerprint within RADIUS bits, where there are any.

    Equal fingerprints are counted once and weigh as many rows as they stand
    for, so groups of copies never meet; each close pair counts in the first
    table that holds both.  A key of more than CHUNK fingerprints is cut into
    chunks by a hash; every pair of chunks is a unit of its own.  Where a
    byte's key would be cut into more than WIDE_PARTS chunks, tables are keyed
    by blocks of two bytes, with the same result.
    """
    distinct = hold(prints.groupBy(F.col(column).alias("fingerprint")).agg(F.count("*").alias("copies")))
    units, close = _dealt(distinct)
    near = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: _within(batches, close), "fp binary, near long")
    return near.groupBy("fp").agg(F.sum("near").alias("others"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and how many rows lie near each.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint (64 hexadecimal digits), near_edited, near_next (share
    of equal bits), copies (other rows with the same fingerprint), near_rows
    (rows with another fingerprint within RADIUS of BITS bits).

    The edited text takes its end from the next row in falling doc_id order
    (the last row's next is the first).  Null texts are empty; the fingerprint
    of a text without words is 0.  Null ids come last.  Rows with one id stand
    in the order of a hash of their texts.  A lone row is its own next; an
    empty table gives no rows; other columns are ignored.
    """
    arrow_rows(docs.sparkSession, 512)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    edges = ranges(rows.select("doc_id"))
    dealt = deal(rows, ["doc_id"], edges, "text").where(F.col("__edge") != AFTER)
    # in falling order a range is followed by the last row of the range below it
    ordered = dealt.sortWithinPartitions("__part", F.col("__edge") == BEFORE, F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    prints = cut(
        ordered.select("doc_id", "text", "__part", "__edge").mapInArrow(
            _ring, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        )
    )
    copies = prints.groupBy("fingerprint").agg((F.count("*") - 1).alias("copies"))
    near = count_near(prints)
    counts = copies.join(near, F.unhex("fingerprint") == F.col("fp"), "left").select(F.col("fingerprint").alias("cf"), "copies", F.coalesce("others", F.lit(0)).cast("long").alias("near_rows"))
    return prints.join(counts, F.col("fingerprint") == F.col("cf")).drop("cf")


__all__ = ["count_near", "edited", "fingerprint_documents", "likeness"]
