"""Tokenisation into pieces and hierarchical best-fit packing.

Each partition packs its pieces best-fit and emits the bins that are nearly
full; bins below that are items of the next round, in which fewer partitions
each take the leftovers of several, until one partition packs the last of them
or a round frees hardly any bin: then what is left does not fit together.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, hold, parts

CAPACITY = 2048
#: A bin with at most so many free places is emitted as it is.
SLACK = 8
#: Partitions whose leftovers meet in one partition of the next round.
FAN_IN = 8
#: A round that frees a smaller part of its bins than this is the last one.
LEAST_FREED = 1 / 64
#: Distinct words a worker remembers; beyond that it starts anew.
CACHE_WORDS = 400_000
END_ID = 0


# Fixed values of the tokenizer file whose words can be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters up to U+024F after lower-casing; texts with characters beyond these, ASCII and white space go whole.
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
_OTHER = re.compile("[^\t-\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


def _byte_names() -> dict[int, str]:
    """The printable character by which byte-level BPE names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words as bytes; a word not yet known is encoded when it is looked up."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordTokenizer:
    """Ids of a tokenizer file, with the ids of words remembered.

    Where the file lower-cases, drops white space and splits there (checked
    against its settings), a word's ids do not depend on its neighbours, so a
    text's ids are those of its words in order.  Texts with unusual characters
    or the spelling of a special token, and any other tokenizer, are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.by_word = self._splits_at_space(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tok.model
        self.names = _byte_names()
        self.words, self.pieces = WordIds(self._word), WordIds(self._piece)

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        norm = (spec.get("normalizer") or {}).get("normalizers")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        split, level = pre[0], pre[-1]
        return (
            norm == _NORMALIZERS
            and len(pre) == 2
            and split.get("pattern") == {"Regex": _PATTERN}
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and spec.get("model", {}).get("type") == "BPE"
        )

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word without white space."""
        pieces = _PIECES.findall(word)
        return self.pieces[word] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        """Ids of what the tokenizer takes as one word."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.names))]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word or _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), np.uint32)
        if len(self.words) > CACHE_WORDS:
            self.words, self.pieces = WordIds(self._word), WordIds(self._piece)
        return ids


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
            for i, text in enumerate(texts):
                ids = np.append(tokenizer(text), np.uint32(END_ID)).astype("<u4", copy=False)
                for p, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    rows.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            take = pa.array(rows, pa.int64())
            cols = [batch.column(j).take(take) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[*batch.schema.names[:-1], "piece", "start", "length", "ids_crc32"],
            )

    return run


class BestFit:
    """Bins by free space: the fullest bin that still takes an item is found with one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.fill: list[int] = []

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the place in it."""
        fits = self.mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = self.free[room].pop()
            if not self.free[room]:
                self.mask ^= 1 << room
        else:
            room, b = self.capacity, len(self.fill)
            self.fill.append(0)
        at = self.capacity - room
        self.fill[b] = at + size
        if left := room - size:
            self.free[left].append(b)
            self.mask |= 1 << left
        return b, at


def _pack(round_no: int, capacity: int):
    """(item, size) to (item, bin, at, fill), best-fit by falling size; bin ids are unique over rounds and partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (round_no << 56) + (TaskContext.get().partitionId() << 36)
        bins, items, where, at = BestFit(capacity), [], [], []
        for batch in batches:  # the partition is sorted by falling size
            items.append(batch.column(0))
            placed = [bins.put(s) for s in batch.column(1).to_pylist()]
            where.append(np.array([b for b, _ in placed], np.int64))
            at.append(np.array([x for _, x in placed], np.int64))
        if items:
            fill = np.array(bins.fill, np.int64)
            for i, w, x in zip(items, where, at, strict=True):
                yield pa.RecordBatch.from_arrays([i, pa.array(w + base), pa.array(x), pa.array(fill[w])], names=["item", "bin", "at", "fill"])

    return run


def pack(pieces: DataFrame, item: str, size: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """item, sequence_id, offset for every row of `pieces` (item ids are unique; 1 <= size <= capacity).

    Items are dealt by a hash and sorted within partitions, so a round that a
    lost executor makes run again fills the same bins.  A partition holds one row of
    bookkeeping a bin and an item of its own range; a later round gets only
    underfull bins, of which a best-fit partition leaves few.  Where items do
    not fit together (most fill over half a bin) no round would thin them out,
    and rounds end before all meet in one task.
    """
    spark = pieces.sparkSession
    todo = pieces.select(F.col(item).alias("item"), F.col(size).cast("int").alias("size"))
    n, level, rounds = max(parts(spark), pieces.rdd.getNumPartitions()), 1, []
    while True:
        dealt = todo.repartition(n, F.xxhash64("item")) if n > 1 else todo.coalesce(1)
        packed = hold(dealt.sortWithinPartitions(F.desc("size"), "item").mapInArrow(_pack(level, capacity), "item long, bin long, at long, fill long"), now=True)
        rounds.append(packed)
        if n == 1:
            break
        if level > 1:
            items, bins = packed.agg(F.count("*"), F.count_if(F.col("at") == 0)).first()
            if items - bins < LEAST_FREED * items:
                break
        # a bin's first item speaks for it, as `at` is 0 once a bin
        todo = packed.where((F.col("fill") < capacity - slack) & (F.col("at") == 0)).select(F.col("bin").alias("item"), F.col("fill").cast("int").alias("size"))
        n, level = -(-n // FAN_IN), level + 1
    placed = rounds[0].select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    for packed in rounds[1:]:
        up = packed.select(F.col("item").alias("__low"), F.col("bin").alias("__high"), F.col("at").alias("__at"))
        placed = placed.join(up, placed["sequence_id"] == up["__low"], "left").select(
            "item", F.coalesce("__high", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__at", F.lit(0))).alias("offset")
        )
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: id columns, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing id 0, so null and empty texts are one
    piece of length 1.  Only longer documents are cut, every `capacity` ids;
    full pieces are sequences of their own.  Repeated rows and repeated ids are
    packed each for itself.  An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    ids = id_cols or ["doc_id"]
    kinds = dict(docs.dtypes)
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(ids)]
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(ids)) + "piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(*named, F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, capacity), schema)
    pieces = hold(pieces.withColumn("item", F.monotonically_increasing_id()), now=True)
    places = pack(pieces, "item", "length", capacity, slack)
    out = pieces.join(places, "item")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(ids)], "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
