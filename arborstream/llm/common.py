"""Shared pieces: reading tables, shared scratch space, and the vectorised word kernel.

The word kernel works on the contiguous UTF-8 buffer of an Arrow string column,
so splitting and hashing words costs a few numpy passes per chunk of rows
rather than Python work per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once (a longer single text is handled alone).
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch sent to Python; texts of a few kB keep a batch at a few MB.
ARROW_ROWS = 1024

U64 = np.uint64


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of the session by rows, so that long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in that of spark.checkpoint.dir; where it is unset and Spark is local (tests), in one made here.

    On a cluster an unset folder is an error: executors do not see each
    other's local ones.  The path is qualified by the file system that Spark
    resolves it with.
    """
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not own:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="arborstream-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(own)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{own}/arborstream-{sc.applicationId}")
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file:///") else full


def sweep(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder; results that still read it must be written first."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back, which ends their lineage.

    A file a partition: partitions follow the bytes of splits or, after
    shuffles, of the advisory size, so tasks stay of one size on any cluster.
    files: into so many at most, for results known to be small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[DataFrame] = []


def release() -> None:
    """Let go of all rows held so far.  Only once the results that read them are written: what is read later is made again."""
    while _HELD:
        _HELD.pop().unpersist()


def hold(df: DataFrame, now: bool = False) -> DataFrame:
    """Keep rows that several later steps read in the executors' memory and disks.

    Only for rows that a given input determines: what a lost executor held is
    computed again, and must come out the same.  now: make them at once, where
    steps that run side by side would otherwise each begin to.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(held)
    if now:
        held.count()
    return held


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % k


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x5851F42D4C957F2D
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n-1 modulo 2**64, and their inverses (the base is odd)."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, b, U64)
            step[0] = 1
            _POW[k] = np.multiply.accumulate(step)
    return _POW[0][:n], _POW[1][:n]


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def runs_of(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of marked positions; a run never crosses a row's end."""
    n = len(raw)
    if not n or not inside.any():
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of 64-bit values, the same wherever the span stands."""
    n = len(values)
    with np.errstate(over="ignore"):
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of a chunk of rows after lower-casing A-Z: runs of bytes outside `between`, by default `[^\\x20\\x09-\\x0D]+`.

    starts, ends: byte offsets in the chunk; row: the row of each word;
    hash: 64-bit hash; first: index of each row's first word (rows + 1 entries).
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE):
        self.low = _LOWER[raw]
        self.starts, self.ends, self.row = runs_of(self.low, off, ~between[self.low])
        self.hash = span_hash(_BYTE[self.low], self.starts, self.ends) if len(self.starts) else np.empty(0, U64)
        self.first = np.searchsorted(self.row, np.arange(len(off)))


def word_chunks(arr: pa.Array, most: int = CHUNK_BYTES, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    raw, off = text_buffer(arr)
    for lo, hi in chunks(off, most):
        yield lo, hi, Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], between)


_K = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def shingle_hashes(words: Words, i: int, k: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of row i's k-word shingles; of fewer words, the whole sequence is one."""
    h = words.hash[words.first[i] : words.first[i + 1]]
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < k:
            total = U64(0x1D8E4E27C47D124F) * U64(len(h))
            for j, x in enumerate(h):
                total = total + x * _K[j % 5] * U64(2 * (j // 5) + 1)
            return mix64(np.array([total], U64))
        total = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            total += h[j : len(h) - k + 1 + j] * (_K[j % 5] * U64(2 * (j // 5) + 1))
        total = np.sort(mix64(total))
    keep = np.empty(len(total), bool)
    keep[0] = True
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]
