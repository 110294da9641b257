"""N-gram Jaccard join by signature trees.

Texts become sets of hashed word shingles; equal sets are one class.  Classes
that can reach the threshold meet in units (those that share a shingle of
their bottom samples), and in each unit a signature tree finds the links: its
nodes hold the OR of their members' token bitmaps and the range of their
sizes, and a dual traversal drops every pair of nodes whose largest possible
overlap is below what the threshold asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, cut, shingle_hashes, word_chunks
from .graph import components

WORDS = 5
#: Threshold as a percentage.
PERCENT = 80
#: Smallest hashes of a set by which classes meet.  Of two linked sets each of
#: the union's smallest hashes is shared with probability 0.8 or more, so the
#: chance that fewer than SHARED of the KEYS are is below 1e-12.
KEYS = 48
SHARED = 14
#: A key of more classes is hot: only classes with SHARED hot keys meet by it
#: (any others that are linked share a key that is not hot).
HOT = 128
#: Classes of a unit; larger units are cut into chunks of about so many ...
CHUNK = 2048
#: ... that first meet so many of the unit's classes; only what is not linked to most of the unit by then meets all chunks.
PIVOTS = 8
#: Units are cut as well where classes times shingles are more than this, which
#: bounds the bitmaps of two chunks by a quarter of so many bytes.
UNIT_PRODUCT = 1 << 30
#: Smallest keys that are not hot, and smallest hot ones, by which a class meets
#: others.  Two linked sets differ in a fifth of their union at most, so of the
#: part by which they must meet three quarters or more is shared, and the chance
#: that none of so many smallest keys is lies below 1e-11.
USED = 20
LEAF = 32
FANOUT = 8
#: Bits of the filter that keeps texts of no candidate class from being moved (1 MB, whatever the input).
FILTER_BITS = 1 << 23


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(exact: bool):
    """(doc_id, text) to (doc_id, n_shingles, set_id, keys): the KEYS smallest shingles, or all of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, keys = [], [], []
            for lo, hi, words in word_chunks(batch.column(1)):
                for i in range(hi - lo):
                    s = shingle_hashes(words, i, WORDS)
                    sizes.append(len(s))
                    ids.append(_set_id(s))
                    keys.append(s[: prefix(len(s)) if exact else KEYS].view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), lists], names=["doc_id", "n_shingles", "set_id", "keys"])

    return run


def prefix(n: int) -> int:
    """So many of a set's n smallest shingles hold one of those of any set it links to: an overlap of PERCENT of its size leaves fewer outside."""
    return n - -(-n * PERCENT // 100) + 1 if n else 0


def _slot(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int64) % FILTER_BITS


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = _slot(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.left_shift(np.int64(1), s & 63))], names=["word", "bits"])


def _sets(bits: np.ndarray):
    """(doc_id, text) to (doc_id, set_id, shingles) of rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array((bits[slot >> 6] >> (slot & 63)) & 1 == 1))
            ids, sets = [], []
            for lo, hi, words in word_chunks(batch.column(1)):
                for i in range(hi - lo):
                    s = shingle_hashes(words, i, WORDS)
                    ids.append(_set_id(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "set_id", "shingles"])

    return run


class SignatureTree:
    """Sets in order of size, in leaves of LEAF; a node is (first, last, OR of bitmaps, smallest size, largest size, children).

    Bitmaps have a bit for each token that two or more sets of the unit hold:
    only those can be shared, so the count of common bits is the overlap.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.bitmaps, self.sizes = bitmaps, sizes
        level = []
        for a in range(0, len(sizes), LEAF):
            b = min(a + LEAF, len(sizes))
            level.append((a, b, np.bitwise_or.reduce(bitmaps[a:b], axis=0), int(sizes[a]), int(sizes[b - 1]), ()))
        while len(level) > 1:
            level = [self._parent(level[a : a + FANOUT]) for a in range(0, len(level), FANOUT)]
        self.root = level[0]

    @staticmethod
    def _parent(nodes: list[tuple]) -> tuple:
        return nodes[0][0], nodes[-1][1], np.bitwise_or.reduce([n[2] for n in nodes], axis=0), nodes[0][3], nodes[-1][4], tuple(nodes)


class Links:
    """Union-find over the members of a unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def whole(self, a: int, b: int, c: int, d: int) -> bool:
        r = self.root(a)
        return all(self.root(i) == r for i in range(a, b)) and all(self.root(i) == r for i in range(c, d))


def _possible(a: tuple, b: tuple) -> bool:
    """Whether some set of node a can reach the threshold with some set of node b."""
    if 100 * a[4] < PERCENT * b[3] or 100 * b[4] < PERCENT * a[3]:
        return False
    most = min(int(np.bitwise_count(a[2] & b[2]).sum()), a[4], b[4])
    # 100 * o >= P * (x + y - o) with the smallest sizes x and y that the nodes allow
    return (100 + PERCENT) * most >= PERCENT * (a[3] + b[3])


def unit_links(sets: list[np.ndarray]) -> Links:
    """The components of the links among sets (ascending distinct hashes each, none empty)."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    links = Links(len(sets))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(sets)), sizes)
    vocab, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    bit, row = number[inverse[keep]], owner[keep]
    width = int(shared.sum()) // 64 + 1
    bitmaps = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(bitmaps, (row, bit >> 6), np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)))
    tree = SignatureTree(bitmaps, sizes)
    todo = [(tree.root, tree.root)]
    while todo:
        a, b = todo.pop()
        if not _possible(a, b):
            continue
        if a[5] or b[5]:
            if links.whole(a[0], a[1], b[0], b[1]):
                continue  # joined already: no link could add anything
            left, right = a[5] or (a,), b[5] or (b,)
            if a is b:
                todo += [(x, y) for i, x in enumerate(left) for y in left[i:]][::-1]
            else:
                todo += [(x, y) for x in left for y in right][::-1]
            continue
        overlap = np.zeros((a[1] - a[0], b[1] - b[0]), np.int64)
        for w in range(0, width, 512):  # bounds the memory of wide bitmaps
            x, y = bitmaps[a[0] : a[1], w : w + 512], bitmaps[b[0] : b[1], w : w + 512]
            overlap += np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
        both = sizes[a[0] : a[1], None] + sizes[None, b[0] : b[1]]
        for i, j in np.argwhere((100 + PERCENT) * overlap >= PERCENT * both):
            if a[0] + i != b[0] + j:
                links.join(a[0] + int(i), b[0] + int(j))
    place = Links(len(sets))
    for i in range(len(sets)):
        place.join(order[i], order[links.root(i)])
    return place


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, c, shingles) in order of unit to edges (u, v); a unit may span batches."""

    def edges(ids: list[int], blobs: list[bytes]) -> tuple[list[int], list[int]]:
        first: dict[int, bytes] = dict(zip(ids, blobs, strict=True))  # a class may stand twice in a unit of two chunks
        own = list(first)
        found = unit_links([np.frombuffer(first[i], np.uint64) for i in own])
        pairs = [(own[i], own[found.root(i)]) for i in range(len(own)) if found.root(i) != i]
        return [u for u, _ in pairs], [v for _, v in pairs]

    unit, ids, blobs = None, [], []
    for batch in batches:
        us, vs = [], []
        for x, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if x != unit:
                if len(ids) > 1:
                    u, v = edges(ids, blobs)
                    us += u
                    vs += v
                unit, ids, blobs = x, [], []
            ids.append(c)
            blobs.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    if len(ids) > 1:
        u, v = edges(ids, blobs)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _candidates(keys: DataFrame) -> DataFrame:
    """Of rows (key, c, need, n_shingles) those of keys by which classes meet, without `need`."""
    for _ in range(2):  # the second time, of partners that are left
        times = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").withColumnRenamed("key", "k")
        met = keys.join(times, F.col("key") == F.col("k")).drop("k")
        mine = W.partitionBy("c")  # KEYS rows at most
        met = met.withColumn("met", F.count("*").over(mine)).withColumn("hot", F.sum((F.col("times") > HOT).cast("int")).over(mine))
        keys = cut(met.where("met >= need").select("key", "c", "n_shingles", "need", "times", "hot"))
        result, keys = keys, keys.select("key", "c", "n_shingles", "need")
    warm = F.col("times") > HOT
    result = result.where(~warm | (F.col("hot") >= F.col("need"))).withColumn("warm", warm)
    rank = F.row_number().over(W.partitionBy("c", "warm").orderBy("key"))
    return result.withColumn("rank", rank).where(F.col("rank") <= USED).select("key", "c", "n_shingles")


def _linked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) that join the linked classes of each unit of `members` (unit, c)."""
    with_sets = members.join(sets, F.col("c") == F.col("sc")).select("unit", "c", "shingles")
    return with_sets.repartition("unit").sortWithinPartitions("unit").mapInArrow(_units, "u long, v long")


def _roots(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the components of all units of `members` (unit, n, cuts, i, c).

    A unit of several chunks i would cost the square of its size if all chunks
    met.  Only components are asked for, so each chunk first meets itself and
    PIVOTS classes of the unit; what these join to the unit's largest component
    needs no comparison within it.  The rest, in chunks of its own, then meets
    all chunks, or, where it is more than half of the unit, all chunks meet
    pairwise: every pair that could still join two components stands in some
    unit.
    """
    hot = members.where("cuts > 1")
    if hot.isEmpty():
        return components(_linked(members.select("unit", "c"), sets))
    sets = cut(sets)
    hot = cut(hot)
    rank = F.row_number().over(W.partitionBy("unit").orderBy(F.xxhash64(F.lit(2), "c"), "c"))
    pivots = hot.withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    pivots = pivots.select("unit", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), "c")
    first = hot.select("unit", "i", "c").unionByName(pivots).select(F.xxhash64("unit", "i").alias("unit"), "c").distinct()
    first = members.where("cuts = 1").select(F.xxhash64("unit", F.lit(-1)).alias("unit"), "c").unionByName(first)
    edges = cut(_linked(first, sets))
    roots = components(edges)
    known = cut(hot.join(roots, F.col("c") == F.col("node"), "left").select("unit", "n", "cuts", "i", "c", F.coalesce("root", "c").alias("root")))
    sizes = known.groupBy("unit", "root").agg(F.count("*").alias("size"))
    most = sizes.groupBy(F.col("unit").alias("mu")).agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("top"))
    # chunks of the rest, in the measure of the unit's own
    most = most.where("all > top").withColumn("rest", F.col("all") - F.col("top"))
    told = known.join(most, F.col("unit") == F.col("mu")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rest") * F.col("cuts") / F.col("all"))).cast("int"))
    told = cut(told.select("unit", "cuts", "parts", "i", "c", (F.col("root") != F.col("main")).alias("left"), (2 * F.col("rest") > F.col("all")).alias("most_left")))
    if told.isEmpty():
        return roots
    other = F.array_remove(F.sequence(F.lit(0), F.col("cuts") - 1), F.col("i"))
    paired = told.where("most_left").select("unit", "i", F.explode(other).alias("j"), "c")
    paired = paired.select(F.xxhash64("unit", F.lit(-2), F.least("i", "j"), F.greatest("i", "j")).alias("unit"), "c")
    told = told.where("not most_left")
    part = F.pmod(F.xxhash64(F.lit(3), "c"), F.col("parts")).cast("int")
    here = told.where("left").select("unit", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), "c")
    there = told.select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "i", "c")
    second = here.unionByName(there).select(F.xxhash64("unit", "p", "i").alias("unit"), "c").distinct()
    return components(edges.unionByName(_linked(second.unionByName(paired), sets)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Two documents link when 100 * |A and B| >= 80 * |A or B| over their sets of
    distinct 5-word shingles (words `[^\\x20\\x09-\\x0D]+` after lower-casing
    A-Z; with fewer than five words the whole sequence is the one shingle).
    component_id is the smallest id reachable by links.  Null and empty texts
    have no shingles, link with nothing and are components of their own; equal
    sets (copies, repeated rows) are one class and never compared.  A null id
    takes part and is never the smallest unless alone.  Shingles are 64-bit
    hashes.  An empty table gives no rows; other columns are ignored.

    By default classes meet by shared bottom samples, which misses a link with
    a probability below 1e-11.  exact: by any shingle that the fifth of their
    smallest ones share, which misses none and moves several times as many keys.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = rows.mapInArrow(_sketch(exact), "doc_id long, n_shingles long, set_id binary, keys array<long>")
    sketch = cut(sketch.withColumn("uid", F.monotonically_increasing_id()))
    classes = cut(sketch.where("n_shingles > 0").groupBy("set_id").agg(F.min("uid").alias("c"), F.min("doc_id").alias("low")))
    one = classes.select("c", F.col("set_id").alias("cs"))
    reps = sketch.join(one, (F.col("uid") == F.col("c")) & (F.col("set_id") == F.col("cs")))
    need = F.least(F.lit(SHARED), F.ceil(F.col("n_shingles") * (SHARED / KEYS))).cast("int")
    keys = reps.select("c", "n_shingles", need.alias("need"), F.explode("keys").alias("key"))
    met = cut(keys.select("key", "c", "n_shingles")) if exact else _candidates(keys)

    # keys with the same members are one unit
    mark = met.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y")
    )
    units = mark.where("n > 1").groupBy("n", "total", "x", "y").agg(F.min("key").alias("unit"))
    members = met.join(units.select("unit", "n", "total"), F.col("key") == F.col("unit"))
    # of so many chunks each has its part of the classes and of the shingles
    cuts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.sqrt(F.col("n") * F.col("total") / UNIT_PRODUCT)))).cast("int")
    members = cut(members.select("unit", "n", cuts.alias("cuts"), F.pmod(F.xxhash64("c"), cuts).cast("int").alias("i"), "c"))

    needed = sketch.join(members.select("c").distinct(), F.col("uid") == F.col("c")).select("c", "doc_id", "set_id")
    slots = needed.select("doc_id").mapInArrow(_slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[slots.column("word").to_numpy()] = slots.column("bits").to_numpy()
    sets = rows.mapInArrow(_sets(bits), "doc_id long, set_id binary, shingles binary")
    named = needed.select("c", F.col("doc_id").alias("nd"), F.col("set_id").alias("ns"))
    sets = sets.join(named, F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("set_id") == F.col("ns"))).select(F.col("c").alias("sc"), "shingles")
    sets = sets.groupBy("sc").agg(F.first("shingles").alias("shingles"))  # a row that stands several times is one set; the join below needs this order too
    roots = _roots(members, sets)
    rooted = classes.join(roots, F.col("c") == F.col("node"), "left").select("set_id", "low", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("set_id").alias("cs"), "component_id")
    out = sketch.select("doc_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("cs"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
