"""Ordered statistics of keyed sequences on built-in functions, with hot keys spread over tasks.

A key with more rows than a slice is cut, in order, into slices; rows are dealt
by key and slice.  A discounted sum is an affine map of the sum before it, so
each slice is summed by itself, the few totals are composed in order, and each
row adds what its slice began with.  Where no key is so long, a key is one
slice that begins with nothing, and no totals are made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .workspace import cut

#: Rows of a slice of a hot key.
SLICE_ROWS = 1 << 18
#: Most slices of hot keys, whose edges are broadcast: with more rows, slices are longer.
MOST_SLICES = 1 << 20
#: Most slices of one key.
KEY_SLICES = 1000
#: A discount's powers stay within exp(-DEPTH) to exp(DEPTH); what lies deeper weighs less than a double's rounding.
DEPTH = 300.0
SLICE = "__slice"


@dataclass
class Sequences:
    """Rows of keyed sequences: rows of a key follow each other by the columns of `order`; longest: most rows of a key; cut: whether some are in slices."""

    rows: DataFrame
    key: str
    order: list[str]
    longest: int
    cut: bool

    @property
    def place(self) -> list[str]:
        """What rows are dealt by."""
        return [self.key, SLICE] if self.cut else [self.key]

    def window(self, *more: str) -> WindowSpec:
        return W.partitionBy(*self.place, *more).orderBy(*self.order)

    def written(self) -> Sequences:
        """With rows that both totals and rows are to be made from written once, so that chains of steps do not multiply."""
        return replace(self, rows=cut(self.rows))

    def add(self, **columns: Column) -> Sequences:
        return replace(self, rows=self.rows.withColumns(columns))


def sliced(df: DataFrame, key: str, order: list[str]) -> Sequences:
    """The sequences of a table; rows of hot keys get `__slice`: 0, 1, 2 ... in order of the first column of `order` (a number).

    Rows of a key that are equal in that column share a slice.  Counts of keys,
    and quantiles of hot ones, are the only passes before rows are dealt.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    size = counts.agg(F.sum("n").alias("total"), F.max("n").alias("longest")).first()
    longest = size.longest or 0
    rows = max(SLICE_ROWS, -(-(size.total or 0) // MOST_SLICES))
    if longest <= rows:
        return Sequences(df, key, order, longest, False)
    # at most total / rows keys
    hot = counts.where(F.col("n") > rows).select(F.col(key).alias("__k"), F.ceil(F.col("n") / rows).cast("int").alias("__m"))
    own = df.select(key, order[0]).join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__k")))
    share = F.array(*[F.lit(i / KEY_SLICES) for i in range(1, KEY_SLICES)])
    sketch = own.groupBy("__k", "__m").agg(F.percentile_approx(order[0], share, 10 * KEY_SLICES).alias("__q"))
    least = F.least(F.col("__m"), F.lit(KEY_SLICES))
    cuts = F.transform(F.sequence(F.lit(1), least - 1), lambda i: F.get("__q", (F.floor(i * KEY_SLICES / least) - 1).cast("int")))
    edges = sketch.select("__k", F.array_distinct(cuts).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c <= F.col(order[0])))
    placed = df.join(F.broadcast(edges), F.col(key).eqNullSafe(F.col("__k")), "left")
    placed = placed.select(*df.columns, F.when(F.col("__cuts").isNull() | F.col(order[0]).isNull(), 0).otherwise(place).alias(SLICE))
    return Sequences(placed, key, order, longest, True)


def _joined(df: DataFrame, table: DataFrame, key: str, on: list[str], names: list[str]) -> DataFrame:
    """df with the columns `names` of a table that has one row for each (key, *on) at most."""
    renamed = table.select(F.col(key).alias("__jk"), *[F.col(c).alias(f"__j{i}") for i, c in enumerate(on)], *names)
    same = F.col(key).eqNullSafe(F.col("__jk"))
    for i, c in enumerate(on):
        same &= F.col(c) == F.col(f"__j{i}")
    return df.join(renamed, same, "left").select(*df.columns, *names)


def previous(seq: Sequences, columns: dict[str, str]) -> Sequences:
    """Add, for each (new: column), its value in the key's row before (null in the first row)."""
    if not seq.cut:
        return seq.add(**{new: F.lag(c).over(seq.window()) for new, c in columns.items()})
    seq = seq.written()
    df = seq.rows
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    ends = df.groupBy(*seq.place).agg(F.max_by(row, F.struct(*seq.order)).alias("__last"))
    before = ends.withColumn("__before", F.lag("__last").over(W.partitionBy(seq.key).orderBy(SLICE))).where(F.col("__before").isNotNull())
    both = _joined(df.withColumn("__row", F.lag(row).over(seq.window())), before, seq.key, [SLICE], ["__before"])
    got = F.coalesce("__row", "__before")
    return replace(seq, rows=both.select(*df.columns, *[got[f"c{i}"].alias(new) for i, new in enumerate(columns)]))


def _depth(discount: float) -> int:
    """Rows until powers of the discount reach exp(-DEPTH)."""
    return 1 << 40 if discount == 0 else max(1, int(DEPTH / -math.log1p(-discount)))


def _power(discount: float, n: Column) -> Column:
    return F.pow(F.lit(1.0 - discount), n.cast("double"))


def _starts(chunks: DataFrame, key: str, discounts: list[float]) -> DataFrame:
    """Of chunks (key, __slice, __chunk, and n, y, z of each statistic by itself): __e, __sy, __sz, what each begins with; a key's first chunk is left out.

    Chunks are composed in order within groups of one depth, and a group
    takes up the one before it.
    """
    by_key = W.partitionBy(key).orderBy(SLICE, "__chunk")
    for i, f in enumerate(discounts):
        depth, end = _depth(f), F.col(f"e{i}")
        chunks = chunks.withColumn(f"e{i}", F.sum(f"n{i}").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
        chunks = chunks.withColumn("group", F.floor(end / depth)).withColumn("left", end - F.col("group") * depth)
        lift = _power(f, F.col(f"n{i}") - 1 - F.col("left"))
        grouped = W.partitionBy(key, "group").orderBy(SLICE, "__chunk").rowsBetween(W.unboundedPreceding, 0)
        chunks = chunks.select("*", *[F.sum(F.coalesce(F.col(f"{v}{i}") * lift, F.lit(0.0))).over(grouped).alias(f"g{v}") for v in "yz"])
        earlier = W.partitionBy(key).orderBy("group").rangeBetween(W.unboundedPreceding, -1)
        chunks = chunks.withColumn("old", F.max(F.struct(F.col(f"e{i}").alias("e"), "left", "gy", "gz")).over(earlier))
        fade = _power(f, end - F.col("old.e") + F.col("old.left"))
        whole = [(F.col(f"g{v}") * _power(f, F.col("left")) + F.coalesce(F.col(f"old.g{v}") * fade, F.lit(0.0))).alias(f"s{v}{i}") for v in "yz"]
        chunks = chunks.select("*", *whole).drop("group", "left", "gy", "gz", "old")
    begun = [f"{v}{i}" for i in range(len(discounts)) for v in ("e", "sy", "sz")]
    return chunks.select(key, SLICE, "__chunk", *[F.lag(c).over(by_key).alias(f"__{c}") for c in begun]).where(F.col("__e0").isNotNull())


def discounted(seq: Sequences, stats: dict[str, tuple[str, float]]) -> Sequences:
    """Add, for each (name: (column, discount)), name_count, name_mean and name_deviation up to and with the row, and before_name_... without it.

    Each value that is not null discounts those before it by 1 - discount (0
    to below 1); nulls change nothing.  Without values mean and deviation are
    0.  The order must be total within a key for the result to be determined.
    """
    discounts = [f for _, f in stats.values()]
    if any(not 0 <= f < 1 for f in discounts):
        raise ValueError("a discount is at least 0 and below 1")
    deepest = min(_depth(f) for f in discounts)
    composed = seq.cut or seq.longest > deepest
    rows, by_chunk = seq.rows, seq.window()
    if composed:
        chunk = F.floor((F.row_number().over(seq.window()) - 1) / deepest).cast("int").alias("__chunk")
        rows = rows.select("*", *([] if seq.cut else [F.lit(0).alias(SLICE)]), chunk)
        by_chunk = W.partitionBy(seq.key, SLICE, "__chunk").orderBy(*seq.order)
    frames = {"": by_chunk.rowsBetween(W.unboundedPreceding, 0), "before_": by_chunk.rowsBetween(W.unboundedPreceding, -1)}
    items = [(i, name, F.col(c).cast("double"), f) for i, (name, (c, f)) in enumerate(stats.items())]
    rows = rows.select("*", *[F.count(x).over(frames[""]).alias(f"__n{i}") for i, _, x, _ in items])
    lifted = [(i, x, x * _power(f, 1 - F.col(f"__n{i}"))) for i, _, x, f in items]
    rows = rows.select("*", *[c for i, x, y in lifted for c in (y.alias(f"__y{i}"), (y * x).alias(f"__z{i}"))])
    sums = [F.sum(f"__{v}{i}").over(frame).alias(f"__r{p}{v}{i}") for i, *_ in items for p, frame in frames.items() for v in "yz"]
    counts = [F.coalesce(F.count(x).over(frames["before_"]), F.lit(0)).alias(f"__nbefore_{i}") for i, _, x, _ in items]
    ready = rows.select("*", *sums, *counts)
    if composed:
        rows = cut(rows)
        ready = rows.select("*", *sums, *counts)
        own = [c for i, *_ in items for c in (F.max(f"__n{i}").alias(f"n{i}"), F.sum(f"__y{i}").alias(f"y{i}"), F.sum(f"__z{i}").alias(f"z{i}"))]
        starts = _starts(rows.groupBy(seq.key, SLICE, "__chunk").agg(*own), seq.key, discounts)
        ready = _joined(ready, starts, seq.key, [SLICE, "__chunk"], [f"__{v}{i}" for i, *_ in items for v in ("e", "sy", "sz")])
    got = []
    for i, name, _, f in items:
        for p in frames:
            n = F.col(f"__n{p}{i}")
            count = n + F.coalesce(f"__e{i}", F.lit(0)) if composed else n
            first, second = (F.coalesce(F.col(f"__r{p}{v}{i}") * _power(f, n - 1), F.lit(0.0)) for v in "yz")
            if composed:
                first, second = (s + F.coalesce(F.col(f"__s{v}{i}") * _power(f, n), F.lit(0.0)) for s, v in ((first, "y"), (second, "z")))
            weight = count.cast("double") if f == 0 else F.when(count == 1, 1.0).otherwise(-F.expm1(count * math.log1p(-f)) / f)
            mean = F.when(count > 0, first / weight).otherwise(0.0)
            spread = F.when(count > 0, F.sqrt(F.greatest(F.lit(0.0), second / weight - mean * mean))).otherwise(0.0)
            got += [count.alias(f"{p}{name}_count"), mean.alias(f"{p}{name}_mean"), spread.alias(f"{p}{name}_deviation")]
    return replace(seq, rows=ready.select(*seq.rows.columns, *got))


def numbered(seq: Sequences, new: str) -> Sequences:
    """Add each row's number within its key, from 1."""
    local = F.row_number().over(seq.window()).cast("long")
    if not seq.cut:
        return seq.add(**{new: local})
    seq = seq.written()
    sizes = seq.rows.groupBy(*seq.place).agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__ahead", F.sum("__size").over(W.partitionBy(seq.key).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)))
    both = _joined(seq.rows.withColumn("__local", local), before, seq.key, [SLICE], ["__ahead"])
    return replace(seq, rows=both.select(*seq.rows.columns, (F.col("__local") + F.coalesce("__ahead", F.lit(0))).alias(new)))


def recent(seq: Sequences, new: str, columns: list[str], size: int) -> Sequences:
    """Add the flat array of `columns` over the key's last `size` rows, the row itself last; null where there are fewer."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    local = F.collect_list(row).over(seq.window().rowsBetween(-(size - 1), 0))
    flat = F.flatten(F.transform("__w", lambda r: F.array(*[r[f"c{i}"] for i in range(len(columns))])))
    got = F.when(F.size("__w") == size, flat).alias(new)
    if not seq.cut or size == 1:
        return replace(seq, rows=seq.rows.withColumn("__w", local).select(*seq.rows.columns, got))
    seq = seq.written()
    # a slice has a row at least, so the ends of size - 1 slices hold the size - 1 rows before
    last = F.row_number().over(W.partitionBy(*seq.place).orderBy(*[F.desc(c) for c in seq.order]))
    at = F.struct(*seq.order).alias("at")
    ends = seq.rows.withColumn("__last", last).where(F.col("__last") < size).groupBy(*seq.place).agg(F.sort_array(F.collect_list(F.struct(at, row.alias("row")))).alias("end"))
    frame = W.partitionBy(seq.key).orderBy(SLICE).rowsBetween(-(size - 1), -1)
    before = ends.select(*seq.place, F.transform(F.flatten(F.collect_list("end").over(frame)), lambda e: e["row"]).alias("__tail"))
    both = _joined(seq.rows.withColumn("__local", local), before, seq.key, [SLICE], ["__tail"])
    whole = F.when(F.col("__tail").isNull(), F.col("__local")).otherwise(F.concat("__tail", "__local"))
    cut = F.when(F.size(whole) > size, F.slice(whole, -size, size)).otherwise(whole)
    return replace(seq, rows=both.withColumn("__w", cut).select(*seq.rows.columns, got))


def latest(seq: Sequences, new: str, column: str) -> Sequences:
    """Add the largest value of a column in the key's rows up to and with this one (null while there is none)."""
    local = F.max(column).over(seq.window().rowsBetween(W.unboundedPreceding, 0))
    if not seq.cut:
        return seq.add(**{new: local})
    seq = seq.written()
    tops = seq.rows.groupBy(*seq.place).agg(F.max(column).alias("__top"))
    before = tops.withColumn("__over", F.max("__top").over(W.partitionBy(seq.key).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)))
    both = _joined(seq.rows.withColumn("__local", local), before, seq.key, [SLICE], ["__over"])
    return replace(seq, rows=both.select(*seq.rows.columns, F.greatest("__local", "__over").alias(new)))
