"""Temperature mixing of sources [native].

Source shares p are raised to an exponent a and normalised; a is bisected until
the mixture meets a repetition limit or a target entropy, and the weights are
realised by repeating random permutations of each source's documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hold
from .prefix import prefix_sums

#: Bisections of the exponent; LEVELS of them share a pass over the sources.
LEVELS, PASSES = 5, 8


def word_count(text: str) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column: the token measure here; null counts none."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(clean) == 0, 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "))) + 1).cast("long")


def _spread(totals: DataFrame, exponents: list[float], total: int) -> dict[float, tuple[float, float]]:
    """For each exponent a: largest over smallest repetition, and entropy in nats, of weights p**a. A row an exponent comes back."""
    p = F.col("tokens") / F.lit(float(total))
    w = F.pow(p, F.col("a"))
    each = totals.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))  # an array, so that passes share compiled code
    rows = each.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wl"), F.max(w / p).alias("hi"), F.min(w / p).alias("lo")).collect()
    return {r.a: (r.hi / r.lo, math.log(r.z) - r.wl / r.z) for r in rows}


def exponent(totals: DataFrame, max_repeat: float | None = None, entropy: float | None = None) -> float:
    """Bisect the exponent in [0, 1].

    `max_repeat`: the flattest mixture (smallest exponent) in which no source
    is repeated more than so many times as often as the least repeated one.
    `entropy`: the exponent whose mixture has this entropy in nats, or the
    nearer end of [0, 1] where none has.  Sources are never collected: each of
    the PASSES looks at the midpoints of the next LEVELS bisections at once and
    brings back a row for each.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give either max_repeat or entropy")
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    lo, hi = 0.0, 1.0

    def steep(found: tuple[float, float]) -> bool:
        ratio, h = found
        return ratio <= max_repeat if max_repeat is not None else h <= entropy

    if steep(_spread(totals, [lo], total)[lo]):
        return lo
    for _ in range(PASSES):
        n = 1 << LEVELS
        step = (hi - lo) / n
        found = _spread(totals, [lo + i * step for i in range(1, n)], total)
        low, high = 0, n
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if steep(found[lo + mid * step]) else (mid, high)
        lo, hi = lo + low * step, hi if high == n else lo + high * step
    return hi


def mix(
    docs: DataFrame,
    max_repeat: float | None = 2.0,
    entropy: float | None = None,
    budget: int | None = None,
    n_blocks: int = 64,
    seed: int = 17,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Realise the mixture: a row for each use of a document.

    Columns: those of `keep` (default: id and source), then mix_tokens (words),
    mix_weight (the source's share), mix_epoch (from 0), mix_block (0 to
    n_blocks - 1; each block holds every source in its share).  `budget` is the
    words to draw; by default the least with which every source is read whole
    once, so that no document is left out.  A source's epochs are permutations
    of its documents by hash; the last epoch is cut at the first document that
    starts at or after the source's quota.

    A null source is a source of its own; documents without words (null or
    empty texts) take no budget and are used in each of their source's epochs
    that begin.  Rows repeated in the input are separate documents.  An empty
    table gives no rows.  Other columns, whatever their names, pass unchanged
    where they are kept.
    """
    keep = keep if keep is not None else [id_col, source_col]
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    base = docs.select(
        *named, F.col(source_col).alias("__s"), F.col(id_col).alias("__id"), word_count(text_col).alias("__n"), F.lit(1).cast("long").alias("__one")
    )
    base = hold(base)  # texts are read once
    totals = cut(base.groupBy("__s").agg(F.sum("__n").alias("tokens")).where("tokens > 0"), files=8)
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        total, a, z, least = 1, 1.0, 1.0, 1.0
    else:
        a = exponent(totals, max_repeat, entropy)
        p = F.col("tokens") / F.lit(float(total))
        z, least = totals.agg(F.sum(F.pow(p, F.lit(a))), F.min(F.pow(p, F.lit(a)) / p)).first()
        least /= z
    words = float(budget) if budget is not None else total / least
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z)
    quota = F.when(F.abs(weight * words - F.col("tokens")) < 0.5, F.col("tokens")).otherwise(F.floor(weight * words + 0.5)).cast("long")
    plan = totals.select(F.col("__s").alias("__ps"), weight.alias("mix_weight"), quota.alias("__quota"), F.col("tokens").alias("__tokens"))
    planned = base.join(plan, base["__s"].eqNullSafe(plan["__ps"]), "left").drop("__ps")
    epochs = F.coalesce(F.ceil(F.col("__quota") / F.col("__tokens")), F.lit(1)).cast("int")
    uses = planned.withColumn("mix_epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))))
    uses = uses.withColumn("__h", F.xxhash64(F.lit(seed), "mix_epoch", "__id"))
    order = [F.col("__s").asc_nulls_first(), F.col("mix_epoch"), F.col("__h"), F.col("__id")]
    placed = prefix_sums(uses, order, {"__before": "__n"}, ["__s"])
    drawn = placed.where(F.col("__quota").isNull() | (F.col("__n") == 0) | (F.col("__before") < F.col("__quota")))
    block = F.when(F.coalesce(F.col("__quota"), F.lit(0)) > 0, F.least(F.lit(n_blocks - 1), F.floor(F.col("__before") / F.col("__quota") * n_blocks))).otherwise(0)
    return drawn.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__n").alias("mix_tokens"),
        F.coalesce(F.col("mix_weight"), F.lit(0.0)).alias("mix_weight"),
        "mix_epoch",
        block.cast("int").alias("mix_block"),
    )
