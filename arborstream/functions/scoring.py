"""Scalar and vector functions of the forest, as Column expressions and in numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seen(depth: Column, mass: Column) -> Column:
    """Score of a point equal to a leaf of this depth and mass."""
    return 1.0 / (depth + F.log2(mass + 1.0))


def unseen(depth: Column, mass: Column | None = None) -> Column:
    """Score of a point that a node of this depth separates."""
    return 1.0 / (depth + 1.0)


def damp(leaf_mass: Column, tree_mass: Column) -> Column:
    return 1.0 - leaf_mass / (2.0 * tree_mass)


def normalizer(score: Column, tree_mass: Column) -> Column:
    return score * F.log2(tree_mass + 1.0)


def displacement_seen(depth: Column, mass: Column) -> Column:
    return 1.0 / (mass + 1.0)


def displacement_unseen(depth: Column, mass: Column) -> Column:
    return mass.cast("double")


def displacement_normalizer(score: Column, tree_mass: Column) -> Column:
    return score / (1.0 + tree_mass)


def height_seen(depth: Column, mass: Column) -> Column:
    return depth + F.log(mass)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(_pairs(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(_pairs(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def linf(a: Column, b: Column) -> Column:
    return F.aggregate(_pairs(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def gap(point: Column, low: Column, high: Column) -> Column:
    """Signed gaps of a point outside a box: above the high side, then below the low side, a value a dimension each."""
    above = _pairs(point, high, lambda x, m: F.greatest(F.lit(0.0), x - m))
    below = _pairs(low, point, lambda m, x: F.greatest(F.lit(0.0), m - x))
    return F.concat(above, below)


def range_sum(low: Column, high: Column) -> Column:
    return F.aggregate(_pairs(high, low, lambda h, m: h - m), F.lit(0.0), lambda s, x: s + x)


def cut_probability(point: Column, low: Column, high: Column) -> Column:
    """Probability that a random cut of the box grown by the point separates them."""
    s = F.aggregate(gap(point, low, high), F.lit(0.0), lambda t, x: t + x)
    r = range_sum(low, high)
    return F.when(s == 0, 0.0).otherwise(s / (s + r))


def canonical(v: Column) -> Column:
    """Negative zeros become zeros."""
    return F.transform(v, lambda x: x + F.lit(0.0))


def missing_indices(v: Column) -> Column:
    """Indices of nulls and NaNs."""
    return F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i).isNull() | F.isnan(F.get(v, i)))


def lift_indices(indices: Column, base: int, dimensions: int, rotated_at: Column | None = None) -> Column:
    """Indices of an input as indices of its shingle: at the end, or at the slot a rotating buffer writes next."""
    if rotated_at is None:
        return F.transform(indices, lambda i: i + (dimensions - base))
    return F.transform(indices, lambda i: F.pmod(i + rotated_at * base, F.lit(dimensions)).cast("int"))


def expand_range(value: Column, lower: Column, upper: Column, shift: Column, scale: Column) -> tuple[Column, Column, Column]:
    """value, lower, upper after scaling and shifting, with lower <= value <= upper kept."""
    v = value * scale + shift
    return v, F.least(v, lower * scale + shift), F.greatest(v, upper * scale + shift)


def density_readout(measure: Column, distances: Column, prob_mass: Column, sample_size: int, manifold: int, q: float = 0.001) -> Column:
    """Scalar density from the sums that a density fold gives."""
    total = F.aggregate(measure, F.lit(0.0), lambda s, x: s + x) / F.lit(float(sample_size))
    terms = F.zip_with(distances, prob_mass, lambda d, p: F.when(p > 0, F.pow(d / p, F.lit(float(manifold))) * p).otherwise(0.0))
    volume = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total == 0, 0.0).otherwise(total / (F.lit(q) * total + volume))


def data_confidence(decay: float, updates: Column, quality: Column, output_after: int) -> Column:
    """Confidence that grows with the points seen and falls with the share of missing values."""
    ready = updates > output_after
    grown = F.lit(1.0) - F.exp(-(updates * F.lit(decay)))
    return F.when(ready, quality * grown).otherwise(0.0)


def converging_mean(values: Column, precision: float = 0.1, least: int = 5, factor: float = 0.5) -> Column:
    """Mean of the leading values of an array that stop once 1/precision of them lie above the running mean by `factor` deviations."""
    zero = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0.0).alias("sq"), F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(False).alias("done")
    )

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        total, squares = s["sum"] + x, s["sq"] + x * x
        mean = total / n
        spread = F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean) * n / F.greatest(F.lit(1), n - 1))
        hit = (n >= least) & ((x - mean) + 1e-6 > factor * spread)
        hits = s["hits"] + F.when(hit, 1).otherwise(0)
        new = F.struct(total.alias("sum"), squares.alias("sq"), n.alias("n"), hits.alias("hits"), (hits >= F.lit(1.0 / precision)).alias("done"))
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(values, zero, step, lambda s: F.when(s["n"] > 0, s["sum"] / s["n"]).otherwise(0.0))
