"""Clustering of weighted items with any distance: single centres, or several representatives a cluster."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

Distance = Callable[[Any, Any], float]
#: An item belongs to every centre no farther than this times its nearest one.
SOFT = 1.25


def l1(a, b) -> float:
    return float(np.abs(np.asarray(a) - np.asarray(b)).sum())


def l2(a, b) -> float:
    return float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))


def linf(a, b) -> float:
    return float(np.abs(np.asarray(a) - np.asarray(b)).max())


def line(a: float, b: float) -> float:
    """Of numbers; `many_on_line` clusters by it."""
    return abs(a - b)


def levenshtein(a: str, b: str) -> float:
    """Edit distance, a row of the table at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return float(row[-1])


def weighted_median(values: np.ndarray, weights: np.ndarray, share: float = 0.5) -> float:
    """First value, ascending, whose cumulative weight reaches the share."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, share * total[-1], "left")])


@dataclass
class Cluster:
    """representatives: (item, weight); radius: mean distance of what it holds, by weight."""

    representatives: list[tuple[Any, float]]
    shrinkage: float = 0.0
    limit: int = 1
    weight: float = 0.0
    spread: float = 0.0
    members: list[tuple[int, float, float]] = field(default_factory=list)

    @property
    def radius(self) -> float:
        return self.spread / self.weight if self.weight > 0 else 0.0

    @property
    def primary(self) -> Any:
        return max(self.representatives, key=lambda r: r[1])[0]

    def distance(self, item: Any, d: Distance) -> float:
        """To the nearest representative, drawn towards the primary one by the shrinkage."""
        near = min(d(item, r) for r, _ in self.representatives)
        return near if not self.shrinkage else near * (1 - self.shrinkage) + self.shrinkage * d(item, self.primary)

    def apart(self, other: Cluster, d: Distance) -> float:
        """Nearest pair of representatives, every pair looked at."""
        return min(d(a, b) for a, _ in self.representatives for b, _ in other.representatives)

    def absorb(self, other: Cluster, d: Distance) -> None:
        """Take over another cluster's weight and the representatives that lie farthest apart, weighed once."""
        pool = self.representatives + other.representatives
        chosen = [max(pool, key=lambda r: r[1])]
        while len(chosen) < min(self.limit, len(pool)):
            rest = [r for r in pool if not any(r is c for c in chosen)]
            best = max(rest, key=lambda r: r[1] * min(d(r[0], c[0]) for c in chosen))
            if min(d(best[0], c[0]) for c in chosen) == 0:
                break
            chosen.append(best)
        moved = other.weight * self.apart(other, d)
        self.weight, self.spread = self.weight + other.weight, self.spread + other.spread + moved
        self.representatives = [(r, w) for r, w in chosen]
        self.members += other.members


def _assign(items: list[tuple[Any, float]], clusters: list[Cluster], d: Distance, numeric: bool) -> None:
    """Soft assignment of all items, then new centres (numeric, one representative) or representative weights."""
    for c in clusters:
        c.weight = c.spread = 0.0
        c.members = []
        c.representatives = [(r, 0.0) for r, _ in c.representatives]
    for i, (x, w) in enumerate(items):
        far = [c.distance(x, d) for c in clusters]
        near = min(far)
        close = [k for k, f in enumerate(far) if f <= SOFT * near] if near > 0 else [far.index(near)]
        shares = [1.0 if near == 0 else near / far[k] for k in close]
        total = sum(shares)
        for k, s in zip(close, shares, strict=True):
            c, part = clusters[k], w * s / total
            c.weight += part
            c.spread += part * far[k]
            c.members.append((i, part, far[k]))
            at = min(range(len(c.representatives)), key=lambda j: d(x, c.representatives[j][0]))
            r, rw = c.representatives[at]
            c.representatives[at] = (r, rw + part)
    if numeric:
        for c in clusters:
            if c.limit == 1 and c.members:
                rows = np.array([items[i][0] for i, *_ in c.members], float)
                parts = np.array([p for _, p, _ in c.members])
                centre = np.array([weighted_median(rows[:, j], parts) for j in range(rows.shape[1])])
                c.representatives = [(centre, c.weight)]


def cluster(items: list[tuple[Any, float]], most: int, distance: Distance = l2, start: int | None = None, stop_at: int = 1, representatives: int = 1, shrinkage: float = 0.0, overlap: float = 1.2, seed: int = 0, previous: list[Cluster] | None = None) -> list[Cluster]:
    """Clusters of (item, weight) pairs, heaviest first: at most `most`, fewer down to `stop_at` while centres overlap.

    Centres start at items drawn by weight (and at the previous clusters'
    representatives); the lightest is merged into its nearest until few enough
    are left, then any two whose distance is below `overlap` times the sum of
    their radii.
    """
    items = [(x, float(w)) for x, w in items if w > 0]
    if not items:
        return []
    if any(isinstance(x, float) and not np.isfinite(x) or not isinstance(x, str) and not np.isfinite(np.asarray(x, float)).all() for x, _ in items):
        raise ValueError("items must be finite")
    numeric = not isinstance(items[0][0], str)
    rng = random.Random(seed)
    n = min(len(items), start or 4 * most)
    picks = list(range(len(items))) if n == len(items) else sorted(range(len(items)), key=lambda i: -(rng.random() ** (1 / items[i][1])))[:n]
    make = lambda x, w: Cluster([(np.asarray(x, float) if numeric else x, w)], shrinkage, representatives)
    clusters = [make(*items[i]) for i in picks]
    for c in previous or []:
        clusters += [make(r, w) for r, w in c.representatives]
    _assign(items, clusters, distance, numeric)
    while len(clusters) > 1:
        clusters = [c for c in clusters if c.weight > 0]
        clusters.sort(key=lambda c: c.weight)
        light = clusters[0]
        if len(clusters) > most:
            target = min(clusters[1:], key=lambda c: c.apart(light, distance))
        else:
            target = None
            for i, a in enumerate(clusters):
                near = [b for b in clusters[i + 1 :] if a.apart(b, distance) <= overlap * (a.radius + b.radius)]
                if near and len(clusters) > stop_at:
                    light, target = a, min(near, key=lambda b: b.apart(a, distance))
                    break
            if target is None:
                break
        target.absorb(light, distance)
        clusters = [c for c in clusters if c is not light]
        _assign(items, clusters, distance, numeric)
    return sorted((c for c in clusters if c.weight > 0), key=lambda c: -c.weight)


#: Sets of numbers that `many_on_line` takes at once.
SIDE_BY_SIDE = 256


def many_on_line(sets: list[list[tuple[float, float]]], most: int, representatives: int, shrinkage: float, start: int | None = None, stop_at: int = 1, overlap: float = 1.2, seed: int = 0) -> list[list[Cluster]]:
    """What `cluster` gives for each set of numbers by `line`, without members: all sets take each step together, as arrays.

    Clusters have two representatives or more, which are numbers of the set.
    Every sum is made in the order in which `cluster` makes it.
    """
    if representatives < 2:
        raise ValueError("clusters with one representative have centres that are no items")
    found: list[list[Cluster]] = []
    for a in range(0, len(sets), SIDE_BY_SIDE):
        found += _on_line(sets[a : a + SIDE_BY_SIDE], most, representatives, shrinkage, start or 4 * most, stop_at, overlap, seed)
    return found


def _on_line(sets: list[list[tuple[float, float]]], most: int, limit: int, shrinkage: float, start: int, stop_at: int, overlap: float, seed: int) -> list[list[Cluster]]:
    sets = [[(float(x), float(w)) for x, w in items if w > 0] for items in sets]
    longest = max(map(len, sets), default=0)
    if not longest:
        return [[] for _ in sets]
    # an absent item weighs nothing, an absent representative is infinitely far
    x, w = np.zeros((longest, len(sets))), np.zeros((longest, len(sets)))
    reps = np.full((limit, len(sets), min(longest, start)), np.inf)
    for k, items in enumerate(sets):
        if not items:
            continue
        x[: len(items), k], w[: len(items), k] = zip(*items, strict=True)
        n = min(len(items), start)
        rng = random.Random(seed)
        picks = range(n) if n == len(items) else sorted(range(len(items)), key=lambda i: -(rng.random() ** (1 / items[i][1])))[:n]
        reps[0, k, :n] = x[picks, k]
    if not np.isfinite(x).all():
        raise ValueError("items must be finite")
    own = np.arange(len(sets))
    out: list[list[Cluster]] = [[] for _ in sets]
    parts, weight, spread = _assign_line(x, w, reps, shrinkage)
    while len(own):
        order = np.argsort(np.where(weight > 0, weight, np.inf), axis=1, kind="stable")[:, : max(1, int((weight > 0).sum(axis=1).max()))]
        weight, spread = np.take_along_axis(weight, order, 1), np.take_along_axis(spread, order, 1)
        reps, parts = np.take_along_axis(reps, order[None], 2), np.take_along_axis(parts, order[None], 2)
        alive = weight > 0
        reps = np.where(alive, reps, np.inf)
        count = alive.sum(axis=1)
        light, target = _pairs(reps, weight, spread, count, most, stop_at, overlap)
        for i in np.flatnonzero(target < 0):
            n = count[i]
            ranked = np.argsort(-weight[i, :n], kind="stable")
            for c in ranked:
                held = [(r, v) for r, v in zip(reps[:, i, c].tolist(), parts[:, i, c].tolist(), strict=True) if r != np.inf]
                out[own[i]].append(Cluster(held, shrinkage, limit, float(weight[i, c]), float(spread[i, c])))
        on = np.flatnonzero(target >= 0)
        if not len(on):
            break
        if len(on) < len(own):
            own, x, w, reps, parts, light, target = own[on], x[:, on], w[:, on], reps[:, on], parts[:, on], light[on], target[on]
        every = np.arange(len(own))
        reps[:, every, target] = _absorbed(reps, parts, light, target)
        reps[:, every, light] = np.inf
        parts, weight, spread = _assign_line(x, w, reps, shrinkage)
    return out


def _assign_line(x: np.ndarray, w: np.ndarray, reps: np.ndarray, shrinkage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _assign: weights of the representatives (limit, sets, clusters), weights and spreads of the clusters."""
    limit, sets, clusters = reps.shape
    parts, weight, spread = np.zeros(reps.shape), np.zeros((sets, clusters)), np.zeros((sets, clusters))
    every = np.arange(sets)
    several = bool((reps[1] != np.inf).any())  # else all are their clusters' only ones
    for own, mass in zip(x, w, strict=True):
        far = np.abs(own[:, None] - reps[0])
        nearest = primary = far
        at = None
        if several:
            at, heavy = np.zeros((sets, clusters), np.int64), parts[0]
            for j in range(1, limit):
                d = np.abs(own[:, None] - reps[j])
                closer, heavier = d < nearest, parts[j] > heavy
                nearest, at[closer] = np.where(closer, d, nearest), j
                primary, heavy = np.where(heavier, d, primary), np.where(heavier, parts[j], heavy)
        if shrinkage:
            nearest = nearest * (1 - shrinkage) + shrinkage * primary
        first = nearest.argmin(axis=1)
        least = nearest[every, first]
        close = nearest <= (SOFT * least)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(close, least[:, None] / nearest, 0.0)
        met = np.flatnonzero(least == 0)
        share[met] = 0.0
        share[met, first[met]] = 1.0
        part = mass[:, None] * share / share.cumsum(axis=1)[:, -1:]
        weight += part
        spread += part * np.where(close, nearest, 0.0)
        if at is None:
            parts[0] += part
        else:
            for j in range(limit):
                parts[j] += np.where(at == j, part, 0.0)
    return parts, weight, spread


def _pairs(reps: np.ndarray, weight: np.ndarray, spread: np.ndarray, count: np.ndarray, most: int, stop_at: int, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cluster of each set goes into which other; -1 where the set is done."""
    limit, sets, clusters = reps.shape
    light, target = np.zeros(sets, np.int64), np.full(sets, -1)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            far = np.fmin.reduce([np.abs(p - q) for p in a for q in b])
        return np.where(np.isnan(far), np.inf, far)

    many = np.flatnonzero(count > most)
    if len(many):
        target[many] = 1 + apart(reps[:, many, :1], reps[:, many, 1:]).argmin(axis=1)
    few = np.flatnonzero((count <= most) & (count > max(1, stop_at)))
    if len(few):
        n = int(count[few].max())
        own = reps[:, few, :n]
        with np.errstate(invalid="ignore", divide="ignore"):
            radius = spread[few, :n] / weight[few, :n]
        far = apart(own[:, :, :, None], own[:, :, None, :])
        meets = (far <= overlap * (radius[:, :, None] + radius[:, None, :])) & np.triu(np.ones((n, n), bool), 1)
        held = meets.any(axis=2)
        rows = np.flatnonzero(held.any(axis=1))
        a = held[rows].argmax(axis=1)
        light[few[rows]] = a
        target[few[rows]] = np.where(meets[rows, a], far[rows, a], np.inf).argmin(axis=1)
    return light, target


def _absorbed(reps: np.ndarray, parts: np.ndarray, light: np.ndarray, target: np.ndarray) -> np.ndarray:
    """As Cluster.absorb: the representatives of each set's target and light cluster that stay."""
    limit, every = len(reps), np.arange(len(light))
    pool = np.concatenate([reps[:, every, target], reps[:, every, light]])
    mass = np.concatenate([parts[:, every, target], parts[:, every, light]])
    free = pool != np.inf
    out = np.full((limit, len(light)), np.inf)
    best = np.where(free, mass, -1.0).argmax(axis=0)
    far, on = np.full(pool.shape, np.inf), np.ones(len(light), bool)
    for j in range(limit):
        if j:
            best = np.where(free, mass * np.where(free, far, 0.0), -1.0).argmax(axis=0)
            on = on & free[best, every] & (far[best, every] != 0)
        chosen = pool[best, every]
        out[j, on] = chosen[on]
        free[best, every] = False
        with np.errstate(invalid="ignore"):
            far = np.minimum(far, np.abs(pool - chosen))
    return out


def summarize(points: np.ndarray, weights: np.ndarray | None = None, most: int = 10, percentile: float = 0.9, typical: bool = True, distance: Distance = l2, seed: int = 0, representatives: int = 1, shrinkage: float = 0.0) -> dict:
    """Weighted mean, deviation, median and percentiles of each dimension, and typical points with their weights."""
    points = np.asarray(points, float)
    w = np.ones(len(points)) if weights is None else np.asarray(weights, float)
    if not np.isfinite(points).all() or not np.isfinite(w).all() or (w < 0).any():
        raise ValueError("points and weights must be finite, weights not negative")
    total = w.sum()
    mean = (points * w[:, None]).sum(axis=0) / total
    out = {
        "weight": total,
        "mean": mean,
        "deviation": np.sqrt(np.maximum(0, (points**2 * w[:, None]).sum(axis=0) / total - mean**2)),
        "median": np.array([weighted_median(points[:, j], w) for j in range(points.shape[1])]),
        "lower": np.array([weighted_median(points[:, j], w, 1 - percentile) for j in range(points.shape[1])]),
        "upper": np.array([weighted_median(points[:, j], w, percentile) for j in range(points.shape[1])]),
        "typical": [],
    }
    if typical:
        found = cluster(list(zip(points, w, strict=True)), most, distance, seed=seed, representatives=representatives, shrinkage=shrinkage)
        out["typical"] = [(c.primary, c.weight / total) for c in found]
    return out
