"""Queries of a tree as folds from leaf to root, over batches of points.

A fold sees, level by level upwards, for all queries at once: the node's depth
and mass, the gaps of the query outside the node's box and the probability
that a cut of the grown box separates the query.  Built-in folds cover scores,
attribution and density; others follow the same protocol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np

from .trees import Tree, routes


@dataclass
class Level:
    """One step of a fold: rows are the queries whose paths hold a node at this level."""

    rows: np.ndarray
    node: np.ndarray
    depth: np.ndarray
    mass: np.ndarray
    gaps: np.ndarray  # above the box, then below it
    total: np.ndarray  # sum of the gaps
    width: np.ndarray  # sum of the box's ranges
    probability: np.ndarray
    low: np.ndarray
    high: np.ndarray


class TreeFold(Protocol):
    def leaf(self, level: Level, equal: np.ndarray, tree: Tree) -> None: ...
    def up(self, level: Level, equal: np.ndarray, tree: Tree) -> None: ...
    def result(self) -> np.ndarray: ...


def seen(depth, mass):
    return 1.0 / (depth + np.log2(mass + 1.0))


def unseen(depth, mass):
    return 1.0 / (depth + 1.0)


def damp(leaf_mass, tree_mass):
    return 1.0 - leaf_mass / (2.0 * tree_mass)


def log_normalizer(score, tree_mass):
    return score * np.log2(tree_mass + 1.0)


def _level(queries: np.ndarray, rows: np.ndarray, node: np.ndarray, tree: Tree, low: np.ndarray, high: np.ndarray) -> Level:
    x = queries[rows]
    gaps = np.concatenate([np.maximum(0.0, x - high), np.maximum(0.0, low - x)], axis=1)
    total, width = gaps.sum(axis=1), (high - low).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(total > 0, total / (total + width), 0.0)
    return Level(rows, node, tree.depth[node], tree.mass[node], gaps, total, width, p, low, high)


def traverse(tree: Tree, queries: np.ndarray, fold: TreeFold, ignore_mass: int = 0) -> np.ndarray:
    """Run a fold for a batch of queries.

    A query equal to its leaf's point (of mass above `ignore_mass`, if any)
    looks at shadow boxes above the leaf: the union of the sibling boxes, as if
    the leaf were not there.  With `ignore_mass`, all queries that equal a leaf do.
    """
    path = routes(tree, queries)
    last = (path >= 0).sum(axis=1) - 1
    every = np.arange(len(queries))
    leaf = path[every, last]
    equal = (tree.points[tree.point[leaf]] == queries).all(axis=1)
    fold.leaf(_level(queries, every, leaf, tree, tree.low[leaf], tree.high[leaf]), equal & (tree.mass[leaf] > ignore_mass), tree)
    shadow_low = np.full(queries.shape, np.inf)
    shadow_high = np.full(queries.shape, -np.inf)
    for k in range(path.shape[1] - 2, -1, -1):
        rows = np.flatnonzero(last > k)
        node, child = path[rows, k], path[rows, k + 1]
        low, high = tree.low[node].copy(), tree.high[node].copy()
        same = equal[rows]
        if same.any():
            other = np.where(tree.left[node] == child, tree.right[node], tree.left[node])[same]
            r = rows[same]
            shadow_low[r] = np.minimum(shadow_low[r], tree.low[other])
            shadow_high[r] = np.maximum(shadow_high[r], tree.high[other])
            low[same], high[same] = shadow_low[r], shadow_high[r]
        fold.up(_level(queries, rows, node, tree, low, high), equal[rows], tree)
    return fold.result()


class Score:
    """Expected inverse depth, or any other score functions; the mean over trees is the forest's score."""

    def __init__(self, seen_fn=seen, unseen_fn=unseen, damp_fn=damp, normalize=log_normalizer, ignore_mass: int = 0):
        self.seen, self.unseen, self.damp, self.normalize, self.ignore = seen_fn, unseen_fn, damp_fn, normalize, ignore_mass

    def leaf(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        self.tree = tree
        hit = self.damp(level.mass, tree.total) * self.seen(level.depth, level.mass)
        self.score = np.where(equal, hit, self.unseen(level.depth, level.mass)).astype(float)

    def up(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        # a query equal to its leaf lies in every box above: nothing separates it
        p = np.where(equal & (self.ignore == 0), 0.0, level.probability)
        self.score[level.rows] = p * self.unseen(level.depth, level.mass) + (1 - p) * self.score[level.rows]

    def result(self) -> np.ndarray:
        return self.normalize(self.score, self.tree.total)


#: Queries that walk a tree together, and values of them: their rows stay in a core's cache.
STRIP, STRIP_VALUES = 512, 16_384


def scores(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """The Score fold with its default functions, without keeping the gaps of each dimension."""
    out = np.empty(len(queries))
    total = tree.total
    d = tree.low.shape[1]
    strip = max(STRIP, STRIP_VALUES // max(1, d))
    room, ones = np.empty((2 * strip, d)), np.ones(d)
    for a in range(0, len(queries), strip):
        q = np.ascontiguousarray(queries[a : a + strip], dtype=float)
        path = routes(tree, q)
        last = (path >= 0).sum(axis=1) - 1
        leaf = path[np.arange(len(q)), last]
        equal = (tree.points[tree.point[leaf]] == q).all(axis=1)
        mass = tree.mass[leaf]
        score = np.where(equal, damp(mass, total) * seen(tree.depth[leaf], mass), unseen(tree.depth[leaf], mass))
        open_ = ~equal  # nothing above a leaf's own point separates it
        for k in range(path.shape[1] - 2, -1, -1):
            rows = np.flatnonzero(open_ & (last > k))
            if not len(rows):
                continue
            node = path[rows, k]
            x = q if len(rows) == len(q) else q.take(rows, axis=0)
            gap = tree.high.take(node, axis=0, out=room[: len(rows)], mode="clip")
            below = tree.low.take(node, axis=0, out=room[strip : strip + len(rows)], mode="clip")
            np.subtract(x, gap, out=gap)
            np.subtract(below, x, out=below)
            np.maximum(gap, below, out=gap)
            np.maximum(gap, 0.0, out=gap)
            s = gap @ ones
            out_of = s > 0
            r, s, n = rows[out_of], s[out_of], node[out_of]
            p = s / (s + tree.width[n])
            score[r] = p / (k + 1.0) + (1 - p) * score[r]
        out[a : a + strip] = log_normalizer(score, total)
    return out


class Attribution:
    """The score split over dimensions: above and below the boxes. Row sums are the scores."""

    def __init__(self, seen_fn=seen, unseen_fn=unseen, damp_fn=damp, normalize=log_normalizer, ignore_mass: int = 0):
        self.scalar = Score(seen_fn, unseen_fn, damp_fn, normalize, ignore_mass)
        self.ignore = ignore_mass

    def leaf(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        self.scalar.leaf(level, equal, tree)
        d2 = level.gaps.shape[1]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(level.total[:, None] > 0, level.gaps / level.total[:, None], 1.0 / d2)
        self.parts = share * self.scalar.score[:, None]
        self.equal = equal

    def up(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        self.scalar.up(level, equal, tree)
        whole = level.total + level.width
        with np.errstate(invalid="ignore", divide="ignore"):
            each = np.where(whole[:, None] > 0, level.gaps / whole[:, None], 0.0)
        new = each * self.scalar.unseen(level.depth, level.mass)[:, None] if np.ndim(self.scalar.unseen(level.depth, level.mass)) else each * self.scalar.unseen(level.depth, level.mass)
        self.parts[level.rows] = new + (1 - level.probability)[:, None] * self.parts[level.rows]

    def result(self) -> np.ndarray:
        total, want = self.parts.sum(axis=1), self.scalar.result()
        with np.errstate(invalid="ignore", divide="ignore"):
            k = np.where(total > 0, want / total, 0.0)
        return self.parts * k[:, None]


class Density:
    """Directional measure, distances and probability mass: an array of 3 a query and slot.

    field(node's mass, what the leaf brings) is what a separation there is
    worth, by default their sum; influence(gaps) weighs it by the distance in
    each direction, by default alike.
    """

    def __init__(self, field: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, influence: Callable[[np.ndarray], np.ndarray] = np.ones_like):
        self.field, self.influence = field, influence

    def leaf(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        d2 = level.gaps.shape[1]
        self.mass = np.where(equal, 1.0 + level.mass, 1.0)
        whole = level.total[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(whole > 0, level.gaps / whole, 0.0)
        same = np.full(level.gaps.shape, 1.0 / d2)  # an equal point lies on no side: its mass goes to all alike
        self.measure = np.where(equal[:, None], same * self.mass[:, None], share * self.field(level.mass, np.ones(len(share)))[:, None] * self.influence(level.gaps))
        self.prob = np.where(equal[:, None], same, share)
        self.distance = np.where(equal[:, None], 0.0, share * level.gaps)

    def up(self, level: Level, equal: np.ndarray, tree: Tree) -> None:
        r, d = level.rows, level.gaps.shape[1] // 2
        whole = (level.total + level.width)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            each = np.where(whole > 0, level.gaps / whole, 0.0)
        stay = 1.0 - each.sum(axis=1)[:, None]
        old = np.tile(level.high - level.low, 2)[:, : 2 * d]
        self.measure[r] = each * self.field(level.mass, self.mass[r])[:, None] * self.influence(level.gaps) + stay * self.measure[r]
        self.prob[r] = each + stay * self.prob[r]
        self.distance[r] = each * (level.gaps + old) + stay * self.distance[r]

    def result(self) -> np.ndarray:
        return np.stack([self.measure, self.distance, self.prob], axis=1)


def displacement() -> Score:
    """Share of the tree that a point would push down: near 1 for a lone point, small in a dense group."""
    return Score(lambda d, m: 1.0 / (1.0 + m), lambda d, m: 1.0 * m, damp, lambda s, t: s / (1.0 + t))


def height() -> Score:
    """Expected depth at which a point would end; copies count as depth."""
    return Score(lambda d, m: d + np.log(m), lambda d, m: 1.0 * d, lambda a, b: 1.0, lambda s, t: s)


def simulated(tree: Tree, queries: np.ndarray, ranges: Callable[[np.ndarray, np.ndarray], np.ndarray], score: Score | None = None, many: bool = False) -> np.ndarray:
    """Score as if the tree's cuts had followed other weights: separation uses the weighed gaps and ranges. `many`: ranges takes boxes a row each."""
    weights = (lambda low, high: ranges(low, high).sum(axis=1)) if many else lambda low, high: np.array([float(ranges(a, b).sum()) for a, b in zip(low, high, strict=True)])
    score = score or Score()
    nodes = weights(tree.low, tree.high)
    path = routes(tree, queries)
    last = (path >= 0).sum(axis=1) - 1
    every = np.arange(len(queries))
    leaf = path[every, last]
    equal = (tree.points[tree.point[leaf]] == queries).all(axis=1)
    score.leaf(_level(queries, every, leaf, tree, tree.low[leaf], tree.high[leaf]), equal, tree)
    for k in range(path.shape[1] - 2, -1, -1):
        rows = np.flatnonzero(last > k)
        node = path[rows, k]
        level = _level(queries, rows, node, tree, tree.low[node], tree.high[node])
        grown_low, grown_high = np.minimum(level.low, queries[rows]), np.maximum(level.high, queries[rows])
        whole, inner = weights(grown_low, grown_high), nodes[node]
        with np.errstate(invalid="ignore", divide="ignore"):
            level.probability = np.where(whole > 0, np.clip((whole - inner) / whole, 0, 1), 0.0)
        score.up(level, equal[rows], tree)
    return score.result()


def neighbours(tree: Tree, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample point at each query's leaf, and its Euclidean distance."""
    path = routes(tree, queries)
    leaf = path[np.arange(len(queries)), (path >= 0).sum(axis=1) - 1]
    point = tree.point[leaf]
    return point, np.sqrt(((tree.points[point] - queries) ** 2).sum(axis=1))


class BranchFold(Protocol):
    """A fold that may go down both sides of a cut: what a leaf gives, how two sides meet, and what a node makes of what comes from below."""

    def splits(self, dim: int) -> bool: ...
    def leaf(self, tree: Tree, node: int) -> Any: ...
    def combine(self, left: Any, right: Any) -> Any: ...
    def up(self, tree: Tree, node: int, below: Any) -> Any: ...


def branch(tree: Tree, query: np.ndarray, fold: BranchFold) -> Any:
    """Run a branching fold: both sides of a cut where it splits, else the query's side; the root's value."""

    def visit(n: int) -> Any:
        d = int(tree.dim[n])
        if d < 0:
            return fold.leaf(tree, n)
        if fold.splits(d):
            below = fold.combine(visit(tree.left[n]), visit(tree.right[n]))
        else:
            below = visit(tree.left[n] if query[d] <= tree.value[n] else tree.right[n])
        return fold.up(tree, n, below)

    return visit(0)


class Conditional:
    """The sample point that fits the observed coordinates best: (rank, point, distance, query filled in by it).

    Of two sides the lower rank wins: the chance of being separated, damped by
    `centrality` (1: rank alone; 0: at random).
    """

    def __init__(self, query: np.ndarray, missing: list[int], centrality: float = 1.0, random: Callable[[], float] | None = None):
        self.query, self.missing, self.hidden = query, missing, set(missing)
        self.observed = [i for i in range(len(query)) if i not in self.hidden]
        self.centrality, self.random = centrality, random or (lambda: 0.5)

    def splits(self, dim: int) -> bool:
        return dim in self.hidden

    def leaf(self, tree: Tree, node: int) -> tuple[float, int, float, np.ndarray]:
        p = int(tree.point[node])
        filled = self.query.copy()
        filled[self.missing] = tree.points[p][self.missing]
        far = float(np.abs(tree.points[p][self.observed] - self.query[self.observed]).sum())
        return (0.0 if far == 0 else 1.0 / (float(tree.depth[node]) + 1.0)), p, far, filled

    def combine(self, left: tuple, right: tuple) -> tuple:
        return min(left, right, key=lambda r: self.centrality * r[0] + (1 - self.centrality) * self.random())

    def up(self, tree: Tree, node: int, below: tuple) -> tuple:
        rank, p, far, filled = below
        s = float(np.maximum(0, filled - tree.high[node]).sum() + np.maximum(0, tree.low[node] - filled).sum())
        r = float((tree.high[node] - tree.low[node]).sum())
        chance = s / (s + r) if s > 0 else 0.0
        return chance / (float(tree.depth[node]) + 1.0) + (1 - chance) * rank, p, far, filled


def conditional(tree: Tree, query: np.ndarray, missing: list[int], centrality: float = 1.0, random: Callable[[], float] | None = None) -> tuple[int, float]:
    """The sample point that fits the observed coordinates best, and its L1 distance over them."""
    _, p, far, _ = branch(tree, query, Conditional(query, missing, centrality, random))
    return p, far


def conditionals(tree: Tree, queries: np.ndarray, missing: list[int]) -> np.ndarray:
    """The sample point of `conditional` (by rank alone) for many queries at once: nodes that are looked at level by level, then ranks from the leaves up."""
    hidden = np.isin(np.arange(queries.shape[1]), missing)
    observed = np.flatnonzero(~hidden)
    node, query, levels = np.zeros(len(queries), int), np.arange(len(queries)), []
    while len(node):
        inner = np.flatnonzero(tree.dim[node] >= 0)
        n, own = node[inner], query[inner]
        dim = tree.dim[n]
        two = np.flatnonzero(hidden[dim])
        first = np.where(hidden[dim] | (queries[own, dim] <= tree.value[n]), tree.left[n], tree.right[n])
        one, other = np.full(len(node), -1), np.full(len(node), -1)
        one[inner], other[inner[two]] = np.arange(len(inner)), len(inner) + np.arange(len(two))
        levels.append((node, query, one, other))
        node, query = np.concatenate([first, tree.right[n[two]]]), np.concatenate([own, own[two]])
    rank, point = np.empty(0), np.empty(0, int)
    for depth in range(len(levels) - 1, -1, -1):
        node, query, one, other = levels[depth]
        new, best = np.empty(len(node)), tree.point[node].copy()
        a = np.flatnonzero(one < 0)
        far = np.abs(tree.points[best[a]][:, observed] - queries[query[a]][:, observed]).sum(axis=1)
        new[a] = np.where(far == 0, 0.0, 1.0 / (depth + 1.0))
        a = np.flatnonzero(one >= 0)
        if len(a):
            i, j = one[a], other[a]
            i = np.where((j >= 0) & (rank[j] < rank[i]), j, i)
            best[a] = point[i]
            filled, n = queries[query[a]].astype(float), node[a]
            filled[:, missing] = tree.points[best[a]][:, missing]
            s = np.maximum(0, filled - tree.high[n]).sum(axis=1) + np.maximum(0, tree.low[n] - filled).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                chance = np.where(s > 0, s / (s + tree.width[n]), 0.0)
            new[a] = chance / (depth + 1.0) + (1 - chance) * rank[i]
        rank, point = new, best
    return point


def paths_of(tree: Tree, queries: np.ndarray) -> Iterator[list[int]]:
    for row in routes(tree, queries):
        yield [int(n) for n in row if n >= 0]
