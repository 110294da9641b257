"""Random cut trees as numpy arrays, built from a sample.

A tree is a set of parallel arrays, so a batch of queries walks all its levels
with vector operations.  Cuts are drawn from md5 of (seed, tree, path), which
makes a tree a function of its sample: rebuilt anywhere, it comes out the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.uniforms import uniform_of

Ranges = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Tree:
    """dim is -1 at leaves; a leaf's point is `point`; low and high are the boxes; path is the cuts from the root."""

    dim: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    mass: np.ndarray
    low: np.ndarray
    high: np.ndarray
    point: np.ndarray
    path: list[str]
    points: np.ndarray
    members: list[np.ndarray]

    def __post_init__(self) -> None:
        self.width = (self.high - self.low).sum(axis=1) if len(self.low) else np.empty(0)

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.dim < 0)

    @property
    def total(self) -> int:
        return int(self.mass[0]) if len(self.mass) else 0

    def centre_of_mass(self) -> np.ndarray:
        """Mean of the points below each node."""
        sums = np.zeros_like(self.low)
        for n in range(len(self.dim) - 1, -1, -1):
            if self.dim[n] < 0:
                sums[n] = self.points[self.members[n]].sum(axis=0)
            else:
                sums[n] = sums[self.left[n]] + sums[self.right[n]]
        return sums / self.mass[:, None]

    def propagate(self, attributes: list, combine: Callable) -> list:
        """An attribute for every node: each point's own (in the order of `points`) are combined from the leaves up."""
        out: list = [None] * len(self.dim)
        for n in range(len(self.dim) - 1, -1, -1):
            own = [attributes[i] for i in self.members[n]] if self.dim[n] < 0 else [out[self.left[n]], out[self.right[n]]]
            out[n] = own[0]
            for a in own[1:]:
                out[n] = combine(out[n], a)
        return out

    def validate(self) -> None:
        """Masses add up, and boxes hold their children's; raises ValueError otherwise."""
        for n in np.flatnonzero(self.dim >= 0):
            kids = [self.left[n], self.right[n]]
            if self.mass[n] != self.mass[kids].sum() or (self.low[kids].min(axis=0) != self.low[n]).any() or (self.high[kids].max(axis=0) != self.high[n]).any():
                raise ValueError(f"node {n} does not match its children")


def choose_cut(ranges: np.ndarray, low: np.ndarray, high: np.ndarray, u: float) -> tuple[int, float]:
    """Dimension with probability in proportion to its range and a uniform place in it, from one uniform."""
    rest = u * float(ranges.sum())
    for d, r in enumerate(ranges):
        if r > 0 and rest <= r:
            break
        rest -= r
    else:  # rounding used the ranges up: the last one that is not empty
        d = int(np.flatnonzero(ranges > 0)[-1])
        rest = float(ranges[d])
    cut = float(low[d]) + rest
    return int(d), cut if cut < high[d] else float(np.nextafter(high[d], low[d]))


def build(points: np.ndarray, tree: int, seed: int = 0, ranges: Ranges | None = None) -> Tree:
    """The tree of a sample (one row a point, repeats allowed). `ranges` may weigh a box's dimensions otherwise."""
    points = np.asarray(points, float)
    d = points.shape[1] if points.ndim == 2 else 0
    rows: list[tuple] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []
    members: list[np.ndarray] = []
    todo = [(np.arange(len(points)), -1, 0, "", 0)] if len(points) else []
    links: dict[int, list[int]] = {}
    while todo:
        own, parent, side, path, depth = todo.pop()
        n = len(rows)
        if parent >= 0:
            links[parent][side] = n
        low, high = points[own].min(axis=0), points[own].max(axis=0)
        width = high - low
        weight = width if ranges is None else np.where(width > 0, ranges(low, high), 0.0)
        boxes.append((low, high))
        if not (weight > 0).any():
            rows.append((-1, 0.0, parent, depth, len(own), int(own[0]), path))
            members.append(own)
            continue
        dim, cut = choose_cut(weight, low, high, uniform_of(seed, tree, path)) if ranges is None else _weighed(weight, low, high, uniform_of(seed, tree, path))
        rows.append((dim, cut, parent, depth, len(own), -1, path))
        members.append(own[:0])
        links[n] = [-1, -1]
        goes = points[own, dim] <= cut
        todo.append((own[~goes], n, 1, path + "R", depth + 1))
        todo.append((own[goes], n, 0, path + "L", depth + 1))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    low = np.array([b[0] for b in boxes]).reshape(len(rows), d)
    high = np.array([b[1] for b in boxes]).reshape(len(rows), d)
    pick = lambda side: np.array([links[i][side] if i in links else -1 for i in range(len(rows))], int)
    return Tree(
        np.array(cols[0], int), np.array(cols[1], float), pick(0), pick(1), np.array(cols[2], int), np.array(cols[3], int), np.array(cols[4], int),
        low, high, np.array(cols[5], int), list(cols[6]), points, members,
    )


def _weighed(weight: np.ndarray, low: np.ndarray, high: np.ndarray, u: float) -> tuple[int, float]:
    """A cut whose dimension follows other weights than the ranges; the place is what the uniform leaves."""
    at = np.cumsum(weight) / weight.sum()
    d = int(np.searchsorted(at, u, "left"))
    before = at[d - 1] if d else 0.0
    cut = low[d] + (high[d] - low[d]) * (u - before) / max(at[d] - before, 1e-300)
    return d, float(min(cut, np.nextafter(high[d], low[d])))


def routes(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """Nodes that each query passes, root to leaf, a column a level; -1 below the leaf."""
    at = np.zeros(len(queries), int)
    levels = [at.copy()]
    while True:
        inner = (at >= 0) & (tree.dim[np.maximum(at, 0)] >= 0)
        if not inner.any():
            break
        q = np.flatnonzero(inner)
        n = at[q]
        goes = queries[q, tree.dim[n]] <= tree.value[n]
        new = np.full(len(queries), -1)
        new[q] = np.where(goes, tree.left[n], tree.right[n])
        at = new
        levels.append(at.copy())
    return np.stack(levels, axis=1)


class DynamicTree:
    """A tree that takes and drops single points: a keyed detector's model between two rows.

    Inserting draws a cut in each box grown by the point on the way down and
    splices a node where it separates them; deleting replaces the parent by
    the sibling and shrinks the boxes above.
    """

    __slots__ = ("root", "random")

    class Node:
        __slots__ = ("dim", "cut", "left", "right", "mass", "low", "high", "point", "up")

        def __init__(self, point: tuple, low: list, high: list, mass: int, up: DynamicTree.Node | None):
            self.point, self.low, self.high, self.mass, self.up = point, low, high, mass, up
            self.dim = -1
            self.cut, self.left, self.right = 0.0, None, None

    def __init__(self, random: Callable[[], float]):
        self.root: DynamicTree.Node | None = None
        self.random = random

    def leaf(self, x: tuple) -> DynamicTree.Node | None:
        n = self.root
        while n is not None and n.dim >= 0:
            n = n.left if x[n.dim] <= n.cut else n.right
        return n

    def insert(self, x: tuple) -> None:
        if self.root is None:
            self.root = self.Node(x, list(x), list(x), 1, None)
            return
        n, random = self.root, self.random
        while True:
            low = [a if a < b else b for a, b in zip(n.low, x)]  # noqa: B905
            high = [a if a > b else b for a, b in zip(n.high, x)]  # noqa: B905
            total = sum(high) - sum(low)
            if n.dim < 0 and total <= 0:  # a copy of the leaf's point
                self._grow(n, x)
                return
            rest, dim = random() * total, -1
            for d, (a, b) in enumerate(zip(low, high)):  # noqa: B905
                r = b - a
                if r > 0:
                    dim = d
                    if rest <= r:
                        break
                    rest -= r
            cut, v = low[dim] + rest, x[dim]
            if cut >= high[dim]:
                cut = math.nextafter(high[dim], -math.inf)
            if v <= cut < n.low[dim] or n.high[dim] <= cut < v:
                self._splice(n, x, dim, cut, low, high)
                return
            if n.dim < 0:
                continue  # a leaf's box is one point: a cut in the grown box separates, but for rounding
            n = n.left if x[n.dim] <= n.cut else n.right

    def _grow(self, n: DynamicTree.Node | None, x: tuple) -> None:
        while n is not None:
            n.mass += 1
            for d, v in enumerate(x):
                if v < n.low[d]:
                    n.low[d] = v
                elif v > n.high[d]:
                    n.high[d] = v
            n = n.up

    def _splice(self, n: DynamicTree.Node, x: tuple, dim: int, cut: float, low: list, high: list) -> None:
        up = n.up
        inner = self.Node((), low, high, n.mass + 1, up)
        new = self.Node(x, list(x), list(x), 1, inner)
        inner.dim, inner.cut = dim, cut
        inner.left, inner.right = (new, n) if x[dim] <= cut else (n, new)
        n.up = inner
        if up is None:
            self.root = inner
        elif up.left is n:
            up.left = inner
        else:
            up.right = inner
        self._grow(up, x)

    def delete(self, x: tuple) -> None:
        n = self.leaf(x)
        if n is None or n.point != x:
            raise KeyError("the point is not in the tree")
        if n.mass > 1:
            while n is not None:
                n.mass -= 1
                n = n.up
            return
        up = n.up
        if up is None:
            self.root = None
            return
        other = up.right if up.left is n else up.left
        top = up.up
        other.up = top
        if top is None:
            self.root = other
        elif top.left is up:
            top.left = other
        else:
            top.right = other
        shrinks = True
        while top is not None:
            top.mass -= 1
            if shrinks:  # a box that stays leaves those above as they are
                low = [a if a < b else b for a, b in zip(top.left.low, top.right.low)]  # noqa: B905
                high = [a if a > b else b for a, b in zip(top.left.high, top.right.high)]  # noqa: B905
                shrinks = low != top.low or high != top.high
                top.low, top.high = low, high
            top = top.up

    def path(self, x: tuple) -> list[DynamicTree.Node]:
        out, n = [], self.root
        while n is not None:
            out.append(n)
            n = None if n.dim < 0 else n.left if x[n.dim] <= n.cut else n.right
        return out
