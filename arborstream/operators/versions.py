"""Forests whose changes make new nodes: many points are scored at once, each by the trees as they were when it came.

A change copies the nodes on its way to the root, so a tree before and after it
is two roots that share the rest.  Rows can then be learnt one after the other
and scored together afterwards, as arrays.  Draws and sums are made in the order
in which `StreamForest` makes them, so scores are the same to the last bit.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Points for which arrays pay; fewer are scored one by one.
FEW = 12


class Nodes:
    """The nodes of some forests: (dimension or -1 at leaves, cut, left, right, mass, sum of low, sum of high, low, high).

    A leaf's box is its point. Numbers only rise; those from `own` on belong to no version but the one that is being
    made, and are changed where they lie. `kept` drops what no tree holds any more.
    """

    def __init__(self, capacity: int):
        self.nodes: list[tuple] = []
        self.own = 0
        self.written = 0
        self.heads, self.boxes = np.empty((0, 5)), np.empty((0, 0))
        self.log2 = [0.0, *[math.log2(m) for m in range(1, capacity + 2)]]
        self.logs = np.array(self.log2)

    def kept(self, roots: list[int]) -> list[int]:
        """The roots again, after their nodes and no others are numbered anew."""
        old, new = self.nodes, []

        def moved(n: int) -> int:
            node = old[n]
            if node[0] >= 0:
                node = (node[0], node[1], moved(node[2]), moved(node[3]), *node[4:])
            new.append(node)
            return len(new) - 1

        roots = [moved(n) if n >= 0 else n for n in roots]
        self.nodes, self.own, self.written = new, len(new), 0
        return roots

    # -- changes -----------------------------------------------------------------------------------

    def _up(self, path: list[tuple], child: int) -> int:
        """The root, where the path's nodes (number, all fields as they become, whether it goes left) stand above a child."""
        nodes, own = self.nodes, self.own
        for n, dim, cut, left, right, mass, low_sum, high_sum, low, high, goes in reversed(path):
            node = (dim, cut, child, right, mass, low_sum, high_sum, low, high) if goes else (dim, cut, left, child, mass, low_sum, high_sum, low, high)
            if n >= own:
                nodes[n] = node
                child = n
            else:
                child = len(nodes)
                nodes.append(node)
        return child

    def inserted(self, root: int, x: tuple, draw: Callable[[], float]) -> int:
        """The root of a tree (-1: an empty one) with one point more; as DynamicTree.insert."""
        total = sum(x)
        leaf = (-1, 0.0, -1, -1, 1, total, total, x, x)
        nodes = self.nodes
        if root < 0:
            nodes.append(leaf)
            return len(nodes) - 1
        n, path = root, []
        while True:
            dim, cut, left, right, mass, low_sum, high_sum, low, high = nodes[n]
            for a, v, b in zip(low, x, high):  # noqa: B905
                if v < a or v > b:
                    break
            else:  # nothing grows, so no cut separates: its draw is passed over
                if dim < 0:
                    nodes.append((dim, cut, left, right, mass + 1, low_sum, high_sum, low, high))
                    return self._up(path, len(nodes) - 1)
                draw()
                goes = x[dim] <= cut
                path.append((n, dim, cut, left, right, mass + 1, low_sum, high_sum, low, high, goes))
                n = left if goes else right
                continue
            new_low = tuple([a if a < b else b for a, b in zip(low, x)])  # noqa: B905
            new_high = tuple([a if a > b else b for a, b in zip(high, x)])  # noqa: B905
            new_low_sum, new_high_sum = sum(new_low), sum(new_high)
            total = new_high_sum - new_low_sum
            if dim < 0 and total <= 0:  # the points differ by less than their sums can tell
                nodes.append((dim, cut, left, right, mass + 1, low_sum, high_sum, low, high))
                return self._up(path, len(nodes) - 1)
            rest, k = draw() * total, -1
            for d, (a, b) in enumerate(zip(new_low, new_high)):  # noqa: B905
                r = b - a
                if r > 0:
                    k = d
                    if rest <= r:
                        break
                    rest -= r
            at, v = new_low[k] + rest, x[k]
            if at >= new_high[k]:
                at = math.nextafter(new_high[k], -math.inf)
            if v <= at < low[k] or high[k] <= at < v:
                nodes.append(leaf)
                new = len(nodes) - 1
                left, right = (new, n) if v <= at else (n, new)
                nodes.append((k, at, left, right, mass + 1, new_low_sum, new_high_sum, new_low, new_high))
                return self._up(path, new + 1)
            if dim < 0:
                continue  # a leaf's box is one point: a cut in the grown box separates, but for rounding
            goes = x[dim] <= cut
            path.append((n, dim, cut, left, right, mass + 1, new_low_sum, new_high_sum, new_low, new_high, goes))
            n = left if goes else right

    def deleted(self, root: int, x: tuple) -> int:
        """The root of a tree with one copy of a point less (-1: none is left); as DynamicTree.delete."""
        nodes, n, path = self.nodes, root, []
        while True:
            dim, cut, left, right, mass, low_sum, high_sum, low, high = nodes[n]
            if dim < 0:
                break
            goes = x[dim] <= cut
            path.append((n, dim, cut, left, right, mass - 1, low_sum, high_sum, low, high, goes))
            n = left if goes else right
        if low != x:
            raise KeyError("the point is not in the tree")
        if mass > 1:
            nodes.append((dim, cut, left, right, mass - 1, low_sum, high_sum, low, high))
            return self._up(path, len(nodes) - 1)
        if not path:
            return -1
        last = path.pop()
        child = last[4] if last[-1] else last[3]
        while path:
            n, dim, cut, left, right, mass, low_sum, high_sum, low, high, goes = path[-1]
            left, right = (child, right) if goes else (left, child)
            a, b = nodes[left], nodes[right]
            new_low = tuple([p if p < q else q for p, q in zip(a[7], b[7])])  # noqa: B905
            new_high = tuple([p if p > q else q for p, q in zip(a[8], b[8])])  # noqa: B905
            if new_low == low and new_high == high:  # a box that stays leaves those above as they are
                break
            path.pop()
            nodes.append((dim, cut, left, right, mass, sum(new_low), sum(new_high), new_low, new_high))
            child = len(nodes) - 1
        return self._up(path, child)

    # -- scores ------------------------------------------------------------------------------------

    def scores(self, points: list[tuple], roots: list[list[int]]) -> list[float]:
        """The score of each point by the trees whose roots stand beside it, as many for all."""
        if len(points) < FEW:
            return [self._alone(x, own) for x, own in zip(points, roots, strict=True)]
        self._write(len(points[0]))
        x = np.repeat(np.array(points, float), len(roots[0]), axis=0)
        return self._score(np.array(roots, np.int64).ravel(), x, len(roots[0])).tolist()

    def _write(self, d: int) -> None:
        n = len(self.nodes)
        if len(self.heads) < n:
            heads, boxes = np.empty((2 * n, 5)), np.empty((2 * n, 2 + 2 * d))
            if self.written:
                heads[: self.written], boxes[: self.written] = self.heads[: self.written], self.boxes[: self.written]
            self.heads, self.boxes = heads, boxes
        new = slice(self.written, n)
        if self.written < n:
            fields = chain.from_iterable([node[:7] + node[7] + node[8] for node in self.nodes[new]])
            rows = np.fromiter(fields, float, (n - self.written) * (7 + 2 * d)).reshape(-1, 7 + 2 * d)
            self.heads[new], self.boxes[new] = rows[:, :5], rows[:, 5:]
            self.written = n

    def _score(self, at: np.ndarray, x: np.ndarray, trees: int) -> np.ndarray:
        d = x.shape[1]
        heads, boxes = self.heads, self.boxes
        mass = heads[at, 4].astype(np.int64)
        depth, rows, n, path = np.zeros(len(at), np.int64), np.arange(len(at)), at, []
        at, flat = at.copy(), x.ravel()
        while True:
            held = heads.take(n, axis=0)
            on = np.flatnonzero(held[:, 0] >= 0)
            if not len(on):
                break
            path.append(at.copy())
            if len(on) < len(rows):
                rows, held = rows[on], held.take(on, axis=0)
            goes = flat.take(rows * d + held[:, 0].astype(np.int64)) <= held[:, 1]
            n = np.where(goes, held[:, 2], held[:, 3]).astype(np.int64)
            at[rows] = n
            depth[rows] += 1
        own = heads[at, 4].astype(np.int64)
        equal = (boxes.take(at, axis=0)[:, 2 : 2 + d] == x).all(axis=1)
        score = np.where(equal, (1 - own / (2 * mass)) / np.where(equal, depth + self.logs[own + 1], 1.0), 1 / (depth + 1))
        rows = np.flatnonzero(~equal & (depth > 0))
        above = np.array(path).ravel()
        depth, points, stay, width = depth[rows], np.ascontiguousarray(x[rows].T), score[rows], len(at)
        while len(rows):
            depth = depth - 1
            held = np.ascontiguousarray(boxes.take(above.take(depth * width + rows), axis=0).T)
            gaps = np.maximum(np.maximum(points - held[2 + d :], held[2 : 2 + d] - points), 0.0)
            gap = gaps[0]
            for k in range(1, d):
                gap = gap + gaps[k]
            out = gap != 0
            p = np.where(out, gap, 1.0)
            p = p / (p + held[1] - held[0])
            stay = np.where(out, p / (depth + 1) + (1 - p) * stay, stay)
            on = out & (depth > 0)  # a box that holds the point lies in all those above
            score[rows[~on]] = stay[~on]
            on = np.flatnonzero(on)
            rows, depth, stay, points = rows[on], depth[on], stay[on], points.take(on, axis=1)
        score = (score * self.logs[mass + 1]).reshape(-1, trees)
        total = np.zeros(len(score))
        for t in range(trees):
            total += score[:, t]
        return total / trees

    def _alone(self, x: tuple, roots: list[int]) -> float:
        nodes, log2, total = self.nodes, self.log2, 0.0
        for root in roots:
            node, path = nodes[root], []
            mass = node[4]
            while node[0] >= 0:
                path.append(node)
                node = nodes[node[2] if x[node[0]] <= node[1] else node[3]]
            depth = len(path)
            if node[7] == x:
                s = (1 - node[4] / (2 * mass)) / (depth + log2[node[4] + 1])
            else:
                s = 1 / (depth + 1)
                for node in reversed(path):
                    depth -= 1
                    gap = 0.0
                    for v, lo, hi in zip(x, node[7], node[8]):  # noqa: B905
                        if v > hi:
                            gap += v - hi
                        elif v < lo:
                            gap += lo - v
                    if gap == 0:
                        break
                    p = gap / (gap + node[6] - node[5])
                    s = p / (depth + 1) + (1 - p) * s
            total += s * log2[mass + 1]
        return total / len(roots)


class VersionedForest:
    """Samples and trees of a StreamForest that takes every point, over shared nodes; `roots` are its trees as they are now."""

    def __init__(self, nodes: Nodes, trees: int, capacity: int, decay: float, seed: int):
        self.nodes, self.capacity, self.decay = nodes, capacity, decay
        self.rng = random.Random(seed)
        self.roots = [-1] * trees
        self.samples: list[list[tuple[float, int, tuple]]] = [[] for _ in range(trees)]
        self.updates = 0

    @property
    def ready(self) -> bool:
        return self.updates > max(1, self.capacity // 4)

    def update(self, x: tuple) -> None:
        self.updates += 1
        random, log, old, roots, capacity = self.rng.random, math.log, self.updates * self.decay, self.roots, self.capacity
        self.nodes.own = len(self.nodes.nodes)
        for t, sample in enumerate(self.samples):
            key = old - log(-log(max(random(), 1e-300)))
            if len(sample) < capacity:
                heapq.heappush(sample, (key, self.updates, x))
            else:
                if key <= sample[0][0]:
                    continue
                roots[t] = self.nodes.deleted(roots[t], heapq.heapreplace(sample, (key, self.updates, x))[2])
            roots[t] = self.nodes.inserted(roots[t], x, random)

    def score(self, x: tuple) -> float:
        return self.nodes.scores([x], [self.roots])[0] if self.ready else 0.0
