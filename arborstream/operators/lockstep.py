"""Keyed state machines side by side: the forests of many keys as numpy arrays.

A step of a key is a generator that asks its forests for scores, distances,
imputed points and updates.  Keys wait for one another at each question, and
all that ask the same are answered by one pass over arrays, so the cost of a
row is a few array elements and not a walk in Python.  Every draw and every sum
is made in the order in which `StreamForest` makes it, so results are the same
to the last bit; `run` answers the same questions of one key by its own forests.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .detector import Steps, StreamForest, run
from .scan import dealt
from .trees import DynamicTree

#: Keys that go side by side, rows that are held for them, and the fewest keys for which arrays pay.
LANES, HELD_ROWS, THIN = 4096, 524_288, 256
#: Keys that are scored or imputed at once: what a pass makes should stay near the core.
STRIP = 512
#: Bytes that the banks of a task may have where a scan states its forests' shapes, and the rows that are then held.
ROOM, ROOM_ROWS = 256 << 20, 131_072
#: Times that the most uniforms that an update of a tree takes are kept for a lane.
UNIFORMS = 12
#: Tasks a core: fewer and larger ones than Spark's own number, as the more keys a task has the less a row costs.
ROUNDS = 2


def _sums(m: np.ndarray) -> np.ndarray:
    """Sums of the rows as the built-in sum() makes them: with what the additions lose."""
    return _added(m.T)


def _added(m: np.ndarray) -> np.ndarray:
    """As _sums, of what lies along the first axis."""
    s, lost = m[0], None
    for x in m[1:]:
        t = s + x
        z = t - s
        e = (s - (t - z)) + (x - z)
        lost = e if lost is None else lost + e
        s = t
    return s if lost is None else s + np.where(np.isfinite(lost), lost, 0.0)


def _picked(m: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return m.ravel().take(row.astype(np.int64) * m.shape[1] + column)


def room(*shapes: tuple[int, int, int]) -> int:
    """Keys that go side by side within ROOM, if each has a forest of each shape (trees, capacity, width)."""
    return max(1, min(LANES, ROOM // sum(Bank.lane_bytes(*shape) for shape in shapes)))


class Seat:
    """Stands for one key's forest in a bank; what a bank does not do for all is done on a copy of the forest."""

    def __init__(self, bank: Bank, lane: int, forest: StreamForest):
        self.bank, self.lane, self.capacity, self.decay = bank, lane, forest.capacity, forest.decay
        self.updates = 0
        self.left = False
        self.copy: StreamForest | None = None

    @property
    def ready(self) -> bool:
        return self.updates > max(1, self.capacity // 4)

    def forest(self) -> StreamForest:
        if self.copy is None:
            self.copy = self.bank.forest(self)
        return self.copy

    def leave(self) -> None:
        """Go on with a forest of one's own."""
        self.forest()
        self.left = True

    def update(self, x: tuple) -> None:
        if not self.left:
            raise RuntimeError("a seat learns with its bank")
        self.copy.update(x)
        self.updates = self.copy.updates

    def score(self, x: tuple) -> float:
        return self.copy.score(x) if self.left else self.bank.score([self], [x])[0]

    def distance(self, x: tuple) -> float:
        return self.copy.distance(x) if self.left else self.bank.distance([self], [x])[0]

    def impute(self, x: tuple, missing: list[int], shares: tuple[float, ...] = (0.5,)) -> list[tuple]:
        return self.copy.impute(x, missing, shares) if self.left else self.bank.impute([self], [x], missing, shares)[0]

    def attribution(self, x: tuple) -> list[float]:
        return self.copy.attribution(x) if self.left else self.bank.attribution([self], [x])[0]

    def distance_attribution(self, x: tuple) -> list[float]:
        return self.copy.distance_attribution(x) if self.left else self.bank.distance_attribution([self], [x])[0]

    def near(self, x: tuple) -> list[tuple[float, tuple, int]]:
        if self.left:
            return self.copy.near(x)
        count: dict[tuple, int] = {}
        for point in map(tuple, self.bank.leaf_points(self, x)):
            count[point] = count.get(point, 0) + 1
        return sorted((math.dist(x, p), p, n) for p, n in count.items())


def seated(forest: StreamForest) -> bool:
    """Whether a forest can have a seat in a bank."""
    return not (forest.shift or forest.frozen or forest.paused)


class Bank:
    """Forests of one shape, a lane each. A tree has slots for its nodes; a leaf's box is its point."""

    def __init__(self, lanes: int, trees: int, capacity: int, decay: float, accept: float):
        self.lanes, self.count, self.capacity, self.decay, self.accept = lanes, trees, capacity, decay, accept
        self.slots = 2 * capacity
        self.width = 0
        q = lanes * trees
        self.root = np.full(q, -1, np.int32)
        self.keys, self.born, self.leaf = np.empty((q, capacity)), np.empty((q, capacity), np.int32), np.empty((q, capacity), np.int32)
        self.taken = np.zeros(q, np.int32)
        self.free, self.top = np.tile(np.arange(self.slots, dtype=np.int16), (q, 1)), np.full(q, self.slots, np.int32)
        self.margin = 3 * capacity + 16
        self.uniforms, self.at = np.empty((lanes, UNIFORMS * self.margin)), np.full(lanes, UNIFORMS * self.margin)
        self.rngs: list[np.random.RandomState] = []
        #: A lane's uniforms made so far, and (how many, the generator) before each of the last two times that more were made.
        self.made: list[int] = []
        self.marks: list[list[tuple[int, tuple]]] = []
        self.logs = np.array([0.0, *[math.log2(m) for m in range(1, capacity + 2)]])

    @staticmethod
    def lane_bytes(trees: int, capacity: int, width: int) -> int:
        """Of a lane: nodes of two slots a point, samples, free slots, uniforms, and its generator with the marks of it."""
        nodes, points, margin = 2 * capacity * 8 * (2 * width + 8), capacity * (8 + 4 + 4), 3 * capacity + 16
        return trees * (nodes + points + 2 * capacity * 2 + 12) + UNIFORMS * margin * 8 + 12_000

    def seat(self, forest: StreamForest) -> Seat:
        if not seated(forest):
            raise ValueError("a forest whose decay has changed, or that is frozen or paused, takes no seat")
        _, inner, _ = forest.rng.getstate()
        rng = np.random.RandomState()
        rng.set_state(("MT19937", np.array(inner[:-1], np.uint32), inner[-1]))
        self.rngs.append(rng)
        self.made.append(0)
        self.marks.append([])
        seat = Seat(self, len(self.rngs) - 1, forest)
        if forest.updates:
            self._take(seat, forest)
        return seat

    def _take(self, seat: Seat, forest: StreamForest) -> None:
        """A lane goes on as a forest that has learnt."""
        seat.updates = forest.updates
        width = next((len(sample[0][2]) for sample in forest.samples if sample), 0)
        if not width:
            return
        self._widen(width)
        for t, (tree, sample) in enumerate(zip(forest.trees, forest.samples, strict=True)):
            q = t * self.lanes + seat.lane
            leaves: dict[tuple, int] = {}
            rows: list[list] = []
            numbers: list[int] = []
            todo = [(tree.root, -1, 0)] if tree.root is not None else []
            while todo:
                node, up, field = todo.pop()
                self.top[q] -= 1
                n = q * self.slots + int(self.free[q, self.top[q]])
                numbers.append(n)
                rows.append([*node.low, *node.high, sum(node.low), sum(node.high), node.dim, node.cut if node.dim >= 0 else -1, -1, -1, node.mass, -1 if up < 0 else numbers[up]])
                if up < 0:
                    self.root[q] = n
                else:
                    rows[up][field] = n
                if node.dim < 0:
                    leaves[node.point] = n
                else:
                    todo += [(node.left, len(rows) - 1, self.left), (node.right, len(rows) - 1, self.right)]
            if rows:
                self.node[numbers] = rows
            k = self.taken[q] = len(sample)
            self.keys[q, :k], self.born[q, :k] = [key for key, _, _ in sample], [born for _, born, _ in sample]
            self.leaf[q, :k] = [leaves[point] for _, _, point in sample]

    def _widen(self, width: int) -> None:
        if self.width != width:
            self.width = width
            #: A node's fields lie side by side: low, high, the sums of both, dimension (-1: a leaf), cut, left, right, mass and node above.
            d = 2 * width + 2
            self.dim, self.cut, self.left, self.right, self.mass, self.up = range(d, d + 6)
            self.node = np.full((len(self.root) * self.slots, d + 6), -1.0)

    def _of(self, field: int, n: np.ndarray) -> np.ndarray:
        return self.node[n, field].astype(np.int64)

    def _columns(self, n: np.ndarray) -> np.ndarray:
        """The fields of the nodes, a row a field."""
        return np.ascontiguousarray(self.node.take(n, axis=0).T)

    def _draw(self, lane: np.ndarray) -> np.ndarray:
        at = self.at[lane]
        self.at[lane] = at + 1
        return self.uniforms[lane, at]

    def _refill(self, lane: np.ndarray) -> None:
        size = self.uniforms.shape[1]
        for i in lane[self.at[lane] > size - self.margin]:
            left = self.uniforms[i, self.at[i] :].copy()
            self.uniforms[i, : len(left)] = left
            self.marks[i] = [*self.marks[i][-1:], (self.made[i], self.rngs[i].get_state())]
            self.made[i] += size - len(left)
            self.uniforms[i, len(left) :] = self.rngs[i].random_sample(size - len(left))
            self.at[i] = 0

    def _slot(self, q: np.ndarray) -> np.ndarray:
        self.top[q] -= 1
        return q * self.slots + self.free[q, self.top[q]]

    def _release(self, q: np.ndarray, node: np.ndarray) -> None:
        self.free[q, self.top[q]] = node - q * self.slots
        self.top[q] += 1

    # -- learning ----------------------------------------------------------------------------------

    def update(self, seats: list[Seat], points: list[tuple]) -> None:
        x = np.array(points, float)
        self._widen(x.shape[1])
        lane = np.array([s.lane for s in seats])
        for s in seats:
            s.updates += 1
            s.copy = None
        number = np.array([s.updates for s in seats])
        for t in range(self.count):
            self._refill(lane)
            q = t * self.lanes + lane
            # numpy's logarithm may differ from that of StreamForest in the last bit
            key = number * self.decay - np.array([math.log(-math.log(u)) for u in np.maximum(self._draw(lane), 1e-300).tolist()])
            size = self.taken[q]
            enter = size < self.capacity
            room = np.flatnonzero(enter)
            if self.accept < 1 and len(room):
                share = size[room] / self.capacity
                late = share >= self.accept
                room, share = room[late], share[late]
                enter[room[self._draw(lane[room]) > 1 - (share - self.accept) / (1 - self.accept)]] = False
            slot = size.copy()
            full = np.flatnonzero(size >= self.capacity)
            if len(full):
                held = self.keys[q[full]]
                worst = held.argmin(axis=1)
                better = key[full] > held[np.arange(len(full)), worst]
                full, worst = full[better], worst[better]
                slot[full] = worst
                if len(full):
                    self._delete(q[full], self.leaf[q[full], worst])
                    enter[full] = True
            own = np.flatnonzero(enter)
            if not len(own):
                continue
            qo, so = q[own], slot[own]
            self.taken[qo] = np.maximum(self.taken[qo], so + 1)
            self.keys[qo, so], self.born[qo, so] = key[own], number[own]
            self.leaf[qo, so] = self._insert(qo, lane[own], x[own])

    def _insert(self, q: np.ndarray, lane: np.ndarray, x: np.ndarray) -> np.ndarray:
        d, node = self.width, self.node
        at = self.root[q].astype(np.int64)
        ends = np.empty(len(q), np.int64)
        points = np.ascontiguousarray(x.T)

        def leaf(rows: np.ndarray, up: np.ndarray | int) -> np.ndarray:
            new, own = self._slot(q[rows]), points.take(rows, axis=1)
            made = np.empty((node.shape[1], len(rows)))
            made[:d] = made[d : 2 * d] = own
            made[2 * d] = made[2 * d + 1] = _added(own)
            made[self.dim : self.mass], made[self.mass], made[self.up] = -1, 1, up
            node[new] = np.ascontiguousarray(made.T)
            ends[rows] = new
            return new

        rows = np.flatnonzero(at < 0)
        if len(rows):
            self.root[q[rows]] = leaf(rows, -1)
        rows = np.flatnonzero(at >= 0)
        while len(rows):
            n, own = at[rows], points.take(rows, axis=1)
            held = self._columns(n)
            grown = np.empty((2, d, len(rows)))
            np.minimum(held[:d], own, out=grown[0])
            np.maximum(held[d : 2 * d], own, out=grown[1])
            end = held[self.dim] < 0
            out = (grown.reshape(2 * d, -1) != held[: 2 * d]).any(axis=0) | end
            inside = rows[:0]
            if not out.all():  # nothing grows, so no cut separates: its draw is passed over
                i = np.flatnonzero(~out)
                m, inside = n[i], rows[i]
                self.at[lane[inside]] += 1
                node[m, self.mass] = held[self.mass].take(i) + 1
                goes = _picked(own, held[self.dim].take(i), i) <= held[self.cut].take(i)
                at[inside] = np.where(goes, held[self.left].take(i), held[self.right].take(i))
                i = np.flatnonzero(out)
                rows, n, own, held, grown, end = rows[i], n[i], own.take(i, axis=1), held.take(i, axis=1), grown.take(i, axis=2), end[i]
                if not len(rows):
                    rows = inside
                    continue
            low, high = _added(grown.swapaxes(0, 1))
            total = high - low
            same = end & (total <= 0)
            if same.any():
                i = np.flatnonzero(same)
                node[n[i], self.mass] += 1
                ends[rows[i]] = n[i]
                i = np.flatnonzero(~same)
                rows, n, own, held, grown, end, low, high, total = rows[i], n[i], own[:, i], held[:, i], grown[:, :, i], end[i], low[i], high[i], total[i]
                if not len(rows):
                    rows = inside
                    continue
            every = np.arange(len(rows))
            ranges = grown[1] - grown[0]
            rest = self._draw(lane[rows]) * total
            dim, open_ = np.full(len(rows), -1), np.ones(len(rows), bool)
            left = np.zeros(len(rows))
            for k in range(d):
                hit = open_ & (rest <= ranges[k]) & (ranges[k] > 0)
                dim[hit], left[hit] = k, rest[hit]
                open_ &= ~hit
                rest = rest - ranges[k]
            none = np.flatnonzero(open_)
            if len(none):  # rounding used the ranges up: the last one that is not empty
                dim[none] = d - 1 - (ranges[::-1, none] > 0).argmax(axis=0)
                left[none] = rest[none]
            most = _picked(grown[1], dim, every)
            cut = _picked(grown[0], dim, every) + left
            cut = np.where(cut >= most, np.nextafter(most, -np.inf), cut)
            v = _picked(own, dim, every)
            goes = v <= cut
            parts = np.where(goes, cut < _picked(held, dim, every), _picked(held, d + dim, every) <= cut)
            held[: 2 * d], held[2 * d], held[2 * d + 1] = grown.reshape(2 * d, -1), low, high
            s = np.flatnonzero(parts)
            if len(s):
                r, m = rows[s], n[s]
                inner = self._slot(q[r])
                new = leaf(r, inner)
                made = held.take(s, axis=1)
                up = made[self.up].astype(np.int64)
                made[self.dim], made[self.cut] = dim[s], cut[s]
                made[self.left], made[self.right] = np.where(goes[s], new, m), np.where(goes[s], m, new)
                made[self.mass] += 1
                node[inner] = np.ascontiguousarray(made.T)
                node[m, self.up] = inner
                self._link(q[r], up, m, inner)
            go = np.flatnonzero(~parts & ~end)
            if len(go):
                made = held.take(go, axis=1)
                made[self.mass] += 1
                node[n[go]] = np.ascontiguousarray(made.T)
                goes = _picked(own, made[self.dim], go) <= made[self.cut]
                at[rows[go]] = np.where(goes, made[self.left], made[self.right])
            rows = rows[~parts]
            if len(inside):
                rows = np.concatenate([inside, rows])
        return ends

    def _link(self, q: np.ndarray, up: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        """Put `new` in the place of `old` under `up` (-1: the root)."""
        top = up < 0
        self.root[q[top]] = new[top]
        up, old, new = up[~top], old[~top], new[~top]
        self.node[up, np.where(self.node[up, self.left] == old, self.left, self.right)] = new

    def _delete(self, q: np.ndarray, leaf: np.ndarray) -> None:
        d, node = self.width, self.node
        leaf = leaf.astype(np.int64)
        many = node[leaf, self.mass] > 1
        at = leaf.copy()
        one = np.flatnonzero(~many)
        if len(one):
            n, own = leaf[one], q[one]
            up = self._of(self.up, n)
            at[one] = -1
            last = up < 0
            self.root[own[last]] = -1
            self._release(own, n)
            n, own, up, one = n[~last], own[~last], up[~last], one[~last]
            held = node[up]
            other = np.where(held[:, self.left] == n, held[:, self.right], held[:, self.left]).astype(np.int64)
            top = held[:, self.up].astype(np.int64)
            node[other, self.up] = top
            self._link(own, top, up, other)
            self._release(own, up)
            at[one] = top
        shrinks = ~many
        rows = np.flatnonzero(at >= 0)
        at, shrinks = at[rows], shrinks[rows]
        while len(at):
            held = node.take(at, axis=0)
            node[at, self.mass] = held[:, self.mass] - 1
            s = np.flatnonzero(shrinks)
            if len(s):
                own = held[s]
                a, b = self._columns(own[:, self.left].astype(np.int64)), self._columns(own[:, self.right].astype(np.int64))
                new = np.empty((2, d, len(s)))
                np.minimum(a[:d], b[:d], out=new[0])
                np.maximum(a[d : 2 * d], b[d : 2 * d], out=new[1])
                changed = (new.reshape(2 * d, -1) != own[:, : 2 * d].T).any(axis=0)
                shrinks[s] = changed
                c = np.flatnonzero(changed)
                if len(c):
                    new = new[:, :, c]
                    node[at[s[c]], : 2 * d + 2] = np.concatenate([new.reshape(2 * d, -1), _added(new.swapaxes(0, 1))]).T
            up = held[:, self.up].astype(np.int64)
            on = up >= 0
            at, shrinks = up[on], shrinks[on]

    # -- questions ---------------------------------------------------------------------------------

    def _queries(self, seats: list[Seat], points: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Roots and points, a row a tree."""
        lane = np.array([s.lane for s in seats])
        roots = self.root[(lane[:, None] + np.arange(self.count) * self.lanes).ravel()].astype(np.int64)
        return roots, np.repeat(np.array(points, float), self.count, axis=0)

    def _leaves(self, roots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, depth = roots.copy(), np.zeros(len(roots), np.int64)
        rows, n, fields = np.arange(len(roots)), at, self.node[:, self.dim : self.mass]
        while True:
            held = fields[n]
            on = np.flatnonzero(held[:, 0] >= 0)
            if not len(on):
                return at, depth
            if len(on) < len(rows):
                rows, held = rows[on], held[on]
            n = np.where(x[rows, held[:, 0].astype(np.int64)] <= held[:, 1], held[:, 2], held[:, 3]).astype(np.int64)
            at[rows] = n
            depth[rows] += 1

    def score(self, seats: list[Seat], points: list[tuple]) -> list[float]:
        found = np.zeros(len(seats))
        ripe = [i for i, s in enumerate(seats) if s.ready]
        for a in range(0, len(ripe), STRIP):
            own = ripe[a : a + STRIP]
            found[own] = self._score(*self._queries([seats[i] for i in own], [points[i] for i in own]))
        return found.tolist()

    def _score(self, roots: np.ndarray, x: np.ndarray) -> np.ndarray:
        d = self.width
        at, depth = self._leaves(roots, x)
        ends = self.node.take(at, axis=0)
        mass, own = self._of(self.mass, roots), ends[:, self.mass].astype(np.int64)
        points = np.ascontiguousarray(x.T)
        equal = (ends[:, :d].T == points).all(axis=0)
        score = np.where(equal, (1 - own / (2 * mass)) / (depth + self.logs[own + 1]), 1 / (depth + 1))
        rows = np.flatnonzero(~equal)
        at, depth, points = ends[rows, self.up].astype(np.int64), depth[rows], points[:, rows]
        on = np.flatnonzero(at >= 0)
        while len(on):
            if len(on) < len(rows):
                rows, at, depth, points = rows[on], at[on], depth[on], points[:, on]
            depth = depth - 1
            held = self._columns(at)
            gaps = np.maximum(np.maximum(points - held[d : 2 * d], held[:d] - points), 0.0)
            gap = gaps[0]
            for k in range(1, d):
                gap = gap + gaps[k]
            out = gap != 0
            p = np.where(out, gap, 1.0)
            p = p / (p + held[2 * d + 1] - held[2 * d])
            old = score[rows]
            score[rows] = np.where(out, p / (depth + 1) + (1 - p) * old, old)
            # a box that holds the point lies in all those above
            at = np.where(out, held[self.up], -1).astype(np.int64)
            on = np.flatnonzero(at >= 0)
        score = (score * self.logs[mass + 1]).reshape(-1, self.count)
        total = np.zeros(len(score))
        for t in range(self.count):
            total += score[:, t]
        return total / self.count

    def distance(self, seats: list[Seat], points: list[tuple]) -> list[float]:
        found = np.zeros(len(seats))
        ripe = [i for i, s in enumerate(seats) if s.ready]
        if ripe:
            roots, x = self._queries([seats[i] for i in ripe], [points[i] for i in ripe])
            at, _ = self._leaves(roots, x)
            far = _sums(np.abs(self.node[at, : self.width] - x)).reshape(-1, self.count)
            found[ripe] = _sums(far) / self.count
        return found.tolist()

    def impute(self, seats: list[Seat], points: list[tuple], missing: list[int], shares: tuple[float, ...] = (0.5,)) -> list[list[tuple]]:
        places = [min(self.count - 1, max(0, math.ceil(s * self.count) - 1)) for s in shares]
        found: list[list[tuple]] = []
        for a in range(0, len(seats), STRIP):
            own = points[a : a + STRIP]
            best = self._conditional(*self._queries(seats[a : a + STRIP], own), missing)
            values = [np.sort(self.node[best, i].reshape(-1, self.count), axis=1)[:, places].tolist() for i in missing]
            if len(missing) == 1:
                i = missing[0]
                found += [[(*p[:i], v, *p[i + 1 :]) for v in new] for p, new in zip(own, values[0], strict=True)]
                continue
            out = [[list(p) for _ in shares] for p in own]
            for i, column in zip(missing, values, strict=True):
                for rows, new in zip(out, column, strict=True):
                    for row, v in zip(rows, new, strict=True):
                        row[i] = v
            found += [[tuple(row) for row in rows] for rows in out]
        return found

    def _conditional(self, roots: np.ndarray, x: np.ndarray, missing: list[int]) -> np.ndarray:
        """The leaf of each tree that fits the observed coordinates best."""
        d = self.width
        seen = np.array([i for i in range(d) if i not in missing], np.int64)
        hidden = np.zeros(d + 1, bool)
        hidden[missing] = True
        points = np.ascontiguousarray(x.T)
        node, query, depth = roots, np.arange(len(roots)), 0
        levels = []  # nodes that are looked at, their inner ones, those of two sides, and what a node makes of the rank below it
        while len(node):
            held, own = self._columns(node), points.take(query, axis=1)
            if len(seen):
                above, below = own[seen], held[seen]
                below -= above
                above -= held[d + seen]
                s = _added(np.maximum(0.0, above, out=above) + np.maximum(0.0, below, out=below))
            else:
                s = np.zeros(len(node))
            inner = np.flatnonzero(held[self.dim] >= 0)
            rank = np.where(s != 0, 1 / (depth + 1), 0.0)  # a leaf's: its box is its point, so at 0 it is equal
            held, s, query = held.take(inner, axis=1), s.take(inner), query.take(inner)
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(s != 0, s / (s + held[2 * d + 1] - held[2 * d]), 0.0)
            dim = held[self.dim].astype(np.int64)
            both = hidden[dim]
            side = np.where(both | (_picked(own, dim, inner) <= held[self.cut]), held[self.left], held[self.right])
            two = np.flatnonzero(both)
            levels.append((node, rank, inner, two, p))
            node, query = np.concatenate([side, held[self.right].take(two)]).astype(np.int64), np.concatenate([query, query.take(two)])
            depth += 1
        below, best = np.empty(0), np.empty(0, np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            node, rank, inner, two, p = levels[depth]
            n = len(inner)
            if n:
                first, fit = below[:n], best[:n]
                if len(two):
                    better = np.flatnonzero(below[n:] < first[two])
                    first[two[better]], fit[two[better]] = below[n:][better], best[n:][better]
                rank[inner] = p / (depth + 1) + (1 - p) * first
                node = node.copy()
                node[inner] = fit
            below, best = rank, node
        return best

    def leaf_points(self, seat: Seat, x: tuple) -> list[list[float]]:
        """The point of each tree's leaf that x falls to."""
        at, _ = self._leaves(*self._queries([seat], [x]))
        return self.node[at, : self.width].tolist()

    def distance_attribution(self, seats: list[Seat], points: list[tuple]) -> list[list[float]]:
        roots, x = self._queries(seats, points)
        point = self.node[self._leaves(roots, x)[0], : self.width]
        far = np.abs(x - point) / self.count
        parts = np.concatenate([np.where(x > point, far, 0.0), np.where(x > point, 0.0, far)], axis=1)
        return self._over_trees(parts).tolist()

    def _over_trees(self, parts: np.ndarray) -> np.ndarray:
        """Sums over the trees, one tree after the other."""
        parts = parts.reshape(-1, self.count, parts.shape[1])
        total = np.zeros((len(parts), parts.shape[2]))
        for t in range(self.count):
            total += parts[:, t]
        return total

    def attribution(self, seats: list[Seat], points: list[tuple]) -> list[list[float]]:
        """As StreamForest.attribution, all trees level by level."""
        d = self.width
        at, own = self._queries(seats, points)
        mass = self._of(self.mass, at)
        norm = self.logs[mass + 1]
        stay, part = np.ones(len(at)), np.zeros((len(at), 2 * d))
        rows, k = np.arange(len(at)), 0
        while len(rows):
            n = at[rows]
            box = self.node.take(n, axis=0)
            dim = box[:, self.dim].astype(np.int64)
            v = own[rows]
            above, below = v - box[:, d : 2 * d], box[:, :d] - v
            gaps = np.concatenate([np.where(above > 0, above, 0.0), np.where(below > 0, below, 0.0)], axis=1)
            s = np.zeros(len(rows))
            for i in range(d):
                s += gaps[:, i] + gaps[:, d + i]
            out = np.flatnonzero(s != 0)
            if len(out):
                whole = s[out] + np.where(dim[out] >= 0, box[out, 2 * d + 1] - box[out, 2 * d], 0.0)
                r = rows[out]
                part[r] += gaps[out] * (stay[r] / whole / (k + 1))[:, None]
                stay[r] *= 1 - s[out] / whole
            end = dim < 0
            same = np.flatnonzero(end & (box[:, :d] == v).all(axis=1))
            if len(same):  # a point's own leaf has its score spread alike, and what the path has brought does not count
                r = rows[same]
                m, t = box[same, self.mass].astype(np.int64), mass[r]
                part[r] = ((1 - m / (2 * t)) / (k + self.logs[m + 1]) * norm[r] / (2 * d))[:, None]
                norm[r] = 1.0
            go = np.flatnonzero(~end)
            rows, box = rows[go], box[go]
            at[rows] = np.where(own[rows, dim[go]] <= box[:, self.cut], box[:, self.left], box[:, self.right])
            k += 1
        return (self._over_trees(part * norm[:, None]) / self.count).tolist()

    def _generator(self, lane: int) -> random.Random:
        """The lane's generator, at the first uniform that was not used."""
        taken = self.made[lane] - (self.uniforms.shape[1] - int(self.at[lane]))
        before, state = next((m for m in reversed(self.marks[lane]) if m[0] <= taken), (taken, self.rngs[lane].get_state()))
        out = random.Random()
        out.setstate((3, (*state[1].tolist(), int(state[2])), None))
        for _ in range(taken - before):
            out.random()
        return out

    def forest(self, seat: Seat) -> StreamForest:
        """The lane's forest as one of its own, which goes on as the lane would."""
        out = StreamForest(0, self.capacity, self.decay, 0, self.accept)
        out.updates = seat.updates
        out.rng = self._generator(seat.lane)
        d = self.width
        for t in range(self.count):
            q = t * self.lanes + seat.lane
            tree = DynamicTree(out.rng.random)
            made: dict[int, DynamicTree.Node] = {}
            todo = [(int(self.root[q]), None, "")] if self.root[q] >= 0 else []
            if todo:
                a = q * self.slots
                box = self.node[a : a + self.slots]
                dim, mass, left, right = (box[:, f].astype(np.int64).tolist() for f in (self.dim, self.mass, self.left, self.right))
                box, cut = box.tolist(), box[:, self.cut].tolist()
            while todo:
                n, up, side = todo.pop()
                i = n - a
                low, high = box[i][:d], box[i][d : 2 * d]
                node = made[n] = DynamicTree.Node(tuple(low) if dim[i] < 0 else (), low, high, mass[i], up)
                if up is None:
                    tree.root = node
                else:
                    setattr(up, side, node)
                if dim[i] >= 0:
                    node.dim, node.cut = dim[i], cut[i]
                    todo += [(left[i], node, "left"), (right[i], node, "right")]
            out.trees.append(tree)
            k = self.taken[q]
            sample = [(key, born, made[leaf].point) for key, born, leaf in zip(self.keys[q, :k].tolist(), self.born[q, :k].tolist(), self.leaf[q, :k].tolist(), strict=True)]
            heapq.heapify(sample)
            out.samples.append(sample)
        return out

    def state(self, seat: Seat) -> tuple[random.Random, list[list[float]], list, list[list[list]]]:
        """What `sources.state` keeps of the lane's forest: generator, points, trees as nested lists and samples; no node becomes an object."""
        d, own = self.width, slice(seat.lane, None, self.lanes)
        box = self.node.reshape(-1, self.slots, self.node.shape[1])[own].reshape(-1, self.node.shape[1])
        dim, mass = (box[:, f].astype(np.int64).tolist() for f in (self.dim, self.mass))
        cut, corner = box[:, self.cut].tolist(), list(map(tuple, box[:, :d].tolist()))
        # nodes of the lane are numbered on from tree to tree
        shift = np.repeat(np.arange(self.count) * (self.lanes - 1) + seat.lane, self.slots) * self.slots
        left, right = ((box[:, f].astype(np.int64) - shift).tolist() for f in (self.left, self.right))
        number: dict[tuple, int] = {}

        def node(n: int) -> list:
            if dim[n] < 0:
                return [mass[n], number.setdefault(corner[n], len(number))]
            return [dim[n], cut[n], mass[n], node(left[n]), node(right[n])]

        trees, samples = [], []
        for t in range(self.count):
            q = t * self.lanes + seat.lane
            away = (q - t) * self.slots
            trees.append(node(int(self.root[q]) - away) if self.root[q] >= 0 else None)
            k = self.taken[q]
            sample = [(key, born, number[corner[n]]) for key, born, n in zip(self.keys[q, :k].tolist(), self.born[q, :k].tolist(), (self.leaf[q, :k] - away).tolist(), strict=True)]
            heapq.heapify(sample)
            samples.append(list(map(list, sample)))
        return self._generator(seat.lane), list(map(list, number)), trees, samples


#: Questions in the order in which they are answered while keys wait for one another.
_ORDER = {"clustered": 0, "clustered_alone": 1, "impute": 2, "distance": 3, "score": 4, "attribution": 5, "distance_attribution": 6, "update": 7}


def _answers(kind: str, asked: list[tuple[int, tuple]]) -> Iterator[tuple[int, Any]]:
    groups: dict[tuple, list[tuple[int, tuple]]] = {}
    for lane, request in asked:
        forest = request[1]
        bank = forest.bank if isinstance(forest, Seat) else None
        groups.setdefault((id(bank), *map(tuple, request[3:])), []).append((lane, request))
    for own in groups.values():
        forest, rest = own[0][1][1], own[0][1][3:]
        if isinstance(forest, Seat):
            got = getattr(forest.bank, kind)([r[1] for _, r in own], [r[2] for _, r in own], *rest)
        elif (many := getattr(forest, f"{kind}_together", None)) is not None:
            got = many([r[1] for _, r in own], [r[2] for _, r in own], *rest)
        else:
            got = [getattr(r[1], kind)(*r[2:]) for _, r in own]
        yield from zip([lane for lane, _ in own], got or [None] * len(own), strict=True)


def together(steps: dict[int, Steps]) -> dict[int, Any]:
    """Run a step of each lane to its end; what it returns, by lane."""
    done: dict[int, Any] = {}
    waiting: list[list[tuple[int, tuple]]] = [[] for _ in _ORDER]

    def go(lane: int, answer: Any) -> None:
        try:
            request = steps[lane].send(answer)
            waiting[_ORDER[request[0]]].append((lane, request))
        except StopIteration as end:
            done[lane] = end.value

    for lane in steps:
        go(lane, None)
    while any(waiting):
        at = next(i for i, w in enumerate(waiting) if w)
        asked, waiting[at] = waiting[at], []
        for lane, answer in _answers(asked[0][1][0], asked):
            go(lane, answer)
    return done


def abreast(on: list[int], steps: list, rows: list[list[tuple]], out: list[list[tuple]], thin: int) -> tuple[int, list[int]]:
    """Step lanes side by side, a row each, until `thin` are left; how many rows of each are done, and the lanes that are left."""
    place = 0
    while len(on) > thin:
        for i, got in together({i: steps[i](rows[i][place]) for i in on}).items():
            out[i] += got
        place += 1
        on = [i for i in on if len(rows[i]) > place]
    return place, on


Start = Callable[[Any, Callable[[StreamForest], Any]], Callable[[tuple], Steps]]


class Hall:
    """Banks by shape."""

    def __init__(self, lanes: int):
        self.lanes, self.banks = lanes, {}

    def seat(self, forest: StreamForest) -> Seat:
        shape = (len(forest.trees), forest.capacity, forest.decay, forest.accept)
        if shape not in self.banks:
            self.banks[shape] = Bank(self.lanes, *shape)
        return self.banks[shape].seat(forest)


def scan(df: DataFrame, key: str, order: list[str], columns: list[str], start: Start, schema: str, thin: int | None = None, lanes: int | None = None) -> DataFrame:
    """As `scan.scan`, with steps that ask: start(key, seat) gives a step, and takes for each new forest what seat(forest) gives.

    A task holds LANES keys or HELD_ROWS rows at most; with `lanes` (see
    `room`) as many keys, or ROOM_ROWS rows. A key whose rows go on
    beyond them, and the last few of a set, go on with forests of their own.
    """
    parts = ROUNDS * df.sparkSession.sparkContext.defaultParallelism
    return dealt(df, key, order, columns, lambda batches: _played(batches, start, thin, lanes), schema, parts)


def _played(batches: Iterator[tuple[list, list[tuple]]], start: Start, thin: int | None = None, lanes: int | None = None) -> Iterator[list[tuple]]:
    """Keys and rows, sorted by key, to output rows, key by key."""
    thin = THIN if thin is None else thin
    most, most_rows = (LANES, HELD_ROWS) if lanes is None else (lanes, min(ROOM_ROWS, HELD_ROWS))
    names: list[Any] = []
    rows: list[list[tuple]] = []
    carried: list = []  # the step of the first key, if it began before
    held = 0

    def play(goes_on: bool) -> list[tuple]:
        nonlocal carried, held, names, rows
        hall = Hall(len(names))
        out: list[list[tuple]] = [[] for _ in names]
        own: list[list] = [[] for _ in names]  # a lane's seats as [seat, forest of its own]
        steps: list[Callable[[tuple], Steps] | None] = []
        for i, name in enumerate(names):
            steps.append(carried[0] if i == 0 and carried else None)

        def begin(i: int, wide: bool) -> None:
            def seat(forest: StreamForest) -> Any:
                if not wide:
                    return forest
                s = hall.seat(forest)
                own[i].append(s)
                return s

            steps[i] = start(names[i], seat)

        fresh = [i for i in range(len(names)) if steps[i] is None]
        wide = len(fresh) > thin
        for i in fresh:
            begin(i, wide)
        place = 0
        if wide:
            place, on = abreast(fresh, steps, rows, out, thin)
            leaving = set(on)
            if goes_on:
                leaving.add(len(names) - 1)
            for i in leaving:
                for s in own[i]:
                    s.leave()
        stepped = set(fresh) if wide else set()
        for i in range(len(names)):
            for row in rows[i][place if i in stepped else 0 :]:
                out[i] += run(steps[i](row))
        carried = [steps[-1]] if goes_on else []
        names, rows = (names[-1:], [[]]) if goes_on else ([], [])
        held = 0
        return [r for o in out for r in o]

    begun = False
    for keys, values in batches:
        for k, row in zip(keys, values, strict=True):
            if not begun or k != names[-1]:
                if begun and (len(names) >= most or held >= most_rows):
                    yield play(False)
                names.append(k)
                rows.append([])
                begun = True
            elif held >= most_rows:
                yield play(True)
            rows[-1].append(row)
            held += 1
    if begun:
        yield play(False)
