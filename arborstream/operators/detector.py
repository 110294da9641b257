"""Sequential detection on one keyed stream: preprocess, score, threshold, correct, update.

A Detector is a state machine whose step takes a row and gives its result.
The batch scan and the streaming processor drive the same class, and a
detector pickles, so a stream resumes where it stopped.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Generator
from dataclasses import dataclass, field
from itertools import pairwise
from typing import Any

import numpy as np

from . import folds
from .deviation import Deviation
from .thresholder import Thresholder
from .transforms import Transform
from .trees import DynamicTree

# Names of the settings.
STRATEGIES = ("EXPECTED_INVERSE_DEPTH", "DISTANCE", "MULTI_MODE", "MULTI_MODE_RECALL")
MODES = ("STANDARD", "TIME_AUGMENTED", "STREAMING_IMPUTE")
IMPUTATIONS = ("ZERO", "FIXED_VALUES", "PREVIOUS", "NEXT", "LINEAR", "RCF")
CORRECTIONS = ("NONE", "NOISE", "MULTI_MODE", "ANOMALY_IN_SHINGLE", "CONDITIONAL_FORECAST", "FORECAST", "DATA_DRIFT", "ALERT_ONCE")

# Fixed values of the correction rules.
MAX_ATTRIBUTORS = 5
ATTRIBUTION_LEAST = 0.1
NOISE_FACTOR = 1.0
PRECISION = 1e-3
DIFFERENTIAL = 0.3
TRIGGER_RATIO = 1.2
RUN_ALLOWED = 2
SUPPORT = 0.1
GAP_FACTOR = 1.5
NEAR_FACTOR = 1.1
FAST_FORWARD_SHINGLES = 3
INITIAL_ROWS = 10
TIME_FACTOR = 1.3


#: A step's questions: (method of a forest, forest, arguments).
Steps = Generator[tuple, Any, Any]


def run(steps: Steps) -> Any:
    """Answer a step's questions by the forests that it asks; what the step returns."""
    answer = None
    try:
        while True:
            kind, forest, *args = steps.send(answer)
            answer = getattr(forest, kind)(*args)
    except StopIteration as end:
        return end.value


class StreamForest:
    """Reservoir samples with dynamic trees, one point at a time."""

    def __init__(self, trees: int, capacity: int, decay: float, seed: int, accept: float = 1.0):
        self.capacity, self.decay, self.accept = capacity, decay, accept
        self.rng = random.Random(seed)
        self.trees = [DynamicTree(self.rng.random) for _ in range(trees)]
        #: Each tree's points as a heap by falling key: (-key, number, point).
        self.samples: list[list[tuple[float, int, tuple]]] = [[] for _ in range(trees)]
        self.updates = 0
        self.shift = 0.0
        self.frozen = False
        self.paused = False

    @property
    def ready(self) -> bool:
        return self.updates > max(1, self.capacity // 4)

    def set_decay(self, decay: float) -> None:
        """Old points keep the decay that they have gathered."""
        self.shift += self.updates * (self.decay - decay)
        self.decay = decay

    def update(self, x: tuple) -> None:
        """Offer a point to each tree's sample: the points with the smallest keys stay. While sampling is paused nothing changes."""
        if self.frozen:
            raise RuntimeError("the forest is frozen for readers")
        if self.paused:
            return
        self.updates += 1
        random, log, old = self.rng.random, math.log, self.updates * self.decay + self.shift
        for tree, sample in zip(self.trees, self.samples, strict=True):
            item = (old - log(-log(max(random(), 1e-300))), self.updates, x)
            if len(sample) < self.capacity:
                share = len(sample) / self.capacity
                if self.accept < 1 and share >= self.accept and random() > 1 - (share - self.accept) / (1 - self.accept):
                    continue
                heapq.heappush(sample, item)
            else:
                if item[0] <= sample[0][0]:
                    continue
                tree.delete(heapq.heapreplace(sample, item)[2])
            tree.insert(x)

    def attribution(self, x: tuple) -> list[float]:
        """Parts of the score above (first half) and below in each dimension; their sum is the score."""
        d = len(x)
        total = [0.0] * (2 * d)
        for tree in self.trees:
            path = tree.path(x)
            if not path:
                continue
            mass = path[0].mass
            leaf = path[-1]
            norm = math.log2(mass + 1)
            depth = len(path) - 1
            if leaf.point == x:
                s = (1 - leaf.mass / (2 * mass)) / (depth + math.log2(leaf.mass + 1)) if depth or leaf.mass else 0.0
                for i in range(2 * d):
                    total[i] += s * norm / (2 * d)
                continue
            stay, part = 1.0, [0.0] * (2 * d)
            for k, n in enumerate(path):
                gaps = [0.0] * (2 * d)
                s = 0.0
                for i, v in enumerate(x):
                    if v > n.high[i]:
                        gaps[i] = v - n.high[i]
                        s += gaps[i]
                    elif v < n.low[i]:
                        gaps[d + i] = n.low[i] - v
                        s += gaps[d + i]
                if s == 0:
                    continue
                whole = s + (sum(n.high) - sum(n.low) if n is not leaf else 0.0)
                f = stay / whole / (k + 1)
                for i in range(2 * d):
                    if gaps[i]:
                        part[i] += gaps[i] * f
                stay *= 1 - s / whole
            for i in range(2 * d):
                total[i] += part[i] * norm
        n = len(self.trees)
        return [v / n for v in total]

    def score(self, x: tuple) -> float:
        """The sum of the attribution, by a walk upwards that ends at the first box that holds the point: those above hold it too."""
        if not self.ready:
            return 0.0
        total, log2 = 0.0, math.log2
        for tree in self.trees:
            n, depth = tree.root, 0
            if n is None:
                continue
            mass = n.mass
            while n.dim >= 0:
                n = n.left if x[n.dim] <= n.cut else n.right
                depth += 1
            if n.point == x:
                s = (1 - n.mass / (2 * mass)) / (depth + log2(n.mass + 1))
            else:
                s = 1 / (depth + 1)
                n = n.up
                while n is not None:
                    depth -= 1
                    gap = 0.0
                    for v, lo, hi in zip(x, n.low, n.high):  # noqa: B905
                        if v > hi:
                            gap += v - hi
                        elif v < lo:
                            gap += lo - v
                    if gap == 0:
                        break
                    p = gap / (gap + sum(n.high) - sum(n.low))
                    s = p / (depth + 1) + (1 - p) * s
                    n = n.up
            total += s * log2(mass + 1)
        return total / len(self.trees)

    def interpolation(self, x: tuple) -> np.ndarray:
        """Measure, distances and probability mass (rows) above (first half) and below in each dimension: the mean of folds.Density over the trees."""
        d = len(x)
        paths = [p for t in self.trees if (p := t.path(x))]
        if not paths:
            return np.zeros((3, 2 * d))
        # every tree is a row of one fold
        queries = np.tile(np.array(x, float), (len(paths), 1))
        fold = folds.Density()
        leaves = [p[-1] for p in paths]
        equal = np.array([n.point == x for n in leaves])

        def level(rows: np.ndarray, nodes: list[DynamicTree.Node], depth: np.ndarray, low: np.ndarray, high: np.ndarray) -> folds.Level:
            mass = np.array([n.mass for n in nodes])
            gaps = np.concatenate([np.maximum(0.0, queries[rows] - high), np.maximum(0.0, low - queries[rows])], axis=1)
            total, width = gaps.sum(axis=1), (high - low).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(total > 0, total / (total + width), 0.0)
            return folds.Level(rows, np.arange(len(rows)), depth, mass, gaps, total, width, p, low, high)

        boxes = lambda nodes: (np.array([n.low for n in nodes], float), np.array([n.high for n in nodes], float))
        last = np.array([len(p) - 1 for p in paths])
        fold.leaf(level(np.arange(len(paths)), leaves, last, *boxes(leaves)), equal, None)
        # above its own point a query looks at the boxes beside it
        shadow_low, shadow_high = np.full(queries.shape, np.inf), np.full(queries.shape, -np.inf)
        for k in range(last.max() - 1, -1, -1):
            rows = np.flatnonzero(last > k)
            nodes = [paths[r][k] for r in rows]
            low, high = boxes(nodes)
            same = equal[rows]
            if same.any():
                r = rows[same]
                beside_low, beside_high = boxes([n.right if n.left is paths[i][k + 1] else n.left for i, n in zip(rows, nodes, strict=True) if equal[i]])
                shadow_low[r] = np.minimum(shadow_low[r], beside_low)
                shadow_high[r] = np.maximum(shadow_high[r], beside_high)
                low[same], high[same] = shadow_low[r], shadow_high[r]
            fold.up(level(rows, nodes, np.full(len(rows), k), low, high), same, None)
        return fold.result().sum(axis=0) / len(paths)

    def directional_density(self, x: tuple, q: float = 0.001) -> list[float]:
        """Parts of the density above (first half) and below in each dimension; their sum is the density. Zeros while warming up."""
        d = len(x)
        measure, distance, mass = self.interpolation(x) if self.ready else np.zeros((3, 2 * d))
        total = float(measure.sum())
        if total <= 0:
            return [0.0] * (2 * d)
        size = sum(t.root.mass for t in self.trees if t.root is not None) / sum(t.root is not None for t in self.trees)
        # both sides of a dimension together; its distance counts as often as there are dimensions
        p, far = mass[:d] + mass[d:], distance[:d] + distance[d:]
        with np.errstate(invalid="ignore", divide="ignore"):
            volume = float((np.where(p > 0, far / p, 0.0) ** d * p).sum())
        density = total / size / (q * total / size + volume)
        return [float(v) for v in measure * density / total]

    def density(self, x: tuple) -> float:
        """Mass near the point by the distance at which it lies; at most 1 / q, also for copies of a point."""
        return sum(self.directional_density(x))

    def distance(self, x: tuple) -> float:
        """Mean L1 distance to the leaves' points over the trees."""
        if not self.ready:
            return 0.0
        far = [sum(abs(a - b) for a, b in zip(leaf.point, x, strict=True)) for t in self.trees if (leaf := t.leaf(x)) is not None]
        return sum(far) / len(far) if far else 0.0

    def distance_attribution(self, x: tuple) -> list[float]:
        d = len(x)
        out = [0.0] * (2 * d)
        for t in self.trees:
            if (leaf := t.leaf(x)) is not None:
                for i, (a, b) in enumerate(zip(x, leaf.point, strict=True)):
                    out[i if a > b else d + i] += abs(a - b) / len(self.trees)
        return out

    def near(self, x: tuple) -> list[tuple[float, tuple, int]]:
        """(Euclidean distance, leaf's point, trees) of the leaves that the point falls to, equal points as one."""
        count: dict[tuple, int] = {}
        for t in self.trees:
            if (leaf := t.leaf(x)) is not None:
                count[leaf.point] = count.get(leaf.point, 0) + 1
        return sorted((math.dist(x, p), p, n) for p, n in count.items())

    def conditional(self, x: tuple, missing: list[int]) -> list[tuple[float, tuple]]:
        """(distance over the observed coordinates, sample point) of each tree's best fit."""
        hidden = set(missing)
        seen = [i for i in range(len(x)) if i not in hidden]

        def visit(n: DynamicTree.Node, depth: int) -> tuple[float, float, tuple]:
            if n.dim < 0:
                far = sum(abs(n.point[i] - x[i]) for i in seen)
                return (0.0 if far == 0 else 1 / (depth + 1)), far, n.point
            if n.dim in hidden:
                best = min(visit(n.left, depth + 1), visit(n.right, depth + 1), key=lambda r: r[0])
            else:
                best = visit(n.left if x[n.dim] <= n.cut else n.right, depth + 1)
            rank, far, point = best
            s = sum(max(0.0, x[i] - n.high[i]) + max(0.0, n.low[i] - x[i]) for i in seen)
            p = s / (s + sum(n.high) - sum(n.low)) if s else 0.0
            return p / (depth + 1) + (1 - p) * rank, far, point

        return [visit(t.root, 0)[1:] for t in self.trees if t.root is not None]

    def impute(self, x: tuple, missing: list[int], shares: tuple[float, ...] = (0.5,)) -> list[tuple]:
        got = self.conditional(x, missing)
        if not got:
            return [x] * len(shares)
        out = []
        for share in shares:
            new = list(x)
            for i in missing:
                values = sorted(p[i] for _, p in got)
                new[i] = values[min(len(values) - 1, max(0, math.ceil(share * len(values)) - 1))]
            out.append(tuple(new))
        return out


@dataclass
class Result:
    """What is known of one row."""

    score: float = 0.0
    threshold: float = 0.0
    grade: float = 0.0
    correction: str = "NONE"
    ready: bool = False
    confidence: float = 0.0
    point: tuple | None = None
    expected_point: tuple | None = None
    relative: int = 0
    clock: int = 0
    high_region: bool = False
    start: bool = False
    attribution: list[float] = field(default_factory=list)
    past: list[float] | None = None
    expected: list[float] | None = None
    imputes: int = 0
    skipped: int = 0
    arm: int = 0
    delta_shift: list[float] | None = None


@dataclass
class Detector:
    """One stream's detector.

    base: values a row; shingle: rows a point.  STREAMING_IMPUTE fills missing
    values and gaps in time by `imputation` (RCF: from the model once it is
    ready, the last row repeated before; rows of a gap lie on the line to the
    row after it with LINEAR and equal that row with NEXT; for missing values
    of a row itself those two know no later row yet and repeat the last).  Every
    row of a gap is filled, however long it is; with `fast_forward` a gap of
    three shingles or more that the model would fill becomes a shingle of
    typical rows.  TIME_AUGMENTED adds the normalised time step as one more value.

    initial: rows that are kept back at the start; then their missing values
    are interpolated in time, the transforms' statistics start from all of
    them, and they are learnt at once (their results have score 0).  By default
    ten where statistics scale the values or time matters, else none.
    """

    base: int = 1
    shingle: int = 4
    trees: int = 30
    capacity: int = 64
    decay: float | None = None
    seed: int = 0
    mode: str = "STANDARD"
    transform: str = "NONE"
    weights: list[float] | None = None
    strategy: str = "EXPECTED_INVERSE_DEPTH"
    imputation: str = "RCF"
    fixed: float = 0.0
    auto_adjust: bool = False
    alert_once: bool = False
    z: float = 3.0
    rate: float = 0.01
    ignore_near: float = 0.0
    ignore_ratio: float = 0.0
    impute_fraction: float = 0.5
    accept: float = 1.0
    initial: int | None = None
    fast_forward: bool = False

    def __post_init__(self) -> None:
        for value, known, what in ((self.mode, MODES, "mode"), (self.strategy, STRATEGIES, "strategy"), (self.imputation, IMPUTATIONS, "imputation")):
            if value not in known:
                raise ValueError(f"unknown {what} {value}")
        if self.base < 1 or self.shingle < 1 or self.capacity < 2 or self.trees < 1:
            raise ValueError("base, shingle, trees and capacity must be positive")
        if self.initial is None:
            needs = self.transform in ("NORMALIZE", "NORMALIZE_DIFFERENCE", "SUBTRACT_MA") or self.mode != "STANDARD"
            self.initial = INITIAL_ROWS if needs else 0
        self.early: list[tuple[int, list[float | None]]] = []
        self.width = self.base + (self.mode == "TIME_AUGMENTED")
        decay = self.decay if self.decay is not None else 1 / (10 * self.capacity)
        self.forest = StreamForest(self.trees, self.capacity, decay, self.seed, self.accept)
        weights = self.weights or [1.0] * self.base
        self.transforms = [Transform(self.transform, w, 1 / self.capacity) for w in weights]
        if self.mode == "TIME_AUGMENTED":
            self.transforms.append(Transform("NORMALIZE", 1.0, 1 / self.capacity))
        self.steps = Deviation(1 / self.capacity)
        self.quality = Deviation(1 / self.capacity)
        self.by_depth = Thresholder(self.rate, z=self.z)
        self.by_distance = Thresholder(self.rate, z=self.z)
        self.window: list[list[float]] = []
        self.filled: list[bool] = []
        self.last_time: int | None = None
        self.last_values: list[float] | None = None
        self.last: Result | None = None
        self.significant: Result | None = None
        self.run = 0
        self.clock = 0
        self.foretold: list | None = None
        self.actual = [Deviation(0.1) for _ in range(self.width)]
        self.foreseen = [Deviation(0.1) for _ in range(self.width)]

    # -- input -------------------------------------------------------------------------------------

    def _fill(self, values: list[float | None]) -> Steps:
        missing = [i for i, v in enumerate(values) if v is None or v != v]
        if not missing:
            return [float(v) for v in values]
        out = [0.0 if i in missing else float(v) for i, v in enumerate(values)]
        before = self.last_values or [0.0] * len(values)
        if self.imputation == "RCF" and self.forest.ready and len(self.window) >= self.shingle - 1 and self.mode != "TIME_AUGMENTED":
            scaled = [t.forward(v) for t, v in zip(self.transforms, out, strict=False)]
            head = [v for row in (self.window[-(self.shingle - 1) :] if self.shingle > 1 else []) for v in row]
            at = [len(head) + i for i in missing]
            guess = (yield "impute", self.forest, tuple(head + scaled), at)[0]
            for i in missing:
                out[i] = self.transforms[i].inverse(guess[len(head) + i])
            return out
        for i in missing:
            out[i] = self.fixed if self.imputation == "FIXED_VALUES" else 0.0 if self.imputation == "ZERO" else before[i]
        return out

    def _start(self) -> Steps:
        """The rows kept back: interpolated, the statistics' first rows, learnt."""
        rows, self.early = self.early, []
        times = [t for t, _ in rows]
        missing = sum(v is None or v != v for _, own in rows for v in own)
        columns = [self._interpolated(times, [own[j] for _, own in rows]) for j in range(self.base)]
        if self.mode == "TIME_AUGMENTED":
            columns.append([0.0, *[float(b - a) for a, b in pairwise(times)]])
        for t, column in zip(self.transforms, columns, strict=True):
            for v in column:
                t.update(v)
            t.last = None
        for a, b in pairwise(times):
            self.steps.update(float(b - a))
        for time, *row in zip(times, *columns, strict=True):
            self.quality.update(1 - missing / (len(rows) * self.base))
            scaled = []
            for t, v in zip(self.transforms, row, strict=True):
                scaled.append(t.forward(v))
                t.last = v
            self.window.append(scaled)
            self.filled.append(False)
            del self.window[: -self.shingle], self.filled[: -self.shingle]
            if len(self.window) == self.shingle:
                yield "update", self.forest, tuple(v for r in self.window for v in r)
            self.last_time, self.last_values = time, row[: self.base]

    def _interpolated(self, times: list[int], values: list[float | None]) -> list[float]:
        """Missing values on the line between those around them, at the ends the nearest; ZERO and FIXED_VALUES fill in their own, and so do columns without any."""
        known = [i for i, v in enumerate(values) if v is not None and v == v]
        if not known or self.imputation in ("ZERO", "FIXED_VALUES"):
            default = 0.0 if self.imputation == "ZERO" else self.fixed
            return [float(values[i]) if i in known else default for i in range(len(values))]
        return np.interp(times, [times[i] for i in known], [float(values[i]) for i in known]).tolist()

    def _take(self, values: list[float], time: int, filled: bool) -> tuple | None:
        """Move the window on by one row; the point once the window is full."""
        row = list(values)
        if self.mode == "TIME_AUGMENTED":
            row.append(0.0 if self.last_time is None else float(time - self.last_time))
        scaled = [t.forward(v) for t, v in zip(self.transforms, row, strict=True)]
        self.window.append(scaled)
        self.filled.append(filled)
        del self.window[: -self.shingle], self.filled[: -self.shingle]
        for t, v in zip(self.transforms, row, strict=True):
            t.update(v)
        return tuple([v for r in self.window for v in r]) if len(self.window) == self.shingle else None

    def step(self, values: list[float | None], time: int) -> Result:
        """Score a row, then learn it."""
        return run(self.asking(values, time))

    def asking(self, values: list[float | None], time: int) -> Steps:
        """The step with what it asks of the forest for every row as questions, so that many keys' can be answered together."""
        out = Result()
        before = self.early[-1][0] if self.early else self.last_time
        if self.mode == "STREAMING_IMPUTE" and before is not None and time <= before:
            raise ValueError("rows must come in rising order of time")
        if self.clock < self.initial:
            self.clock += 1
            out.clock = self.clock
            self.early.append((time, list(values)))
            if self.clock == self.initial:
                yield from self._start()
            self.last = out
            return out
        learnt: list[tuple] = []  # rows that fill a gap are learnt with the row after it, once that is scored
        if self.mode == "STREAMING_IMPUTE" and self.last_time is not None:
            learnt = yield from self._fill_gap(values, time, out)
        share = sum(v is None or v != v for v in values) / len(values)
        self.quality.update(1.0 - share)
        row = yield from self._fill(values)
        past = self.last_values
        shift, scale = [t.shift for t in self.transforms], [t.scale for t in self.transforms]
        filled = share == 1
        point = self._take(row, time, filled)
        out.delta_shift = [t.shift - s for t, s in zip(self.transforms, shift, strict=True)]
        if self.last_time is not None:
            self.steps.update(float(time - self.last_time))
        self.last_time, self.last_values = time, row
        self.clock += 1
        out.clock = self.clock
        out.point = point
        if point is not None:
            depth = yield "score", self.forest, point
            distance = (yield "distance", self.forest, point) if self.strategy != "EXPECTED_INVERSE_DEPTH" else 0.0
            yield from self._detect(out, point, scale, shift, depth, distance)
            if out.grade > 0:
                self._explain(out, row, past)
        for x in learnt:
            yield "update", self.forest, x
        if point is not None and self._allowed():
            yield "update", self.forest, point
        n = self.forest.updates
        out.ready = self.forest.ready
        out.confidence = self.quality.mean * (1 - math.exp(-n * self.forest.decay)) if out.ready else 0.0
        self.last = out
        return out

    def _fill_gap(self, values: list[float | None], time: int, out: Result) -> Steps:
        """Move the window over the rows that a gap in time lacks; the points of them that may be learnt."""
        gap = time - self.last_time
        if self.steps.count <= 1 or not gap >= GAP_FACTOR * self.steps.mean > 0:
            return []
        missing = math.ceil(gap / self.steps.mean) - 1
        by_model = self.imputation == "RCF" and self.forest.ready
        learnt = []
        if by_model and self.fast_forward and missing >= FAST_FORWARD_SHINGLES * self.shingle:
            out.skipped, missing = missing, 0
            self.filled = [False] * len(self.filled)
            for _ in range(self.shingle - 1):
                typical = [t.inverse(0.0, t.last) for t in self.transforms[: self.base]]
                self.last_values = typical
                point = self._take(typical, time, False)
                learnt += [point] if point is not None and self._allowed() else []
        first, last = self.last_values, (yield from self._fill(values))
        for i in range(missing):
            part = (i + 1) / (missing + 1)
            if self.imputation == "LINEAR":
                row = [a + (b - a) * part for a, b in zip(first, last, strict=True)]
            else:
                row = last if self.imputation == "NEXT" else (yield from self._fill([None] * self.base))
            self.last_values = row
            point = self._take(row, time, True)
            learnt += [point] if point is not None and self._allowed() else []
        out.imputes = missing
        return learnt

    def _allowed(self) -> bool:
        """Whether the window may be learnt: less than `impute_fraction` of its rows are filled in."""
        return not any(self.filled) or sum(self.filled) < self.impute_fraction * self.shingle

    def pause(self, paused: bool = True) -> None:
        """Go on scoring without learning, or (False) learn again."""
        self.forest.paused = paused

    def reconfigure(self, **settings: object) -> None:
        """Change settings of a running detector: decay, strategy, auto_adjust, alert_once, ignore_near, ignore_ratio, impute_fraction, z, rate, fixed, fast_forward."""
        free = ("strategy", "auto_adjust", "alert_once", "ignore_near", "ignore_ratio", "impute_fraction", "fixed", "fast_forward")
        for name, value in settings.items():
            if name == "decay":
                self.forest.set_decay(value)
            elif name == "z":
                self.by_depth.z = self.by_distance.z = value
            elif name == "rate":
                for t in (self.by_depth, self.by_distance):
                    t.discount = t.primary.discount = t.secondary.discount = value
                    t.below.discount = value / 2
            elif name not in free or (name == "strategy" and value not in STRATEGIES):
                raise ValueError(f"{name} = {value} cannot be set on a running detector")
            setattr(self, name, value)

    # -- decision ----------------------------------------------------------------------------------

    def _parts(self, point: tuple, distance: bool) -> tuple:
        return ("distance_attribution" if distance else "attribution"), self.forest, point

    def _block(self, parts: list[float], start: int) -> int:
        """The row of the window (from `start` to 0, 0 the newest) that contributes most."""
        d = self.width * self.shingle
        best, at = -1.0, 0
        for k in range(start, 0):
            a = d + k * self.width
            s = sum(parts[i] + parts[d + i] for i in range(a, a + self.width))
            if s > best:
                best, at = s, k
        return at + 1

    def _expect(self, parts: list[float], start: int, point: tuple) -> tuple | None:
        """The point with the row's main contributors imputed; None where the blame is spread.

        A row of one value is imputed.  Of several, all count that bring a
        tenth of the row's sum or, if that is more, ATTRIBUTION_LEAST; there is
        no expected point where the largest brings less than a tenth, where
        more than MAX_ATTRIBUTORS count, or where they are more than half of
        the window.
        """
        return run(self._expected(parts, start, point))

    def _expected(self, parts: list[float], start: int, point: tuple) -> Steps:
        d, n = len(point), self.width
        own = [parts[i] + parts[d + i] for i in range(start, start + n)]
        if n == 1:
            taken = [start]
        else:
            tenth, ranked = 0.1 * sum(own), sorted(own, reverse=True)
            if ranked[0] < tenth:
                return None
            count = max(1, sum(v >= min(tenth, ATTRIBUTION_LEAST) for v in own))
            if count > MAX_ATTRIBUTORS:
                return None
            taken = []
            for i, v in enumerate(own):
                if len(taken) < count and v >= ranked[count - 1] and (not taken or v > tenth):
                    taken.append(start + i)
        return (yield "impute", self.forest, point, taken)[0] if len(taken) <= 0.5 * d else None

    def _triggers(self, now: list[float], ideal: list[float], difference: int, limit: float) -> bool:
        """Whether the rows since the last anomaly bring enough of their own."""
        d = self.width * self.shingle
        if difference >= d or self.significant is None:
            return True
        rest = sum(abs(now[i] - ideal[i]) + abs(now[d + i] - ideal[d + i]) for i in range(d - difference, d))
        return rest > DIFFERENTIAL * self.significant.score and rest * d / max(1, difference) > TRIGGER_RATIO * limit

    def _repaired(self, point: tuple, gap: int, scale: list[float]) -> tuple:
        """The window as it would be had the last anomaly been as expected.

        Its rows up to the anomaly are those expected.  Where steps are seen,
        the first row after it gets back what the anomaly took; a moving mean
        that it has shifted comes back with the decay, over two shingles.
        """
        s = self.significant
        if s is None or s.expected_point is None or gap < 1:
            return point
        n, d, out = len(point), self.width, list(point)
        if gap < self.shingle:
            out[: n - gap * d] = s.expected_point[gap * d :]
        if gap <= self.shingle and s.relative == 0:
            excess = [a - b for a, b in zip(s.point[-d:], s.expected_point[-d:], strict=True)]
            after = n - gap * d
            if self.transforms[0].differenced:
                for i in range(self.base):
                    out[after + i] += excess[i]
            if self.mode == "TIME_AUGMENTED":
                out[after + d - 1] += excess[-1]
        if gap < 2 * self.shingle and self.transform in ("NORMALIZE", "SUBTRACT_MA") and s.delta_shift:
            for i in range(self.base):
                back = s.delta_shift[i] * math.exp(-gap * self.transforms[i].decay) / scale[i]
                for k in range(min(gap, self.shingle)):
                    out[n - (k + 1) * d + i] += back
        return tuple(out)

    def _detect(self, out: Result, point: tuple, scale: list[float], shift: list[float], depth: float, distance: float) -> Steps:
        by_distance = self.strategy == "DISTANCE"
        score = distance if by_distance else depth
        out.score = score
        if score == 0:
            return
        if self.significant is None and self.last is not None and self.last.expected_point is not None:
            self.significant = self.last
        differenced = self.transforms[0].differenced
        if by_distance:
            limit, grade = self.by_distance.primary_both(score)
        else:
            limit, grade = self.by_depth.grade(score, self.transform != "NONE", differenced, self.shingle)
        out.threshold = limit
        last = self.last
        candidate = grade > 0 and last is not None and (score > last.score or last.score - last.threshold > score - max(limit, last.threshold))
        if grade > 0 and self.strategy == "MULTI_MODE":
            t, g = self.by_distance.primary_both(distance)
            if t > 0 and g == 0:
                grade, out.correction = 0.0, "MULTI_MODE"
        gap = self.clock - self.significant.clock if self.significant else self.shingle + 1
        if self.strategy == "MULTI_MODE_RECALL" and grade == 0 and gap >= self.shingle:
            limit, grade = self.by_distance.primary_both(distance)
            by_distance = grade > 0
        repaired = self._repaired(point, gap, scale)
        corrected = score
        if grade > 0:
            level = self._signal(repaired, scale, shift)
            grade *= level
            if level == 0:
                out.correction = "NOISE"
        parts: list[float] = []
        expected = None
        start = -min(gap, self.shingle)
        if grade > 0:
            out.high_region = True
            parts = yield self._parts(repaired, by_distance)
            if repaired != point:
                corrected = sum(parts)
                if corrected > limit:
                    k = self._block(parts, start)
                    guess = yield from self._expected(parts, len(point) + (k - 1) * self.width, repaired)
                    if guess is not None:
                        ideal = yield self._parts(guess, by_distance)
                        if not self._triggers(parts, ideal, gap * self.width, limit):
                            grade, out.correction = 0.0, "ANOMALY_IN_SHINGLE"
        if grade > 0:
            out.relative = 0 if self.shingle == 1 else self._block(parts, start)
            at = len(point) + (out.relative - 1) * self.width
            if self.auto_adjust and self._explained(point, repaired, at, scale):
                grade, out.correction = 0.0, "CONDITIONAL_FORECAST"
            else:
                expected = yield from self._expected(parts, at, repaired)
                if expected is not None:
                    if gap < self.shingle:
                        ideal = yield self._parts(expected, by_distance)
                        corrected = sum(ideal)
                        if not self._triggers(parts, ideal, gap * self.width, limit):
                            grade, out.correction = 0.0, "ANOMALY_IN_SHINGLE"
                    if grade > 0 and self._near(point, expected, at, scale):
                        grade, out.correction = 0.0, "FORECAST"
        if grade == 0:
            corrected = score
        if candidate and grade > 0:
            grade = self._drift(out, point, expected, grade, gap)
        out.grade = grade
        if grade > 0:
            out.expected_point = expected
            total = sum(parts)
            out.attribution = [p * score / total if total else 0.0 for p in parts]
            out.start = True
            self.run += 1
            if expected is not None:
                self.significant = out
        elif out.correction == "NONE":
            self.run = 0
            for d in (*self.actual, *self.foreseen):
                d.reset()
        elif self.run:
            self.run += 1
        before = last.score if last is not None else 0.0
        self.by_depth.observe(depth, corrected if not by_distance else depth, before)
        if self.strategy != "EXPECTED_INVERSE_DEPTH":
            self.by_distance.update(distance, distance - before if self.strategy == "DISTANCE" else 0.0)

    def _signal(self, point: tuple, scale: list[float], shift: list[float]) -> float:
        """0 for points that are all noise around their centre, else 1."""
        n = self.width
        return 1.0 if any(abs(v) * scale[i % n] > PRECISION * (1 + abs(shift[i % n])) for i, v in enumerate(point)) else 0.0

    def _explained(self, point: tuple, repaired: tuple, at: int, scale: list[float]) -> bool:
        """Whether enough trees hold a neighbour of the repaired point, none much farther than the others, whose row lies within the noise of the point's."""
        near = self.forest.near(repaired)
        if not near:
            return False
        mean = sum(d for d, _, _ in near) / len(near)
        noise = [NOISE_FACTOR * t.stats.step.deviation / s for t, s in zip(self.transforms, scale, strict=True)]
        close = sum(n for d, p, n in near if d < NEAR_FACTOR * mean and all(abs(p[at + i] - point[at + i]) <= v for i, v in enumerate(noise)))
        return close >= SUPPORT * self.trees

    def _near(self, point: tuple, expected: tuple, at: int, scale: list[float]) -> bool:
        """Whether the row lies within the stated or observed noise of what was expected."""
        for i in range(at, at + self.width):
            far = abs(point[i] - expected[i]) * scale[i % self.width]
            noise = NOISE_FACTOR * self.transforms[i % self.width].stats.step.deviation if self.transform != "NONE" else 0.0
            if far > max(self.ignore_near, self.ignore_ratio * abs(expected[i]) * scale[i % self.width], 0.1 * noise):
                return False
        return True

    def _drift(self, out: Result, point: tuple, expected: tuple | None, grade: float, gap: int) -> float:
        if self.auto_adjust:
            tail = point[-self.width :]
            for d, v in zip(self.actual, tail, strict=True):
                d.update(v)
            if expected is not None:
                for d, v in zip(self.foreseen, expected[-self.width :], strict=True):
                    d.update(v)
            settled = all(abs(d.mean - v) <= max(2 * d.deviation, 1e-9) for d, v in zip(self.actual, tail, strict=True))
            if self.run > RUN_ALLOWED and settled:
                out.correction = "DATA_DRIFT"
                return 0.0
        if self.alert_once and self.run > 0 and gap < self.shingle:
            out.correction = "ALERT_ONCE"
            return 0.0
        return grade

    def _explain(self, out: Result, row: list[float], past: list[float] | None) -> None:
        """Past and expected values of the row that is to blame, in input space."""
        out.past = row if out.relative == 0 else past or row
        if out.expected_point is not None:
            at = len(out.expected_point) + (out.relative - 1) * self.width
            before = past if out.relative == 0 else None
            out.expected = [t.inverse(out.expected_point[at + i], before[i] if before else None) for i, t in enumerate(self.transforms[: self.base])]

    # -- forecast ----------------------------------------------------------------------------------

    def extrapolate(self, horizon: int, shares: tuple[float, float, float] = (0.5, 0.1, 0.9)) -> list[list[tuple[float, float, float]]]:
        """For each step ahead and value: (median, lower, upper) in input space; empty until the model is ready."""
        return run(self.extrapolation(horizon, shares))

    def extrapolation(self, horizon: int, shares: tuple[float, float, float] = (0.5, 0.1, 0.9)) -> Steps:
        if not self.forest.ready or len(self.window) < self.shingle:
            return []
        flat = tuple([v for r in self.window for v in r])
        gap = self.clock - self.significant.clock if self.significant else self.shingle
        window = self._repaired(flat, gap, [t.scale for t in self.transforms]) if gap < self.shingle else flat
        steps: list[list[tuple]] = []
        rest, missing = (0.0,) * self.width, list(range(len(window) - self.width, len(window)))
        for _ in range(horizon):
            window = window[self.width :] + rest
            got = yield "impute", self.forest, window, missing, shares
            window = got[0]
            steps.append([tuple([g[i] for g in got]) for i in missing])
        self.foretold = [s[-1] for s in steps] if self.mode == "TIME_AUGMENTED" else None
        columns = []
        for j, t in enumerate(self.transforms[: self.base]):
            v, lo, hi = zip(*[(s[j][0], min(s[j]), max(s[j])) for s in steps], strict=True)
            columns.append(t.inverse_range(list(v), list(lo), list(hi)))
        return [list(x) for x in zip(*columns, strict=True)]

    def extrapolate_timed(self, horizon: int) -> list[tuple[list[tuple[float, float, float]], tuple[int, int, int] | None]]:
        """For each step ahead its values as extrapolate() gives them and its time (expected, earliest, latest).

        With TIME_AUGMENTED the times are forecast too, each counted on from
        the latest of the step before; with STREAMING_IMPUTE there are none;
        else steps are as long as they are on average, give or take 1.3
        deviations.
        """
        values = self.extrapolate(horizon)
        if not values or self.mode == "STREAMING_IMPUTE":
            return [(v, None) for v in values]
        out, at = [], self.last_time
        mean, far = self.steps.mean, TIME_FACTOR * self.steps.deviation
        for h, v in enumerate(values):
            if self.foretold is not None:
                t = self.transforms[-1]
                step, low, high = (max(0.0, t.inverse(x)) for x in self.foretold[h])
                now, early, late = (at + round(x) for x in (step, min(step, low, high), max(step, low, high)))
                at = late
            else:
                now, early, late = (at + round(x) for x in (mean, max(0.0, mean - far), mean + far))
                at = now
            out.append((v, (now, early, late)))
        return out
