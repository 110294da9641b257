"""Many series over a few shared models: each series picks a model by a bandit."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from itertools import islice

from .detector import Result, StreamForest
from .deviation import Deviation
from .thresholder import Thresholder
from .versions import Nodes, VersionedForest


@dataclass
class Bandit:
    """Pulls the arm with the least discounted loss, now and then another; all arms start anew together."""

    arms: int
    explore: float = 0.05
    discount: float = 0.05
    seed: int = 0
    reset_after: int = 1000
    pulls: int = 0
    losses: list[Deviation] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)
        self.losses = [Deviation(self.discount) for _ in range(self.arms)]

    def choose(self) -> int:
        self.pulls += 1
        if self.pulls % self.reset_after == 0:
            for d in self.losses:
                d.reset()
        fresh = [i for i, d in enumerate(self.losses) if d.count == 0]
        if fresh:
            return fresh[0]
        if self.rng.random() < self.explore:
            return self.rng.randrange(self.arms)
        return min(range(self.arms), key=lambda i: self.losses[i].mean)

    def learn(self, arm: int, loss: float) -> None:
        self.losses[arm].update(loss)


@dataclass
class SeriesState:
    window: list[float] = field(default_factory=list)
    thresholder: Thresholder = field(default_factory=lambda: Thresholder(0.01))
    bandit: Bandit | None = None
    last: float = 0.0


@dataclass
class MultiSeries:
    """step(id, value) scores a row of any series by one of `models` shared forests and offers the row to it."""

    models: int = 2
    shingle: int = 4
    trees: int = 20
    capacity: int = 64
    update_share: float = 1.0
    seed: int = 0

    def __post_init__(self) -> None:
        self.forests = [StreamForest(self.trees, self.capacity, 1 / (10 * self.capacity), self.seed + i) for i in range(self.models)]
        self.series: dict = {}
        self.rng = random.Random(self.seed)

    def step(self, key, value: float) -> Result:
        """Score a row, then learn it."""
        out = self._score(key, value)
        self._learn(out)
        return out

    def process(self, batch: dict) -> dict:
        """Results by id of a micro-batch (id: value): all rows are scored by the models as they are at its start, then all are learnt."""
        found = {key: self._score(key, value) for key, value in batch.items()}
        for out in found.values():
            self._learn(out)
        return found

    def _learn(self, out: Result) -> None:
        if out.point is not None and self.rng.random() < self.update_share:
            self.forests[out.arm].update(out.point)

    def _score(self, key, value: float) -> Result:
        s, out = self._chosen(key, value)
        if out.point is not None:
            self._judged(s, out, self.forests[out.arm].score(out.point))
        return out

    def _chosen(self, key, value: float) -> tuple[SeriesState, Result]:
        """A row's series, with its point and forest, if it has a point yet."""
        s = self.series.get(key)
        if s is None:
            s = self.series[key] = SeriesState(bandit=Bandit(self.models, seed=hash(str(key)) & 0xFFFF if isinstance(key, str) else int(key)))
        s.window.append(value)
        del s.window[: -self.shingle]
        out = Result()
        if len(s.window) == self.shingle:
            out.point, out.arm = tuple(s.window), s.bandit.choose()
            out.ready = self.forests[out.arm].ready
        return s, out

    def _judged(self, s: SeriesState, out: Result, score: float) -> None:
        out.score = score
        if score > 0:
            out.threshold, out.grade = s.thresholder.grade(score, shingle=self.shingle)
            s.thresholder.observe(score, score, s.last)
            s.bandit.learn(out.arm, score)
            s.last = score


#: Rows of a ManySeries that are scored at once, and nodes beyond which those of no tree are dropped.
WINDOW, NODES = 256, 65_536


@dataclass
class ManySeries(MultiSeries):
    """A MultiSeries that is given many rows at once, for a whole table: results are those of a step a row, to the last bit.

    What a forest learns does not hang on scores, and which forest a series takes hangs on that series alone. So
    rows are learnt in order up to the next row of a series that is among them, and then scored
    together, each by the trees as they were before it.
    """

    def __post_init__(self) -> None:
        super().__post_init__()
        self.nodes = Nodes(self.capacity)
        self.forests = [VersionedForest(self.nodes, self.trees, self.capacity, f.decay, self.seed + i) for i, f in enumerate(self.forests)]

    def steps(self, rows: list[tuple]) -> list[Result]:
        """Results of (id, value) rows, in order."""
        found: list[Result] = []
        seen: set = set()
        asked: list[tuple[SeriesState, Result, list[int]]] = []

        def judge() -> None:
            scores = self.nodes.scores([out.point for _, out, _ in asked], [roots for _, _, roots in asked])
            for (s, out, _), score in zip(asked, scores, strict=True):
                self._judged(s, out, score)
            seen.clear()
            asked.clear()
            if len(self.nodes.nodes) > NODES:
                roots = iter(self.nodes.kept([n for f in self.forests for n in f.roots]))
                for f in self.forests:
                    f.roots = list(islice(roots, self.trees))

        for key, value in rows:
            if key in seen or len(seen) >= WINDOW:
                judge()
            s, out = self._chosen(key, value)
            found.append(out)
            if out.ready:
                seen.add(key)
                asked.append((s, out, self.forests[out.arm].roots[:]))
            self._learn(out)
        judge()
        return found
