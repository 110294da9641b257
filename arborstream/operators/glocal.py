"""Global-local detection: items of any kind against clusters of a reservoir of earlier ones."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .cluster import Cluster, Distance, cluster, line, many_on_line
from .detector import Steps, run
from .thresholder import Thresholder

#: Representatives lighter than this share of all weight are not looked at.
IGNORE_BELOW = 0.005
SCORE_CAP = 10.0


@dataclass
class Reservoir:
    """A time-decayed weighted sample of any objects: the smallest keys stay."""

    capacity: int
    decay: float
    seed: int = 0
    items: list[tuple[float, Any, float]] = field(default_factory=list)
    count: int = 0

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)

    def offer(self, item: Any, weight: float = 1.0) -> None:
        self.count += 1
        if weight <= 0:
            return
        key = math.log(-math.log(max(self.rng.random(), 1e-300)) / weight) - self.count * self.decay
        if len(self.items) >= self.capacity:
            keys = [i[0] for i in self.items]
            most = max(keys)
            if key >= most:
                return
            self.items.pop(keys.index(most))
        self.items.append((key, item, weight))

    @classmethod
    def merged(cls, first: Reservoir, second: Reservoir, capacity: int, seed: int = 0) -> Reservoir:
        """The sample of both streams: keys are brought to the same time, the smallest stay."""
        out = cls(capacity, first.decay, seed)
        out.count = max(first.count, second.count)
        pool = [(k + r.count * r.decay - out.count * r.decay, x, w) for r in (first, second) for k, x, w in r.items]
        out.items = sorted(pool, key=lambda i: i[0])[:capacity]
        return out


@dataclass
class GlobalLocal:
    """step(item) gives score, threshold, grade and the representatives near it with their shares."""

    distance: Distance
    capacity: int = 256
    decay: float | None = None
    clusters_most: int = 10
    representatives: int = 3
    shrinkage: float = 0.1
    recluster_after: int | None = None
    z: float = 3.0
    seed: int = 0

    def __post_init__(self) -> None:
        self.sample = Reservoir(self.capacity, 1 / (10 * self.capacity) if self.decay is None else self.decay, self.seed)
        self.thresholder = Thresholder(1 / (10 * self.capacity), z=self.z)
        self.clusters: list[Cluster] = []
        self.last_clustered = 0
        self.last_mean = 1.0
        self.wait = self.recluster_after or self.capacity // 2

    def _recluster(self) -> Steps:
        if self.sample.count <= self.last_clustered + self.wait:
            return
        mean = self.thresholder.primary.mean
        if abs(mean - self.last_mean) > 0.1 or mean > 1.7 or self.sample.count > self.last_clustered + 20 * self.wait:
            self.last_clustered, self.last_mean = self.sample.count, mean
            items = [(x, w) for _, x, w in self.sample.items]
            settings = (self.clusters_most, self.representatives, self.shrinkage)
            # the numbers of many keys are clustered together; a seed matters only where items are drawn
            alike = self.distance is line and self.representatives > 1 and len(items) <= 4 * self.clusters_most
            self.clusters = yield ("clustered" if alike else "clustered_alone"), self, items, settings

    def clustered(self, items: list[tuple], settings: tuple) -> list[Cluster]:
        return self.clustered_together([self], [items], settings)[0]

    @staticmethod
    def clustered_together(_: list[GlobalLocal], items: list[list[tuple]], settings: tuple) -> list[list[Cluster]]:
        return many_on_line(items, *settings)

    def clustered_alone(self, items: list[tuple], settings: tuple) -> list[Cluster]:
        most, representatives, shrinkage = settings
        return cluster(items, most, self.distance, representatives=representatives, shrinkage=shrinkage, seed=self.seed)

    def candidates(self, item: Any, local: Distance | None = None, occlusion: bool = True) -> list[tuple[Any, float]]:
        """(representative, distance over its cluster's radius), nearest first; with `occlusion`, none that a nearer one hides."""
        d = local or self.distance
        total = sum(c.weight for c in self.clusters)
        near = []
        for c in self.clusters:
            reps = [(d(item, r), i, r) for i, (r, w) in enumerate(c.representatives) if w > IGNORE_BELOW * total]
            if reps:
                far, _, r = min(reps, key=lambda x: x[:2])
                near.append((far, len(near), r, c.radius))
        near.sort(key=lambda x: x[:2])
        if near and near[0][0] == 0:
            return [(near[0][2], 0.0)]
        kept: list[tuple] = []
        for far, i, r, radius in near:
            hidden = any((between := d(k[2], r)) < far and far > math.sqrt(k[0] ** 2 + between**2) for k in kept) if occlusion else False
            if not hidden:
                kept.append((far, i, r, radius))
        measure: Callable[[tuple], float] = lambda k: (self.distance(item, k[2]) if local else k[0]) / k[3] if k[3] > 0 else math.inf
        return [(k[2], measure(k)) for k in kept]

    def step(self, item: Any, weight: float = 1.0, local: Distance | None = None, occlusion: bool = True) -> dict:
        return run(self.asking(item, weight, local, occlusion))

    def asking(self, item: Any, weight: float = 1.0, local: Distance | None = None, occlusion: bool = True) -> Steps:
        """The step with the clusters that it needs as a question, so that many keys' can be made together."""
        if weight < 0:
            raise ValueError("a weight cannot be negative")
        yield from self._recluster()
        out: dict[str, Any] = {"score": 0.0, "threshold": self.thresholder.primary_threshold(), "grade": 0.0, "representatives": []}
        if self.clusters:
            found = self.candidates(item, local, occlusion)
            score = min((m for _, m in found), default=math.inf)
            out["score"] = min(score, SCORE_CAP)
            soft = [0.0 if m == math.inf else math.exp(-m * m) for _, m in found]
            total = sum(soft)
            out["representatives"] = [(r, s / total if total > 0 else 1 / len(found)) for (r, _), s in zip(found, soft, strict=True)]
            out["grade"] = self.thresholder.primary_grade(out["score"])
            # scores count once there are clusters: no zeros from before
            self.thresholder.update(out["score"], min(out["score"], self.z))
        self.sample.offer(item, weight)
        return out

    @classmethod
    def merged(cls, first: GlobalLocal, second: GlobalLocal) -> GlobalLocal:
        """A detector whose reservoir is the union of two; it clusters anew."""
        out = cls(first.distance, first.capacity, first.decay, first.clusters_most, first.representatives, first.shrinkage, first.recluster_after, first.z, first.seed)
        out.sample = Reservoir.merged(first.sample, second.sample, first.capacity, first.seed)
        out.last_clustered = out.sample.count
        out.clusters = cluster([(x, w) for _, x, w in out.sample.items], out.clusters_most, out.distance, representatives=out.representatives, shrinkage=out.shrinkage)
        return out
