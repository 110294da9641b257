"""Predictive forest: transforms in front of a forest, with queries in input space."""

from __future__ import annotations

from dataclasses import dataclass

from .cluster import summarize
from .detector import Steps, StreamForest, run
from .transforms import Transform


@dataclass
class PredictiveForest:
    """update(row) learns; predict, score, attribution, density and neighbours answer for rows not learnt."""

    dimensions: int
    trees: int = 50
    capacity: int = 256
    transform: str = "NONE"
    decay: float | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        self.forest = StreamForest(self.trees, self.capacity, self.decay or 1 / (10 * self.capacity), self.seed)
        self.transforms = [Transform(self.transform, 1.0, 1 / self.capacity) for _ in range(self.dimensions)]

    def _in(self, row) -> tuple:
        return tuple(t.forward(float(v)) for t, v in zip(self.transforms, row, strict=True))

    def update(self, row) -> None:
        run(self.updates(row))

    def updates(self, row) -> Steps:
        """update() by questions to the forest."""
        yield "update", self.forest, self._in(row)
        for t, v in zip(self.transforms, row, strict=True):
            t.update(float(v))

    def predict(self, row, missing: list[int], shares: tuple[float, ...] = (0.5, 0.1, 0.9)) -> list[list[float]]:
        """The row with its missing values at each percentile."""
        return run(self.predictions(row, missing, shares))

    def predictions(self, row, missing: list[int], shares: tuple[float, ...] = (0.5, 0.1, 0.9)) -> Steps:
        """predict() by questions to the forest."""
        filled = self._in([0.0 if i in missing else v for i, v in enumerate(row)])
        out = []
        for got in (yield "impute", self.forest, filled, missing, shares):
            out.append([self.transforms[i].inverse(got[i]) if i in missing else row[i] for i in range(self.dimensions)])
        return out

    def neighbour_summary(self, row, missing: list[int], most: int = 5) -> dict:
        """Summary of the samples that fit the observed values."""
        import numpy as np

        filled = self._in([0.0 if i in missing else v for i, v in enumerate(row)])
        points = [[self.transforms[i].inverse(p[i]) for i in range(self.dimensions)] for _, p in self.forest.conditional(filled, missing)]
        return summarize(np.array(points), most=most)

    def score(self, row) -> float:
        return self.forest.score(self._in(row))

    def attribution(self, row) -> list[float]:
        return self.forest.attribution(self._in(row))

    def distance_attribution(self, row) -> list[float]:
        return self.forest.distance_attribution(self._in(row))

    def density(self, row) -> float:
        """Interpolated density of the samples, with their mass."""
        return self.forest.density(self._in(row))

    def directional_density(self, row) -> list[float]:
        """Its parts above (first half) and below in each dimension."""
        return self.forest.directional_density(self._in(row))
