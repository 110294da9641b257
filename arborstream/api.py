"""A plain Python model of one stream: score, update, impute, forecast, attribution, process."""

from __future__ import annotations

from .operators.detector import Detector, Result, StreamForest


class StreamModel:
    """A forest over a sliding window of the last `shingle` rows.

    score and attribution look at the window as it would be with the row;
    update moves it on.  None and NaN mark missing values for impute.
    """

    def __init__(self, dimensions: int, shingle: int = 1, trees: int = 100, capacity: int = 256, decay: float = 0.0, seed: int = 42, output_after: int | None = None):
        self.base, self.shingle = dimensions, shingle
        self.forest = StreamForest(trees, capacity, decay, seed)
        self.output_after = output_after
        self.window: list[float] = []

    @property
    def ready(self) -> bool:
        return self.forest.updates >= self.output_after if self.output_after is not None else self.forest.ready

    def _with(self, row) -> tuple | None:
        whole = [*self.window, *map(float, row)][-self.base * self.shingle :]
        return tuple(whole) if len(whole) == self.base * self.shingle else None

    def score(self, row) -> float:
        point = self._with(row)
        return self.forest.score(point) if point and self.ready else 0.0

    def get_attribution(self, row) -> dict[str, list[float]]:
        point = self._with(row)
        d = self.base * self.shingle
        parts = self.forest.attribution(point) if point and self.ready else [0.0] * (2 * d)
        return {"high": parts[:d], "low": parts[d:]}

    def update(self, row) -> None:
        if len(row) != self.base:
            raise ValueError(f"expected {self.base} values")
        point = self._with(row)
        self.window = [*self.window, *map(float, row)][-self.base * self.shingle :]
        if point:
            self.forest.update(point)

    def impute(self, row) -> list[float]:
        missing = [i for i, v in enumerate(row) if v is None or v != v]
        filled = [0.0 if i in missing else float(v) for i, v in enumerate(row)]
        point = self._with(filled)
        if not missing or point is None or not self.ready:
            return filled
        at = self.base * (self.shingle - 1)
        return list(self.forest.impute(point, [at + i for i in missing])[0][at:])

    def forecast(self, horizon: int) -> list[list[float]]:
        """Medians of the next rows."""
        out: list[list[float]] = []
        window = tuple(self.window)
        if len(window) < self.base * self.shingle or self.shingle < 2 or not self.ready:
            return out
        for _ in range(horizon):
            moved = window[self.base :] + (0.0,) * self.base
            window = self.forest.impute(moved, list(range(len(moved) - self.base, len(moved))))[0]
            out.append(list(window[-self.base :]))
        return out


class ThresholdedModel:
    """process(row, time) gives the detector's result of the row."""

    def __init__(self, **settings):
        self.detector = Detector(**settings)

    def process(self, row, time: int) -> Result:
        return self.detector.step(list(row), time)
