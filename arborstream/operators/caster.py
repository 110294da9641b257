"""Calibrated forecasts: detection, forecasts, and what past forecasts have missed by."""

from __future__ import annotations

from dataclasses import dataclass, field

from .detector import Detector, Result, Steps, StreamForest, run
from .deviation import Deviation

CALIBRATIONS = ("NONE", "MINIMAL", "SIMPLE")
#: Errors times this make an interval.
WIDEN = 1.3
#: Of the model of errors.
TREES, CAPACITY = 20, 64


@dataclass
class ErrorTracker:
    """For each step and value: hits of the interval, and errors above and below."""

    horizon: int
    width: int
    decay: float
    percentile: float = 0.1
    learned: bool = False
    past: list[list] = field(default_factory=list)
    seen: int = 0

    def __post_init__(self) -> None:
        make = lambda: [[Deviation(self.decay) for _ in range(self.width)] for _ in range(self.horizon)]
        self.hits, self.above, self.below = make(), make(), make()
        self.data = [0.0] * self.width
        self.recent: list[float] = [0.0] * (2 * self.width)
        self.model = StreamForest(TREES, CAPACITY, 1 / (10 * CAPACITY), 5) if self.learned else None

    @staticmethod
    def shape(width: int) -> tuple[int, int, int]:
        """Trees, capacity and width of the model of errors: the last two rows, step, value and error."""
        return TREES, CAPACITY, 2 * width + 3

    def actual(self, values: list[float], spread: list[float]) -> None:
        """Compare a row with each forecast that was made of it: the newest was one step ahead."""
        run(self.compared(values, spread))

    def compared(self, values: list[float], spread: list[float]) -> Steps:
        self.data = spread
        self.recent = self.recent[self.width :] + list(values)
        for h, forecast in enumerate(reversed(self.past)):
            for j, x in enumerate(values):
                v, lo, hi = forecast[h][j]
                self.hits[h][j].update(1.0 if lo <= x <= hi else 0.0)
                e = x - v
                self.above[h][j].update(max(0.0, e))
                self.below[h][j].update(min(0.0, e))
                if self.model is not None:
                    yield "update", self.model, (*self.recent, float(h), float(j), e)

    def forecast(self, steps: list) -> None:
        self.seen += 1
        self.past.append(steps)
        del self.past[: -self.horizon]

    def rmse(self, h: int, j: int) -> tuple[float, float]:
        """High and low error; the data's own deviation until forecasts have been seen ten horizons long, blended up to twenty."""
        a = self.seen / (10 * self.horizon)
        own = self.data[j]
        if a < 1:
            return own, own
        high, low = self.above[h][j].deviation, self.below[h][j].deviation
        k = max(0.0, 2 - a)
        return k * own + (1 - k) * high, k * own + (1 - k) * low

    def distribution(self, h: int, j: int) -> tuple[float, float, float]:
        """Mean, lower and upper error."""
        return self.widened(h, j, run(self.learnt(h, j)))

    def learnt(self, h: int, j: int) -> Steps:
        """How far the model of past errors sees them above and below; None without it."""
        if self.model is None or not self.model.ready:
            return None
        query = (*self.recent, float(h), float(j), 0.0)
        lo, mid, hi = (p[-1] for p in (yield "impute", self.model, query, [len(query) - 1], (0.3, 0.5, 0.7)))
        return hi - mid, mid - lo

    def widened(self, h: int, j: int, learnt: tuple[float, float] | None) -> tuple[float, float, float]:
        high, low = self.rmse(h, j)
        if learnt is not None:
            high, low = max(high, learnt[0]), max(low, learnt[1])
        precision = self.hits[h][j].mean
        k = max(1.0, 1.0 / (precision + 0.1)) if precision < 1 - self.percentile else 1.0
        mean = self.above[h][j].mean + self.below[h][j].mean
        return mean, mean - WIDEN * k * low, mean + WIDEN * k * high


@dataclass
class Caster:
    """A detector whose forecasts are calibrated; missing values are not allowed."""

    detector: Detector
    horizon: int
    calibration: str = "SIMPLE"
    error_horizon: int | None = None
    lower_limit: float = float("-inf")
    upper_limit: float = float("inf")
    learned: bool = False

    def __post_init__(self) -> None:
        if self.calibration not in CALIBRATIONS:
            raise ValueError(f"unknown calibration {self.calibration}")
        if self.horizon < 1:
            raise ValueError("the horizon must be positive")
        span = self.error_horizon or max(self.detector.capacity, 2 * self.horizon)
        self.errors = ErrorTracker(self.horizon, self.detector.base, 1 / span, learned=self.learned)

    def step(self, values: list[float], time: int) -> tuple[Result, list]:
        """The row's result, and the calibrated forecast of the next rows (empty until ready)."""
        return run(self.asking(values, time))[:2]

    def asking(self, values: list[float], time: int) -> Steps:
        """The same by questions to the forests, with what the model of errors has given for each step and value."""
        if any(v is None or v != v for v in values):
            raise ValueError("missing values cannot be forecast from")
        result = yield from self.detector.asking(values, time)
        spread = [t.stats.value.deviation for t in self.detector.transforms[: self.detector.base]]
        yield from self.errors.compared(values, spread)
        steps = yield from self.detector.extrapolation(self.horizon)
        if not steps:
            return result, [], []
        shown, learnt = [], []
        model = self.errors.model
        asks = model is not None and model.ready
        for h, row in enumerate(steps):
            own = [None] * len(row)
            if asks:
                for j in range(len(row)):
                    own[j] = yield from self.errors.learnt(h, j)
            learnt.append(own)
            shown.append([self.calibrated(h, j, s, own[j]) for j, s in enumerate(row)])
        self.errors.forecast(shown)
        return result, shown, learnt

    def calibrated(self, h: int, j: int, step: tuple[float, float, float], learnt: tuple[float, float] | None = None) -> tuple[float, float, float]:
        v, lo, hi = step
        if self.calibration == "NONE":
            return step
        clamp = lambda x: min(max(x, self.lower_limit), self.upper_limit)
        mean, low, high = self.errors.widened(h, j, learnt)
        v = clamp(v + mean if self.calibration == "SIMPLE" else v)
        return v, clamp(min(lo, v + low)), clamp(max(hi, v + high))
