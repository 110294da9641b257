"""Stream transforms and their inverses.

Running statistics are those of the rows before the current one, so a value
never explains itself.  `statistics` and `transformed` are the columns of whole
tables, by slices of built-in windows; `Stats` and `Transform` are the same
rules for a detector that takes a row at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .deviation import Deviation
from .slices import Sequences, discounted, previous

NONE, WEIGHTED, SUBTRACT_MA, NORMALIZE, DIFFERENCE, NORMALIZE_DIFFERENCE = METHODS = (
    "NONE",
    "WEIGHTED",
    "SUBTRACT_MA",
    "NORMALIZE",
    "DIFFERENCE",
    "NORMALIZE_DIFFERENCE",
)
CLIP = 100.0
#: Discount of the statistics of statistics, relative to the transform's own.
SLOW = 0.1


@dataclass
class Stats:
    """Of one input: its value, its step, and slow averages of the value's deviation and the step's mean and deviation."""

    decay: float
    value: Deviation = field(init=False)
    step: Deviation = field(init=False)
    spread: Deviation = field(init=False)
    drift: Deviation = field(init=False)
    step_spread: Deviation = field(init=False)

    def __post_init__(self) -> None:
        self.value, self.step, self.spread = Deviation(self.decay), Deviation(self.decay), Deviation(self.decay)
        self.drift, self.step_spread = Deviation(SLOW * self.decay), Deviation(SLOW * self.decay)

    def update(self, x: float, before: float | None, missing: bool = False) -> None:
        if not missing:
            self.value.update(x)
            self.spread.update(self.value.deviation)
        self.step.update(0.0 if before is None or self.step.count == 0 else x - before)
        self.drift.update(self.step.mean)
        self.step_spread.update(self.step.deviation)


@dataclass
class Transform:
    """One input's transform: forward, inverse and the statistics between."""

    method: str = NONE
    weight: float = 1.0
    decay: float = 1 / 256
    clip: float = CLIP
    last: float | None = None
    stats: Stats = field(init=False)

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown transform {self.method}")
        self.stats = Stats(self.decay)

    @property
    def differenced(self) -> bool:
        return self.method in (DIFFERENCE, NORMALIZE_DIFFERENCE)

    @property
    def shift(self) -> float:
        if self.method in (SUBTRACT_MA, NORMALIZE):
            return self.stats.value.mean
        return self.stats.step.mean if self.method == NORMALIZE_DIFFERENCE else 0.0

    @property
    def scale(self) -> float:
        if self.method == NORMALIZE:
            return abs(self.stats.spread.mean) + 1.0
        return self.stats.step.deviation + 1.0 if self.method == NORMALIZE_DIFFERENCE else 1.0

    @property
    def drift(self) -> float:
        return self.stats.drift.mean if self.method in (SUBTRACT_MA, NORMALIZE) else 0.0

    def forward(self, x: float) -> float:
        if self.differenced:
            x = 0.0 if self.last is None else x - self.last
        y = (x - self.shift) / self.scale
        if self.method in (NORMALIZE, NORMALIZE_DIFFERENCE):
            y = max(-self.clip, min(self.clip, y))
        return self.weight * y

    def inverse(self, y: float, last: float | None = None) -> float:
        x = (y / self.weight * self.scale if self.weight else 0.0) + self.shift
        return x + (last if last is not None else self.last or 0.0) if self.differenced else x

    def inverse_range(self, values: list[float], lower: list[float], upper: list[float]) -> list[tuple[float, float, float]]:
        """Forecast steps back in input space; differenced forecasts add up step by step."""
        out, last = [], self.last or 0.0
        k = self.scale / self.weight if self.weight else 0.0
        for i, (v, lo, hi) in enumerate(zip(values, lower, upper, strict=True)):
            base = self.shift + (last if self.differenced else i * self.drift)
            value = v * k + base
            out.append((value, min(value, lo * k + base), max(value, hi * k + base)))
            last = value
        return out

    def update(self, x: float, missing: bool = False) -> None:
        self.stats.update(x, self.last, missing)
        self.last = x


#: Statistics that forward transforms need.
_NEEDED = {SUBTRACT_MA: {"value"}, NORMALIZE: {"value", "spread"}, DIFFERENCE: set(), NORMALIZE_DIFFERENCE: {"step"}}


def statistics(seq: Sequences, column: str, decay: float, needed: set[str] | None = None) -> Sequences:
    """Add `before` (the key's last value), `step`, and mean and deviation of value, step, spread, drift and step_spread (or those needed), as `slices.discounted` names them."""
    rows, slow = seq, SLOW * decay
    if needed is None or not needed or "step" in needed:
        rows = previous(rows, {"before": column})
        rows = rows.add(step=F.coalesce(F.col(column) - F.col("before"), F.lit(0.0)))
    first = {"value": (column, decay), "step": ("step", decay)}
    second = {"spread": ("value_deviation", decay), "drift": ("step_mean", slow), "step_spread": ("step_deviation", slow)}
    for level in (first, second):
        own = {name: x for name, x in level.items() if needed is None or name in needed}
        rows = discounted(rows, own) if own else rows
    return rows


def shift_and_scale(method: str) -> tuple[Column, Column]:
    """What a row's value is moved and scaled by, from the statistics before it."""
    if method in (SUBTRACT_MA, NORMALIZE):
        return F.col("before_value_mean"), F.abs("before_spread_mean") + 1.0 if method == NORMALIZE else F.lit(1.0)
    if method == NORMALIZE_DIFFERENCE:
        return F.col("before_step_mean"), F.col("before_step_deviation") + 1.0
    return F.lit(0.0), F.lit(1.0)


def forward(method: str, column: str, weight: float = 1.0, clip: float = CLIP) -> Column:
    """The transformed value of a row of `statistics`."""
    if method not in METHODS:
        raise ValueError(f"unknown transform {method}")
    shift, scale = shift_and_scale(method)
    x = F.col("step") if method in (DIFFERENCE, NORMALIZE_DIFFERENCE) else F.col(column)
    y = (x - shift) / scale
    if method in (NORMALIZE, NORMALIZE_DIFFERENCE):
        y = F.greatest(F.lit(-clip), F.least(F.lit(clip), y))
    return weight * y


def inverse(method: str, y: Column, weight: float = 1.0) -> Column:
    """The value that a row of `statistics` is transformed from; differences add to the value before."""
    shift, scale = shift_and_scale(method)
    x = y / weight * scale + shift
    return x + F.coalesce("before", F.lit(0.0)) if method in (DIFFERENCE, NORMALIZE_DIFFERENCE) else x


def transformed(seq: Sequences, column: str, method: str, new: str = "y", weight: float = 1.0, decay: float = 1 / 256, clip: float = CLIP) -> Sequences:
    """Add the transformed column; only the statistics that the method needs are made."""
    y = forward(method, column, weight, clip).alias(new)
    rows = seq if method in (NONE, WEIGHTED) else statistics(seq, column, decay, _NEEDED[method])
    return replace(rows, rows=rows.rows.select(*seq.rows.columns, y))
