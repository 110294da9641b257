"""Thresholds and grades of a score sequence."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deviation import Deviation
from .slices import Sequences, discounted, previous

# Fixed values of the decision rules.
Z_FACTOR, MIN_Z_FACTOR = 3.0, 2.0
ABSOLUTE_THRESHOLD, INITIAL_THRESHOLD, ADJUSTMENT_THRESHOLD = 0.8, 1.5, 0.9
MINIMUM_SCORES, SCORE_DIFFERENCING = 10, 0.5
SCORE_CAP = 2.0


@dataclass
class Thresholder:
    """Primary: the scores; secondary: their changes; below: how far scores fall under the mean."""

    discount: float = 1 / 2560
    z: float = Z_FACTOR
    absolute: float = ABSOLUTE_THRESHOLD
    initial: float = INITIAL_THRESHOLD
    minimum: int = MINIMUM_SCORES
    differencing: float = SCORE_DIFFERENCING
    auto: bool = True
    count: int = 0
    primary: Deviation = field(init=False)
    secondary: Deviation = field(init=False)
    below: Deviation = field(init=False)

    def __post_init__(self) -> None:
        self.primary, self.secondary, self.below = Deviation(self.discount), Deviation(self.discount), Deviation(self.discount / 2)

    @classmethod
    def seeded(cls, scores: list[float], rate: float) -> Thresholder:
        """Start from known scores, which count without discount; later ones are discounted by `rate`."""
        t = cls(discount=0.0)
        for s in scores:
            t.update(s, s)
        t.primary.discount = t.secondary.discount = rate
        t.below.discount = 0.1 * rate
        return t

    @property
    def ready(self) -> bool:
        return self.count >= self.minimum and (self.differencing == 0 or self.secondary.count >= self.minimum)

    def primary_threshold(self) -> float:
        return self.primary.mean + self.z * self.primary.deviation if self.ready else 0.0

    def primary_grade(self, score: float) -> float:
        if not self.ready:
            return 0.0
        if self.primary.deviation == 0:
            return 1.0 if score > self.primary.mean + 1e-10 else 0.0
        return max(0.0, (min(2 * self.z, (score - self.primary.mean) / self.primary.deviation) - self.z) / self.z)

    def primary_both(self, score: float) -> tuple[float, float]:
        if not self.ready or score <= 0:
            return 0.0, 0.0
        t = self.primary_threshold()
        return t, self.primary_grade(score) if 0 < t < score else 0.0

    def grade(self, score: float, transformed: bool = False, differenced: bool = False, shingle: int = 1) -> tuple[float, float]:
        """Threshold and grade (0 to 1) of a score."""
        mean, spread = self.primary.mean, self.primary.deviation
        warm = min(1.0, max(0.0, (self.count - self.minimum) / self.minimum))
        z = max(MIN_Z_FACTOR, self.z * mean / ADJUSTMENT_THRESHOLD if transformed and mean < ADJUSTMENT_THRESHOLD else self.z)
        fall = math.sqrt(2.0) * self.below.deviation
        if shingle == 1 and not differenced:
            long_term = min(fall, spread)
        else:
            change = self.secondary.deviation
            long_term = self.differencing * min(spread, max(change, fall)) + (1 - self.differencing) * change
        width = (z - 1) * long_term + spread
        floor = self.absolute
        if self.auto and warm >= 1 and mean < ADJUSTMENT_THRESHOLD:
            floor *= mean / ADJUSTMENT_THRESHOLD
        ready = self.ready
        limit = max(floor, warm * (mean + width) + (1 - warm) * self.initial) if ready else max(self.initial, floor)
        if score < limit or limit <= 0:
            return limit, 0.0
        if ready:
            surprise = max(0.0, min(z, (score - limit) * z / width) / z) if width > 0 else 2.0
        else:
            surprise = min(1.0, max(0.0, (score - self.absolute) / self.absolute))
        level = min(1.0, math.floor(surprise * 20) / 16)
        return (score, 0.0) if level == 0 else (limit, level)

    def update(self, score: float, change: float) -> None:
        if self.primary.mean > score:
            self.below.update(self.primary.mean - score)
        self.primary.update(score)
        self.secondary.update(change)
        self.count += 1

    def observe(self, score: float, corrected: float, last: float) -> None:
        """Update with a capped score and the change from the last score."""
        self.update(min(score, SCORE_CAP), corrected - last)


def primary(score: Column, count: Column, mean: Column, deviation: Column, z: float = Z_FACTOR, minimum: int = MINIMUM_SCORES) -> tuple[Column, Column]:
    """Primary threshold and grade of a score, from the statistics before it."""
    flat = F.when(score > mean + 1e-10, 1.0).otherwise(0.0)
    grade = F.greatest(F.lit(0.0), (F.least(F.lit(2 * z), (score - mean) / F.nullif(deviation, F.lit(0.0))) - z) / z)
    ready = count >= minimum
    return F.when(ready, mean + z * deviation).otherwise(0.0), F.when(~ready, 0.0).when(deviation == 0, flat).otherwise(grade)


def graded(
    seq: Sequences,
    score: str,
    discount: float = 1 / 2560,
    shingle: int = 1,
    z: float = Z_FACTOR,
    absolute: float = ABSOLUTE_THRESHOLD,
    initial: float = INITIAL_THRESHOLD,
    minimum: int = MINIMUM_SCORES,
    differencing: float = SCORE_DIFFERENCING,
    auto: bool = True,
    transformed: bool = False,
) -> DataFrame:
    """Rows that have a score, with its threshold and grade, as `Thresholder` gives them where it observes every score of the key."""
    columns = seq.rows.columns
    seen = previous(replace(seq, rows=seq.rows.where(F.col(score).isNotNull())), {"__last": score})
    seen = seen.add(__capped=F.least(score, F.lit(SCORE_CAP)), __change=F.col(score) - F.coalesce("__last", F.lit(0.0)))
    seen = discounted(seen, {"__p": ("__capped", discount), "__s": ("__change", discount)})
    mean, spread, count = F.col("before___p_mean"), F.col("before___p_deviation"), F.col("before___p_count")
    seen = discounted(seen.add(__gap=F.when(mean > F.col("__capped"), mean - F.col("__capped"))), {"__b": ("__gap", discount / 2)})
    fall, change = F.sqrt(F.lit(2.0)) * F.col("before___b_deviation"), F.col("before___s_deviation")
    warm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (count - minimum) / F.lit(float(minimum))))
    long_term = F.least(fall, spread) if shingle == 1 else differencing * F.least(spread, F.greatest(change, fall)) + (1 - differencing) * change
    steep = F.lit(z)
    if transformed:
        steep = F.greatest(F.lit(MIN_Z_FACTOR), F.when(mean < ADJUSTMENT_THRESHOLD, z * mean / ADJUSTMENT_THRESHOLD).otherwise(z))
    floor = F.when((warm >= 1) & (mean < ADJUSTMENT_THRESHOLD), absolute * mean / ADJUSTMENT_THRESHOLD).otherwise(absolute) if auto else F.lit(absolute)
    parts = seen.rows.withColumns({"__z": steep, "__width": (steep - 1) * long_term + spread, "__floor": floor, "__warm": warm, "__ready": count >= minimum})
    x, width, warm, floor, steep = F.col(score), F.col("__width"), F.col("__warm"), F.col("__floor"), F.col("__z")
    ripe = F.greatest(floor, warm * (mean + width) + (1 - warm) * initial)
    parts = parts.withColumn("__limit", F.when(F.col("__ready"), ripe).otherwise(F.greatest(F.lit(initial), floor)))
    limit = F.col("__limit")
    surprise = F.greatest(F.lit(0.0), F.least(steep, (x - limit) * steep / F.nullif(width, F.lit(0.0))) / steep)
    young = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - absolute) / absolute))
    surprise = F.when(F.col("__ready"), F.when(width > 0, surprise).otherwise(2.0)).otherwise(young)
    level = F.when((x < limit) | (limit <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.floor(surprise * 20) / 16))
    parts = parts.withColumn("grade", level)
    threshold = F.when((x >= limit) & (limit > 0) & (F.col("grade") == 0), x).otherwise(limit)
    return parts.select(*columns, threshold.alias("threshold"), "grade")
