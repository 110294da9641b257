"""Exponentially discounted statistics of a sequence."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass
class Deviation:
    """Discounted weight, sum and sum of squares; mean and deviation are read off them."""

    discount: float = 0.0
    weight: float = 0.0
    total: float = 0.0
    squares: float = 0.0
    count: int = 0

    def update(self, x: float) -> None:
        keep = 1.0 - self.discount
        self.total = self.total * keep + x
        self.squares = self.squares * keep + x * x
        self.weight = self.weight * keep + 1.0
        self.count += 1

    @property
    def mean(self) -> float:
        return self.total / self.weight if self.weight > 0 else 0.0

    @property
    def deviation(self) -> float:
        if self.weight <= 0:
            return 0.0
        m = self.total / self.weight
        return math.sqrt(max(0.0, self.squares / self.weight - m * m))

    def reset(self) -> None:
        self.weight = self.total = self.squares = 0.0
        self.count = 0
