"""Deterministic uniforms: the same numbers on any engine, any partitioning and any retry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1) from the parts as text: 52 bits of their md5 plus a half."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def uniform_of(*parts: object) -> float:
    """The same number in Python."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def uniform_sql(*parts: str) -> str:
    """The same number in DuckDB SQL; parts are SQL expressions."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def mixed(seed: int, count: int) -> np.ndarray:
    """Uniforms in [0, 1) from a counter by a 64-bit finaliser: the top 53 bits of each mixed word."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) + (np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
