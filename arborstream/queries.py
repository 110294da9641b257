"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from .plans import detection, forests, online, relational, streams


def queries() -> dict:
    return {**relational.QUERIES, **forests.QUERIES, **detection.QUERIES, **online.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict:
    return {**relational.ORACLES, **forests.ORACLES, **detection.ORACLES, **online.ORACLES, **streams.ORACLES}
