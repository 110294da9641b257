"""Many rows of many series at once give what a step a row gives, to the last bit, and a group of series is a task."""

import random

import pytest
from pyspark.sql import functions as F

from arborstream.operators import multi, versions
from arborstream.operators.multi import ManySeries, MultiSeries
from arborstream.plans import detection


def _rows(series: int, n: int) -> list[tuple]:
    rng = random.Random(5)
    flat = {s: [float(rng.randrange(3)) for _ in range(n)] for s in range(0, series, 4)}  # equal points come again
    return [(s, flat[s][i] if s in flat else rng.gauss(s, 1) + (20 if rng.random() < 0.03 else 0)) for i in range(n) for s in range(series) if rng.random() < 0.9]


@pytest.mark.parametrize("series,few,window,nodes", [(1, 1, 256, 65_536), (9, 1, 256, 500), (40, 1, 16, 65_536), (40, 12, 256, 500)])
@pytest.mark.parametrize("share", [1.0, 0.5])
def test_rows_at_once_give_what_a_step_a_row_gives(monkeypatch, series, few, window, nodes, share):
    monkeypatch.setattr(versions, "FEW", few)
    monkeypatch.setattr(multi, "WINDOW", window)
    monkeypatch.setattr(multi, "NODES", nodes)
    rows = _rows(series, 1500 // series + 60)
    one, many = (kind(2, 3, 4, 16, share, 7) for kind in (MultiSeries, ManySeries))
    want = [one.step(*r) for r in rows]
    got = [r for i in range(0, len(rows), 400) for r in many.steps(rows[i : i + 400])]
    assert got == want
    assert [f.samples for f in many.forests] == [f.samples for f in one.forests]
    assert [f.rng.getstate() for f in many.forests] == [f.rng.getstate() for f in one.forests]
    assert len(many.nodes.nodes) < nodes + 2 * 4 * 40 * (window + 2)


def test_a_group_is_a_task(spark, sf):
    tasks = detection.multi_series_bandit(spark, sf).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct(F.col("user_id") % 16).alias("groups"))
    assert {r.groups for r in tasks.collect()} == {1}
