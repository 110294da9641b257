"""Forms for many rows at once give what the forms for one row give, and long groups are picked from slice by slice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborstream.operators import folds, forest, sampler, slices
from arborstream.queries import queries


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    rows = [(t, i, np.round(rng.normal(size=3), 1).tolist()) for t in range(6) for i in range(40)]
    return forest.from_sample(pd.DataFrame(rows, columns=["tree", "seq", "v"]), 6, 40, 2, 400)


@pytest.fixture(scope="module")
def asked(model):
    return np.concatenate([np.round(np.random.default_rng(5).normal(size=(60, 3)), 1), model.trees[0].points[:20]])


@pytest.mark.parametrize("missing", [[1], [0, 2], [0, 1, 2]])
def test_many_are_imputed_as_each_is(model, asked, missing):
    got = model.impute_many(asked, missing, (0.5, 0.1, 0.9))
    assert np.array_equal(got, np.stack([model.impute(q, missing, (0.5, 0.1, 0.9)) for q in asked]))


def test_many_are_extrapolated_as_each_is(model, asked):
    assert np.array_equal(model.extrapolate_many(asked, 1, 4), np.stack([model.extrapolate(q, 1, 4) for q in asked]))


def test_simulated_scores_of_many_boxes_at_once(model, asked):
    weigh = lambda low, high: (high - low) ** 2
    for t in model.trees:
        assert np.allclose(folds.simulated(t, asked, weigh, many=True), folds.simulated(t, asked, weigh), rtol=1e-13)


def test_early_stopping_takes_the_scores_that_skip_the_gaps(model, asked, monkeypatch):
    want = model.approximate(asked, lambda: folds.Score())
    monkeypatch.setattr(folds, "traverse", None)
    assert np.allclose(model.approximate(asked), want, rtol=1e-13)


def test_a_long_group_is_picked_from_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 700), "o": rng.integers(0, 300, 700), "i": np.arange(700), "w": rng.integers(-3, 9, 700)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: (r["i"], r["running"]) for r in sampler.prefix_pick(df, "g", ["o", "i"], "w", 0.25).collect()}
    want = {}
    for g, own in pdf.groupby("g", dropna=False):
        own = own.sort_values(["o", "i"])
        running = own["w"].cumsum()
        at = np.flatnonzero(running >= 0.25 * own["w"].sum())[0]
        want[None if pd.isna(g) else g] = (own["i"].iloc[at], running.iloc[at])
    assert got == want


def test_rows_are_not_repeated_for_the_representatives(spark, sf):
    plan = queries()["edit_distance_assign"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan
    got = spark.read.parquet(f"{sf}/part.parquet").agg(F.countDistinct("p_partkey")).first()[0]
    assert queries()["edit_distance_assign"](spark, sf).count() == got
