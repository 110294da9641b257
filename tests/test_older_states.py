import json
import math
import random

import pytest

from arborstream.operators.caster import Caster
from arborstream.operators.detector import Detector
from arborstream.operators.predictive import PredictiveForest
from arborstream.sources import snapshot, state


@pytest.mark.parametrize("learned", [False, True])
def test_a_restored_caster_goes_on_as_before(learned):
    rng = random.Random(3)
    make = lambda: Caster(Detector(trees=8, capacity=32, seed=5), 3, learned=learned, error_horizon=40, lower_limit=-30.0)
    whole, again = make(), make()
    shown = 0
    for i in range(160):
        if i % 50 == 40:
            again = state.load(state.dump(again))
        row = [10 * math.sin(i / 4) + rng.gauss(0, 0.3)]
        a, b = whole.step(row, i), again.step(row, i)
        assert a == b
        shown += bool(a[1])
    assert shown > 50 and again.upper_limit == math.inf


@pytest.mark.parametrize("transform", ["NONE", "NORMALIZE"])
def test_a_restored_predictive_forest_goes_on_as_before(transform):
    rng = random.Random(4)
    whole, again = (PredictiveForest(3, 8, 32, transform, seed=2) for _ in range(2))
    for i in range(120):
        if i % 50 == 40:
            again = state.load(state.dump(again, compress=False))
        row = [rng.gauss(0, 1), i / 10, rng.gauss(5, 2)]
        assert whole.score(row) == again.score(row)
        whole.update(row)
        again.update(row)
    assert whole.predict([0.0, 9.0, 5.0], [0]) == again.predict([0.0, 9.0, 5.0], [0])
    assert whole.directional_density([0.0, 9.0, 5.0]) == again.directional_density([0.0, 9.0, 5.0])


def older(**changes):
    """A preprocessor state of version 2: two values a row, windows of three rows."""
    statistics = {"discount": 1e-4, "weight": 629.5, "sumSquared": 629.5, "sum": 629.5, "count": 1257}
    own = {
        "version": "2.1", "useImputedFraction": 0.5, "imputationMethod": "PREVIOUS", "forestMode": "STANDARD", "transformMethod": "NONE", "weights": [1.0, 1.0, 1.0],
        "lastShingledPoint": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "lastShingledInput": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "shingleSize": 3, "dimensions": 6, "inputLength": 6,
        "previousTimeStamps": [0, 1, 2], "valuesSeen": 1257, "internalTimeStamp": 1257, "dataQualityState": statistics, "timeStampDeviationState": {**statistics, "sum": 0.0, "sumSquared": 0.0},
    }
    return json.dumps({**own, **changes})


def test_a_preprocessor_of_version_2():
    got = snapshot.preprocessor_from_json(older())
    assert (got.base, got.shingle, got.seen, got.times) == (2, 3, 1257, [0, 1, 2])
    assert got.window == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    assert (got.quality.mean, got.quality.count, got.gaps.mean, got.gaps.deviation) == (1.0, 1257, 0.0, 0.0)
    # a stream of single values may say that a row is one value long
    assert snapshot.preprocessor_from_json(older(dimensions=6, shingleSize=6, inputLength=1)).base == 1


@pytest.mark.parametrize("changes", [{"version": "3.0"}, {"version": None}, {"lastShingledInput": None}, {"dimensions": 9}])
def test_another_layout_is_an_error(changes):
    with pytest.raises(ValueError):
        snapshot.preprocessor_from_json(older(**changes))


def test_a_state_without_a_forest_is_an_error():
    with pytest.raises(ValueError):
        snapshot.from_json(older())
    with pytest.raises(ValueError):
        snapshot.from_json(json.dumps({"compactSamplerStates": [{"pointIndex": [0]}], "pointStoreState": {"pointData": "AAAA"}}))
