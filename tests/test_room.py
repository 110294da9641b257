"""Keys that go side by side are as many as their banks have room for."""

import random

import numpy as np
import pytest

from arborstream.operators import lockstep
from arborstream.operators.caster import Caster, ErrorTracker
from arborstream.operators.detector import Detector, StreamForest, run
from arborstream.plans import detection


def _bytes(bank: lockstep.Bank) -> int:
    return sum(v.nbytes for v in vars(bank).values() if isinstance(v, np.ndarray))


@pytest.mark.parametrize("shape", [(20, 32, 4), (20, 64, 5), (3, 7, 1)])
def test_a_banks_lanes_take_what_is_stated(shape):
    trees, capacity, width = shape
    bank = lockstep.Bank(16, trees, capacity, 0.01, 1.0)
    bank.update([bank.seat(StreamForest(trees, capacity, 0.01, 1))], [(0.5,) * width])
    assert _bytes(bank) / 16 <= lockstep.Bank.lane_bytes(*shape) <= _bytes(bank) / 16 + 16_000


@pytest.mark.parametrize("name", ["forecast_learned_errors", "forecast_caster", "forecast_caster_minimal"])
def test_casters_side_by_side_stay_within_the_room(monkeypatch, name):
    said = {}
    monkeypatch.setattr(detection, "events", lambda spark, sf_dir: None)
    monkeypatch.setattr(lockstep, "scan", lambda *_, **settings: said.update(settings))
    detection.QUERIES[name](None, None)
    small = detection.SMALL
    shapes = [(small["trees"], small["capacity"], small["shingle"])] + [ErrorTracker.shape(1)] * (name == "forecast_learned_errors")
    assert lockstep.THIN < said["lanes"] and said["lanes"] * sum(lockstep.Bank.lane_bytes(*s) for s in shapes) <= 256 << 20


def test_sets_of_few_lanes_give_the_same_rows_and_no_wider_bank(monkeypatch):
    def start(key, seat):
        c = Caster(Detector(base=1, seed=key, trees=5, capacity=12, shingle=3), 2, learned=True)
        c.detector.forest, c.errors.model = seat(c.detector.forest), seat(c.errors.model)

        def step(row):
            r, steps, _ = yield from c.asking([row[1]], row[2])
            return [(row[0], row[2], r.score, str(steps))]

        return step

    rng = random.Random(5)
    rows = [(k, rng.gauss(10, 3), t) for k in range(11) for t in range(40)]
    alone = []
    for k in range(11):
        step = start(k, lambda forest: forest)
        alone += [x for row in rows if row[0] == k for x in run(step(row))]
    made = []
    monkeypatch.setattr(lockstep, "Hall", lambda lanes, hall=lockstep.Hall: made.append(lanes) or hall(lanes))
    got = [r for out in lockstep._played(iter([([r[0] for r in rows], rows)]), start, 1, 4) for r in out]
    assert got == alone and made == [4, 4, 3]


@pytest.mark.parametrize("missing", [[3], [0], [1, 2], [0, 1, 2, 3]])
def test_lanes_are_imputed_strip_by_strip_as_alone(monkeypatch, missing):
    monkeypatch.setattr(lockstep, "STRIP", 3)
    bank, twins = lockstep.Bank(7, 6, 16, 0.01, 1.0), [StreamForest(6, 16, 0.01, seed) for seed in range(7)]
    seats, rng = [bank.seat(StreamForest(6, 16, 0.01, seed)) for seed in range(7)], random.Random(2)
    for _ in range(50):
        points = [tuple(float(rng.choice([0, 1, 5, rng.gauss(0, 3)])) for _ in range(4)) for _ in seats]
        bank.update(seats, points)
        for twin, x in zip(twins, points, strict=True):
            twin.update(x)
        points = [tuple(rng.gauss(0, 3) for _ in range(4)) if i % 2 else x for i, x in enumerate(points)]
        assert bank.impute(seats, points, missing, (0.5, 0.1, 0.9)) == [t.impute(x, missing, (0.5, 0.1, 0.9)) for t, x in zip(twins, points, strict=True)]


def test_rows_held_for_casters_are_bounded(monkeypatch):
    monkeypatch.setattr(lockstep, "ROOM_ROWS", 60)

    def start(key, seat):
        def step(row):
            return [row]
            yield

        return step

    rows = [(k, i) for k in range(9) for i in range(25)]
    outs = list(lockstep._played(iter([([r[0] for r in rows], rows)]), start, 2, 100))
    assert [r for out in outs for r in out] == rows and max(map(len, outs)) <= 75
    assert len(list(lockstep._played(iter([([r[0] for r in rows], rows)]), start, 2))) == 1
