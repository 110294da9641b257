"""Keys side by side give what each gives alone, to the last bit."""

import random

import numpy as np
import pytest

from arborstream.operators import lockstep
from arborstream.operators.caster import Caster
from arborstream.operators.detector import Detector, StreamForest, run

SMALL = {"trees": 5, "capacity": 12, "shingle": 3}


def _rows(keys: int, longest: int) -> list[tuple]:
    rng = random.Random(3)
    out = []
    for k in range(keys):
        t = 0
        for _ in range(longest - k if k else 3 * longest):
            t += rng.choice([1, 1, 2, 9])
            v = rng.choice([0.0, 1.0, 5.0]) if k == 2 else rng.gauss(10, 2) + (30 if rng.random() < 0.05 else 0)
            out.append((k, v, t))
    return out


def _alone(forest):
    return forest


def _detector(**settings):
    def start(key, seat):
        d = Detector(base=1, seed=key, **{**SMALL, **settings})
        d.forest = seat(d.forest)

        def step(row):
            r = yield from d.asking([None if settings.get("mode") == "STREAMING_IMPUTE" and row[2] % 7 == 0 else row[1]], row[2])
            return [(row[0], row[2], r.score, r.threshold, r.grade, r.correction, r.expected, tuple(r.attribution), r.imputes)]

        return step

    return start


def _caster(key, seat):
    c = Caster(Detector(base=1, seed=key, **SMALL), 2, learned=True)
    c.detector.forest, c.errors.model = seat(c.detector.forest), seat(c.errors.model)

    def step(row):
        r, steps, _ = yield from c.asking([row[1]], row[2])
        return [(row[0], row[2], r.score, str(steps))]

    return step


@pytest.mark.parametrize(
    "start",
    [
        _detector(),
        _detector(strategy="DISTANCE"),
        _detector(strategy="MULTI_MODE_RECALL", alert_once=True),
        _detector(transform="NORMALIZE_DIFFERENCE", auto_adjust=True),
        _detector(mode="TIME_AUGMENTED"),
        _detector(mode="STREAMING_IMPUTE"),
        _detector(accept=0.25),
        _caster,
    ],
)
@pytest.mark.parametrize("held", [100_000, 150])
def test_keys_side_by_side_give_what_each_gives_alone(monkeypatch, start, held):
    monkeypatch.setattr(lockstep, "THIN", 2)
    monkeypatch.setattr(lockstep, "HELD_ROWS", held)
    rows = _rows(9, 50)
    alone, now, step = [], None, None
    for r in rows:
        if r[0] != now:
            now, step = r[0], start(r[0], _alone)
        alone += run(step(r))
    batches = (([r[0] for r in rows[i : i + 40]], rows[i : i + 40]) for i in range(0, len(rows), 40))
    together = [r for out in lockstep._played(batches, start) for r in out]
    assert together == alone


def test_sums_are_those_of_the_built_in_sum():
    m = np.random.default_rng(1).normal(size=(500, 5)) * 10.0 ** np.random.default_rng(2).integers(-12, 12, (500, 5))
    assert lockstep._sums(m).tolist() == [sum(r) for r in m.tolist()]


def test_a_forest_leaves_its_seat_as_it_is():
    bank, twin = lockstep.Bank(1, 4, 8, 0.01, 1.0), StreamForest(4, 8, 0.01, 7)
    seat, rng = bank.seat(StreamForest(4, 8, 0.01, 7)), random.Random(1)
    for i in range(60):
        x = (rng.random(), rng.random())
        if i == 30:
            seat.leave()
        assert i < 2 or (seat.score(x), seat.attribution(x), seat.near(x), seat.impute(x, [1])) == (twin.score(x), twin.attribution(x), twin.near(x), twin.impute(x, [1]))
        if i < 30:
            bank.update([seat], [x])
        else:
            seat.update(x)
        twin.update(x)


def test_a_nodes_fields_lie_side_by_side_and_strips_give_the_same_scores(monkeypatch):
    bank = lockstep.Bank(7, 4, 8, 0.01, 1.0)
    seats = [bank.seat(StreamForest(4, 8, 0.01, seed)) for seed in range(7)]
    rng = random.Random(4)
    for _ in range(30):
        bank.update(seats, [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in seats])
    # one read brings all of a node: both corners, their sums, dimension, cut, left, right, mass and the node above
    assert bank.node.shape == (7 * 4 * 16, 2 * 2 + 2 + 6) and bank.node.flags.c_contiguous
    points = [(rng.gauss(0, 2), rng.gauss(0, 2)) for _ in seats]
    whole = bank.score(seats, points)
    monkeypatch.setattr(lockstep, "STRIP", 3)
    assert bank.score(seats, points) == whole == [bank.forest(s).score(p) for s, p in zip(seats, points, strict=True)]
