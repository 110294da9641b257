"""States of a stream are saved from where the forests lie, as those of forests of their own."""

import random

import pytest

from arborstream.operators import lockstep
from arborstream.operators.detector import Detector, StreamForest
from arborstream.sources import state
from arborstream.streaming import processor

SMALL = {"base": 1, "trees": 5, "capacity": 12, "shingle": 3}


def _rows(keys: int, n: int = 40) -> list[list[tuple]]:
    rng = random.Random(6)
    return [[(t, [float(rng.randrange(3)) if k == 1 else rng.gauss(5, 1)]) for t in range(n - k)] for k in range(keys)]


@pytest.mark.parametrize("settings", [{}, {"accept": 0.25}, {"strategy": "MULTI_MODE", "transform": "NORMALIZE"}])
def test_a_seat_is_saved_as_its_forest_and_loaded_as_it(monkeypatch, settings):
    monkeypatch.setattr(lockstep, "THIN", 2)
    rows = _rows(6)
    models = [Detector(**SMALL, **settings, seed=k) for k in range(6)]
    processor._seated(models, rows)
    assert sum(isinstance(d.forest, lockstep.Seat) for d in models) >= 3
    for d in models:
        saved = state.dump(d)
        if isinstance(d.forest, lockstep.Seat):
            d.forest = d.forest.forest()
        assert saved == state.dump(d)


def test_a_seat_that_has_learnt_nothing_is_saved():
    bank = lockstep.Bank(3, 4, 8, 0.01, 1.0)
    seats = [bank.seat(StreamForest(4, 8, 0.01, seed)) for seed in range(3)]
    assert [state.dump(s) for s in seats] == [state.dump(StreamForest(4, 8, 0.01, seed)) for seed in range(3)]
    bank.update(seats[:1], [(1.0, 2.0)])
    assert state.dump(seats[1]) == state.dump(StreamForest(4, 8, 0.01, 1))


def test_no_forest_becomes_objects_for_its_state_and_no_two_states_wait_for_their_seats(monkeypatch):
    monkeypatch.setattr(lockstep, "THIN", 2)
    made = []
    monkeypatch.setattr(lockstep.Bank, "forest", lambda self, seat, real=lockstep.Bank.forest: made.append(seat.lane) or real(self, seat))
    rows = _rows(6)
    blobs = [state.dump(Detector(**SMALL, seed=k)) for k in range(6)]
    for _ in range(2):
        models, before = [], []

        def begun(models=models, before=before, blobs=blobs):
            for blob in blobs:
                before.append(sum(isinstance(d.forest, StreamForest) for d in models))
                models.append(state.load(blob))
                yield models[-1]

        processor._seated(begun(), rows)
        assert before == [0] * 6
        blobs = [state.dump(d) for d in models]
        rows = [[(t + 100, v) for t, v in own] for own in rows]
    # the last two of a set go on alone
    assert made == [0, 1] * 2


def test_samples_keys_are_those_of_a_forest_of_its_own_to_the_last_bit():
    bank, twins = lockstep.Bank(64, 8, 16, 0.01, 1.0), [StreamForest(8, 16, 0.01, seed) for seed in range(64)]
    seats = [bank.seat(StreamForest(8, 16, 0.01, seed)) for seed in range(64)]
    rng = random.Random(9)
    for _ in range(40):
        points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in seats]
        bank.update(seats, points)
        for twin, x in zip(twins, points, strict=True):
            twin.update(x)
    assert all(sorted(a) == sorted(b) for s, twin in zip(seats, twins, strict=True) for a, b in zip(bank.forest(s).samples, twin.samples, strict=True))


def test_sets_of_some_hundred_keys_go_side_by_side_almost_to_their_end(monkeypatch):
    assert processor.FEW < lockstep.THIN
    made = []
    monkeypatch.setattr(lockstep.Bank, "forest", lambda self, seat, real=lockstep.Bank.forest: made.append(seat.lane) or real(self, seat))
    rows = [[(t, [float(t % 3)]) for t in range(8 + k // 10)] for k in range(processor.FEW + 1)]
    models = [Detector(base=1, trees=2, capacity=4, shingle=2, seed=k) for k in range(len(rows))]
    processor._seated(models, rows)
    assert 0 < len(made) <= processor.LAST
