"""Rules of the detector that a result alone does not show: past correction, neighbours' vote, gaps, the first rows, live settings."""

import math

import numpy as np
import pytest

from arborstream.operators.detector import Detector, Result


def wave(n, step=25):
    rng = np.random.default_rng(4)
    return [10 * math.sin(2 * math.pi * i / step) + float(rng.normal(0, 0.3)) for i in range(n)]


def fed(n=200, missing=(), gap_at=None, gap=1, **settings):
    d = Detector(**{"trees": 20, "capacity": 64, "shingle": 4, "seed": 3, **settings})
    t, got = 0, []
    for i, v in enumerate(wave(n)):
        t += 10 * (gap if i == gap_at else 1)
        got.append(d.step([None if i in missing else v], t))
    return d, got


def anomaly(d, point, expected, relative=0, delta=0.0):
    d.significant = Result(point=tuple(point), expected_point=tuple(expected), relative=relative, delta_shift=[delta] * d.width, clock=d.clock, score=2.0)


@pytest.mark.parametrize("gap", [1, 2, 3, 4, 5])
def test_rows_up_to_the_anomaly_are_those_expected(gap):
    d = Detector(shingle=4)
    anomaly(d, [1, 2, 3, 99], [1, 2, 3, 4])
    got = d._repaired((3.0, 99.0, 5.0, 6.0), gap, [1.0])
    want = {1: (2, 3, 4, 6.0), 2: (3, 4, 5.0, 6.0), 3: (4, 99.0, 5.0, 6.0)}.get(gap, (3.0, 99.0, 5.0, 6.0))
    assert got == want


@pytest.mark.parametrize("gap", [1, 2, 4, 5])
def test_steps_get_back_what_the_anomaly_took(gap):
    d = Detector(shingle=4, transform="DIFFERENCE")
    anomaly(d, [0, 0, 0, 90], [0, 0, 0, 1])
    got = d._repaired((0.0, 0.0, 0.0, 0.0), gap, [1.0])
    plain = list((0.0, 0.0, 0.0, 0.0))
    if gap < 4:
        plain[: 4 - gap] = [0, 0, 0, 1][gap:]
    if gap <= 4:
        plain[4 - gap] += 89
    assert got == tuple(plain)


@pytest.mark.parametrize("method", ["NORMALIZE", "SUBTRACT_MA"])
def test_a_shifted_mean_comes_back_with_the_decay(method):
    d = Detector(shingle=4, capacity=64, transform=method)
    for gap in (1, 3, 7, 8):
        anomaly(d, [0, 0, 0, 9], [0, 0, 0, 1], delta=5.0)
        got = d._repaired((0.0, 0.0, 0.0, 0.0), gap, [2.0])
        back = 5 * math.exp(-gap / 64) / 2 if gap < 8 else 0.0
        want = [0.0] * 4
        if gap < 4:
            want[: 4 - gap] = [0, 0, 0, 1][gap:]
        for k in range(min(gap, 4)):
            want[3 - k] += back
        assert got == pytest.approx(want)


def test_time_comes_back_too():
    d = Detector(shingle=2, mode="TIME_AUGMENTED")
    anomaly(d, [1, 0, 9, 50], [1, 0, 2, 3])
    assert d._repaired((9.0, 50.0, 4.0, 1.0), 1, [1.0, 1.0]) == (2, 3, 4.0, 48.0)


def test_neighbours_vote_by_distance_and_noise():
    d, _ = fed(300)
    d.transforms[0].stats.step.update(1.0)
    for point in list({leaf.point for t in d.forest.trees for leaf in [t.leaf((0.0, 0.0, 0.0, 0.0))]})[:3] + [(50.0, 50.0, 50.0, 50.0)]:
        leaves = [t.leaf(point).point for t in d.forest.trees]
        merged = sorted({p: leaves.count(p) for p in leaves}.items(), key=lambda x: (math.dist(point, x[0]), x[0]))
        assert d.forest.near(point) == [(math.dist(point, p), p, n) for p, n in merged]
        mean = sum(math.dist(point, p) for p, _ in merged) / len(merged)
        noise = d.transforms[0].stats.step.deviation
        votes = sum(n for p, n in merged if math.dist(point, p) < 1.1 * mean and abs(p[3] - point[3]) <= noise)
        assert d._explained(point, point, 3, [1.0]) == (votes >= 0.1 * 20)


def test_a_long_gap_is_filled_whole_or_skipped():
    plain, got = fed(220, gap_at=200, gap=101, mode="STREAMING_IMPUTE")
    assert got[200].imputes == 100 and got[200].skipped == 0
    quick, got = fed(220, gap_at=200, gap=101, mode="STREAMING_IMPUTE", fast_forward=True)
    assert got[200].imputes == 0 and got[200].skipped == 100
    short, got = fed(220, gap_at=200, gap=6, mode="STREAMING_IMPUTE", fast_forward=True)
    assert got[200].imputes == 5 and got[200].skipped == 0


@pytest.mark.parametrize("how,want", [("LINEAR", [1, 2, 3, 4]), ("NEXT", [4, 4, 4, 4]), ("PREVIOUS", [0, 0, 0, 4]), ("ZERO", [0, 0, 0, 4]), ("FIXED_VALUES", [7, 7, 7, 4])])
def test_rows_of_a_gap(how, want):
    d = Detector(shingle=4, trees=5, capacity=16, mode="STREAMING_IMPUTE", imputation=how, fixed=7.0, initial=0)
    for t in range(20):
        d.step([0.0], 10 * t)
    r = d.step([4.0], 230)
    assert r.imputes == 3 and [row[0] for row in d.window] == pytest.approx(want)


def test_a_window_of_fills_is_not_learnt():
    d = Detector(shingle=4, trees=5, capacity=16, mode="STREAMING_IMPUTE", imputation="PREVIOUS", initial=0)
    for t in range(20):
        d.step([float(t % 3)], 10 * t)
    before = d.forest.updates
    d.step([1.0], 10 * 25)  # five rows lack: of them the first alone leaves less than half the window filled in
    assert d.forest.updates == before + 1


def test_the_first_rows_are_interpolated_and_learnt_at_once():
    d = Detector(shingle=4, trees=5, capacity=16, transform="NORMALIZE")
    times, values = [0, 10, 20, 40, 50, 60, 70, 80, 90, 100], [None, 1.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, None]
    for i, (t, v) in enumerate(zip(times, values)):
        r = d.step([v], t)
        assert (r.score, r.clock, d.forest.updates) == (0.0, i + 1, 0 if i < 9 else 7)
    whole = [1.0, 1.0, 2.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 9.0]
    stats = Detector(shingle=4, capacity=16, transform="NORMALIZE").transforms[0]
    for v in whole:
        stats.update(v)
    assert d.transforms[0].stats == stats.stats
    scaled = []
    stats.last = None
    for v in whole:
        scaled.append(stats.forward(v))
        stats.last = v
    assert [r[0] for r in d.window] == pytest.approx(scaled[-4:])
    assert d.quality.mean == pytest.approx(0.7) and d.last_time == 100 and d.steps.count == 9
    for how, first in (("ZERO", 0.0), ("FIXED_VALUES", 3.0)):
        e = Detector(imputation=how, fixed=3.0, initial=2)
        assert e._interpolated([0, 1], [None, 5.0]) == [first, 5.0]
    assert Detector(fixed=2.0)._interpolated([0, 1], [None, None]) == [2.0, 2.0]
    assert Detector().initial == 0 and Detector(mode="TIME_AUGMENTED").initial == 10


def test_gaps_are_scored_before_their_rows_are_learnt():
    d, _ = fed(200, mode="STREAMING_IMPUTE", imputation="LINEAR")
    seen = []
    score = d.forest.score
    d.forest.score = lambda x: seen.append(d.forest.updates) or score(x)
    before = d.forest.updates
    d.step([1.0], d.last_time + 30)
    assert seen == [before] and d.forest.updates > before


def test_pause_and_live_settings():
    d, _ = fed(100)
    d.pause()
    n = d.forest.updates
    assert d.step([3.0], 2000).score > 0 and d.forest.updates == n
    d.pause(False)
    d.step([3.0], 2010)
    assert d.forest.updates == n + 1
    d.reconfigure(z=4.0, rate=0.02, strategy="MULTI_MODE", decay=0.01, auto_adjust=True)
    assert (d.by_depth.primary.discount, d.by_distance.below.discount) == (0.02, 0.01)
    assert (d.by_depth.z, d.strategy, d.forest.decay, d.auto_adjust) == (4.0, "MULTI_MODE", 0.01, True)
    for bad in ({"shingle": 3}, {"strategy": "X"}):
        with pytest.raises(ValueError):
            d.reconfigure(**bad)


@pytest.mark.parametrize("mode", ["STANDARD", "TIME_AUGMENTED", "STREAMING_IMPUTE"])
def test_forecasts_have_times(mode):
    d, _ = fed(200, mode=mode)
    got = d.extrapolate_timed(3)
    assert len(got) == 3 and [v for v, _ in got] == d.extrapolate(3)
    if mode == "STREAMING_IMPUTE":
        assert all(t is None for _, t in got)
    else:
        at = d.last_time
        for _, (now, early, late) in got:
            assert early <= now <= late and abs(now - at - 10) <= 1
            at = late if mode == "TIME_AUGMENTED" else now
    assert Detector().extrapolate_timed(3) == []


@pytest.mark.parametrize(
    ("base", "shingle", "own", "taken"),
    [
        (1, 4, [0.0], [1]),  # a row of one value is always imputed
        (1, 1, [9.0], None),  # but not more than half of the window
        (3, 4, [5.0, 0.5, 0.05], [3]),  # a second one only with more than a tenth
        (3, 4, [5.0, 2.0, 0.05], [3, 4]),
        (3, 4, [0.6, 0.06, 0.34], [3, 5]),
        (8, 2, [1.0] * 8, None),  # more than five count
        (8, 2, [4.0, *[0.01] * 7], [8]),
        (20, 2, [0.05] * 20, None),  # the largest brings less than a tenth
        (4, 1, [1.0, 1.0, 1.0, 0.0], None),  # more than half of the window
        (4, 1, [1.0, 1.0, 0.0, 0.0], [0, 1]),
    ],
)
def test_main_contributors_are_imputed(base, shingle, own, taken):
    d = Detector(base=base, shingle=shingle, trees=2, capacity=8)
    d.forest.impute = lambda point, at: [tuple(at)]
    n, start = base * shingle, base if shingle > 1 else 0
    parts = [0.0] * (2 * n)
    for i, v in enumerate(own):
        parts[start + i], parts[n + start + i] = v / 4, v * 3 / 4
    assert d._expect(parts, start, (0.0,) * n) == (None if taken is None else tuple(taken))
