import random

from arborstream.operators import block_detector, blocks, slices

ORDER = ["t", "i"]
SETTINGS = {"shingle": 2, "trees": 10, "capacity": 32, "block": 16, "seed": 4, "rate": 0.01}


def rows(hot=400, spikes=(200, 201, 202, 203, 300)):
    """A hot user with spikes, and short ones."""
    rng = random.Random(2)
    out, n = [], 0
    for i in range(hot):
        out.append(("hot", i, n, 50 + rng.gauss(0, 1) + (60 if i in spikes else 0)))
        n += 1
    for k in range(4):
        for i in range(rng.randrange(0, 60)):
            out.append((f"k{k}", i, n, rng.gauss(10, 3)))
            n += 1
    rng.shuffle(out)
    return out


def detect(spark, data, **settings):
    df = spark.createDataFrame(data, "k string, t long, i long, v double").repartition(6)
    got = block_detector.detect(df, "k", ORDER, ["v"], ["k", "t", "i"], **{**SETTINGS, **settings}).collect()
    assert len(got) == len(data)
    return {(r.k, r.t): r for r in got}


def test_a_hot_user_in_slices_and_units_has_the_same_result(spark, monkeypatch):
    data = rows()
    whole = detect(spark, data, transform="NORMALIZE")
    monkeypatch.setattr(slices, "SLICE_ROWS", 100)
    monkeypatch.setattr(blocks, "UNIT_ROWS", 64)
    monkeypatch.setattr(blocks, "LEAST_UNIT_ROWS", 64)
    parts = detect(spark, data, transform="NORMALIZE")
    assert whole.keys() == parts.keys()
    for k, r in whole.items():
        assert all(abs(r[c] - parts[k][c]) < 1e-6 for c in ("score", "threshold", "grade")), k


def test_spikes_get_grades_and_a_run_alerts_once(spark):
    data = rows()
    all_ = detect(spark, data)
    once = detect(spark, data, alert_once=True)
    found = {t for (k, t), r in all_.items() if k == "hot" and r.grade > 0}
    assert {200, 300} <= found
    assert len(found) < 40
    run = 0
    for t in range(400):
        r, s = all_["hot", t], once["hot", t]
        run = run + 1 if r.grade > 0 else 0
        silent = run > 0 and (run - 1) % SETTINGS["shingle"] != 0
        assert (s.grade, s.correction) == ((0.0, "ALERT_ONCE") if silent else (r.grade, "NONE"))
        assert (s.score, s.threshold) == (r.score, r.threshold)
    assert all_["hot", 0].score == 0 and all_["hot", 0].threshold == 0
    assert all_["hot", 200].threshold > 0


def test_edges(spark):
    assert detect(spark, []) == {}
    one = detect(spark, [("a", 1, 1, 2.0), ("b", 1, 2, 1.0)])
    assert {r.score for r in one.values()} == {0.0}
    flat = detect(spark, [("a", i, i, 1.0) for i in range(200)], transform="NORMALIZE_DIFFERENCE")
    assert all(r.grade == 0 for r in flat.values())
    two = detect(spark, [("a", i, i, float(i % 3)) for i in range(100)], shingle=1)
    assert two["a", 99].score > 0
