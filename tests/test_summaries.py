import numpy as np
import pytest

from arborstream.operators import summaries
from arborstream.operators.cluster import cluster, l2


def blobs(n, d=6, k=5, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 20
    label = rng.integers(0, k, n)
    return centres[label] + rng.normal(size=(n, d)), label, centres


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist(), "w") for i, v in enumerate(x)], "i long, v array<double>, w string").repartition(parts)


def test_a_part_is_covered_within_twice_the_best():
    x, _, centres = blobs(300)
    one, zero = np.ones(300), np.zeros(300)
    got, weight, radius, spread = summaries.covered(x, one, zero, zero, 5)
    best = max(min(np.linalg.norm(p - c) for c in centres) for p in x)
    assert weight.sum() == 300
    assert radius.max() <= 2 * best + 1e-9
    assert (spread <= radius + 1e-9).all()
    assert all(min(np.linalg.norm(p - g) for g in got) <= radius.max() + 1e-9 for p in x)
    same = summaries.covered(np.zeros((7, 2)), np.ones(7), np.zeros(7), np.zeros(7), 5)
    assert (len(same[0]), same[1].tolist()) == (1, [7.0])


@pytest.mark.parametrize("sizes", [(1024, 64, 256), (50, 5, 12)])
def test_weights_add_up_over_levels(spark, monkeypatch, sizes):
    for name, v in zip(("PART", "KEPT", "CLUSTERED"), sizes, strict=True):
        monkeypatch.setattr(summaries, name, v)
    x, *_ = blobs(1500)
    got = summaries.condense(frame(spark, x, 9), "v").collect()
    assert len(got) <= summaries.CLUSTERED
    assert sum(r.w for r in got) == 1500
    reach = max(r.radius for r in got)
    reps = np.array([r.v for r in got])
    assert all(np.linalg.norm(reps - p, axis=1).min() <= reach + 1e-9 for p in x)
    weighted = summaries.condense(frame(spark, x).selectExpr("v", "i % 3 AS g"), "v", "g").collect()
    assert sum(r.w for r in weighted) == sum(i % 3 for i in range(1500))


def test_clusters_agree_with_those_of_one_pass(spark, monkeypatch):
    for name, v in (("PART", 100), ("KEPT", 20), ("CLUSTERED", 60)):
        monkeypatch.setattr(summaries, name, v)
    x, label, _ = blobs(400)
    df = frame(spark, x, 7)
    found = summaries.clusters(df, "v", 5, representatives=3, shrinkage=0.1, seed=1)
    assert abs(sum(c.weight for c in found) - 400) < 1e-6
    rows = {r.i: r.cluster for r in summaries.assigned(df, "v", found, ["i"]).collect()}
    # either way a cluster is a blob
    assert len(found) == 5
    assert len({(label[i], c) for i, c in rows.items()}) == 5
    one = cluster([(v, 1.0) for v in x], 5, l2, seed=1)
    sizes = sorted(np.bincount(label))
    assert sorted(round(c.weight) for c in one) == sizes == sorted(np.bincount(list(rows.values())))


def test_edges(spark):
    schema = "i long, v array<double>"
    none = spark.createDataFrame([], schema)
    assert summaries.clusters(none, "v", 3) == []
    assert summaries.assigned(none, "v", [], ["i"]).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])], schema)
    found = summaries.clusters(odd, "v", 3)
    assert [c.weight for c in found] == [2.0]
    got = {(r.i, r.cluster) for r in summaries.assigned(odd, "v", found, ["i"]).collect()}
    assert got == {(1, None), (2, None), (3, None), (4, 0)}
