"""Queries over whole embedding vectors, against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from arborstream.plans.relational import QUERIES, RADIUS


@pytest.fixture(scope="module")
def vectors(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    v = np.array(t["embedding"].to_pylist(), float)
    assert v.shape[1] == 64
    ids, labels = np.array(t["vec_id"].to_pylist()), np.array(t["label"].to_pylist())
    names = sorted(set(labels.tolist()))
    return ids, labels, v, names, np.array([v[labels == n].mean(axis=0) for n in names])


def l2(a, b):
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def run(name, spark, sf, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in QUERIES[name](spark, sf).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("name, f", [("l1", lambda x: np.abs(x).sum()), ("l2", lambda x: np.sqrt((x * x).sum())), ("linf", lambda x: np.abs(x).max())])
def test_distances(name, f, spark, sf, vectors):
    at = dict(zip(vectors[0].tolist(), vectors[2]))
    same(run(f"dist_{name}", spark, sf, "a", "b", "d"), {(i, i + 1): f(v - at[i + 1]) for i, v in at.items() if i + 1 in at})


def test_neighbors_within(spark, sf, vectors):
    ids, _, v, _, _ = vectors
    want = {}
    for i in np.flatnonzero(ids % 100 == 0):
        far = l2(v, v[i])
        want |= {(int(ids[i]), int(ids[j])): far[j] for j in np.flatnonzero(far < RADIUS) if ids[j] != ids[i]}
    same(run("neighbors_within", spark, sf, "query", "near", "d"), want)


def test_neighbors_far_in_the_last_components_are_none(spark, tmp_path):
    import pyarrow as pa

    rows = [[0.0] * 64, [0.0] * 8 + [5.0] * 56, [0.0] * 63 + [0.1]]
    pq.write_table(pa.table({"vec_id": [0, 1, 2], "label": pa.array([0, 0, 0], pa.int32()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    same(run("neighbors_within", spark, str(tmp_path), "query", "near", "d"), {(0, 2): 0.1})


def test_occlusion(spark, sf, vectors):
    ids, _, v, names, centres = vectors
    want = {}
    for i in np.flatnonzero(ids % 100 == 0):
        far = l2(centres, v[i])
        for b, d in enumerate(far):
            between = l2(centres, centres[b])
            if not ((far < d) & (between < d) & (d > np.sqrt(far**2 + between**2))).any():
                want[int(ids[i]), names[b]] = d
    same(run("neighbors_occlusion", spark, sf, "query", "centre", "d"), want)


def test_soft_assignment(spark, sf, vectors):
    ids, _, v, names, centres = vectors
    want = {}
    for i, x in zip(ids.tolist(), v):
        far = l2(centres, x)
        near = np.flatnonzero(far <= 1.25 * far.min())
        raw = far.min() / far[near]
        want |= {(i, names[c]): r for c, r in zip(near, raw / raw.sum())}
    same(run("soft_assign_step", spark, sf, "point_id", "centre_id", "share"), want)


def test_median_centre(spark, sf, vectors):
    ids, labels, v, names, _ = vectors
    want = {}
    for n in names:
        w = 1.0 + ids[labels == n] % 3
        for i, x in enumerate(v[labels == n].T):
            order = np.argsort(x, kind="stable")
            want[n, i] = x[order][np.searchsorted(np.cumsum(w[order]), 0.5 * w.sum())]
    same(run("weighted_median_center", spark, sf, "label", "i", "median"), want)


def test_cut_probability(spark, sf, vectors):
    ids, labels, v, _, _ = vectors
    low, high = v[labels == 0].min(axis=0), v[labels == 0].max(axis=0)
    s = (np.maximum(0, v - high) + np.maximum(0, low - v)).sum(axis=1)
    same(run("cut_probability", spark, sf, "vec_id", "p"), {(i,): x / (x + (high - low).sum()) for i, x in zip(ids.tolist(), s)})
