"""Folds, accumulators, kernels and attributes of the caller's."""

import numpy as np
import pytest

from arborstream.operators import folds, forest
from arborstream.operators.trees import build


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(80, 3))
    points[:9] = points[0]
    trees = [build(points[rng.choice(80, 60, replace=False)], t, 2) for t in range(12)]
    return forest.Forest(trees, [np.arange(60)] * 12, 60, 2, 1000)


class Reach:
    """Which leaves a query with hidden coordinates can reach, and the depth of the deepest."""

    def __init__(self, hidden):
        self.hidden = hidden

    def splits(self, dim):
        return dim in self.hidden

    def leaf(self, tree, node):
        return {node}, int(tree.depth[node])

    def combine(self, left, right):
        return left[0] | right[0], max(left[1], right[1])

    def up(self, tree, node, below):
        assert all(tree.depth[n] > tree.depth[node] for n in below[0])
        return below


def test_branching_folds(model):
    query = np.array([0.1, -0.2, 0.3])
    for t, (leaves, depth) in zip(model.trees, model.branch(query, lambda: Reach({0, 1, 2}))):
        assert leaves == set(t.leaves.tolist()) and depth == t.depth.max()
    for t, (leaves, _) in zip(model.trees, model.branch(query, lambda: Reach(set()))):
        assert leaves == {folds.routes(t, query[None, :])[0].max()} or len(leaves) == 1
    some = model.branch(query, lambda: Reach({1}))
    for t, (leaves, _) in zip(model.trees, some):
        want, todo = set(), [0]
        while todo:
            n = todo.pop()
            if t.dim[n] < 0:
                want.add(n)
            else:
                todo += [t.left[n], t.right[n]] if t.dim[n] == 1 else [t.left[n] if query[t.dim[n]] <= t.value[n] else t.right[n]]
        assert leaves == want


def test_accumulators(model):
    q = np.random.default_rng(1).normal(size=(20, 3))
    each = model.per_tree(q, folds.Score)
    assert np.allclose(model.accumulate(q, folds.Score, np.maximum), each.max(axis=1))
    assert np.allclose(model.accumulate(q, folds.Score, np.add, each=np.square, finish=np.sqrt), np.sqrt((each**2).sum(axis=1)))
    seen = []
    got = model.accumulate(q, folds.Score, np.add, done=lambda total: seen.append(1) or len(seen) == 3)
    assert np.allclose(got, each[:, :3].sum(axis=1))


def simple_density(tree, x, field, influence):
    """The measure by direction, read off the definition by a recursion from the root."""
    d = len(x)
    leaf = int([n for n in folds.routes(tree, x[None, :])[0] if n >= 0][-1])
    equal = (tree.points[tree.point[leaf]] == x).all()
    brings = 1.0 + tree.mass[leaf] if equal else 1.0

    def walk(n, beside):
        if tree.dim[n] < 0:
            gaps = np.concatenate([np.maximum(0, x - tree.high[n]), np.maximum(0, tree.low[n] - x)])
            if equal:
                return np.full(2 * d, brings / (2 * d)), (np.full(d, np.inf), np.full(d, -np.inf))
            return gaps / gaps.sum() * field(tree.mass[n], 1.0) * influence(gaps), beside
        left = x[tree.dim[n]] <= tree.value[n]
        below, (low, high) = walk(tree.left[n] if left else tree.right[n], beside)
        other = tree.right[n] if left else tree.left[n]
        if equal:
            low, high = np.minimum(low, tree.low[other]), np.maximum(high, tree.high[other])
            box = low, high
        else:
            box = tree.low[n], tree.high[n]
        gaps = np.concatenate([np.maximum(0, x - box[1]), np.maximum(0, box[0] - x)])
        whole = gaps.sum() + (box[1] - box[0]).sum()
        share = gaps / whole if whole > 0 else np.zeros(2 * d)
        return share * field(tree.mass[n], brings) * influence(gaps) + (1 - share.sum()) * below, (low, high)

    return walk(0, (None, None))[0]


@pytest.mark.parametrize("field,influence", [(np.add, np.ones_like), (lambda m, k: np.log1p(m) * k, lambda g: np.exp(-np.asarray(g)))])
def test_density_kernels_against_a_second_reading(model, field, influence):
    rng = np.random.default_rng(5)
    queries = np.concatenate([rng.normal(size=(15, 3)), model.trees[0].points[:10]])
    for t in model.trees[:4]:
        got = folds.traverse(t, queries, folds.Density(field, influence))[:, 0]
        assert np.allclose(got, [simple_density(t, x, field, influence) for x in queries])


def test_attributes_are_propagated(model):
    t = model.trees[0]
    labels = [{i % 3} for i in range(len(t.points))]
    got = t.propagate(labels, lambda a, b: a | b)
    assert got[0] == {0, 1, 2} and t.propagate([1] * len(labels), lambda a, b: a + b) == t.mass.tolist()
    for n in t.leaves:
        assert got[n] == {int(i) % 3 for i in t.members[n]}
