"""Interpolated density of the stream forest, the predictive forest and the command line."""

import argparse
import random

import numpy as np

from arborstream.cli import COMMANDS, stepper
from arborstream.operators import folds
from arborstream.operators.detector import StreamForest
from arborstream.operators.predictive import PredictiveForest
from arborstream.operators.trees import Tree


def arrays(t):
    """A dynamic tree as the arrays that the batch fold walks."""
    nodes, todo = [], [(t.root, 0)]
    while todo:
        n, d = todo.pop()
        nodes.append((n, d))
        if n.dim >= 0:
            todo += [(n.left, d + 1), (n.right, d + 1)]
    at = {id(n): i for i, (n, _) in enumerate(nodes)}
    leaves = [n.point for n, _ in nodes if n.dim < 0]
    place = {p: i for i, p in enumerate(leaves)}
    column = lambda f: np.array([f(n) for n, _ in nodes])
    side = lambda k: column(lambda n: at[id(getattr(n, k))] if n.dim >= 0 else -1)
    return Tree(
        column(lambda n: n.dim), column(lambda n: n.cut), side("left"), side("right"), column(lambda n: -1), np.array([d for _, d in nodes]), column(lambda n: n.mass),
        column(lambda n: n.low).astype(float), column(lambda n: n.high).astype(float), column(lambda n: place.get(n.point, -1)), [], np.array(leaves), [],
    )


def grown(n=600):
    rng = random.Random(4)
    f = StreamForest(12, 64, 0.0, 3)
    for i in range(n):
        # a third of the rows are one value
        f.update((1.0, 1.0) if i % 3 == 0 else (rng.gauss(0, 1), rng.gauss(0, 1)))
    return f


def test_it_is_the_batch_fold_over_the_trees():
    f = grown()
    trees = [arrays(t) for t in f.trees]
    for x in [(0.1, 0.2), (5.0, -1.0), (1.0, 1.0), f.samples[0][5][2]]:
        want = sum(folds.traverse(t, np.array([x]), folds.Density())[0] for t in trees) / len(trees)
        assert np.allclose(f.interpolation(x), want)
        measure, distance, mass = want
        assert abs(mass.sum()) <= 1 + 1e-9
        p, far = mass[:2] + mass[2:], distance[:2] + distance[2:]
        points = measure.sum() / 64
        volume = sum(b * (a / b) ** 2 for a, b in zip(far, p) if b > 0)
        assert np.isclose(f.density(x), points / (0.001 * points + volume))


def test_mass_and_direction_count():
    f = grown()
    copies, lone = f.density((1.0, 1.0)), f.density(min((s[2] for s in f.samples[0]), key=sum))
    assert np.isfinite(copies) and copies > lone
    up = f.directional_density((6.0, 0.0))
    assert len(up) == 4 and int(np.argmax(up)) == 0 and np.isclose(sum(up), f.density((6.0, 0.0)))
    assert f.density((0.3, 0.3)) > 10 * f.density((6.0, 6.0))
    assert StreamForest(2, 64, 0.0, 1).density((1.0, 1.0)) == 0.0


def test_an_equal_point_has_mass_one():
    same = folds.traverse(arrays(grown(1).trees[0]), np.array([[1.0, 1.0]]), folds.Density())[0]
    assert np.allclose(same[2], 0.25) and np.allclose(same[0], 0.25 * 2) and not same[1].any()


def test_predictive_forest_and_command_line():
    p = PredictiveForest(2, 12, 64, seed=3)
    for i in range(200):
        p.update([1.0, 2.0] if i % 2 else [i / 100, 2 - i / 100])
    assert np.isfinite(p.density([1.0, 2.0])) and np.isclose(sum(p.directional_density([1.0, 2.0])), p.density([1.0, 2.0]))
    assert "directional-density" in COMMANDS
    args = argparse.Namespace(number_of_trees=10, sample_size=16, window_size=0, random_seed=1, shingle_size=1, shingle_cyclic=False)
    for command, cells in (("density", 1), ("directional-density", 4)):
        step = stepper(command, args)(None)
        got = [step((i, [], [1.0, float(i % 2)]))[0][2] for i in range(40)]
        assert len(got[-1]) == cells and np.isfinite(got[-1]).all() and got[0] is None
