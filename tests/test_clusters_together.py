"""Numbers of many keys are clustered together as each set is alone, to the last bit."""

import random

import pytest

from arborstream.operators import cluster as cl
from arborstream.operators import lockstep
from arborstream.operators.glocal import GlobalLocal


def _sets(n: int) -> list[list[tuple[float, float]]]:
    rng = random.Random(5)
    kinds = [lambda: round(rng.expovariate(0.02), 2), lambda: float(rng.choice([1, 2, 3, 50])), lambda: rng.gauss(0, 1) + rng.choice([0, 10, 20]), lambda: float(rng.randrange(12))]
    return [[(kinds[k % 4](), 1.0 if k % 3 else rng.random()) for _ in range(rng.choice([1, 2, 5, 17, 32, 45]))] for k in range(n)]


def _plain(found: list[cl.Cluster]) -> list:
    return [(float(c.weight), float(c.spread), [(float(r), float(w)) for r, w in c.representatives]) for c in found]


@pytest.mark.parametrize("most, representatives, shrinkage", [(10, 3, 0.1), (4, 2, 0.0), (3, 4, 0.3)])
def test_sets_together_are_sets_alone(most, representatives, shrinkage):
    sets = _sets(40)
    got = cl.many_on_line(sets, most, representatives, shrinkage, seed=3)
    for items, found in zip(sets, got, strict=True):
        assert _plain(found) == _plain(cl.cluster(items, most, cl.line, representatives=representatives, shrinkage=shrinkage, seed=3))


def test_empty_sets_and_items_that_are_not_finite():
    assert cl.many_on_line([[], [(1.0, 0.0)]], 3, 2, 0.1) == [[], []]
    assert [len(f) for f in cl.many_on_line([[], [(1.0, 1.0)]], 3, 2, 0.1)] == [0, 1]
    with pytest.raises(ValueError):
        cl.many_on_line([[(float("nan"), 1.0)]], 3, 2, 0.1)


def test_keys_of_glocal_are_clustered_together(monkeypatch):
    taken = []
    many = cl.many_on_line
    monkeypatch.setattr("arborstream.operators.glocal.many_on_line", lambda sets, *rest: taken.append(len(sets)) or many(sets, *rest))

    def start(distance):
        def begin(key, seat):
            g = GlobalLocal(distance, capacity=12, clusters_most=4, recluster_after=6, seed=key)

            def step(row):
                r = yield from g.asking(row[1])
                return [(row[0], float(r["score"]), float(r["threshold"]), float(r["grade"]), len(r["representatives"]))]

            return step

        return begin

    rng = random.Random(2)
    rows = [(k, round(rng.expovariate(0.1), 1) + (40 if rng.random() < 0.05 else 0)) for k in range(9) for _ in range(40 - k)]
    play = lambda distance, thin: [r for o in lockstep._played(iter([([k for k, _ in rows], rows)]), start(distance), thin) for r in o]
    alone = play(lambda a, b: abs(a - b), 100)
    assert not taken
    assert play(cl.line, 1) == alone
    assert max(taken) == 9 and len(alone) == len(rows)
