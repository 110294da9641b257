"""Attribution of every row, sampled values too, against a scalar walk over the points below each node."""

import math

import numpy as np

from arborstream.plans.forests import QUERIES, model


def below(t, n):
    return t.points[t.members[n]] if t.dim[n] < 0 else np.concatenate([below(t, t.left[n]), below(t, t.right[n])])


def naive(t, x):
    """(score, parts) of one tree, before the normalizer."""
    points = {n: below(t, n) for n in range(len(t.dim))}

    def visit(n):
        d, m = int(t.depth[n]), int(t.mass[n])
        if t.dim[n] < 0:
            gaps = np.concatenate([np.maximum(0, x - t.low[n]), np.maximum(0, t.low[n] - x)])
            if not gaps.any():
                s = (1 - m / (2 * t.total)) / (d + math.log2(m + 1))
                return s, np.full(2 * len(x), s / (2 * len(x))), True
            return 1 / (d + 1), gaps / gaps.sum() / (d + 1), False
        s, parts, equal = visit(t.left[n] if x[t.dim[n]] <= t.value[n] else t.right[n])
        p = points[n]
        if equal:  # as if the point were not there
            p = p[(p != x).any(axis=1)]
        low, high = p.min(axis=0), p.max(axis=0)
        gaps = np.concatenate([np.maximum(0, x - high), np.maximum(0, low - x)])
        whole = gaps.sum() + (high - low).sum()
        if not gaps.any():
            return s, parts, equal
        share = gaps.sum() / whole
        return s if equal else share / (d + 1) + (1 - share) * s, gaps / whole / (d + 1) + (1 - share) * parts, equal

    s, parts, _ = visit(0)
    return parts * s / parts.sum() * math.log2(t.total + 1)


def test_every_row_has_its_parts(spark, sf):
    p, f = model(spark, sf)
    rows = {r.seq: np.array([r.x0, r.x1]) for r in p.collect()}
    got = {r.seq: np.array([r.high0, r.high1, r.low0, r.low1]) for r in QUERIES["forest_attribution_all"](spark, sf).collect()}
    assert got.keys() == rows.keys()
    taken = {tuple(x) for t in f.trees for x in t.points.tolist()}
    known = [i for i, x in rows.items() if tuple(x) in taken]
    assert known
    for i in [*known[:60], *[i for i in rows if i not in set(known)][:60]]:
        want = sum(naive(t, rows[i]) for t in f.trees) / len(f.trees)
        assert np.allclose(got[i], want, atol=2e-6), i
    rest = {r.seq for r in QUERIES["forest_attribution"](spark, sf).collect()}
    assert rest == set(rows) - set(known)
