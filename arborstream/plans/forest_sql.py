"""The whole model in SQL: sample, trees and scores of two-dimensional points.

Each level of the recursion boxes the sample rows of a node, draws its cut and
routes sample and query rows alike; a query's levels are folded from leaf to
root.  DuckDB runs it as the oracle of the forest operators.
"""

from __future__ import annotations

from ..functions.uniforms import uniform_sql


def sample_sql(source: str, trees: int, capacity: int, decay: float, seed: int, sequence: str = "seq") -> str:
    """CTEs `drawn` and `sample` (tree, seq, x0, x1) of `source` (seq, x0, x1)."""
    u = uniform_sql(str(seed), "t.tree", f"s.{sequence}")
    return f"""
drawn AS (
  SELECT s.*, t.tree::INTEGER AS tree, ln(-ln({u})) - s.{sequence} * {decay!r} AS sample_key
  FROM {source} s, range({trees}) t(tree)),
sample AS (
  SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY sample_key, {sequence}) AS rk FROM drawn)
  WHERE rk <= {capacity})"""


def levels_sql(queries: str, seed: int, number: str = "tree", meets: str = "TRUE") -> str:
    """Recursive CTE `walk`: every row of `sample` and of `queries` (seq, x0, x1) at each level, and `box` with its node's values.

    number: what stands for the tree in its uniforms; meets: which trees (t) a query (q) walks.
    """
    u = uniform_sql(str(seed), number, "path")
    return f"""
walk AS (
  SELECT tree, seq, x0, x1, FALSE AS isq, '' AS path, 0 AS depth FROM sample
  UNION ALL
  SELECT t.tree, q.seq, q.x0, q.x1, TRUE, '', 0 FROM {queries} q, (SELECT DISTINCT tree FROM sample) t WHERE {meets}
  UNION ALL
  SELECT tree, seq, x0, x1, isq,
         path || CASE WHEN CASE WHEN r0 > 0 AND brk <= r0 THEN x0 <= least(lo0 + brk, hi0) ELSE x1 <= lo1 + (brk - r0) END THEN 'L' ELSE 'R' END,
         depth + 1
  FROM (
    SELECT *, hi0 - lo0 AS r0, hi1 - lo1 AS r1, {u} * ((hi0 - lo0) + (hi1 - lo1)) AS brk
    FROM (
      SELECT *, min(x0) FILTER (NOT isq) OVER p AS lo0, max(x0) FILTER (NOT isq) OVER p AS hi0,
             min(x1) FILTER (NOT isq) OVER p AS lo1, max(x1) FILTER (NOT isq) OVER p AS hi1
      FROM walk WINDOW p AS (PARTITION BY tree, path)))
  WHERE r0 + r1 > 0),
box AS (
  SELECT *, greatest(0, x0 - hi0) AS up0, greatest(0, x1 - hi1) AS up1, greatest(0, lo0 - x0) AS dn0, greatest(0, lo1 - x1) AS dn1,
         (hi0 - lo0) + (hi1 - lo1) AS width,
         max(depth) OVER (PARTITION BY tree, seq, isq) AS last
  FROM (
    SELECT *, count(*) FILTER (NOT isq) OVER p AS mass,
           min(x0) FILTER (NOT isq) OVER p AS lo0, max(x0) FILTER (NOT isq) OVER p AS hi0,
           min(x1) FILTER (NOT isq) OVER p AS lo1, max(x1) FILTER (NOT isq) OVER p AS hi1
    FROM walk WINDOW p AS (PARTITION BY tree, path)))"""


def scores_sql(leaf_equal: str, leaf_other: str, up: str, finish: str) -> str:
    """CTE `scored` (seq, tree, score) by score functions of d (depth), m (mass) and t (the tree's mass)."""

    def at(text: str) -> str:
        return text.replace("{d}", "v.d").replace("{m}", "v.m").replace("{t}", "v.t")

    return f"""
folded AS (
  SELECT seq, tree, max(t) AS t, list({{'d': depth, 'm': mass, 's': gap, 'w': width, 't': t, 'acc': 0.0::DOUBLE, 'leaf': depth = last}} ORDER BY depth DESC) AS steps
  FROM (SELECT *, up0 + up1 + dn0 + dn1 AS gap, max(mass) OVER (PARTITION BY tree) AS t FROM box) WHERE isq GROUP BY seq, tree),
scored AS (
  SELECT seq, tree, t,
    list_reduce(
      list_transform(steps, lambda v: {{'d': v.d, 'm': v.m, 's': v.s, 'w': v.w, 't': v.t, 'leaf': v.leaf,
        'acc': CASE WHEN v.leaf THEN (CASE WHEN v.s = 0 THEN {at(leaf_equal)} ELSE {at(leaf_other)} END) ELSE 0.0 END::DOUBLE}}),
      lambda a, v: {{'d': v.d, 'm': v.m, 's': v.s, 'w': v.w, 't': v.t, 'leaf': v.leaf,
        'acc': (CASE WHEN v.s = 0 THEN a.acc ELSE v.s / (v.s + v.w) * ({at(up)}) + (1 - v.s / (v.s + v.w)) * a.acc END)::DOUBLE}}
    ).acc AS raw
  FROM folded),
per_tree AS (SELECT seq, tree, {finish} AS score FROM scored)"""


def steps_sql() -> str:
    """CTEs `nodes` (tree, path and its box) and `steps`: each query's levels, where one that equals its leaf's point sees the boxes beside its path instead of its own."""
    ends = "lo0, hi0, lo1, hi1".split(", ")
    return f"""
nodes AS (
  SELECT tree, path, min(depth) AS depth, count(*) AS mass, min(seq) AS id, min(x0) AS lo0, max(x0) AS hi0, min(x1) AS lo1, max(x1) AS hi1
  FROM walk WHERE NOT isq GROUP BY tree, path),
ends AS (SELECT seq, tree, path, mass AS leaf_mass, up0 + up1 + dn0 + dn1 = 0 AS equal FROM box WHERE isq AND depth = last),
beside AS (
  SELECT b.seq, b.tree, b.depth - 1 AS depth, {', '.join(f'n.{e}' for e in ends)}
  FROM box b JOIN ends e ON e.seq = b.seq AND e.tree = b.tree
  JOIN nodes n ON n.tree = b.tree AND n.path = left(b.path, b.depth - 1) || CASE WHEN right(b.path, 1) = 'L' THEN 'R' ELSE 'L' END
  WHERE b.isq AND b.depth > 0 AND e.equal),
shadow AS (
  SELECT seq, tree, depth, {', '.join(f"{'min' if e[0] == 'l' else 'max'}({e}) OVER w AS {e}" for e in ends)}
  FROM beside WINDOW w AS (PARTITION BY seq, tree ORDER BY depth DESC)),
seen AS (
  SELECT b.seq, b.tree, b.depth, b.mass, b.depth = b.last AS leaf, b.x0, b.x1, e.equal, {', '.join(f'coalesce(s.{e}, b.{e}) AS {e}' for e in ends)}
  FROM box b JOIN ends e ON e.seq = b.seq AND e.tree = b.tree LEFT JOIN shadow s ON s.seq = b.seq AND s.tree = b.tree AND s.depth = b.depth
  WHERE b.isq),
steps AS (
  SELECT *, s / (s + w) AS p FROM (
    SELECT *, g[1] + g[2] + g[3] + g[4] AS s FROM (
      SELECT v.*, t.mass AS t, (hi0 - lo0) + (hi1 - lo1) AS w, [hi0 - lo0, hi1 - lo1, hi0 - lo0, hi1 - lo1] AS r,
        [greatest(0, x0 - hi0), greatest(0, x1 - hi1), greatest(0, lo0 - x0), greatest(0, lo1 - x1)]::DOUBLE[] AS g
      FROM seen v JOIN (SELECT tree, mass FROM nodes WHERE path = '') t ON t.tree = v.tree)))"""


def fold_sql(start: dict[str, str], at_leaf: dict[str, str], up: dict[str, str]) -> str:
    """CTE `folds` (seq, tree, t, a): the values named in `start` at the leaf, then at each level above from those below.

    Expressions see a step's columns as v.<name> and the values below as a.<name>.
    """
    step = ", ".join(f"'{c}': v.{c}" for c in ("d", "m", "t", "leaf", "eq", "s", "w", "p", "g", "r"))
    raw = "'d': depth, 'm': mass, 't': t, 'leaf': leaf, 'eq': equal, 's': s, 'w': w, 'p': coalesce(p, 0), 'g': g, 'r': r"
    return f"""
folds AS (
  SELECT seq, tree, t, list_reduce(
    list_transform(levels, lambda v: {{{step}, {', '.join(f"'{k}': CASE WHEN v.leaf THEN {at_leaf[k]} ELSE v.{k} END" for k in start)}}}),
    lambda a, v: {{{step}, {', '.join(f"'{k}': {e}" for k, e in up.items())}}}) AS a
  FROM (SELECT seq, tree, max(t) AS t, list({{{raw}, {', '.join(f"'{k}': {e}" for k, e in start.items())}}} ORDER BY depth DESC) AS levels FROM steps GROUP BY seq, tree))"""


_LIST = "[0.0, 0.0, 0.0, 0.0]::DOUBLE[]"


def attribution_sql(seen: str, unseen: str, damp: str) -> str:
    """`folds` with c, the score, and a, its parts before they are brought to its sum."""
    return fold_sql(
        {"c": "0.0::DOUBLE", "a": _LIST},
        {
            "c": f"(CASE WHEN v.eq THEN {damp} * ({seen}) ELSE {unseen} END)::DOUBLE",
            "a": f"CASE WHEN v.eq THEN list_transform(v.g, lambda g: {damp} * ({seen}) / 4) ELSE list_transform(v.g, lambda g: g / v.s * ({unseen})) END",
        },
        {
            "c": f"(CASE WHEN v.eq THEN a.c ELSE v.p * ({unseen}) + (1 - v.p) * a.c END)::DOUBLE",
            "a": f"CASE WHEN v.s = 0 THEN a.a ELSE list_transform(list_zip(v.g, a.a), lambda z: z[1] / (v.s + v.w) * ({unseen}) + (1 - v.p) * z[2]) END",
        },
    )


def density_sql(field: str = "{m} + {k}", influence: str = "1") -> str:
    """`folds` with the leaf's mass k, and by direction the measure x, the probability q and the distance y.

    field: what a separation at a node of mass {m} is worth to what the leaf brings, {k}; influence: its weight at a distance {g}.
    """
    worth = lambda m, k, g: f"({field.format(m=m, k=k)}) * ({influence.format(g=g)})"
    zip3 = lambda old, new: f"list_transform(list_zip(v.g, {old}, v.r), lambda z: {new})"
    each, stay = "(CASE WHEN v.s = 0 THEN 0 ELSE z[1] / (v.s + v.w) END)", "(1 - v.p)"
    share = "(CASE WHEN v.s = 0 THEN 0 ELSE g / v.s END)"
    return fold_sql(
        {"k": "0.0::DOUBLE", "x": _LIST, "q": _LIST, "y": _LIST},
        {
            "k": "(CASE WHEN v.eq THEN 1 + v.m ELSE 1 END)::DOUBLE",
            "x": f"list_transform(v.g, lambda g: CASE WHEN v.eq THEN (1 + v.m) / 4.0 ELSE {share} * {worth('v.m', '1', 'g')} END)",
            "q": f"list_transform(v.g, lambda g: CASE WHEN v.eq THEN 0.25 ELSE {share} END)",
            "y": f"list_transform(v.g, lambda g: CASE WHEN v.eq THEN 0.0 ELSE {share} * g END)",
        },
        {
            "k": "a.k",
            "x": zip3("a.x", f"{each} * {worth('v.m', 'a.k', 'z[1]')} + {stay} * z[2]"),
            "q": zip3("a.q", f"{each} + {stay} * z[2]"),
            "y": zip3("a.y", f"{each} * (z[1] + z[3]) + {stay} * z[2]"),
        },
    )


def cuts_sql(seed: int) -> str:
    """CTE `cuts`: nodes with the dimension (-1: none) and the place of their cut; needs `nodes`."""
    return f"""
cuts AS (
  SELECT *, CASE WHEN r0 + r1 = 0 THEN -1 WHEN r0 > 0 AND brk <= r0 THEN 0 ELSE 1 END AS dim,
    CASE WHEN r0 > 0 AND brk <= r0 THEN least(lo0 + brk, hi0) ELSE lo1 + (brk - r0) END AS cut
  FROM (SELECT *, hi0 - lo0 AS r0, hi1 - lo1 AS r1, {uniform_sql(str(seed), 'tree', 'path')} * ((hi0 - lo0) + (hi1 - lo1)) AS brk FROM nodes))"""


def conditional_sql(name: str, queries: str) -> str:
    """CTE `name` (qid, tree, id, far, l0, l1): of each tree the sample point that fits x0 of each row (qid, x0) of `queries` best; needs `cuts`.

    Both sides of a cut in x1 are tried; then, level by level upwards, the side of lower rank stays.
    """
    return f"""
{name}_down AS (
  SELECT q.qid, q.x0, n.tree, ''::VARCHAR AS path, 0 AS depth FROM {queries} q, (SELECT DISTINCT tree FROM cuts) n
  UNION ALL
  SELECT d.qid, d.x0, d.tree, d.path || side, d.depth + 1
  FROM {name}_down d JOIN cuts c ON c.tree = d.tree AND c.path = d.path, (VALUES ('L'), ('R')) s(side)
  WHERE c.dim = 1 OR (c.dim = 0 AND side = CASE WHEN d.x0 <= c.cut THEN 'L' ELSE 'R' END)),
{name}_up AS (
  SELECT d.qid, d.x0, d.tree, d.path, d.depth, c.id, abs(c.lo0 - d.x0) AS far, c.lo0 AS l0, c.lo1 AS l1,
    CASE WHEN c.lo0 = d.x0 THEN 0.0 ELSE 1.0 / (d.depth + 1) END::DOUBLE AS rank, max(d.depth) OVER () AS lvl
  FROM {name}_down d JOIN cuts c ON c.tree = d.tree AND c.path = d.path WHERE c.dim = -1
  UNION ALL
  SELECT qid, x0, tree, up AS path, d AS depth, id, far, l0, l1, (CASE WHEN NOT lifted OR s = 0 THEN rank ELSE s / (s + w) / (d + 1) + (1 - s / (s + w)) * rank END)::DOUBLE, lvl - 1
  FROM (
    SELECT b.*, greatest(0, b.x0 - c.hi0) + greatest(0, c.lo0 - b.x0) + greatest(0, b.l1 - c.hi1) + greatest(0, c.lo1 - b.l1) AS s, c.r0 + c.r1 AS w
    FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, tree, up ORDER BY lifted DESC, rank, path) AS place
      FROM (SELECT *, depth = lvl AS lifted, CASE WHEN depth = lvl THEN left(path, lvl - 1) ELSE path END AS up, CASE WHEN depth = lvl THEN lvl - 1 ELSE depth END AS d FROM {name}_up WHERE lvl > 0)) b
    JOIN cuts c ON c.tree = b.tree AND c.path = b.up WHERE place = 1 OR NOT lifted)),
{name} AS (SELECT qid, tree, id, far, l0, l1 FROM {name}_up WHERE lvl = 0)"""


def imputed_sql(name: str, source: str, shares: dict[str, float]) -> str:
    """CTE `name` (qid, a column a share): over the trees' points of `source` the x1 at each share."""
    at = lambda s: f"list_sort(list(l1))[greatest(1, ceil({s} * count(*)))::INTEGER]"
    return f"{name} AS (SELECT qid, {', '.join(f'{at(s)} AS {n}' for n, s in shares.items())} FROM {source} GROUP BY qid)"
