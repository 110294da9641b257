"""Queries of the forest operators.

Those on two-dimensional shingles have the whole model in DuckDB SQL as their
oracle; the one on embeddings is held by invariants in the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uniforms import uniform_sql
from ..operators import folds, shingle
from ..operators import forest as fo
from ..operators.forest import Forest
from ..operators.sampler import reservoir
from ..operators.trees import build
from ..sources import snapshot
from .forest_sql import attribution_sql, conditional_sql, cuts_sql, density_sql, fold_sql, imputed_sql, levels_sql, sample_sql, scores_sql, steps_sql
from .relational import EV, ORDER, Query, events, six, sql_six, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TREES, CAPACITY, SEED = 4, 64, 11
DECAY = 1 / 640


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two values: seq (event_id), user_id, x0, x1."""
    two = shingle.linear(events(spark, sf_dir), "user_id", ORDER, ["value"], 2)
    return two.select(F.col("event_id").alias("seq"), "user_id", F.get("shingle", F.lit(0)).alias("x0"), F.get("shingle", F.lit(1)).alias("x1"))


PAIRS = f"{EV}, pairs AS (SELECT * FROM (SELECT event_id AS seq, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY rn) AS x0, value AS x1 FROM ev) WHERE x0 IS NOT NULL)"
_MODEL = f"WITH RECURSIVE {PAIRS}, {sample_sql('(SELECT seq, x0, x1 FROM pairs)', TREES, CAPACITY, DECAY, SEED)}, {levels_sql('(SELECT seq, x0, x1 FROM pairs)', SEED)}"
_NONE = f"WITH RECURSIVE {PAIRS}, {sample_sql('(SELECT seq, x0, x1 FROM pairs)', TREES, CAPACITY, DECAY, SEED)}, {levels_sql('(SELECT seq, x0, x1 FROM pairs WHERE FALSE)', SEED)}"


def model(spark: SparkSession, sf_dir: str, trees: int = TREES, capacity: int = CAPACITY) -> tuple[DataFrame, Forest]:
    p = pairs(spark, sf_dir)
    return p, fo.fit(p, ["x0", "x1"], "seq", trees, capacity, DECAY, SEED)


@query(f"{_NONE} SELECT tree, path, min(depth) AS depth, count(*) AS mass, {sql_six('min(x0)')} AS lo0, {sql_six('max(x0)')} AS hi0, {sql_six('min(x1)')} AS lo1, {sql_six('max(x1)')} AS hi1 FROM walk GROUP BY tree, path")
def forest_nodes(spark, sf_dir):
    """Every tree is built in a task of its own from its sample."""
    sample = reservoir(pairs(spark, sf_dir), TREES, CAPACITY, "seq", DECAY, SEED)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        t = build(pdf[["x0", "x1"]].to_numpy(), int(pdf["tree"].iloc[0]), SEED)
        return pd.DataFrame(
            {"tree": int(pdf["tree"].iloc[0]), "path": t.path, "depth": t.depth, "mass": t.mass, "lo0": t.low[:, 0], "hi0": t.high[:, 0], "lo1": t.low[:, 1], "hi1": t.high[:, 1]}
        )

    nodes = sample.groupBy("tree").applyInPandas(one, "tree int, path string, depth int, mass long, lo0 double, hi0 double, lo1 double, hi1 double")
    return nodes.select("tree", "path", "depth", "mass", *[six(c).alias(c) for c in ("lo0", "hi0", "lo1", "hi1")])


@query(f"{_NONE} SELECT tree, path, {sql_six('sum(x0) / count(*)')} AS c0, {sql_six('sum(x1) / count(*)')} AS c1 FROM walk GROUP BY tree, path")
def forest_center_of_mass(spark, sf_dir):
    sample = reservoir(pairs(spark, sf_dir), TREES, CAPACITY, "seq", DECAY, SEED)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        t = build(pdf[["x0", "x1"]].to_numpy(), int(pdf["tree"].iloc[0]), SEED)
        c = t.centre_of_mass()
        return pd.DataFrame({"tree": int(pdf["tree"].iloc[0]), "path": t.path, "c0": c[:, 0], "c1": c[:, 1]})

    got = sample.groupBy("tree").applyInPandas(one, "tree int, path string, c0 double, c1 double")
    return got.select("tree", "path", six("c0").alias("c0"), six("c1").alias("c1"))


_DAMP = "(1 - {m} / (2.0 * {t}))"
_SCORE = scores_sql(f"{_DAMP} * (1.0 / ({{d}} + log2({{m}} + 1)))", "1.0 / ({d} + 1)", "1.0 / ({d} + 1)", "raw * log2(t + 1)")
_DISPLACED = scores_sql(f"{_DAMP} * (1.0 / ({{m}} + 1))", "{m}", "{m}", "raw / (1.0 + t)")
_HEIGHT = scores_sql("{d} + ln({m})", "{d}", "{d}", "raw")
_MEAN = f"SELECT seq, floor(sum(score) / {TREES} * 1e6 + 0.5) / 1e6 AS score FROM per_tree GROUP BY seq"


def _scored(df: DataFrame, forest: Forest, answer) -> DataFrame:
    got = fo.ask(df, forest, ["x0", "x1"], answer, ["seq"], "seq long, score double", ["score"])
    return got.select("seq", six("score").alias("score"))


@query(f"{_MODEL}, {_SCORE} {_MEAN}")
def forest_score(spark, sf_dir):
    """Shingles, reservoir samples, trees and anomaly scores of all events."""
    p, f = model(spark, sf_dir)
    return _scored(p, f, lambda m, q: m.score(q))


@query(f"{_MODEL}, {_DISPLACED} {_MEAN}")
def forest_displacement(spark, sf_dir):
    p, f = model(spark, sf_dir)
    return _scored(p, f, lambda m, q: m.fold(q, folds.displacement))


@query(f"{_MODEL}, {_HEIGHT} {_MEAN}")
def forest_height(spark, sf_dir):
    p, f = model(spark, sf_dir)
    return _scored(p, f, lambda m, q: m.fold(q, folds.height))


@query(
    f"""{_MODEL}, leafs AS (SELECT tree, path, min(seq) AS near, min(x0) AS l0, min(x1) AS l1 FROM walk WHERE NOT isq GROUP BY tree, path HAVING count(*) >= 1),
ends AS (SELECT b.seq, b.tree, b.path, b.x0, b.x1 FROM box b WHERE isq AND depth = last),
far AS (SELECT seq, l.near, sqrt(pow(a.x0 - l.l0, 2) + pow(a.x1 - l.l1, 2)) AS d FROM ends a JOIN leafs l USING (tree, path))
SELECT seq, near, {sql_six('min(d)')} AS d, count(*) AS trees FROM far WHERE d < 5 GROUP BY seq, near"""
)
def forest_leaf_neighbors(spark, sf_dir):
    """Leaf points nearer than 5 over all trees, and how many trees lead there."""
    p, f = model(spark, sf_dir)
    held = spark.sparkContext.broadcast(f)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seq = batch.column(0).to_numpy()
            q = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            for t, ids in zip(held.value.trees, held.value.point_ids, strict=True):
                at, far = folds.neighbours(t, q)
                ok = far < 5
                yield pa.RecordBatch.from_arrays([pa.array(seq[ok]), pa.array(ids[at[ok]]), pa.array(far[ok])], names=["seq", "near", "d"])

    each = p.select("seq", "x0", "x1").mapInArrow(run, "seq long, near long, d double")
    return each.groupBy("seq", "near").agg(six(F.min("d")).alias("d"), F.count("*").alias("trees"))


_ATTR = f"""{_MODEL}, folded AS (
  SELECT seq, tree, list({{'d': depth, 's': up0 + up1 + dn0 + dn1, 'w': width, 't': t, 'm': mass, 'g': [up0, up1, dn0, dn1], 'leaf': depth = last, 'a': [0.0, 0.0, 0.0, 0.0]::DOUBLE[]}} ORDER BY depth DESC) AS steps
  FROM (SELECT *, max(mass) OVER (PARTITION BY tree) AS t, max(CASE WHEN depth = last AND up0 + up1 + dn0 + dn1 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tree, seq, isq) AS dup FROM box) WHERE isq AND dup = 0 GROUP BY seq, tree),
att AS (SELECT seq, tree, list_reduce(list_transform(steps, lambda v: {{'d': v.d, 's': v.s, 'w': v.w, 't': v.t, 'm': v.m, 'g': v.g, 'leaf': v.leaf,
      'a': CASE WHEN v.leaf THEN list_transform(v.g, lambda g: g / v.s / (v.d + 1)) ELSE v.a END}}),
    lambda a, v: {{'d': v.d, 's': v.s, 'w': v.w, 't': v.t, 'm': v.m, 'g': v.g, 'leaf': v.leaf,
      'a': list_transform(list_zip(v.g, a.a), lambda z: z[1] / (v.s + v.w) / (v.d + 1) + (1 - v.s / (v.s + v.w)) * z[2])}}) AS r FROM folded)
SELECT seq, {', '.join(sql_six(f"sum(r.a[{i + 1}] * log2(r.t + 1)) / {TREES}") + f" AS {n}" for i, n in enumerate(("high0", "high1", "low0", "low1")))}
FROM att GROUP BY seq HAVING count(*) = {TREES}"""


@query(_ATTR)
def forest_attribution(spark, sf_dir):
    """The parts of the score above and below in each dimension, of rows that are in no sample."""
    p, f = model(spark, sf_dir)
    taken = sorted({tuple(x) for t in f.trees for x in t.points.tolist()})
    known = spark.createDataFrame(taken, "x0 double, x1 double")  # trees x capacity points at most
    rest = p.join(F.broadcast(known), ["x0", "x1"], "left_anti")
    got = fo.attribute(rest, f, ["x0", "x1"], ["seq"])
    return got.select("seq", *[six(c).alias(c) for c in ("high0", "high1", "low0", "low1")])


_STEPS = f"{_MODEL}, {steps_sql()}"
_NODES = f"{_NONE}, nodes AS (SELECT tree, path, min(depth) AS depth, count(*) AS mass, min(seq) AS id, min(x0) AS lo0, max(x0) AS hi0, min(x1) AS lo1, max(x1) AS hi1 FROM walk GROUP BY tree, path), {cuts_sql(SEED)}"
_SIDES = ("high0", "high1", "low0", "low1")
_LAST = "last_pair AS (SELECT user_id, max_by(x0, seq) AS x0, max_by(x1, seq) AS x1 FROM pairs GROUP BY user_id)"


def _sides(each: str) -> str:
    return ", ".join(f"{sql_six(each.replace('#', str(i + 1)))} AS {n}" for i, n in enumerate(_SIDES))


def _by_side(df: DataFrame) -> DataFrame:
    return df.select("seq", *[six(n).alias(n) for n in _SIDES])


_PARTS = attribution_sql("1.0 / (v.d + log2(v.m + 1))", "1.0 / (v.d + 1)", "(1 - v.m / (2.0 * v.t))")
_DYNAMIC_PARTS = attribution_sql("pow(2.0, -v.d)", "pow(2.0, -v.d)", "1.0")


@query(f"{_STEPS}, {_PARTS} SELECT seq, {_sides(f'sum(a.a[#] * a.c * log2(t + 1) / list_sum(a.a)) / {TREES}')} FROM folds GROUP BY seq")
def forest_attribution_all(spark, sf_dir):
    """As forest_attribution, of every row: those equal to a sampled point look at the boxes beside it."""
    p, f = model(spark, sf_dir)
    return _by_side(fo.attribute(p, f, ["x0", "x1"], ["seq"]))


@query(f"{_STEPS}, {_PARTS}, {_SCORE.replace('folded', 'score_folded')} SELECT a.seq, {sql_six(f'sum(a.score) / {TREES}')} AS score, {sql_six(f'sum(b.a.c * log2(b.t + 1)) / {TREES}')} AS parts FROM per_tree a JOIN folds b ON a.seq = b.seq AND a.tree = b.tree GROUP BY a.seq")
def forest_attribution_total(spark, sf_dir):
    """Every row's score beside the sum of its parts, sample rows too."""
    p, f = model(spark, sf_dir)
    both = lambda m, q: np.stack([m.score(q), m.attribution(q).sum(axis=1)], axis=1)
    got = fo.ask(p, f, ["x0", "x1"], both, ["seq"], "seq long, score double, parts double", ["score", "parts"])
    return got.select("seq", six("score").alias("score"), six("parts").alias("parts"))


def _dynamic() -> folds.Score:
    return folds.Score(lambda d, m: np.exp2(-d), lambda d, m: np.exp2(-d), lambda a, b: 1.0, lambda s, t: s, ignore_mass=1)


@query(
    f"""{_STEPS}, {fold_sql({"c": "0.0::DOUBLE"}, {"c": "pow(2.0, -v.d)"}, {"c": "(v.p * pow(2.0, -v.d) + (1 - v.p) * a.c)::DOUBLE"})}
SELECT seq, {sql_six(f'sum(a.c) / {TREES}')} AS score FROM folds GROUP BY seq"""
)
def forest_dynamic_score(spark, sf_dir):
    """Scores by functions that the caller gives, with light leaves ignored."""
    p, f = model(spark, sf_dir)
    return _scored(p, f, lambda m, q: m.fold(q, _dynamic, ignore_mass=1))


@query(f"{_STEPS}, {_DYNAMIC_PARTS} SELECT seq, {_sides(f'sum(a.a[#] * a.c / list_sum(a.a)) / {TREES}')} FROM folds GROUP BY seq")
def forest_dynamic_attribution(spark, sf_dir):
    p, f = model(spark, sf_dir)
    make = lambda: folds.Attribution(lambda d, m: np.exp2(-d), lambda d, m: np.exp2(-d), lambda a, b: 1.0, lambda s, t: s)
    return _by_side(fo.ask(p, f, ["x0", "x1"], lambda m, q: m.fold(q, make), ["seq"], "seq long, " + ", ".join(f"{n} double" for n in _SIDES), list(_SIDES)))


_SQUARES = "pow(hi0 - lo0, 2) + pow(hi1 - lo1, 2)"
_GROWN = "pow(greatest(hi0, x0) - least(lo0, x0), 2) + pow(greatest(hi1, x1) - least(lo1, x1), 2)"


@query(
    f"""{_MODEL}, folded AS (
  SELECT seq, tree, max(t) AS t, list({{'d': depth, 'm': mass, 's': gap, 'p': CASE WHEN grown > 0 THEN (grown - inside) / grown ELSE 0 END, 't': t, 'acc': 0.0::DOUBLE, 'leaf': depth = last}} ORDER BY depth DESC) AS steps
  FROM (SELECT *, up0 + up1 + dn0 + dn1 AS gap, {_SQUARES} AS inside, {_GROWN} AS grown, max(mass) OVER (PARTITION BY tree) AS t FROM box) WHERE isq GROUP BY seq, tree),
scored AS (SELECT seq, tree, t, list_reduce(
  list_transform(steps, lambda v: {{'d': v.d, 'm': v.m, 's': v.s, 'p': v.p, 't': v.t, 'leaf': v.leaf, 'acc':
    (CASE WHEN NOT v.leaf THEN 0.0 WHEN v.s = 0 THEN (1 - v.m / (2.0 * v.t)) / (v.d + log2(v.m + 1)) ELSE 1.0 / (v.d + 1) END)::DOUBLE}}),
  lambda a, v: {{'d': v.d, 'm': v.m, 's': a.s, 'p': v.p, 't': v.t, 'leaf': v.leaf, 'acc': (CASE WHEN a.s = 0 THEN a.acc ELSE v.p / (v.d + 1) + (1 - v.p) * a.acc END)::DOUBLE}}).acc AS raw FROM folded)
SELECT seq, {sql_six(f'sum(raw * log2(t + 1)) / {TREES}')} AS score FROM scored GROUP BY seq"""
)
def forest_simulated_score(spark, sf_dir):
    """Scores as if cuts had followed the squares of the ranges."""
    p, f = model(spark, sf_dir)
    weigh = lambda low, high: (high - low) ** 2
    return _scored(p, f, lambda m, q: sum(folds.simulated(t, q, weigh, many=True) for t in m.trees) / len(m.trees))


_HYPER = f"""WITH RECURSIVE {PAIRS}, {sample_sql('(SELECT seq, x0, x1 FROM pairs)', TREES, CAPACITY, DECAY, SEED)},
walk AS (
  SELECT tree, seq, x0, x1, ''::VARCHAR AS path FROM sample
  UNION ALL
  SELECT tree, seq, x0, x1, path || CASE WHEN CASE WHEN u <= part THEN x0 <= lo0 + r0 * u / part ELSE x1 <= lo1 + r1 * (u - part) / (1 - part) END THEN 'L' ELSE 'R' END
  FROM (SELECT *, r0 * r0 / (r0 * r0 + r1 * r1) AS part FROM (
    SELECT *, hi0 - lo0 AS r0, hi1 - lo1 AS r1, {uniform_sql(str(SEED), 'tree', 'path')} AS u FROM (
      SELECT *, min(x0) OVER p AS lo0, max(x0) OVER p AS hi0, min(x1) OVER p AS lo1, max(x1) OVER p AS hi1 FROM walk WINDOW p AS (PARTITION BY tree, path))))
  WHERE r0 + r1 > 0),
n AS (SELECT tree, path, count(*) AS mass, max(x0) - min(x0) AS r0, max(x1) - min(x1) AS r1 FROM walk GROUP BY tree, path)
SELECT tree, path, CASE WHEN r0 + r1 = 0 THEN -1 WHEN {uniform_sql(str(SEED), 'tree', 'path')} <= r0 * r0 / (r0 * r0 + r1 * r1) THEN 0 ELSE 1 END::INTEGER AS dim, mass FROM n"""


@query(_HYPER)
def forest_hyper_tree(spark, sf_dir):
    """Trees whose cuts follow weights of the caller's."""
    sample = reservoir(pairs(spark, sf_dir), TREES, CAPACITY, "seq", DECAY, SEED)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        t = build(pdf[["x0", "x1"]].to_numpy(), int(pdf["tree"].iloc[0]), SEED, ranges=lambda low, high: (high - low) ** 2)
        return pd.DataFrame({"tree": int(pdf["tree"].iloc[0]), "path": t.path, "dim": t.dim, "mass": t.mass})

    return sample.groupBy("tree").applyInPandas(one, "tree int, path string, dim int, mass long")


def _mean_list(name: str) -> str:
    return "[" + ", ".join(f"sum(a.{name}[{i + 1}]) / {TREES}" for i in range(4)) + "]"


@query(
    f"""{_STEPS}, {density_sql()}, means AS (SELECT seq, {_mean_list('x')} AS x, {_mean_list('y')} AS y, {_mean_list('q')} AS q FROM folds GROUP BY seq),
parts AS (SELECT seq, list_sum(x) / {CAPACITY} AS total, list_sum(list_transform(list_zip(y, q), lambda z: CASE WHEN z[2] > 0 THEN pow(z[1] / z[2], 2) * z[2] ELSE 0 END)) AS volume FROM means)
SELECT seq, {sql_six('CASE WHEN total > 0 THEN total / (0.001 * total + volume) ELSE 0 END')} AS density FROM parts"""
)
def forest_density(spark, sf_dir):
    p, f = model(spark, sf_dir)
    got = fo.ask(p, f, ["x0", "x1"], lambda m, q: m.scalar_density(q), ["seq"], "seq long, density double", ["density"])
    return got.select("seq", six("density").alias("density"))


@query(f"{_STEPS}, {density_sql()} SELECT seq, {_sides(f'sum(a.x[#]) / {TREES}')} FROM folds GROUP BY seq")
def forest_directional_density(spark, sf_dir):
    """Measure by direction: above and below in each dimension."""
    p, f = model(spark, sf_dir)
    return _by_side(fo.ask(p, f, ["x0", "x1"], lambda m, q: m.density(q)[:, 0], ["seq"], "seq long, " + ", ".join(f"{n} double" for n in _SIDES), list(_SIDES)))


@query(f"{_STEPS}, {density_sql('sqrt({m} * {k})', '1 / (1 + {g} / 10)')} SELECT seq, {_sides(f'sum(a.x[#]) / {TREES}')} FROM folds GROUP BY seq")
def forest_density_kernel(spark, sf_dir):
    """Measure by direction with a kernel that fades with the distance, of the masses' geometric mean."""
    p, f = model(spark, sf_dir)
    kernel = lambda: folds.Density(lambda mass, leaf: np.sqrt(mass * leaf), lambda gaps: 1 / (1 + gaps / 10))
    return _by_side(fo.ask(p, f, ["x0", "x1"], lambda m, q: m.fold(q, kernel)[:, 0], ["seq"], "seq long, " + ", ".join(f"{n} double" for n in _SIDES), list(_SIDES)))


def _last_pairs(p: DataFrame) -> DataFrame:
    return p.groupBy("user_id").agg(F.max_by(F.struct("x0", "x1"), "seq").alias("v")).select("user_id", "v.*")


@query(
    f"""{_MODEL}, {_LAST}, leafs AS (SELECT tree, path, min(seq) AS id, min(x0) AS l0, min(x1) AS l1 FROM walk WHERE NOT isq GROUP BY tree, path),
last_seq AS (SELECT user_id, max(seq) AS seq FROM pairs GROUP BY user_id),
far AS (SELECT s.user_id, l.id, l.l0, l.l1, sqrt(pow(b.x0 - l.l0, 2) + pow(b.x1 - l.l1, 2)) AS d FROM box b JOIN last_seq s ON s.seq = b.seq JOIN leafs l ON l.tree = b.tree AND l.path = b.path WHERE b.isq AND b.depth = b.last)
SELECT user_id, min(id) AS near, {sql_six('min(d)')} AS d, count(*) AS trees FROM far WHERE d < 20 GROUP BY user_id, l0, l1"""
)
def forest_near_neighbors(spark, sf_dir):
    """Points of the sample near each user's last shingle, equal points of several trees as one."""
    p, f = model(spark, sf_dir)
    held = spark.sparkContext.broadcast(f)

    def run(pdfs):
        for pdf in pdfs:
            rows = [(u, i, d, n) for u, a, b in pdf.itertuples(index=False) for i, d, n, _ in held.value.near(np.array([a, b]), 20.0)]
            yield pd.DataFrame(rows, columns=["user_id", "near", "d", "trees"])

    got = _last_pairs(p).mapInPandas(run, "user_id long, near long, d double, trees long")
    return got.select("user_id", "near", six("d").alias("d"), "trees")


_FIELD = f"{_NODES}, {_LAST}, {conditional_sql('field', '(SELECT user_id AS qid, x0 FROM last_pair)')}"


@query(f"{_FIELD} SELECT qid AS user_id, tree, id AS point_id, {sql_six('far')} AS distance, l0 AS x0, l1 AS x1 FROM field")
def forest_conditional_field(spark, sf_dir):
    """One sample a tree that fits the observed half of each user's last shingle."""
    p, f = model(spark, sf_dir)
    held = spark.sparkContext.broadcast(f)

    def run(pdfs):
        for pdf in pdfs:
            for u, a, b in pdf.itertuples(index=False):
                yield held.value.conditional_samples(np.array([a, b]), [1]).assign(user_id=u)[["user_id", "tree", "point_id", "distance", "x0", "x1"]]

    got = _last_pairs(p).mapInPandas(run, "user_id long, tree int, point_id long, distance double, x0 double, x1 double")
    return got.select("user_id", "tree", "point_id", six("distance").alias("distance"), "x0", "x1")


@query(
    f"""{_FIELD}, w AS (SELECT qid AS user_id, l1, count(*) AS w FROM field GROUP BY qid, l1),
r AS (SELECT user_id, l1, sum(w) OVER (PARTITION BY user_id ORDER BY l1) AS r, sum(w) OVER (PARTITION BY user_id) AS t FROM w)
SELECT user_id, min(CASE WHEN r >= 0.1 * t THEN l1 END) AS lower, min(CASE WHEN r >= 0.5 * t THEN l1 END) AS median, min(CASE WHEN r >= 0.9 * t THEN l1 END) AS upper FROM r GROUP BY user_id"""
)
def conditional_summary(spark, sf_dir):
    """Those samples as weighted percentiles of the missing coordinate, equal points as one."""
    from ..operators.summary import weighted_percentile

    got = forest_conditional_field(spark, sf_dir).groupBy("user_id", "point_id", "x1").agg(F.count("*").cast("double").alias("weight"))
    return weighted_percentile(got, ["user_id"], "x1", "weight", {"lower": 0.1, "median": 0.5, "upper": 0.9})


@query(f"{_NODES}, {conditional_sql('field', '(SELECT seq AS qid, x0 FROM pairs)')}, {imputed_sql('filled', 'field', {'v': 0.5})} SELECT p.seq, p.x1, f.v AS imputed FROM pairs p JOIN filled f ON f.qid = p.seq")
def impute_forest(spark, sf_dir):
    """Each shingle with its second value hidden and imputed."""
    p, f = model(spark, sf_dir)
    return fo.ask(p, f, ["x0", "x1"], lambda m, q: m.impute_many(q, [1])[:, 0, 1], ["seq", "x1"], "seq long, x1 double, imputed double", ["imputed"])


_HORIZON = 5
_AHEAD = ", ".join(
    f"{conditional_sql(f'field{h}', '(SELECT user_id AS qid, x1 AS x0 FROM last_pair)' if h == 1 else f'(SELECT qid, v AS x0 FROM ahead{h - 1})')}, {imputed_sql(f'ahead{h}', f'field{h}', {'v': 0.5, 'lo': 0.1, 'hi': 0.9})}"
    for h in range(1, _HORIZON + 1)
)


@query(f"{_NODES}, {_LAST}, {_AHEAD} " + " UNION ALL ".join(f"SELECT qid AS user_id, {h}::INTEGER AS h, v AS value, least(v, lo) AS lower, greatest(v, hi) AS upper FROM ahead{h}" for h in range(1, _HORIZON + 1)))
def extrapolate_forest(spark, sf_dir):
    """Five steps ahead of each user, with the tenth and ninetieth percentiles."""
    p, f = model(spark, sf_dir)
    held = spark.sparkContext.broadcast(f)

    def run(pdfs):
        for pdf in pdfs:
            got = held.value.extrapolate_many(pdf.iloc[:, 1:3].to_numpy(float), 1, _HORIZON)[:, :, 0].reshape(-1, 3)
            steps = np.tile(np.arange(1, _HORIZON + 1), len(pdf))
            yield pd.DataFrame({"user_id": np.repeat(pdf.iloc[:, 0].to_numpy(), _HORIZON), "h": steps, "value": got[:, 0], "lower": got[:, 1], "upper": got[:, 2]})

    return _last_pairs(p).mapInPandas(run, "user_id long, h int, value double, lower double, upper double")


_MANY = 50
_MANY_MODEL = f"WITH RECURSIVE {PAIRS}, {sample_sql('(SELECT seq, x0, x1 FROM pairs)', _MANY, CAPACITY, DECAY, SEED)}, {levels_sql('(SELECT seq, x0, x1 FROM pairs)', SEED)}"
#: A tree's total is a witness if it lies half a deviation above the running mean, from the fifth tree on; the tenth witness is the last tree.
_STOP = """list_reduce(list_transform(trees, lambda v: {'v': v.v, 'x': v.x, 'n': 1, 's': v.v, 'q': v.v * v.v, 'hits': 0}),
  lambda a, v: CASE WHEN a.hits >= 10 THEN a ELSE {'v': v.v, 'x': list_transform(list_zip(a.x, v.x), lambda z: z[1] + z[2]), 'n': a.n + 1, 's': a.s + v.v, 'q': a.q + v.v * v.v,
    'hits': a.hits + CASE WHEN a.n + 1 >= 5 AND v.v - (a.s + v.v) / (a.n + 1) + 1e-6 > 0.5 * sqrt(greatest(0, (a.q + v.v * v.v) / (a.n + 1) - pow((a.s + v.v) / (a.n + 1), 2)) * (a.n + 1) / a.n) THEN 1 ELSE 0 END} END)"""


@query(
    f"""{_MANY_MODEL}, {_SCORE}, listed AS (SELECT seq, avg(score) AS score, list({{'v': score, 'x': [score]}} ORDER BY tree) AS trees FROM per_tree GROUP BY seq)
SELECT seq, {sql_six('score')} AS score, {sql_six('r.x[1] / r.n')} AS approximate FROM (SELECT seq, score, {_STOP} AS r FROM listed)"""
)
def forest_approximate(spark, sf_dir):
    """Scores that stop early over the trees, beside the exact ones."""
    p, f = model(spark, sf_dir, trees=_MANY)

    def both(m: Forest, q: np.ndarray) -> np.ndarray:
        each = [folds.scores(t, q) for t in m.trees]
        exact = sum(each) / len(each) if m.ready else np.zeros(len(q))
        return np.stack([exact, m.approximate(q, known=each)], axis=1)

    got = fo.ask(p, f, ["x0", "x1"], both, ["seq"], "seq long, score double, approximate double", ["score", "approximate"])
    return got.select("seq", six("score").alias("score"), six("approximate").alias("approximate"))


@query(
    f"""{_MANY_MODEL}, {steps_sql()}, {_PARTS},
listed AS (SELECT seq, list({{'v': a.c * log2(t + 1), 'x': list_transform(a.a, lambda z: z * (a.c * log2(t + 1) / list_sum(a.a)))}} ORDER BY tree) AS trees FROM folds GROUP BY seq)
SELECT seq, {_sides('r.x[#] / r.n')} FROM (SELECT seq, {_STOP} AS r FROM listed)"""
)
def forest_approximate_attribution(spark, sf_dir):
    p, f = model(spark, sf_dir, trees=_MANY)
    return _by_side(fo.ask(p, f, ["x0", "x1"], lambda m, q: m.approximate(q, folds.Attribution), ["seq"], "seq long, " + ", ".join(f"{n} double" for n in _SIDES), list(_SIDES)))


@query(f"{_MODEL}, {_SCORE} SELECT p.seq, p.x0, p.x1, s.score, s.score AS again FROM pairs p JOIN ({_MEAN}) s ON s.seq = p.seq")
def snapshot_roundtrip(spark, sf_dir):
    """Scores by a forest and by the same forest written and read again."""
    p, f = model(spark, sf_dir)
    again = snapshot.from_table(snapshot.to_table(spark, f))
    both = fo.ask(p, f, ["x0", "x1"], lambda m, q: m.score(q), ["seq", "x0", "x1"], "seq long, x0 double, x1 double, score double", ["score"])
    got = fo.ask(both, again, ["x0", "x1"], lambda m, q: m.score(q), ["seq", "x0", "x1", "score"], "seq long, x0 double, x1 double, score double, again double", ["again"])
    return got.select("seq", "x0", "x1", six("score").alias("score"), six("again").alias("again"))


_BLOCK = 256
_REPLAY = f"""WITH RECURSIVE rows AS (SELECT event_id AS seq, value AS x0, (user_id % 10)::DOUBLE AS x1, (row_number() OVER (ORDER BY event_id) - 1) // {_BLOCK} AS blk FROM events),
sample AS (
  SELECT b.blk * {TREES} + t.tree AS tree, r.seq, r.x0, r.x1
  FROM (SELECT DISTINCT blk FROM rows) b JOIN rows r ON r.blk < b.blk, range({TREES}) t(tree)
  QUALIFY row_number() OVER (PARTITION BY b.blk, t.tree ORDER BY ln(-ln({uniform_sql(str(SEED), 't.tree', 'r.seq')})) - r.seq * {DECAY!r}, r.seq) <= {CAPACITY}),
{levels_sql('rows', SEED, f'tree % {TREES}', f't.tree // {TREES} = q.blk')}, {_SCORE}
SELECT r.seq, {sql_six(f'coalesce(sum(s.score), 0) / {TREES}')} AS score FROM rows r LEFT JOIN per_tree s ON s.seq = r.seq GROUP BY r.seq"""


@query(_REPLAY)
def forest_replay(spark, sf_dir):
    """Every row scored against the model before its block: a model a block, scores of the block's rows where they lie."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("x0"), (F.col("user_id") % 10).cast("double").alias("x1"))
    return fo.replay(ev, ["x0", "x1"], "seq", TREES, CAPACITY, DECAY, _BLOCK, SEED).select("seq", six("score").alias("score"))


# ---------------------------------------------------------------- without SQL


@query()
def forest_embeddings(spark, sf_dir):
    """Scores of 64-dimensional vectors."""
    e = table(spark, sf_dir, "embeddings")
    f = fo.fit(e, F.col("embedding"), "vec_id", 20, 64, DECAY, SEED)
    return fo.score(e, f, F.col("embedding"), ["vec_id", "label"])
