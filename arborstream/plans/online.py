"""Queries of samples, online trees, first rows, sources and generators, each with its SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.uniforms import mixed, uniform_sql
from ..operators import folds
from ..operators import forest as fo
from ..operators.detector import Detector, StreamForest
from ..operators.sampler import reservoir
from ..operators.scan import scan
from ..operators.trees import DynamicTree, build
from ..operators.workspace import folder
from ..sources import delimited, generators
from . import forests as fr
from .forest_sql import fold_sql, sample_sql, steps_sql
from .relational import EV, EVM, ORDER, Query, events, masked, six, sql_six, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- samples and leaves

_SAMPLE = f"WITH {fr.PAIRS}, {sample_sql('(SELECT seq, x0, x1 FROM pairs)', fr.TREES, fr.CAPACITY, fr.DECAY, fr.SEED)}"


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir(fr.pairs(spark, sf_dir), fr.TREES, fr.CAPACITY, "seq", fr.DECAY, fr.SEED)


@query(f"{_SAMPLE} SELECT tree, seq, user_id, x0, x1 FROM sample JOIN (SELECT seq, user_id FROM pairs) USING (seq)")
def forest_sample(spark, sf_dir):
    """Every tree's sample with its points and what else the rows carry."""
    return _sample(spark, sf_dir).select("tree", "seq", "user_id", "x0", "x1")


@query(f"{_SAMPLE} SELECT x0, x1, count(*) AS weight, min(seq) AS first_seq FROM sample GROUP BY x0, x1")
def forest_sample_weights(spark, sf_dir):
    """The live sample as weighted points: equal points of all trees as one."""
    return _sample(spark, sf_dir).groupBy("x0", "x1").agg(F.count("*").alias("weight"), F.min("seq").alias("first_seq"))


@query(f"{fr._NONE}, n AS (SELECT tree, path, count(*) AS mass, min(seq) AS first_seq, max(seq) AS last_seq, max(x0) - min(x0) + max(x1) - min(x1) AS w FROM walk GROUP BY tree, path) SELECT tree, path, mass, first_seq, last_seq FROM n WHERE w = 0")
def forest_leaves(spark, sf_dir):
    """Leaves with their copies and the first and last sequence number of them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seq, t = pdf["seq"].to_numpy(), build(pdf[["x0", "x1"]].to_numpy(), int(pdf["tree"].iloc[0]), fr.SEED)
        rows = [(int(pdf["tree"].iloc[0]), t.path[n], int(t.mass[n]), int(seq[t.members[n]].min()), int(seq[t.members[n]].max())) for n in t.leaves]
        return pd.DataFrame(rows, columns=["tree", "path", "mass", "first_seq", "last_seq"])

    return _sample(spark, sf_dir).groupBy("tree").applyInPandas(one, "tree int, path string, mass long, first_seq long, last_seq long")


_FAR = f"""{fr._MODEL}, {fr._LAST}, {fr._SCORE}, leafs AS (SELECT tree, path, min(seq) AS id, min(x0) AS l0, min(x1) AS l1 FROM walk WHERE NOT isq GROUP BY tree, path),
last_seq AS (SELECT user_id, max(seq) AS seq FROM pairs GROUP BY user_id),
far AS (SELECT s.user_id, b.seq, b.tree, l.id, l.l0, l.l1, sqrt(pow(b.x0 - l.l0, 2) + pow(b.x1 - l.l1, 2)) AS d FROM box b JOIN last_seq s ON s.seq = b.seq JOIN leafs l ON l.tree = b.tree AND l.path = b.path WHERE b.isq AND b.depth = b.last)"""


def _each_user(spark: SparkSession, sf_dir: str, rows, schema: str, names: list[str]) -> DataFrame:
    p, f = fr.model(spark, sf_dir)
    held = spark.sparkContext.broadcast(f)

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([(u, *r) for u, a, b in pdf.itertuples(index=False) for r in rows(held.value, np.array([a, b]))], columns=["user_id", *names])

    return fr._last_pairs(p).mapInPandas(run, f"user_id long, {schema}")


@query(f"{_FAR}, near AS (SELECT user_id, min(id) AS near, min(d) AS d, count(*) AS trees FROM far GROUP BY user_id, l0, l1) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY d, near)::INTEGER AS rank, near, {sql_six('d')} AS d, trees FROM near")
def forest_near_ranked(spark, sf_dir):
    """Neighbours of each user's last shingle in order of distance."""
    rows = lambda f, q: [(k + 1, i, d, n) for k, (i, d, n, _) in enumerate(f.near(q))]
    got = _each_user(spark, sf_dir, rows, "rank int, near long, d double, trees long", ["rank", "near", "d", "trees"])
    return got.select("user_id", "rank", "near", six("d").alias("d"), "trees")


@query(f"{_FAR}, ranked AS (SELECT f.user_id, row_number() OVER (PARTITION BY f.user_id ORDER BY f.d, f.tree) AS rank, s.score, f.l0 AS x0, f.l1 AS x1, f.d FROM far f JOIN per_tree s ON s.seq = f.seq AND s.tree = f.tree) SELECT user_id, rank::INTEGER AS rank, {sql_six('score')} AS score, x0, x1, {sql_six('d')} AS d FROM ranked WHERE rank <= ceil(0.75 * {fr.TREES})")
def forest_near_list(spark, sf_dir):
    """Each tree's score and leaf, nearest first, the nearest three quarters of the trees."""
    rows = lambda f, q: [(k + 1, s, *p, d) for k, (s, p, d) in enumerate(f.near_list(q, 0.75))]
    got = _each_user(spark, sf_dir, rows, "rank int, score double, x0 double, x1 double, d double", ["rank", "score", "x0", "x1", "d"])
    return got.select("user_id", "rank", six("score").alias("score"), "x0", "x1", six("d").alias("d"))


@query(f"{fr._MODEL}, {fr._SCORE} SELECT seq, {sql_six('min(score)')} AS least, {sql_six('max(score)')} AS most, {sql_six('sum(score * score)')} AS squares FROM per_tree GROUP BY seq")
def forest_combine(spark, sf_dir):
    """Trees' scores put together by the caller's accumulators."""
    p, f = fr.model(spark, sf_dir)

    def combined(m, q):
        least = m.accumulate(q, folds.Score, np.minimum)
        most = m.accumulate(q, folds.Score, np.maximum)
        squares = m.accumulate(q, folds.Score, lambda a, b: a + b, each=np.square)
        return np.stack([least, most, squares], axis=1)

    got = fo.ask(p, f, ["x0", "x1"], combined, ["seq"], "seq long, least double, most double, squares double", ["least", "most", "squares"])
    return got.select("seq", *[six(c).alias(c) for c in ("least", "most", "squares")])


@query(
    f"""{fr._MANY_MODEL}, {steps_sql()}, {fold_sql({"c": "0.0::DOUBLE"}, {"c": "pow(2.0, -v.d)"}, {"c": "(v.p * pow(2.0, -v.d) + (1 - v.p) * a.c)::DOUBLE"})},
listed AS (SELECT seq, list({{'v': a.c, 'x': [a.c]}} ORDER BY tree) AS trees FROM folds GROUP BY seq) SELECT seq, {sql_six('r.x[1] / r.n')} AS score FROM (SELECT seq, {fr._STOP} AS r FROM listed)"""
)
def forest_approximate_dynamic(spark, sf_dir):
    """Scores by the caller's functions that stop early over the trees."""
    p, f = fr.model(spark, sf_dir, trees=fr._MANY)
    return fr._scored(p, f, lambda m, q: m.approximate(q, fr._dynamic, ignore_mass=1))


# ---------------------------------------------------------------- online trees


@query(
    f"""WITH {fr.PAIRS}, k AS (SELECT * FROM pairs WHERE seq % 3 <> 0)
SELECT user_id, count(*) AS mass, min(x0) AS lo0, max(x0) AS hi0, min(x1) AS lo1, max(x1) AS hi1, count(DISTINCT (x0, x1)) AS leaves, TRUE AS valid FROM k GROUP BY user_id"""
)
def dynamic_tree(spark, sf_dir):
    """A tree a user that takes all shingles and drops a third again: its mass, box and leaves, and whether every node matches its children."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        t = DynamicTree(random.Random(1).random)
        rows = [(int(s), (float(a), float(b))) for s, a, b in pdf.sort_values("seq")[["seq", "x0", "x1"]].itertuples(index=False)]
        for _, x in rows:
            t.insert(x)
        for s, x in rows:
            if s % 3 == 0:
                t.delete(x)
        leaves, valid, todo = 0, True, [t.root] if t.root is not None else []
        while todo:
            n = todo.pop()
            if n.dim < 0:
                leaves += 1
                valid &= tuple(n.low) == n.point == tuple(n.high)
                continue
            both = (n.left, n.right)
            valid &= n.mass == sum(c.mass for c in both) and n.low == [min(v) for v in zip(*[c.low for c in both], strict=True)]
            valid &= n.high == [max(v) for v in zip(*[c.high for c in both], strict=True)] and n.left.high[n.dim] <= n.cut < n.right.low[n.dim]
            todo += both
        if t.root is None:
            return pd.DataFrame(columns=["user_id", "mass", "lo0", "hi0", "lo1", "hi1", "leaves", "valid"])
        r = t.root
        return pd.DataFrame([(int(pdf["user_id"].iloc[0]), r.mass, r.low[0], r.high[0], r.low[1], r.high[1], leaves, valid)], columns=["user_id", "mass", "lo0", "hi0", "lo1", "hi1", "leaves", "valid"])

    return fr.pairs(spark, sf_dir).groupBy("user_id").applyInPandas(one, "user_id long, mass long, lo0 double, hi0 double, lo1 double, hi1 double, leaves long, valid boolean")


@query(f"WITH {fr.PAIRS} SELECT user_id, seq, row_number() OVER w AS updates, 3 * least(16, row_number() OVER w) AS sampled, 3 * least(16, row_number() OVER w) AS mass FROM pairs WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
def stream_forest_sizes(spark, sf_dir):
    """An online forest of three trees of 16 points a user: updates, sampled points and the trees' masses after each row."""

    def start(key):
        f = StreamForest(3, 16, 0.01, int(key))

        def step(row):
            f.update((row[1], row[2]))
            return [(int(key), row[0], f.updates, sum(len(s) for s in f.samples), sum(t.root.mass for t in f.trees))]

        return step

    return scan(fr.pairs(spark, sf_dir), "user_id", ["seq"], ["seq", "x0", "x1"], start, "user_id long, seq long, updates long, sampled long, mass long")


@query(f"WITH {EV} SELECT user_id, event_id, rn AS clock, greatest(0, rn - 3) > 8 AS ready, greatest(0, rn - 4) > 8 AS scored FROM ev")
def detect_order(spark, sf_dir):
    """A row is scored by what came before it, then learnt: its place, and whether the model was ready after and before it."""

    def start(key):
        d = Detector(base=1, trees=4, capacity=32, shingle=4, seed=int(key))

        def step(row):
            r = d.step([row[1]], row[2])
            return [(int(key), row[0], r.clock, r.ready, r.score > 0)]

        return step

    return scan(events(spark, sf_dir), "user_id", ORDER, ["event_id", "value", "t"], start, "user_id long, event_id long, clock long, ready boolean, scored boolean")


@query(
    f"""WITH {EVM}, early AS (SELECT * FROM evm WHERE rn <= 10), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
  last_value(CASE WHEN value IS NOT NULL THEN {{'t': t, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn) AS b,
  first_value(CASE WHEN value IS NOT NULL THEN {{'t': t, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM early)
SELECT user_id, event_id, {sql_six('CASE WHEN value IS NOT NULL THEN value WHEN b IS NULL AND a IS NULL THEN 0 WHEN b IS NULL THEN a.v WHEN a IS NULL THEN b.v WHEN a.t = b.t THEN b.v ELSE b.v + (a.v - b.v) * (t - b.t) / (a.t - b.t) END')} AS value FROM k WHERE n = 10"""
)
def initial_segment(spark, sf_dir):
    """The first ten rows of each user as a detector learns them: missing values on the line between those around them."""

    def start(key):
        d = Detector(base=1, trees=1, capacity=8, shingle=10, seed=1, initial=10)
        ids: list[int] = []

        def step(row):
            if len(ids) == 10:
                return []
            ids.append(row[0])
            d.step([row[1]], row[2])
            return [(int(key), i, w[0]) for i, w in zip(ids, d.window, strict=True)] if len(ids) == 10 else []

        return step

    got = scan(masked(spark, sf_dir), "user_id", ORDER, ["event_id", "value", "t"], start, "user_id long, event_id long, value double")
    return got.select("user_id", "event_id", six("value").alias("value"))


# ---------------------------------------------------------------- sources, generators, functions


@query("SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal * 2 END AS twice FROM customer")
def delimited_roundtrip(spark, sf_dir):
    """Cells written as delimited text with a result appended, NA where it is missing, and read again."""
    path = f"{folder(spark)}/text"
    cells = F.array(*[F.col(c).cast("string") for c in ("c_custkey", "c_nationkey", "c_acctbal")])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), cells.alias("cells"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") * 2).alias("twice"))
    delimited.write(delimited.lines(rows, [F.col("twice")]), path)
    v = lambda i: F.get("v", F.lit(i))
    return delimited.read(spark, path).select(v(0).cast("long").alias("c_custkey"), v(1).cast("int").alias("c_nationkey"), v(2).alias("c_acctbal"), v(3).alias("twice"))


def _normal_sql(seed: int, *parts: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(str(seed), *parts)})) * cos(2 * pi() * {uniform_sql(str(seed + 1_000_003), *parts)}))"


def _dimension_sql(i: int) -> str:
    z = _normal_sql(5 + 7 + i, "seq")
    return f"{sql_six(f'CASE WHEN anomalous THEN {z} * 2 + 4 ELSE {z} END')} AS v{i}"


@query(
    f"""WITH u AS (SELECT seq, {uniform_sql('5', 'seq')} AS u FROM range(2000) r(seq)),
s AS (SELECT seq, coalesce(last_value(CASE WHEN u < 0.01 THEN TRUE WHEN u > 0.7 THEN FALSE END IGNORE NULLS) OVER (ORDER BY seq), FALSE) AS anomalous FROM u)
SELECT seq, anomalous, anomalous <> coalesce(lag(anomalous) OVER (ORDER BY seq), FALSE) AS changed, {', '.join(map(_dimension_sql, range(3)))} FROM s"""
)
def generated_mixture(spark, sf_dir):
    made = generators.normal_mixture(spark, 2000, 3, seed=5)
    return made.select("seq", "anomalous", "changed", *[six(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(3)])


@query(
    f"""SELECT seq, {sql_six(f"100 * cos(2 * pi() * (seq + 50) / 50) + 5 * {uniform_sql('2', 'seq')} + CASE WHEN {uniform_sql('5', 'seq')} < 0.01 THEN CASE WHEN {uniform_sql('7', 'seq')} < 0.5 THEN -50 ELSE 50 END ELSE 0 END")} AS value FROM range(3000) r(seq)"""
)
def generated_cosine(spark, sf_dir):
    return generators.single_cosine(spark, 3000, seed=2).select("seq", six("value").alias("value"))


_BLADE_X, _BLADE_Y = f"(0.05 * {_normal_sql(3, 'seq')})", f"(0.2 * {_normal_sql(4, 'seq')} + 0.6)"
_TURN = "(0.5 + 2 * pi() * (seq % 3) / 3)"


@query(
    f"""SELECT seq, (seq % 3)::INTEGER AS blade, {sql_six(f'{_BLADE_X} * cos({_TURN}) - {_BLADE_Y} * sin({_TURN})')} AS x, {sql_six(f'{_BLADE_X} * sin({_TURN}) + {_BLADE_Y} * cos({_TURN})')} AS y FROM range(1500) r(seq)"""
)
def generated_fan(spark, sf_dir):
    made = generators.fan(spark, 1500, angle=0.5, seed=3)
    return made.select("seq", "blade", six(F.get("v", F.lit(0))).alias("x"), six(F.get("v", F.lit(1))).alias("y"))


_MIX = "((z{n}::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


@query(
    f"""WITH a AS (SELECT i, ((42::UHUGEINT + i::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS y0 FROM range(1, 2001) r(i)),
b AS (SELECT i, xor(y0, y0 >> 30) AS z0 FROM a), c AS (SELECT i, {_MIX.format(n=0, k=13787848793156543929)} AS y1 FROM b),
d AS (SELECT i, xor(y1, y1 >> 27) AS z1 FROM c), e AS (SELECT i, {_MIX.format(n=1, k=10723151780598845931)} AS y2 FROM d)
SELECT i, (xor(y2, y2 >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM e"""
)
def mixed_uniforms(spark, sf_dir):
    """The counter-based uniforms of a seed."""
    return spark.createDataFrame([(i + 1, float(u)) for i, u in enumerate(mixed(42, 2000))], "i long, u double")


@query(
    f"""WITH {EVM}, w AS (SELECT user_id, event_id, rn, [CASE WHEN value = round(value) THEN -0.0 ELSE value END, CASE WHEN event_id % 4 = 0 THEN NULL ELSE -0.0 END] AS v FROM evm),
m AS (SELECT *, list_filter([0, 1], lambda i: v[i + 1] IS NULL) AS idx FROM w)
SELECT user_id, event_id, array_to_string(idx, ',') AS missing, array_to_string(list_transform(idx, lambda i: i + 6), ',') AS shingled, array_to_string(list_transform(idx, lambda i: (i + 2 * (rn % 4)) % 8), ',') AS rotated,
  list_reduce(list_prepend(0, list_transform(v, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END)), lambda a, b: a + b)::INTEGER AS zeros, 0 AS negative FROM m"""
)
def canonical_inputs(spark, sf_dir):
    """Missing values of two inputs as places of the shingle of four rows, plain and rotating, and zeros that are never negative."""
    v = F.array(F.when(F.col("value") == F.round("value"), F.lit(-0.0)).otherwise(F.col("value")), F.when(F.col("event_id") % 4 == 0, None).otherwise(F.lit(-0.0)))
    rows = masked(spark, sf_dir).withColumn("v", scoring.canonical(v)).withColumn("at", scoring.missing_indices(F.col("v")))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    zeros = F.aggregate("v", F.lit(0), lambda s, x: s + F.when(x == 0, 1).otherwise(0))
    negative = F.aggregate("v", F.lit(0), lambda s, x: s + F.when(x.cast("string") == "-0.0", 1).otherwise(0))
    return rows.select(
        "user_id",
        "event_id",
        text("at").alias("missing"),
        text(scoring.lift_indices(F.col("at"), 2, 8)).alias("shingled"),
        text(scoring.lift_indices(F.col("at"), 2, 8, F.col("rn") % 4)).alias("rotated"),
        zeros.alias("zeros"),
        negative.alias("negative"),
    )
