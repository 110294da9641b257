"""Detection over whole keyed streams, block by block, with SQL: the forest of each user's block, then thresholds and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uniforms import uniform_sql
from ..operators import block_detector, glocal_blocks
from ..operators.workspace import folder
from ..streaming.shared import SharedForests, backfill
from .forest_sql import levels_sql, scores_sql
from .relational import _DIFF, EV, ORDER, Query, _mean, _spread, sql_six, six, stream, table, threshold_sql

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A user has some 50 to 100 rows: small samples and blocks, as a key's stream is short.
TREES, CAPACITY, BLOCK, SEED, SHINGLE, RATE = 10, 32, 16, 5, 2, 0.01
DECAY = 1 / (10 * CAPACITY)


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _detected(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    got = block_detector.detect(
        stream(spark, sf_dir), "user_id", ORDER, ["value"], ["user_id", "event_id"], SHINGLE, TREES, CAPACITY, DECAY, BLOCK, SEED, rate=RATE, identity=F.col("event_id"), **settings
    )
    return got.select("user_id", "event_id", six("score").alias("score"), six("threshold").alias("threshold"), six("grade").alias("grade"), "correction")


def _sql(values: str, alert_once: bool = False, z: str = "3.0") -> str:
    """values: CTEs up to `y` (user_id, event_id, rn, y)."""
    calm = "max(CASE WHEN lev = 0 THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    again = f"lev > 0 AND (rn - coalesce(calm, 0) - 1) % {SHINGLE} <> 0" if alert_once else "FALSE"
    key = f"ln(-ln({uniform_sql(str(SEED), 't.tree', 'r.seq')})) - r.n * {DECAY!r}"
    return f"""WITH RECURSIVE {values},
windows AS (SELECT user_id, event_id AS seq, rn - 1 AS n, lag(y) OVER (PARTITION BY user_id ORDER BY rn) AS x0, y AS x1, (rn - 2) // {BLOCK} AS blk FROM y),
rows AS (SELECT *, dense_rank() OVER (ORDER BY user_id, blk) AS g FROM windows WHERE x0 IS NOT NULL),
sample AS (
  SELECT b.g * {TREES} + t.tree AS tree, r.seq, r.x0, r.x1
  FROM (SELECT DISTINCT user_id, blk, g FROM rows) b JOIN rows r ON r.user_id = b.user_id AND r.blk < b.blk, range({TREES}) t(tree)
  QUALIFY row_number() OVER (PARTITION BY b.g, t.tree ORDER BY {key}, r.n) <= {CAPACITY}),
{levels_sql('rows', SEED, f'tree % {TREES}', f't.tree // {TREES} = q.g')},
{scores_sql("(1 - {m} / (2.0 * {t})) / ({d} + log2({m} + 1))", "1.0 / ({d} + 1)", "1.0 / (v.d + 1)", "raw * log2(t + 1)")},
forest AS (SELECT seq, sum(score) / {TREES} AS x FROM per_tree GROUP BY seq),
scores AS (SELECT y.user_id, y.event_id, row_number() OVER (PARTITION BY y.user_id ORDER BY y.rn) AS rn, f.x FROM y JOIN forest f ON f.seq = y.event_id),
{threshold_sql('scores', RATE, z)},
a AS (
  SELECT y.user_id, y.event_id, y.rn, coalesce(v.x, 0) AS x, CASE WHEN v.x IS NULL THEN 0 WHEN v.x >= v.lim AND v.lev = 0 THEN v.x ELSE v.lim END AS lim, coalesce(v.lev, 0) AS lev
  FROM y LEFT JOIN v ON v.event_id = y.event_id),
b AS (SELECT *, {calm} AS calm FROM a)
SELECT user_id, event_id, {sql_six('x')} AS score, {sql_six('lim')} AS threshold, {sql_six(f'CASE WHEN {again} THEN 0 ELSE lev END')} AS grade,
  CASE WHEN {again} THEN 'ALERT_ONCE' ELSE 'NONE' END AS correction FROM b"""


_PLAIN = f"{EV}, y AS (SELECT user_id, event_id, rn, value AS y FROM ev)"
_PAST = "(PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NORMAL = f"""{EV}, na AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_v FROM ev),
nb AS (SELECT *, {_spread('l_v', 1 / CAPACITY)} AS dev FROM na), nc AS (SELECT *, list(value) OVER {_PAST} AS l_p, list(dev) OVER {_PAST} AS l_s FROM nb),
y AS (SELECT user_id, event_id, rn, greatest(-100, least(100, (value - {_mean('l_p', 1 / CAPACITY)}) / (abs({_mean('l_s', 1 / CAPACITY)}) + 1))) AS y FROM nc)"""
_STEPS = f"""{_DIFF}, nd AS (SELECT *, list(dv) OVER {_PAST} AS l_d FROM d),
y AS (SELECT user_id, event_id, rn, greatest(-100, least(100, (dv - {_mean('l_d', 1 / CAPACITY)}) / ({_spread('l_d', 1 / CAPACITY)} + 1))) AS y FROM nd)"""
_FLAT = "greatest(2.0, CASE WHEN m < 0.9 THEN 3 * m / 0.9 ELSE 3 END)"


@query(_sql(_PLAIN))
def block_detect(spark, sf_dir):
    """Scores, thresholds and grades of every row of every user."""
    return _detected(spark, sf_dir)


@query(_sql(_NORMAL, z=_FLAT))
def block_detect_normalized(spark, sf_dir):
    return _detected(spark, sf_dir, transform="NORMALIZE")


@query(_sql(_STEPS, z=_FLAT))
def block_detect_normalized_steps(spark, sf_dir):
    return _detected(spark, sf_dir, transform="NORMALIZE_DIFFERENCE")


@query(_sql(_PLAIN, alert_once=True))
def block_detect_alert_once(spark, sf_dir):
    """The first row of a run of anomalies speaks for those that share its window."""
    return _detected(spark, sf_dir, alert_once=True)


# ---------------------------------------------------------------- global and local

KNOWN, FEW, KEPT = 32, 16, 4


def _glocal_sql(source: str, apart: str) -> str:
    """source: a SELECT of (user_id, event_id, rn, x); apart: a macro body, the distance of a and b."""
    d = lambda a, b: apart.replace("$a", a).replace("$b", b)
    key = f"ln(-ln({uniform_sql(str(SEED), '0', 'r.event_id')})) - r.rn * {1 / (10 * KNOWN)!r}"
    steps = "".join(
        f"""
c{i} AS (SELECT user_id, blk, pos, x, CASE WHEN {d('x', 'f')} < away THEN {i} ELSE near END AS near, least(away, {d('x', 'f')}) AS away
  FROM (SELECT *, first_value(x) OVER (PARTITION BY user_id, blk ORDER BY away DESC, pos) AS f FROM c{i - 1})),"""
        for i in range(1, KEPT)
    )
    hidden = f"{d('k.c', 'e[1].c')} < e[1].d AND e[1].d > sqrt(k.d * k.d + pow({d('k.c', 'e[1].c')}, 2))"
    return f"""WITH {EV}, base AS ({source}),
rows AS (SELECT *, (rn - 1) // {FEW} AS blk FROM base),
sample AS (
  SELECT g.user_id, g.blk, r.x, row_number() OVER (PARTITION BY g.user_id, g.blk ORDER BY {key}, r.rn) AS pos
  FROM (SELECT DISTINCT user_id, blk FROM rows) g JOIN rows r ON r.user_id = g.user_id AND r.blk < g.blk QUALIFY pos <= {KNOWN}),
ripe AS (SELECT * FROM sample QUALIFY count(*) OVER (PARTITION BY user_id, blk) > {KNOWN // 4}),
c0 AS (SELECT user_id, blk, pos, x, 0 AS near, {d('x', 'f')} AS away FROM (SELECT *, first_value(x) OVER (PARTITION BY user_id, blk ORDER BY x) AS f FROM ripe)),{steps}
reps AS (
  SELECT user_id, blk, near AS i, arg_min(x, pos) FILTER (away = 0) AS c, (sum(away) + any_value(typical)) / (count(*) + 1) AS r
  FROM (SELECT *, avg(away) OVER (PARTITION BY user_id, blk) AS typical FROM c{KEPT - 1}) GROUP BY user_id, blk, near),
met AS (
  SELECT q.user_id, q.event_id, q.rn, list({{'d': {d('q.x', 'p.c')}, 'c': p.c, 'r': p.r}} ORDER BY {d('q.x', 'p.c')}, p.i) AS l
  FROM rows q JOIN reps p ON p.user_id = q.user_id AND p.blk = q.blk GROUP BY q.user_id, q.event_id, q.rn),
clear AS (
  SELECT *, CASE WHEN l[1].d = 0 THEN l[1:1] ELSE list_reduce(list_transform(l, lambda e: [e]),
    lambda a, e: CASE WHEN len(list_filter(a, lambda k: {hidden})) > 0 THEN a ELSE list_concat(a, e) END) END AS kept FROM met),
fits AS (SELECT *, list_transform(kept, lambda k: CASE WHEN k.d = 0 THEN 0.0::DOUBLE WHEN k.r > 0 THEN k.d / k.r ELSE 'infinity'::DOUBLE END) AS ms FROM clear),
scores AS (
  SELECT user_id, event_id, rn, least(list_min(ms), 10) AS x, len(kept) AS near, kept[list_position(ms, list_min(ms))].c AS c,
    exp(-list_min(ms) * list_min(ms)) AS own, list_sum(list_transform(ms, lambda m: exp(-m * m))) AS parts FROM fits),
past AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS nth, list(x) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_x FROM scores),
stats AS (SELECT *, {_mean('l_x', 1 / (10 * KNOWN))} AS m, {_spread('l_x', 1 / (10 * KNOWN))} AS s FROM past)
SELECT b.user_id, b.event_id, {sql_six('coalesce(t.x, 0)')} AS score, {sql_six('CASE WHEN t.nth > 10 THEN m + 3 * s ELSE 0 END')} AS threshold,
  {sql_six('CASE WHEN t.nth > 10 THEN CASE WHEN s = 0 THEN CASE WHEN t.x > m + 1e-10 THEN 1 ELSE 0 END ELSE greatest(0, (least(6, (t.x - m) / s) - 3) / 3) END ELSE 0 END')} AS grade,
  coalesce(t.near, 0)::INTEGER AS near, %s AS representative, {sql_six('CASE WHEN t.parts > 0 THEN t.own / t.parts ELSE 1.0 / t.near END')} AS share
FROM base b LEFT JOIN stats t ON t.user_id = b.user_id AND t.event_id = b.event_id"""


def _glocal(rows: DataFrame, representative) -> DataFrame:
    got = glocal_blocks.detect(rows, "user_id", ORDER, "x", ["user_id", "event_id"], KNOWN, None, KEPT, FEW, seed=SEED, identity=F.col("event_id"))
    figures = [six(c).alias(c) for c in ("score", "threshold", "grade", "share")]
    return got.select("user_id", "event_id", *figures, "near", representative.alias("representative"))


@query(_glocal_sql("SELECT user_id, event_id, rn, value AS x FROM ev", "abs($a - $b)") % "t.c")
def glocal_blocks_values(spark, sf_dir):
    """Every row of every user against representatives of the user's reservoir: score, grade, and the one it belongs to."""
    rows = stream(spark, sf_dir).withColumn("x", F.array("value"))
    return _glocal(rows, F.col("representative")[0])


_VECTORS = "SELECT label AS user_id, vec_id AS event_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS x FROM embeddings"


@query(_glocal_sql(_VECTORS, "list_distance($a, $b)") % "t.c[1]")
def glocal_blocks_vectors(spark, sf_dir):
    """The same of vectors, a stream a label, in the order of their ids."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").alias("user_id"), F.col("vec_id").alias("event_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("x"))
    return _glocal(rows, F.col("representative")[0])


# ---------------------------------------------------------------- many series over shared models

SPANS, TOGETHER = 8, 64


def _shared_sql() -> str:
    """One forest for all users, as it is at the start of each of SPANS spans of time."""
    key = f"ln(-ln({uniform_sql(str(SEED), 't.tree', 'r.name')})) - r.born / {10.0 * TOGETHER}"
    fade = f"pow({1 - RATE!r}, s.n - s.i)"
    return f"""WITH RECURSIVE {EV},
span AS (SELECT min(t) AS low, (max(t) - min(t)) // {SPANS} + 1 AS width FROM ev),
windows AS (
  SELECT user_id, event_id AS seq, rn, (t - low) // width AS b, concat_ws('|', user_id, t, event_id) AS name, lag(value) OVER (PARTITION BY user_id ORDER BY rn) AS x0, value AS x1 FROM ev, span),
counts AS (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS born FROM (SELECT b, count(x0) AS n FROM windows GROUP BY b)),
rows AS (SELECT w.*, c.born FROM windows w JOIN counts c USING (b) WHERE x0 IS NOT NULL),
sample AS (
  SELECT c.b * {TREES} + t.tree AS tree, r.seq, r.x0, r.x1
  FROM counts c JOIN rows r ON r.b < c.b, range({TREES}) t(tree) WHERE c.born > {max(1, TOGETHER // 4)}
  QUALIFY row_number() OVER (PARTITION BY c.b, t.tree ORDER BY {key}, r.seq) <= {TOGETHER}),
{levels_sql('rows', SEED, f'tree % {TREES}', f't.tree // {TREES} = q.b')},
{scores_sql("(1 - {m} / (2.0 * {t})) / ({d} + log2({m} + 1))", "1.0 / ({d} + 1)", "1.0 / (v.d + 1)", "raw * log2(t + 1)")},
forest AS (SELECT seq, sum(score) / {TREES} AS x FROM per_tree GROUP BY seq),
judged AS (SELECT w.*, f.x FROM windows w LEFT JOIN forest f USING (seq)),
past AS (
  SELECT a.user_id, a.b, s.x, row_number() OVER (PARTITION BY a.user_id, a.b ORDER BY s.rn) AS i, count(*) OVER (PARTITION BY a.user_id, a.b) AS n
  FROM (SELECT DISTINCT user_id, b FROM windows) a JOIN judged s ON s.user_id = a.user_id AND s.b < a.b WHERE s.x > 0),
stats AS (SELECT user_id, b, max(n) AS n, sum(s.x * {fade}) / sum({fade}) AS m, sum(s.x * s.x * {fade}) / sum({fade}) AS q FROM past s GROUP BY user_id, b),
limits AS (
  SELECT s.user_id, s.seq AS event_id, coalesce(s.x, 0) AS x, m, sqrt(greatest(0, q - m * m)) AS dev, s.x > 0 AND n >= 10 AS found FROM judged s LEFT JOIN stats USING (user_id, b)),
graded AS (
  SELECT *, CASE WHEN found AND x > m + 3 * dev THEN CASE WHEN dev = 0 THEN CASE WHEN x > m + 1e-10 THEN 1 ELSE 0 END ELSE greatest(0, (least(6, (x - m) / dev) - 3) / 3) END ELSE 0 END AS g FROM limits)
SELECT user_id, event_id, {sql_six('x')} AS score, {sql_six('CASE WHEN found THEN m + 3 * dev ELSE 0 END')} AS threshold, {sql_six('g')} AS grade FROM graded"""


def _together(spark: SparkSession, sf_dir: str, models: int) -> DataFrame:
    shared = SharedForests(folder(spark), models, SHINGLE, TREES, TOGETHER, rate=RATE, seed=SEED)
    rows = stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("t").alias("time"), F.col("event_id").alias("id"), "value")
    got = backfill(rows, shared, SPANS)
    return got.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "arm", *[six(c).alias(c) for c in ("score", "threshold", "grade")])


@query(_shared_sql())
def shared_model(spark, sf_dir):
    """All users' rows by one forest of all users, a version a span of time; no user is tied to a group."""
    return _together(spark, sf_dir, 1).drop("arm")


def shared_models(spark, sf_dir):
    """Each user picks one of two forests by its losses; a brute-force version holds it."""
    return _together(spark, sf_dir, 2)


QUERIES["shared_models"] = shared_models
