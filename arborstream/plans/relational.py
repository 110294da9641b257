"""Queries of the relational operators over the driver's tables, each with the DuckDB SQL that says the same.

Floating results are compared after floor(x * 1e6 + 0.5) / 1e6 on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as fn
from ..functions.uniforms import uniform, uniform_sql
from ..operators import fills, near, sampler, shingle, slices, summary, thresholder, transforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(c: Column | str) -> Column:
    """Rounded to six places by plain IEEE steps, the same on any engine."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6


def sql_six(e: str) -> str:
    return f"(floor(({e}) * 1e6 + 0.5) / 1e6)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed stream: user_id, event_id, t (microseconds), value."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")


def streams(spark: SparkSession, sf_dir: str) -> slices.Sequences:
    """The stream as one sequence a user."""
    return slices.sliced(stream(spark, sf_dir), "user_id", ORDER)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with rn, the row of its user."""
    return shingle.ordered(stream(spark, sf_dir), "user_id", ["t", "event_id"])


EV = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS t, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
ORDER = ["t", "event_id"]


def _masked() -> Column:
    return F.when(uniform(7, "event_id") >= 0.1, F.col("value"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with about a tenth of its values missing."""
    return events(spark, sf_dir).withColumn("value", _masked())


EVM = EV + f""", evm AS (SELECT * REPLACE (CASE WHEN {uniform_sql("7", "event_id")} >= 0.1 THEN value END AS value) FROM ev)"""

# ---------------------------------------------------------------- shingles

_W4 = "list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def _four(df: DataFrame, name: str = "shingle") -> DataFrame:
    return df.select("user_id", "event_id", *[F.get(name, F.lit(i)).alias(f"v{i}") for i in range(4)])


@query(f"WITH {EV}, s AS (SELECT user_id, event_id, {_W4} AS v FROM ev) SELECT user_id, event_id, v[1] AS v0, v[2] AS v1, v[3] AS v2, v[4] AS v3 FROM s WHERE len(v) = 4")
def shingle_linear(spark, sf_dir):
    return _four(shingle.linear(events(spark, sf_dir), "user_id", ORDER, ["value"], 4))


_RING = ", ".join(f"v[1 + ((({i} - (rn - 4)) % 4 + 4) % 4)::BIGINT] AS v{i}" for i in range(4))


@query(f"WITH {EV}, s AS (SELECT user_id, event_id, rn, {_W4} AS v FROM ev) SELECT user_id, event_id, {_RING} FROM s WHERE len(v) = 4")
def shingle_cyclic(spark, sf_dir):
    return _four(shingle.rotating(events(spark, sf_dir), "user_id", ORDER, ["value"], 4))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, event_id, rn, list({{'a': value, 'b': (rn * 2)::DOUBLE}}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM ev)
SELECT user_id, event_id, v[1 + (rn % 2)].a AS v0, v[1 + (rn % 2)].b AS v1, v[2 - (rn % 2)].a AS v2, v[2 - (rn % 2)].b AS v3 FROM s WHERE len(v) = 2"""
)
def shingle_rotated(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("twice", (F.col("rn") * 2).cast("double"))
    return _four(shingle.rotating(ev, "user_id", ORDER, ["value", "twice"], 2))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, rn, {_W4} AS v, max(rn) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, v[2] AS v0, v[3] AS v1, v[4] AS v2, 50.0::DOUBLE AS v3 FROM s WHERE rn = n AND len(v) = 4"""
)
def shingle_query_lift(spark, sf_dir):
    ev = events(spark, sf_dir)
    windows = shingle.linear(ev, "user_id", ORDER, ["value"], 4)
    asks = ev.select("user_id").distinct().withColumn("q", F.lit(50.0))
    lifted = shingle.complete_query(asks, windows, "user_id", "rn", ["q"])
    return lifted.select("user_id", *[F.get("shingle", F.lit(i)).alias(f"v{i}") for i in range(4)])


@query(
    f"""WITH {EVM}, s AS (SELECT user_id, event_id, {_W4} AS v, count(*) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM evm)
SELECT user_id, event_id, array_to_string([i - 1 FOR i IN range(1, 5) IF v[i] IS NULL], ',') AS missing, array_to_string([(i - 1) + 4 FOR i IN range(1, 5) IF v[i] IS NULL], ',') AS lifted
FROM s WHERE n = 4"""
)
def missing_indices(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(*ORDER)
    rows = masked(spark, sf_dir).withColumn("v", F.array(*[F.lag("value", 3 - i).over(w) for i in range(4)])).where("rn >= 4")
    found = fn.missing_indices(F.col("v"))
    return rows.select("user_id", "event_id", F.concat_ws(",", found.cast("array<string>")).alias("missing"), F.concat_ws(",", fn.lift_indices(found, 4, 8).cast("array<string>")).alias("lifted"))


# ---------------------------------------------------------------- running statistics and transforms

DISCOUNT = 0.05


def _power(x: str, n: str = "rn", before: bool = False, f: float = DISCOUNT) -> str:
    """Discounted sum of the list x of a window by its closed form."""
    keep = 1 - f
    return f"list_sum(list_transform({x}, lambda y, i: y * pow({keep!r}, len({x}) - i)))"


def _dev(rows: str, x: str, out: str, f: float = DISCOUNT, upto: str = "CURRENT ROW") -> str:
    """SELECT list for mean and deviation of x discounted by f over the rows up to here."""
    w = f"list({x}) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
    return f"SELECT *, {w} AS l_{out} FROM {rows}"


def _mean(l: str, f: float = DISCOUNT) -> str:
    return f"coalesce({_power(l, f=f)} / {_power(f'list_transform({l}, lambda y: 1.0)', f=f)}, 0.0)"


def _spread(l: str, f: float = DISCOUNT) -> str:
    return f"sqrt(greatest(0.0, coalesce({_mean(f'list_transform({l}, lambda y: y * y)', f)} - pow({_mean(l, f)}, 2), 0.0)))"


@query(f"WITH {EV}, a AS ({_dev('ev', 'value', 'v')}) SELECT user_id, event_id, {sql_six(_mean('l_v'))} AS mean, {sql_six(_spread('l_v'))} AS deviation FROM a")
def deviation_discounted(spark, sf_dir):
    got = slices.discounted(streams(spark, sf_dir), {"v": ("value", DISCOUNT)}).rows
    return got.select("user_id", "event_id", six("v_mean").alias("mean"), six("v_deviation").alias("deviation"))


def _transformed(spark: SparkSession, sf_dir: str, method: str, weight: float = 1.0) -> DataFrame:
    got = transforms.transformed(streams(spark, sf_dir), "value", method, "y", weight, DISCOUNT)
    return got.rows.select("user_id", "event_id", six("y").alias("y"))


@query(f"WITH {EV} SELECT user_id, event_id, {sql_six('value * 2.5')} AS y FROM ev")
def transform_weighted(spark, sf_dir):
    return _transformed(spark, sf_dir, "WEIGHTED", 2.5)


_DIFF = f"{EV}, d AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn), 0) AS dv FROM ev)"


@query(f"WITH {_DIFF} SELECT user_id, event_id, {sql_six('dv')} AS y FROM d")
def transform_difference(spark, sf_dir):
    return _transformed(spark, sf_dir, "DIFFERENCE")


@query(f"WITH {EV}, a AS ({_dev('ev', 'value', 'v', upto='1 PRECEDING')}) SELECT user_id, event_id, {sql_six('value - ' + _mean('l_v'))} AS y FROM a")
def transform_subtract_ma(spark, sf_dir):
    return _transformed(spark, sf_dir, "SUBTRACT_MA")


@query(
    f"""WITH {EV}, a AS ({_dev('ev', 'value', 'v')}), b AS (SELECT *, {_spread('l_v')} AS sd FROM a),
c AS (SELECT *, list(value) OVER p AS l_p, list(sd) OVER p AS l_s FROM b WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, {sql_six(f"greatest(-100, least(100, (value - {_mean('l_p')}) / (abs({_mean('l_s')}) + 1)))")} AS y FROM c"""
)
def transform_normalize(spark, sf_dir):
    return _transformed(spark, sf_dir, "NORMALIZE")


@query(
    f"""WITH {_DIFF}, a AS ({_dev('d', 'dv', 'd', upto='1 PRECEDING')})
SELECT user_id, event_id, {sql_six(f"greatest(-100, least(100, (dv - {_mean('l_d')}) / ({_spread('l_d')} + 1)))")} AS y FROM a"""
)
def transform_normalize_difference(spark, sf_dir):
    return _transformed(spark, sf_dir, "NORMALIZE_DIFFERENCE")


@query(
    f"""WITH {_DIFF}, a AS (SELECT *, list(value) OVER p AS l_v, list(dv) OVER p AS l_d FROM d WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, {_mean('l_v')} AS m, {_mean('l_d')} AS md, {_spread('l_v')} AS sv, {_spread('l_d')} AS sd FROM a),
c AS (SELECT *, list(sv) OVER p AS l_sv, list(md) OVER p AS l_md, list(sd) OVER p AS l_sd FROM b WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, {sql_six('m')} AS value_mean, {sql_six('md')} AS step_mean, {sql_six(_mean('l_sv'))} AS spread_mean,
  {sql_six(_mean('l_md', DISCOUNT * 0.1))} AS drift, {sql_six(_mean('l_sd', DISCOUNT * 0.1))} AS step_spread FROM c"""
)
def transform_statistics(spark, sf_dir):
    """The five running statistics of a transform."""
    got = transforms.statistics(streams(spark, sf_dir), "value", DISCOUNT).rows
    names = {"value_mean": "value_mean", "step_mean": "step_mean", "spread_mean": "spread_mean", "drift_mean": "drift", "step_spread_mean": "step_spread"}
    return got.select("user_id", "event_id", *[six(c).alias(n) for c, n in names.items()])


@query(f"WITH {EV} SELECT user_id, event_id, {sql_six('value')} AS back FROM ev")
def transform_inverse(spark, sf_dir):
    """Forward and back: every value returns."""
    got = transforms.statistics(streams(spark, sf_dir), "value", DISCOUNT).rows
    back = transforms.inverse("NORMALIZE_DIFFERENCE", transforms.forward("NORMALIZE_DIFFERENCE", "value", 2.0, 1e9), 2.0)
    return got.select("user_id", "event_id", six(F.when(F.col("before").isNull(), F.col("value")).otherwise(back)).alias("back"))


_GAP = f"{EV}, g AS (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 1e6 AS dt FROM ev)"


@query(f"WITH {_GAP}, a AS (SELECT *, list(dt) FILTER (dt IS NOT NULL) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM g) SELECT user_id, event_id, {sql_six(_mean('l'))} AS mean, {sql_six(_spread('l'))} AS deviation FROM a WHERE rn > 1")
def time_gap_stats(spark, sf_dir):
    rows = slices.previous(streams(spark, sf_dir), {"last": "t"})
    got = slices.discounted(rows.add(dt=(F.col("t") - F.col("last")) / 1e6), {"dt": ("dt", DISCOUNT)}).rows
    return got.where("last is not null").select("user_id", "event_id", six("dt_mean").alias("mean"), six("dt_deviation").alias("deviation"))


@query(
    f"""WITH {_GAP}, s AS (SELECT user_id, event_id, list({{'a': value, 'b': coalesce(dt, 0)}}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM g)
SELECT user_id, event_id, v[1].a AS v0, {sql_six('v[1].b')} AS v1, v[2].a AS v2, {sql_six('v[2].b')} AS v3 FROM s WHERE len(v) = 2"""
)
def time_augmented_shingle(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(*ORDER)
    ev = events(spark, sf_dir).withColumn("dt", F.coalesce((F.col("t") - F.lag("t").over(w)) / 1e6, F.lit(0.0)))
    four = _four(shingle.linear(ev, "user_id", ORDER, ["value", "dt"], 2))
    return four.select("user_id", "event_id", "v0", six("v1").alias("v1"), "v2", six("v3").alias("v3"))


@query(f"WITH {EVM}, a AS ({_dev('evm', 'CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END', 'q')}) SELECT user_id, event_id, {sql_six(_mean('l_q'))} AS quality FROM a")
def data_quality(spark, sf_dir):
    known = stream(spark, sf_dir).withColumn("known", F.when(_masked().isNull(), 0.0).otherwise(1.0))
    got = slices.discounted(slices.sliced(known, "user_id", ORDER), {"known": ("known", DISCOUNT)}).rows
    return got.select("user_id", "event_id", six("known_mean").alias("quality"))


@query(f"WITH {EV} SELECT user_id, event_id, {sql_six('CASE WHEN rn > 8 THEN 0.9 * (1 - exp(-(rn * 0.05))) ELSE 0 END')} AS confidence FROM ev")
def data_confidence(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", six(fn.data_confidence(0.05, F.col("rn"), F.lit(0.9), 8)).alias("confidence"))


# ---------------------------------------------------------------- fills and gaps


def _filled(method: str, fixed: float = 0.0) -> Query:
    def run(spark, sf_dir):
        got = fills.fill(masked(spark, sf_dir), "user_id", ORDER, "value", method, fixed)
        return got.select("user_id", "event_id", six("filled").alias("filled"))

    run.__name__ = "fill_" + method.lower().split("_")[0]
    return run


_PW = "(PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FW = "(PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FILL = f"{EVM}, b AS (SELECT *, last_value(value IGNORE NULLS) OVER {_PW} AS p, first_value(value IGNORE NULLS) OVER {_FW} AS f, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {_PW} AS pn, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {_FW} AS fnn FROM evm)"
for _method, _sql in {
    "ZERO": "coalesce(value, 0)",
    "FIXED_VALUES": "coalesce(value, 12.5)",
    "PREVIOUS": "coalesce(p, 0)",
    "NEXT": "coalesce(f, 0)",
    "LINEAR": "coalesce(value, p + (f - p) * (rn - pn) / (fnn - pn), p, f, 0)",
}.items():
    query(f"WITH {_FILL} SELECT user_id, event_id, {sql_six(_sql)} AS filled FROM b")(_filled(_method, 12.5))

_GAPS = f"""{EV}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM ev),
h AS (SELECT *, avg(step) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_step FROM g),
found AS (SELECT *, ceil(step / mean_step)::BIGINT AS steps FROM h WHERE step >= 1.5 * mean_step)"""


@query(f"WITH {_GAPS} SELECT user_id, event_id, t, step, steps FROM found")
def gap_detection(spark, sf_dir):
    return fills.gaps(events(spark, sf_dir), "user_id", "t").select("user_id", "event_id", "t", "step", "steps")


@query(f"WITH {_GAPS} SELECT user_id, event_id, (t - step + floor(step * i / steps))::BIGINT AS t FROM found, LATERAL (SELECT unnest(range(1, steps)) AS i) WHERE steps > 1")
def gap_rows(spark, sf_dir):
    return fills.insert_missing(fills.gaps(events(spark, sf_dir), "user_id", "t"), "t").select("user_id", "event_id", "t")


# ---------------------------------------------------------------- sampling

LAMBDA = 1 / 640


def _key_sql(u: str, seq: str = "event_id", decay: str = repr(LAMBDA), w: str | None = None) -> str:
    e = f"(-ln({u}))"
    return f"ln({e}{' / ' + w if w else ''}) - {seq} * {decay}"


def _reservoir_sql(key: str, rows: str = "events", where: str = "TRUE", cap: int = 64, trees: int = 4, pre: str = "") -> str:
    return f"WITH {pre} d AS (SELECT *, t.tree::INTEGER AS tree, {key} AS k FROM {rows}, range({trees}) t(tree) WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY k, event_id) AS rk FROM d) SELECT tree, event_id FROM r WHERE rk <= {cap}"


_U = uniform_sql("3", "t.tree", "event_id")


def _taken(df: DataFrame) -> DataFrame:
    return df.select("tree", "event_id")


@query(_reservoir_sql(_key_sql(_U)))
def reservoir_sample(spark, sf_dir):
    return _taken(sampler.reservoir(table(spark, sf_dir, "events"), 4, 64, "event_id", LAMBDA, seed=3))


@query(_reservoir_sql(_key_sql(_U, decay="0.0")))
def reservoir_uniform(spark, sf_dir):
    return _taken(sampler.reservoir(table(spark, sf_dir, "events"), 4, 64, "event_id", 0.0, seed=3))


@query(_reservoir_sql(_key_sql(_U, w="(event_id % 5)"), where="event_id % 5 > 0"))
def reservoir_weighted(spark, sf_dir):
    return _taken(sampler.reservoir(table(spark, sf_dir, "events"), 4, 64, "event_id", LAMBDA, seed=3, weight=F.col("event_id") % 5))


@query(_reservoir_sql(_key_sql(_U)))
def reservoir_merge(spark, sf_dir):
    """The sample of a union from the samples of its halves."""
    ev = table(spark, sf_dir, "events")
    halves = [sampler.reservoir(ev.where(F.col("event_id") % 2 == i), 4, 64, "event_id", LAMBDA, seed=3) for i in (0, 1)]
    return _taken(sampler.merge(*halves, 64, "event_id"))


_STEEP = "(CASE WHEN event_id < 500 THEN 0.001 ELSE 0.01 END)"


@query(
    f"""WITH c AS (SELECT *, sum({_STEEP}::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ds FROM events),
d AS (SELECT user_id, event_id, t.tree::INTEGER AS tree, ln(-ln({_U})) - ds AS k FROM c, range(2) t(tree)),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY k, event_id) AS rk FROM d) SELECT tree, event_id FROM r WHERE rk <= 64"""
)
def reservoir_decay_change(spark, sf_dir):
    """A decay that changes on the way: keys use the decay gathered so far."""
    ev = sampler.accumulated_decay(table(spark, sf_dir, "events"), "user_id", "event_id", F.when(F.col("event_id") < 500, 0.001).otherwise(0.01))
    drawn = ev.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(1))))
    keyed = drawn.withColumn("sample_key", sampler.sample_key(uniform(3, "tree", "event_id"), F.col("decay_sum"), 1.0))
    return _taken(sampler.smallest(keyed, 64, "event_id"))


_U1 = uniform_sql("5", "c_custkey")


@query(
    f"""WITH t AS (SELECT sum(abs(c_acctbal)) AS s FROM customer)
SELECT c_custkey, {sql_six('CASE WHEN abs(c_acctbal) > 0.0008 * s THEN abs(c_acctbal) ELSE abs(c_acctbal) / 0.3 END')} AS w
FROM customer, t WHERE abs(c_acctbal) > 0.0008 * s OR {_U1} < 0.3"""
)
def weighted_downsample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("w"))
    return sampler.downsample(c, "w", "c_custkey", 0.0008, 0.3, seed=5).select("c_custkey", six("w").alias("w"))


@query(
    """WITH r AS (SELECT l_returnflag, l_orderkey, row_number() OVER w AS place, sum(l_quantity) OVER w AS running, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS whole FROM lineitem
 WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY place) AS rn FROM r WHERE running >= 0.25 * whole)
SELECT l_returnflag, l_orderkey, running FROM k WHERE rn = 1"""
)
def prefix_pick(spark, sf_dir):
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *place)
    return sampler.prefix_pick(li, "l_returnflag", place, "l_quantity", 0.25).select("l_returnflag", "l_orderkey", "running")


@query(f"WITH {EV} SELECT user_id, event_id, {sql_six('CASE WHEN rn / 64.0 < 0.5 THEN 1 WHEN rn / 64.0 >= 1 THEN 0 ELSE 1 - (rn / 64.0 - 0.5) / 0.5 END')} AS p FROM ev")
def initial_admission(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_id", six(sampler.initial_admission(F.col("rn"), 64, 0.5)).alias("p"))


# ---------------------------------------------------------------- distances, neighbours, summaries

_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _distance(name: str, f: Callable[[Column, Column], Column]) -> Query:
    def run(spark, sf_dir):
        e = _emb(spark, sf_dir)
        a = e.select((F.col("vec_id") + 1).alias("next"), F.col("vec_id").alias("a"), F.col("v").alias("va"))
        return a.join(e, F.col("next") == F.col("vec_id")).select("a", F.col("vec_id").alias("b"), six(f(F.col("va"), F.col("v"))).alias("d"))

    run.__name__ = name
    return run


for _name, _f, _sql in (
    ("dist_l1", fn.l1, "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"),
    ("dist_l2", fn.l2, "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"),
    ("dist_linf", fn.linf, "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"),
):
    query(f"WITH {_EMB} SELECT a.vec_id AS a, b.vec_id AS b, {sql_six(_sql)} AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")(_distance(_name, _f))

_PD = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


#: About one in twenty pairs of the embeddings lies nearer than this.
RADIUS = 1.25


@query(f"WITH {_EMB}, p AS (SELECT a.vec_id AS query, b.vec_id AS near, {_PD} AS d FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query, near, {sql_six('d')} AS d FROM p WHERE d < {RADIUS}")
def neighbors_within(spark, sf_dir):
    """Rows of a stated query set (every hundredth) against all rows."""
    got = near.within(_emb(spark, sf_dir), F.col("id") % 100 == 0, RADIUS, "vec_id", "v")
    return got.select("query", "near", six("d").alias("d"))


_CEN = "c AS (SELECT label AS centre, list(avg_x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS avg_x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return mean.groupBy(F.col("label").alias("centre")).agg(F.transform(ordered, lambda s: s["x"]).alias("vc"))


@query(
    f"""WITH {_EMB}, {_CEN}, q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
p AS (SELECT a.vec_id AS query, b.centre, b.v AS bv, {_PD} AS d FROM q a, c b)
SELECT query, centre, {sql_six('d')} AS d FROM p b WHERE NOT EXISTS (
  SELECT 1 FROM p a WHERE a.query = b.query AND a.d < b.d
  AND {_PD.replace('a.v', 'a.bv').replace('b.v', 'b.bv')} < b.d AND b.d > sqrt(a.d * a.d + pow({_PD.replace('a.v', 'a.bv').replace('b.v', 'b.bv')}, 2)))"""
)
def neighbors_occlusion(spark, sf_dir):
    """Cluster centres that no nearer centre hides from the query."""
    c = _centres(spark, sf_dir)
    q = _emb(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "v")
    p = q.join(near.small(c)).select("query", "centre", "vc", fn.l2(F.col("v"), F.col("vc")).alias("d"))
    a = p.select(F.col("query").alias("q2"), F.col("vc").alias("va"), F.col("d").alias("da"))
    between = fn.l2(F.col("va"), F.col("vc"))
    hidden = (F.col("query") == F.col("q2")) & (F.col("da") < F.col("d")) & (between < F.col("d")) & (F.col("d") > F.sqrt(F.col("da") * F.col("da") + between * between))
    return p.join(a, hidden, "left_anti").select("query", "centre", six("d").alias("d"))


@query(
    """WITH t AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM t)
SELECT l_returnflag, min(x) FILTER (r >= 0.1 * t) AS lower, min(x) FILTER (r >= 0.5 * t) AS median, min(x) FILTER (r >= 0.9 * t) AS upper FROM r GROUP BY l_returnflag"""
)
def weighted_percentiles(spark, sf_dir):
    return summary.weighted_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", {"lower": 0.1, "median": 0.5, "upper": 0.9})


@query(
    f"""WITH s AS (SELECT c_nationkey, sum(w) AS total, sum(w * x) AS s, sum(w * x * x) AS q FROM (SELECT c_nationkey, c_acctbal AS x, (1 + c_custkey % 3)::DOUBLE AS w FROM customer) GROUP BY 1)
SELECT c_nationkey, total, {sql_six('s / total')} AS mean, floor(sqrt(greatest(0, q / total - pow(s / total, 2))) * 1e3 + 0.5) / 1e3 AS deviation FROM s"""
)
def sample_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), (1 + F.col("c_custkey") % 3).cast("double").alias("w"))
    m = summary.weighted_moments(c, ["c_nationkey"], "x", "w")
    return m.select("c_nationkey", "total", six("mean").alias("mean"), (F.floor(F.col("deviation") * 1e3 + 0.5) / 1e3).alias("deviation"))


@query(
    f"""WITH {_EMB}, {_CEN}, p AS (SELECT a.vec_id AS point_id, b.centre AS centre_id, {_PD} AS d FROM e a, c b), n AS (SELECT *, min(d) OVER (PARTITION BY point_id) AS nd FROM p),
r AS (SELECT *, CASE WHEN nd = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE nd / d END AS raw FROM n WHERE d <= 1.25 * nd)
SELECT point_id, centre_id, {sql_six('raw / sum(raw) OVER (PARTITION BY point_id)')} AS share FROM r"""
)
def soft_assign_step(spark, sf_dir):
    points = _emb(spark, sf_dir).select(F.col("vec_id").alias("point_id"), "v")
    centres = _centres(spark, sf_dir).withColumnRenamed("centre", "centre_id")
    got = summary.soft_assign(points, centres, fn.l2(F.col("v"), F.col("vc")))
    return got.select("point_id", "centre_id", six("share").alias("share"))


@query(
    """WITH x AS (SELECT label, i, v, sum(w) AS w FROM (SELECT label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS v, (1 + vec_id % 3)::DOUBLE AS w FROM embeddings) GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY label, i ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, sum(w) OVER (PARTITION BY label, i) AS t FROM x)
SELECT label, i, min(v) FILTER (r >= 0.5 * t) AS median FROM r GROUP BY label, i"""
)
def weighted_median_center(spark, sf_dir):
    e = _emb(spark, sf_dir).select("label", (1 + F.col("vec_id") % 3).cast("double").alias("w"), F.posexplode("v").alias("i", "x"))
    return summary.weighted_percentile(e, ["label", "i"], "x", "w", {"median": 0.5})


_REPS = "reps AS (SELECT p_brand AS brand, min(p_name) AS rep FROM part GROUP BY p_brand)"


@query(
    f"""WITH {_REPS}, d AS (SELECT p_partkey, brand, levenshtein(p_name, rep) AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(p_name, rep), brand) AS rk FROM part, reps)
SELECT p_partkey, brand, d::INTEGER AS d FROM d WHERE rk = 1"""
)
def edit_distance_assign(spark, sf_dir):
    """Strings to the nearest of a small set of representatives by edit distance."""
    p = table(spark, sf_dir, "part")
    reps = p.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_name").alias("rep"))
    few = reps.limit(near.SMALL_ROWS + 1).count() <= near.SMALL_ROWS
    if few:  # all of them beside every row, whose nearest is found where it lies: no row is repeated
        listed = reps.agg(F.collect_list(F.struct("brand", "rep")).alias("reps"))
        nearest = F.array_min(F.transform("reps", lambda r: F.struct(F.levenshtein("p_name", r["rep"]).alias("d"), r["brand"].alias("brand"))))
        each = p.select("p_partkey", "p_name").join(F.broadcast(listed)).select("p_partkey", nearest.alias("m")).select("p_partkey", "m.d", "m.brand")
    else:
        each = p.join(reps).withColumn("d", F.levenshtein("p_name", "rep"))
    return each.groupBy("p_partkey").agg(F.min(F.struct("d", "brand")).alias("m")).select("p_partkey", "m.brand", "m.d")


# ---------------------------------------------------------------- scores, thresholds, forecasts

_GRID = "(1 + event_id % 7) AS d, (1 + event_id % 11) AS m, 64 AS t"


@query(
    f"""SELECT event_id, {sql_six('1.0 / (d + log2(m + 1))')} AS seen, {sql_six('1.0 / (d + 1)')} AS unseen, {sql_six('1 - m / (2.0 * t)')} AS damp,
{sql_six('value * log2(t + 1)')} AS normalized, {sql_six('1.0 / (m + 1)')} AS displaced_seen, {sql_six('m')} AS displaced_unseen, {sql_six('value / (1.0 + t)')} AS displaced_normal, {sql_six('d + ln(m)')} AS height FROM (SELECT event_id, value, {_GRID} FROM events)"""
)
def score_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d, m, t = 1 + F.col("event_id") % 7, 1 + F.col("event_id") % 11, F.lit(64)
    shown = {
        "seen": fn.seen(d, m), "unseen": fn.unseen(d, m), "damp": fn.damp(m, t), "normalized": fn.normalizer(F.col("value"), t),
        "displaced_seen": fn.displacement_seen(d, m), "displaced_unseen": fn.displacement_unseen(d, m),
        "displaced_normal": fn.displacement_normalizer(F.col("value"), t), "height": fn.height_seen(d, m),
    }
    return e.select("event_id", *[six(c).alias(n) for n, c in shown.items()])


@query(
    f"""WITH {_EMB}, b AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM (SELECT i, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM e WHERE label = 0) GROUP BY i)),
g AS (SELECT vec_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: greatest(0, v[i] - hi[i]) + greatest(0, lo[i] - v[i]))) AS s, list_sum(list_transform(range(1, len(v) + 1), lambda i: hi[i] - lo[i])) AS r FROM e, b)
SELECT vec_id, {sql_six('CASE WHEN s = 0 THEN 0 ELSE s / (s + r) END')} AS p FROM g"""
)
def cut_probability(spark, sf_dir):
    e = _emb(spark, sf_dir)
    sides = e.where("label = 0").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    side = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c]).alias(c)
    box = sides.agg(side("lo"), side("hi"))
    return e.join(F.broadcast(box)).select("vec_id", six(fn.cut_probability(F.col("v"), F.col("lo"), F.col("hi"))).alias("p"))  # one row


@query(
    f"""WITH x AS (SELECT event_id, [value / 100, value / 50] AS m, [value / 10, value / 20] AS d, [0.25, 0.5] AS p FROM events),
y AS (SELECT event_id, list_sum(m) / 64 AS t, list_sum(list_transform(range(1, 3), lambda i: pow(d[i] / p[i], 2) * p[i])) AS v FROM x)
SELECT event_id, {sql_six('CASE WHEN t = 0 THEN 0 ELSE t / (0.001 * t + v) END')} AS density FROM y"""
)
def density_readout(spark, sf_dir):
    v = F.col("value")
    d = fn.density_readout(F.array(v / 100, v / 50), F.array(v / 10, v / 20), F.array(F.lit(0.25), F.lit(0.5)), 64, 2)
    return table(spark, sf_dir, "events").select("event_id", six(d).alias("density"))


_STEP = """{'s': a.s + v.s, 'q': a.q + v.s * v.s, 'n': a.n + 1, 'h': a.h + CASE WHEN a.n + 1 >= 5 AND (v.s - (a.s + v.s) / (a.n + 1)) + 1e-6 > 0.5 * sqrt(greatest(0.0, (a.q + v.s * v.s) / (a.n + 1) - pow((a.s + v.s) / (a.n + 1), 2)) * (a.n + 1) / greatest(1, a.n)) THEN 1 ELSE 0 END}"""


@query(
    f"""WITH {EV}, l AS (SELECT user_id, list(value ORDER BY rn) AS vs FROM ev GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'n': 0, 'h': 0}}, list_transform(vs, lambda x: {{'s': x, 'q': 0.0::DOUBLE, 'n': 0, 'h': 0}})),
  lambda a, v: CASE WHEN a.h >= 10 THEN a ELSE {_STEP} END) AS z FROM l)
SELECT user_id, {sql_six('z.s / z.n')} AS score FROM r"""
)
def converged_score(spark, sf_dir):
    """Means that stop early once enough witnesses lie above."""
    lists = events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("vs"))
    return lists.select("user_id", six(fn.converging_mean(F.col("vs"))).alias("score"))


@query(
    f"""WITH {EV}, a AS ({_dev('ev', 'value', 'v', upto='1 PRECEDING')}), b AS (SELECT *, {_mean('l_v')} AS m, {_spread('l_v')} AS s FROM a)
SELECT user_id, event_id, {sql_six('CASE WHEN rn <= 10 THEN 0 ELSE m + 3 * s END')} AS threshold,
{sql_six('CASE WHEN rn <= 10 THEN 0 WHEN s = 0 THEN CASE WHEN value > m + 1e-10 THEN 1 ELSE 0 END ELSE greatest(0, (least(6, (value - m) / s) - 3) / 3) END')} AS grade FROM b"""
)
def primary_grade(spark, sf_dir):
    got = slices.discounted(streams(spark, sf_dir), {"v": ("value", DISCOUNT)}).rows
    threshold, grade = thresholder.primary(F.col("value"), F.col("before_v_count"), F.col("before_v_mean"), F.col("before_v_deviation"))
    return got.select("user_id", "event_id", six(threshold).alias("threshold"), six(grade).alias("grade"))


def threshold_sql(source: str, discount: float = DISCOUNT, z: str = "3.0") -> str:
    """CTEs up to `v` (user_id, event_id, x, lim, lev): thresholds and grades of scores x in `source` (user_id, event_id, rn, x); z is an expression of m, the mean before."""
    return f"""s AS (SELECT user_id, event_id, rn, x, least(x, 2.0) AS c, x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY rn), 0) AS dx FROM {source}),
p AS (SELECT *, list(c) OVER w AS l_c, list(dx) OVER w AS l_d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, {_mean('l_c', discount)} AS m, {_spread('l_c', discount)} AS sd, {_spread('l_d', discount)} AS ch FROM p),
g AS (SELECT *, CASE WHEN m > c THEN m - c END AS gap, {z}::DOUBLE AS z FROM q),
h AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_g FROM g),
i AS (SELECT *, rn - 1 AS n, sqrt(2.0) * {_spread('l_g', discount / 2)} AS fall FROM h),
j AS (SELECT *, greatest(0, least(1, (n - 10) / 10.0)) AS warm, 0.5 * least(sd, greatest(ch, fall)) + 0.5 * ch AS lt FROM i),
k AS (SELECT *, (z - 1) * lt + sd AS width, CASE WHEN warm >= 1 AND m < 0.9 THEN 0.8 * m / 0.9 ELSE 0.8 END AS fl FROM j),
t AS (SELECT *, CASE WHEN n >= 10 THEN greatest(fl, warm * (m + width) + (1 - warm) * 1.5) ELSE greatest(1.5, fl) END AS lim FROM k),
u AS (SELECT *, CASE WHEN x < lim THEN 0 WHEN n >= 10 THEN CASE WHEN width > 0 THEN greatest(0, least(z, (x - lim) * z / width) / z) ELSE 2 END ELSE least(1, greatest(0, (x - 0.8) / 0.8)) END AS sur FROM t),
v AS (SELECT *, least(1, floor(sur * 20) / 16) AS lev FROM u)"""


_TH = f"{EV}, {threshold_sql('(SELECT user_id, event_id, rn, value / 50 AS x FROM ev)')}"


@query(f"WITH {_TH} SELECT user_id, event_id, {sql_six('CASE WHEN x >= lim AND lev = 0 THEN x ELSE lim END')} AS threshold, {sql_six('lev')} AS grade FROM v")
def full_threshold(spark, sf_dir):
    """Warm-up, long-term deviation and the stepped surprise of a score series."""
    return _graded(spark, sf_dir)


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stream(spark, sf_dir).withColumn("x", F.col("value") / 50)
    got = thresholder.graded(slices.sliced(scores, "user_id", ORDER), "x", DISCOUNT, shingle=4)
    return got.select("user_id", "event_id", six("threshold").alias("threshold"), six("grade").alias("grade"))


@query(f"WITH {_TH} SELECT user_id, event_id, {sql_six('lev')} AS grade FROM v WHERE lev > 0")
def grade_filter(spark, sf_dir):
    """The default descriptor filter: rows with a grade above 0."""
    return _graded(spark, sf_dir).where("grade > 0").select("user_id", "event_id", "grade")


# a persistence forecast: the value `h` rows ahead is the present one, give or take 10
_FC = f"{EV}, f AS (SELECT a.user_id, a.rn + h AS rn, h::INTEGER AS h, a.value AS v, a.value - 10 AS lo, a.value + 10 AS hi FROM ev a, range(1, 4) r(h)), j AS (SELECT f.*, e.value AS actual FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn)"


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("user_id", "rn", "value")
    made = ev.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "user_id", (F.col("rn") + F.col("h")).alias("rn"), "h", F.col("value").alias("v"), (F.col("value") - 10).alias("lo"), (F.col("value") + 10).alias("hi")
    )
    return made.join(ev.withColumnRenamed("value", "actual"), ["user_id", "rn"])


@query(f"WITH {_FC} SELECT user_id, h, {sql_six('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS precision, count(*) AS n FROM j GROUP BY user_id, h")
def interval_precision(spark, sf_dir):
    hit = F.when(F.col("actual").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)
    return _forecasts(spark, sf_dir).groupBy("user_id", "h").agg(six(F.avg(hit)).alias("precision"), F.count("*").alias("n"))


@query(f"WITH {_FC} SELECT user_id, h, {sql_six('sqrt(avg(pow(greatest(0, actual - v), 2)))')} AS high, {sql_six('sqrt(avg(pow(least(0, actual - v), 2)))')} AS low, {sql_six('avg(actual - v)')} AS mean FROM j GROUP BY user_id, h")
def forecast_rmse(spark, sf_dir):
    e = F.col("actual") - F.col("v")
    up, down = F.greatest(F.lit(0.0), e), F.least(F.lit(0.0), e)
    got = _forecasts(spark, sf_dir).groupBy("user_id", "h")
    return got.agg(six(F.sqrt(F.avg(up * up))).alias("high"), six(F.sqrt(F.avg(down * down))).alias("low"), six(F.avg(e)).alias("mean"))


_CAL = f"{_FC}, e AS (SELECT user_id, h, avg(actual - v) AS em, avg(actual - v) - 1.3 * stddev_pop(actual - v) AS el, avg(actual - v) + 1.3 * stddev_pop(actual - v) AS eu FROM j GROUP BY user_id, h), k AS (SELECT j.*, em, el, eu FROM j JOIN e USING (user_id, h))"


def calibrated(method: str, v: Column, lo: Column, hi: Column, mean: Column, low: Column, high: Column, least: float, most: float) -> tuple[Column, Column, Column]:
    """NONE leaves a forecast; MINIMAL widens its interval by the observed errors; SIMPLE moves its value too; limits hold."""
    if method == "NONE":
        return v, lo, hi
    floor, top = F.lit(least), F.lit(most)
    value = F.least(F.greatest(v + mean if method == "SIMPLE" else v, floor), top)
    return value, F.greatest(F.least(lo, value + low), floor), F.least(F.greatest(hi, value + high), top)


def _calibrated(method: str) -> Query:
    def run(spark, sf_dir):
        f = _forecasts(spark, sf_dir)
        e = F.col("actual") - F.col("v")
        errors = f.groupBy("user_id", "h").agg(F.avg(e).alias("em"), (F.avg(e) - 1.3 * F.stddev_pop(e)).alias("el"), (F.avg(e) + 1.3 * F.stddev_pop(e)).alias("eu"))
        c = F.col
        got = calibrated(method, c("v"), c("lo"), c("hi"), c("em"), c("el"), c("eu"), 0.0, 120.0)
        return f.join(errors, ["user_id", "h"]).select("user_id", "rn", "h", *[six(x).alias(n) for x, n in zip(got, ("value", "lower", "upper"), strict=True)])

    run.__name__ = f"calibrate_{method.lower()}"
    return run


for _method, _shift in (("MINIMAL", "v"), ("SIMPLE", "v + em")):
    _v = f"least(greatest({_shift}, 0.0), 120.0)"
    query(f"WITH {_CAL} SELECT user_id, rn, h, {sql_six(_v)} AS value, {sql_six(f'greatest(least(lo, {_v} + el), 0.0)')} AS lower, {sql_six(f'least(greatest(hi, {_v} + eu), 120.0)')} AS upper FROM k")(_calibrated(_method))
query(f"WITH {_CAL} SELECT user_id, rn, h, {sql_six('v')} AS value, {sql_six('lo')} AS lower, {sql_six('hi')} AS upper FROM k")(_calibrated("NONE"))


@query(f"WITH {EV} SELECT user_id, event_id, {sql_six('value * 2 - 3')} AS value, {sql_six('least(value * 2 - 3, (value - 5) * 2 - 3)')} AS lower, {sql_six('greatest(value * 2 - 3, (value + 5) * 2 - 3)')} AS upper FROM ev")
def range_shift_scale(spark, sf_dir):
    v = F.col("value")
    got = fn.expand_range(v, v - 5, v + 5, F.lit(-3.0), F.lit(2.0))
    return events(spark, sf_dir).select("user_id", "event_id", *[six(x).alias(n) for x, n in zip(got, ("value", "lower", "upper"), strict=True)])
