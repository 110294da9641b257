"""Queries of the sequential operators: detectors, forecasts, clusters, many series, streams and snapshots.

They have no SQL; the tests hold them to scenarios and invariants.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import forest as fo
from ..operators import lockstep, summaries
from ..operators.caster import Caster, ErrorTracker
from ..operators.detector import Detector
from ..operators.glocal import GlobalLocal
from ..operators.multi import ManySeries
from ..operators.near import small
from ..operators.predictive import PredictiveForest
from ..operators.scan import dealt, scan
from ..streaming.processor import ROCKSDB, detect_stream
from .relational import ORDER, Query, events, masked, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A user has some 50 to 100 rows: small samples, as a key's stream is short.
SMALL = {"trees": 20, "capacity": 32, "shingle": 4}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


ROW = "user_id long, event_id long, score double, threshold double, grade double, correction string, confidence double, expected double, imputes int"


def detected(df: DataFrame, **settings) -> DataFrame:
    """Every row of every user through a detector of its own."""

    def start(key, seat):
        d = Detector(base=1, seed=int(key), **{**SMALL, **settings})
        d.forest = seat(d.forest)

        def step(row):
            r = yield from d.asking([row[1]], row[3])
            return [(row[0], row[2], r.score, r.threshold, r.grade, r.correction, r.confidence, r.expected[0] if r.expected else None, r.imputes)]

        return step

    return lockstep.scan(df, "user_id", ORDER, ["user_id", "value", "event_id", "t"], start, ROW)


@query
def detect_thresholded(spark, sf_dir):
    return detected(events(spark, sf_dir))


@query
def detect_distance(spark, sf_dir):
    return detected(events(spark, sf_dir), strategy="DISTANCE")


@query
def detect_multi_mode(spark, sf_dir):
    return detected(events(spark, sf_dir), strategy="MULTI_MODE")


@query
def detect_multi_mode_recall(spark, sf_dir):
    return detected(events(spark, sf_dir), strategy="MULTI_MODE_RECALL")


@query
def detect_normalized(spark, sf_dir):
    return detected(events(spark, sf_dir), transform="NORMALIZE")


@query
def detect_auto_adjust(spark, sf_dir):
    return detected(events(spark, sf_dir), transform="NORMALIZE_DIFFERENCE", auto_adjust=True)


@query
def detect_alert_once(spark, sf_dir):
    return detected(events(spark, sf_dir), alert_once=True)


@query
def detect_time_augmented(spark, sf_dir):
    return detected(events(spark, sf_dir), mode="TIME_AUGMENTED")


@query
def detect_missing_values(spark, sf_dir):
    return detected(masked(spark, sf_dir), imputation="PREVIOUS")


@query
def detect_streaming_impute(spark, sf_dir):
    return detected(masked(spark, sf_dir), mode="STREAMING_IMPUTE", imputation="RCF")


@query
def detect_lazy_admission(spark, sf_dir):
    """Reservoirs that fill slowly above an eighth."""
    return detected(events(spark, sf_dir), accept=0.125)


@query
def sequential_analysis(spark, sf_dir):
    """One-shot batch detection: only the rows with a grade."""
    return detected(events(spark, sf_dir)).where("grade > 0")


#: Casters that pay side by side: they ask more of a row than a detector does.
FEW = 48


def _cast(spark: SparkSession, sf_dir: str, calibration: str, learned: bool = False) -> DataFrame:
    def start(key, seat):
        c = Caster(Detector(base=1, seed=int(key), **SMALL), 3, calibration, lower_limit=0.0, learned=learned)
        c.detector.forest = seat(c.detector.forest)
        if learned:
            c.errors.model = seat(c.errors.model)

        def step(row):
            r, steps, learnt = yield from c.asking([row[1]], row[3])
            return [(row[0], row[2], r.grade, h + 1, *s[0], *c.errors.widened(h, 0, learnt[h][0]), c.errors.hits[h][0].mean) for h, s in enumerate(steps)]

        return step

    schema = "user_id long, event_id long, grade double, h int, value double, lower double, upper double, error_mean double, error_lower double, error_upper double, precision double"
    shapes = [(SMALL["trees"], SMALL["capacity"], SMALL["shingle"])]
    if learned:
        shapes.append(ErrorTracker.shape(1))
    return lockstep.scan(events(spark, sf_dir), "user_id", ORDER, ["user_id", "value", "event_id", "t"], start, schema, thin=FEW, lanes=lockstep.room(*shapes))


@query
def forecast_caster(spark, sf_dir):
    return _cast(spark, sf_dir, "SIMPLE")


@query
def forecast_caster_minimal(spark, sf_dir):
    return _cast(spark, sf_dir, "MINIMAL")


@query
def forecast_learned_errors(spark, sf_dir):
    """Intervals from a second forest over past errors."""
    return _cast(spark, sf_dir, "SIMPLE", learned=True)


@query
def predictive_forest(spark, sf_dir):
    """The next value of each user from the last, learnt as the rows pass."""

    def start(key, seat):
        p = PredictiveForest(2, 20, 32, "NORMALIZE", seed=int(key))
        p.forest = seat(p.forest)
        last = [None]

        def step(row):
            before, last[0] = last[0], row[1]
            if before is None:
                return []
            guess = (yield from p.predictions([before, 0.0], [1]))[0][1] if p.forest.ready else None
            s = yield "score", p.forest, p._in([before, row[1]])
            yield from p.updates([before, row[1]])
            return [(row[0], row[2], guess, s)]

        return step

    return lockstep.scan(events(spark, sf_dir), "user_id", ORDER, ["user_id", "value", "event_id"], start, "user_id long, event_id long, predicted double, score double")


@query
def cluster_centers(spark, sf_dir):
    """Clusters of the live sample of a forest over all vectors: size of the sample, whatever the table."""
    e = table(spark, sf_dir, "embeddings")
    f = fo.fit(e, F.col("embedding"), "vec_id", 4, 128, 1 / 1280, 3)
    items = [(p, 1.0) for t in f.trees for p in t.points]
    found = cl.cluster(items, 5, cl.l2, seed=1)
    return spark.createDataFrame([(i, float(c.weight), float(c.radius), [float(x) for x in c.primary]) for i, c in enumerate(found)], "cluster int, weight double, radius double, centre array<double>")


#: Weighted points of a nation that are clustered, and those that are merged to as many at once on the way there.
CLUSTERED, PART = 64, 1024


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    return abs(float(a[0]) - float(b[0]))


def _merged(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CLUSTERED weighted points at most: of ascending ones the two whose merger moves least (by squares) are merged first."""
    while len(x) > CLUSTERED:
        i = int(np.argmin(w[:-1] * w[1:] / (w[:-1] + w[1:]) * np.diff(x) ** 2))
        total = w[i] + w[i + 1]
        x[i], w[i] = (x[i] * w[i] + x[i + 1] * w[i + 1]) / total, total
        x, w = np.delete(x, i + 1), np.delete(w, i + 1)
    return x, w


def _condensed(points: DataFrame) -> DataFrame:
    """(c_nationkey, x, w): equal values of a nation as one weighted point, merged in parts until it has CLUSTERED at most; weights add up."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, w = _merged(pdf["x"].to_numpy(copy=True), pdf["w"].to_numpy(copy=True))
        return pd.DataFrame({"c_nationkey": pdf["c_nationkey"].iloc[0], "x": x, "w": w})

    equal = points.groupBy("c_nationkey", "x").agg(F.sum("w").alias("w")).persist()
    sizes = equal.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= CLUSTERED:
        return equal
    parts = sizes.select(F.col("c_nationkey").alias("nation"), F.ceil(F.col("n") / PART).alias("parts"))
    dealt = equal.join(small(parts), F.col("c_nationkey").eqNullSafe(F.col("nation")))
    dealt = dealt.select("c_nationkey", "x", "w", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
    return _condensed(dealt.groupBy("c_nationkey", "part").applyInPandas(part, "c_nationkey int, x double, w double"))


@query
def cluster_multi(spark, sf_dir):
    """Clusters with several representatives each, of each nation's customers' balances; their weights add up to its rows."""
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("x"), F.lit(1.0).alias("w")).where("x is not null")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        found = cl.cluster([(np.array([x]), w) for x, w in zip(pdf["x"], pdf["w"], strict=True)], 4, _distance, start=len(pdf), representatives=3, shrinkage=0.1)
        rows = [(pdf["c_nationkey"].iloc[0], i, float(r[0]), float(w)) for i, c in enumerate(found) for r, w in c.representatives]
        return pd.DataFrame(rows, columns=["c_nationkey", "cluster", "representative", "weight"])

    return _condensed(s).groupBy("c_nationkey").applyInPandas(one, "c_nationkey int, cluster int, representative double, weight double")


@query
def cluster_vectors(spark, sf_dir):
    """All vectors by clusters of several representatives, which come from merged summaries."""
    e = table(spark, sf_dir, "embeddings")
    found = summaries.clusters(e, "embedding", 10, representatives=4, shrinkage=0.1, seed=1)
    return summaries.assigned(e, "embedding", found, ["vec_id"])


@query
def glocal_numeric(spark, sf_dir):
    def start(key, seat):
        g = GlobalLocal(cl.line, capacity=32, recluster_after=16, seed=int(key))

        def step(row):
            r = yield from g.asking(row[1])
            return [(row[0], row[2], float(r["score"]), r["threshold"], r["grade"], len(r["representatives"]))]

        return step

    ev = events(spark, sf_dir)
    schema = "user_id long, event_id long, score double, threshold double, grade double, near int"
    return lockstep.scan(ev, "user_id", ORDER, ["user_id", "value", "event_id"], start, schema, thin=1)


@query
def glocal_text(spark, sf_dir):
    """Part names by edit distance, a stream a brand."""

    def start(key):
        g = GlobalLocal(cl.levenshtein, capacity=32, clusters_most=4, recluster_after=16, seed=1)

        def step(row):
            r = g.step(row[1])
            return [(row[0], float(r["score"]), r["grade"])]

        return step

    return scan(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], ["p_partkey", "p_name"], start, "p_partkey long, score double, grade double")


@query
def multi_series_bandit(spark, sf_dir):
    """Users dealt into groups that share models; a group is a task."""

    def play(batches):
        group, models = None, None
        for keys, rows in batches:
            out = []
            for key, own in groupby(zip(keys, rows, strict=True), itemgetter(0)):
                if models is None or key != group:
                    group, models = key, ManySeries(2, 4, 10, 64, seed=int(key))
                own = [row for _, row in own]
                out += [(row[0], row[2], r.score, r.grade) for row, r in zip(own, models.steps([row[:2] for row in own]), strict=True)]
            yield out

    ev = events(spark, sf_dir).withColumn("group", F.col("user_id") % 16)
    schema = "user_id long, event_id long, score double, grade double"
    return dealt(ev, "group", ["t", "event_id"], ["user_id", "value", "event_id"], play, schema, 16, numbered=True)


@query
def stream_replay(spark, sf_dir):
    """The detector as a stateful stream over the event files, all that is there now."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    from ..operators.workspace import folder

    stream = _followed(spark, sf_dir, "events")
    rows = stream.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v0"))
    out = folder(spark)
    running = detect_stream(rows, "key", "t", ["v0"], **SMALL).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    running.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("epoch")


#: Bytes of files that a micro-batch takes, or one file if it is longer.
BATCH_BYTES = 16 << 30


def _followed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, where they lie: a folder of files, or one file of the folder of tables."""
    known = table(spark, sf_dir, name)
    reader = spark.readStream.schema(known.schema).option("maxBytesPerTrigger", str(BATCH_BYTES))
    if known.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")
