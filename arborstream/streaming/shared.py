"""Many series over a few shared forests, a micro-batch at a time.

No series is tied to a group: every window of a micro-batch is scored where it
lies by the forests as they were when the batch began (a broadcast of fixed
size), and each series picks a forest by its discounted losses.  Then the
forests' samples take up the batch's windows by top-k merges, and what changed
of the series is written.  A batch is one version: it reads the version before
it, writes its own, and the mark of it last, so that a batch that is run again
after a failure, from the start or half-way, leaves the same rows and models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uniforms import uniform
from ..operators import slices, thresholder
from ..operators.forest import MODEL_LIMIT, Forest, from_sample
from ..operators.sampler import merge, reservoir

_SAMPLES = "arm int, tree int, sample_key double, seq long, v array<double>"
_SERIES = "key long, version long, last long, tail array<double>, tries array<double>, losses array<double>, scores long, weight double, sum double, squares double"
_ROWS = "key long, time long, id long, late boolean, arm int, window array<double>, score double, threshold double, grade double"
_DONE = "updates array<long>"


@dataclass
class SharedForests:
    """Call it with (micro-batch, version), as `foreachBatch` does: rows (key, time, id: longs; value) to `rows(version)`.

    Within a series rows follow each other by time, then id; (key, time, id)
    names a row.  A row that is not later than its series' last row of an
    earlier batch, or has no time, is late: it is marked, and neither scored nor learnt.  A
    window that holds a null scores 0 and isn't learnt, nor does one score
    before its forest has learnt more than a quarter of its capacity.  Rows of
    a null key are a series.  `path` is a folder that all executors share.

    A series first tries every forest for a batch each, then takes the one of
    least discounted loss (mean score of a batch), with probability `explore`
    any.  Threshold and grade come from the series' scores before the batch.
    Every `compact`-th version holds all series, the others the changed ones.
    """

    path: str
    models: int = 2
    shingle: int = 4
    trees: int = 20
    capacity: int = 64
    share: float = 1.0
    explore: float = 0.05
    discount: float = 0.05
    rate: float = 0.01
    z: float = thresholder.Z_FACTOR
    seed: int = 0
    compact: int = 16

    def __post_init__(self) -> None:
        if self.models * self.trees * self.capacity * self.shingle > MODEL_LIMIT:
            raise ValueError("the models are larger than MODEL_LIMIT values")

    def __call__(self, batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        updates = self.updates(spark, version - 1)
        rows = batch.select(*[F.col(c).cast("long").alias(c) for c in ("key", "time", "id")], F.col("value").cast("double").alias("value")).persist()
        try:
            self._score(rows, version, updates).write.mode("overwrite").parquet(self._at("rows", version))
        finally:
            rows.unpersist()
        live = self.rows(spark, version).where("not late")
        self._grow(live, version, updates)
        self._remember(live, version)
        counts = {r.arm: r.n for r in live.where(self._learnt()).groupBy("arm").agg(F.count("*").alias("n")).collect()}  # one row a forest
        now = [n + counts.get(a, 0) for a, n in enumerate(updates)]
        spark.createDataFrame([(now,)], _DONE).coalesce(1).write.mode("overwrite").json(self._at("done", version))

    # -- what versions hold ------------------------------------------------------------------------

    def _at(self, what: str, version: int) -> str:
        return f"{self.path}/{what}/v{version}"

    def rows(self, spark: SparkSession, version: int) -> DataFrame:
        """A batch's results: key, time, id, late, arm (its forest), window, score, threshold, grade."""
        return spark.read.schema(_ROWS).parquet(self._at("rows", version))

    def updates(self, spark: SparkSession, version: int) -> list[int]:
        """Windows that each forest has learnt up to a version; an unfinished version raises."""
        if version < 0:
            return [0] * self.models
        return list(spark.read.schema(_DONE).json(self._at("done", version)).first().updates)

    def samples(self, spark: SparkSession, version: int) -> DataFrame:
        """The forests' samples: models x trees x capacity rows at most."""
        return spark.read.schema(_SAMPLES).parquet(self._at("samples", version)) if version >= 0 else spark.createDataFrame([], _SAMPLES)

    def series(self, spark: SparkSession, version: int) -> DataFrame:
        """Each series as of a version: the last state since the version that held them all."""
        if version < 0:
            return spark.createDataFrame([], _SERIES)
        parts = [self._at("series", v) for v in range(version - version % self.compact, version + 1)]
        every = spark.read.schema(_SERIES).parquet(*parts)
        return every.groupBy("key").agg(F.max_by(F.struct(*every.columns[1:]), "version").alias("s")).select("key", "s.*")

    def forests(self, spark: SparkSession, version: int) -> list[Forest]:
        table = self.samples(spark, version).toPandas()  # bounded by MODEL_LIMIT
        updates = self.updates(spark, version)
        return [from_sample(table[table["arm"] == a], self.trees, self.capacity, self.seed + a, updates[a]) for a in range(self.models)]

    # -- a batch -----------------------------------------------------------------------------------

    def _arm(self, version: int) -> Column:
        """The forest of a series for a batch, from its tries and losses."""
        arms = F.sequence(F.lit(0), F.lit(self.models - 1))
        first = F.pmod(F.crc32(F.coalesce(F.col("key"), F.lit(-1)).cast("string")), F.lit(self.models)).cast("int")
        place = lambda a: F.pmod(a - first, F.lit(self.models))
        fresh = F.array_min(F.transform(F.filter(arms, lambda a: F.coalesce(F.get("tries", a), F.lit(0.0)) == 0), place))
        losses = F.transform(arms, lambda a: F.struct(F.try_divide(F.get("losses", a), F.get("tries", a)).alias("loss"), a.alias("arm")))
        any_arm = F.least(F.floor(uniform(self.seed, F.lit("arm"), "key", version) * self.models), F.lit(self.models - 1))
        strays = uniform(self.seed, F.lit("explore"), "key", version) < self.explore
        best = F.when(strays, any_arm.cast("int")).otherwise(F.array_min(losses)["arm"])
        return F.when(fresh.isNotNull(), F.pmod(first + fresh, F.lit(self.models))).otherwise(best).cast("int")

    def _score(self, rows: DataFrame, version: int, updates: list[int]) -> DataFrame:
        spark = rows.sparkSession
        # the series that the batch holds, once each
        known = self.series(spark, version - 1).withColumnRenamed("key", "k")
        held = rows.select("key").distinct().join(known, F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
        none = F.array_repeat(F.lit(None).cast("double"), self.shingle - 1)
        mean = F.try_divide("sum", "weight")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("squares", "weight") - mean * mean))
        held = held.select("key", "last", F.coalesce("tail", none).alias("tail"), self._arm(version).alias("arm"), F.coalesce("scores", F.lit(0)).alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("spread"))
        placed = rows.join(held.drop("tail").withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).drop("k")
        placed = placed.withColumn("late", F.col("time").isNull() | F.coalesce(F.col("time") <= F.col("last"), F.lit(False)))
        # the rows before the batch stand in front of it: earlier than all times, in their order
        tails = held.select("key", F.lit(None).cast("long").alias("time"), F.posexplode("tail").alias("p", "value")).select("key", "time", F.col("p").cast("long").alias("id"), "value", F.lit(False).alias("own"))
        both = placed.where("not late").withColumn("own", F.lit(True)).unionByName(tails, allowMissingColumns=True)
        seq = slices.recent(slices.sliced(both, "key", ["time", "id"]), "window", ["value"], self.shingle)
        fresh = seq.rows.where("own").select(*placed.columns, "window")
        scored = self._asked(fresh.unionByName(placed.where("late"), allowMissingColumns=True), version, updates)
        threshold, grade = thresholder.primary(F.col("score"), F.col("n"), F.col("mean"), F.col("spread"), self.z)
        found = (F.col("score") > 0) & (threshold > 0)
        graded = F.when(found & (F.col("score") > threshold), grade).otherwise(0.0)
        return scored.select("key", "time", "id", "late", "arm", "window", "score", F.when(found, threshold).otherwise(0.0).alias("threshold"), graded.alias("grade"))

    def _asked(self, rows: DataFrame, version: int, updates: list[int]) -> DataFrame:
        """Add each window's score by its forest."""
        spark = rows.sparkSession
        ready = [n > max(1, self.capacity // 4) for n in updates]
        if not any(ready):
            return rows.withColumn("score", F.lit(0.0))
        held = spark.sparkContext.broadcast(self.forests(spark, version - 1))
        width, names = self.shingle, rows.columns
        whole = F.when(F.col("window").isNotNull() & ~F.exists("window", lambda x: x.isNull()), F.col("window"))
        sent = rows.withColumn("__w", whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arm = batch.column(names.index("arm")).to_numpy(zero_copy_only=False)
                vectors = batch.column(batch.num_columns - 1)
                some = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
                points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                score = np.zeros(batch.num_rows)
                for a, forest in enumerate(held.value):
                    own = np.flatnonzero(arm[some] == a)
                    if ready[a] and len(own):
                        score[some[own]] = forest.score(points[own])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*names, "score"])

        kinds = dict(rows.dtypes)
        return sent.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "score double"]))

    def _learnt(self) -> Column:
        name = [F.coalesce(F.col(c), F.lit(-1)) for c in ("key", "time", "id")]
        return F.col("window").isNotNull() & ~F.exists("window", lambda x: x.isNull()) & (uniform(self.seed, F.lit("learn"), *name) < self.share)

    def _grow(self, live: DataFrame, version: int, updates: list[int]) -> None:
        """The samples with the batch's windows: those of a batch are of one age."""
        spark = live.sparkSession
        name = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(-1)) for c in ("key", "time", "id")])
        new = live.where(self._learnt()).select("arm", name.alias("name"), F.col("window").alias("v"))
        old, grown = self.samples(spark, version - 1), []
        for a in range(self.models):
            own = new.where(F.col("arm") == a).select("name", F.lit(updates[a]).cast("long").alias("born"), "v")
            taken = reservoir(own, self.trees, self.capacity, "born", 1 / (10 * self.capacity), self.seed + a, identity="name")
            taken = taken.select("tree", "sample_key", F.xxhash64("name").alias("seq"), "v")
            grown.append(merge(old.where(F.col("arm") == a).drop("arm"), taken, self.capacity, "seq").select(F.lit(a).alias("arm"), "tree", "sample_key", "seq", "v"))
        every = grown[0]
        for g in grown[1:]:
            every = every.unionByName(g)
        every.coalesce(1).write.mode("overwrite").parquet(self._at("samples", version))

    def _remember(self, live: DataFrame, version: int) -> None:
        """The states of the batch's series; of all series in every `compact`-th version."""
        spark, keep = live.sparkSession, 1.0 - self.rate
        seq = slices.numbered(slices.sliced(live.where("score > 0"), "key", ["time", "id"]), "number").rows
        count = seq.groupBy("key").agg(F.count("*").alias("n"))
        counted = seq.join(count.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")))
        fade = F.pow(F.lit(keep), (F.col("n") - F.col("number")).cast("double"))
        sums = counted.groupBy("key").agg(F.first("n").alias("n"), F.sum(fade).alias("w"), F.sum(fade * F.col("score")).alias("s"), F.sum(fade * F.col("score") * F.col("score")).alias("q"), F.avg("score").alias("loss"))
        ends = live.groupBy("key").agg(F.max("time").alias("end"), F.max_by("window", F.struct("time", "id")).alias("window"), F.first("arm").alias("arm"))
        known = self.series(spark, version - 1)
        for other, name in ((sums, "k1"), (known.drop("version"), "k2")):
            ends = ends.join(other.withColumnRenamed("key", name), F.col("key").eqNullSafe(F.col(name)), "left").drop(name)
        arms = F.sequence(F.lit(0), F.lit(self.models - 1))
        pulled = lambda a: (a == F.col("arm")) & F.col("loss").isNotNull()

        def learnt(column: str, gain: Column) -> Column:
            return F.transform(arms, lambda a: F.coalesce(F.get(column, a), F.lit(0.0)) * F.when(pulled(a), 1 - self.discount).otherwise(1.0) + F.when(pulled(a), gain).otherwise(0.0))

        older = F.pow(F.lit(keep), F.coalesce("n", F.lit(0)).cast("double"))
        total = lambda column, new: (F.coalesce(column, F.lit(0.0)) * older + F.coalesce(new, F.lit(0.0))).alias(column)
        changed = ends.select(
            "key",
            F.lit(version).cast("long").alias("version"),
            F.coalesce(F.greatest("end", "last"), F.col("end"), F.col("last")).alias("last"),
            F.slice("window", 2, self.shingle - 1).alias("tail") if self.shingle > 1 else F.array().cast("array<double>").alias("tail"),
            learnt("tries", F.lit(1.0)).alias("tries"),
            learnt("losses", F.col("loss")).alias("losses"),
            (F.coalesce("scores", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("scores"),
            total("weight", "w"),
            total("sum", "s"),
            total("squares", "q"),
        )
        if version % self.compact == 0:
            rest = known.join(changed.select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_anti")
            changed = changed.unionByName(rest.withColumn("version", F.lit(version).cast("long")))
        changed.write.mode("overwrite").parquet(self._at("series", version))


def backfill(df: DataFrame, models: SharedForests, batches: int) -> DataFrame:
    """Rows that are there already (key, time, id, value), as `batches` micro-batches of equal spans of time: rows and their batch."""
    spark = df.sparkSession
    low, high = df.agg(F.min("time"), F.max("time")).first()
    if low is None:
        return spark.createDataFrame([], f"{_ROWS}, batch int")
    span = (high - low) // batches + 1
    for b in range(batches):
        models(df.where((F.col("time") >= low + b * span) & (F.col("time") < low + (b + 1) * span)), b)
    parts = [models.rows(spark, b).withColumn("batch", F.lit(b)) for b in range(batches)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every
