import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstream import cli
from arborstream.operators import cluster as cl
from arborstream.operators.caster import Caster
from arborstream.operators.detector import Detector
from arborstream.operators.glocal import GlobalLocal, Reservoir
from arborstream.operators.multi import Bandit, MultiSeries
from arborstream.operators.predictive import PredictiveForest
from arborstream.operators.thresholder import Thresholder
from arborstream.operators.transforms import METHODS, Transform
from arborstream.plans import detection
from arborstream.sources import delimited, generators
from arborstream.streaming.processor import ROCKSDB, detect_stream


def wave(n, spikes=(), period=40, noise=2.0, seed=0, step=None):
    rng = random.Random(seed)
    out = [100 * math.cos(2 * math.pi * i / period) + noise * rng.uniform(-1, 1) for i in range(n)]
    for s in spikes:
        out[s] += 150
    if step:
        out = [v + (300 if i >= step else 0) for i, v in enumerate(out)]
    return out


def run(values, **settings):
    d = Detector(**{"trees": 25, "capacity": 128, "shingle": 4, "seed": 1, **settings})
    return d, [d.step([v], i * 10) for i, v in enumerate(values)]


@pytest.mark.parametrize("settings", [{}, {"transform": "NORMALIZE"}, {"transform": "DIFFERENCE"}, {"mode": "TIME_AUGMENTED"}, {"strategy": "DISTANCE"}, {"strategy": "MULTI_MODE_RECALL"}])
def test_planted_spikes_are_found(settings):
    spikes = [400, 520, 610]
    _, got = run(wave(700, spikes), **settings)
    hits = [i for i, r in enumerate(got) if r.grade > 0 and i > 200]
    assert sum(any(s <= h < s + 4 for h in hits) for s in spikes) >= 2
    assert len([h for h in hits if not any(s <= h < s + 5 for s in spikes)]) <= 12
    assert all(0 <= r.grade <= 1 and r.threshold >= 0 for r in got)


def test_expected_value_is_near_the_wave():
    values = wave(500, [450])
    _, got = run(values)
    r = got[450]
    assert r.grade > 0 and r.expected is not None and abs(r.expected[0] - (values[450] - 150)) < 60
    assert math.isclose(sum(r.attribution), r.score, rel_tol=1e-6)


def test_alert_once_and_drift():
    values = wave(700, step=400)
    _, plain = run(values)
    _, once = run(values, alert_once=True)
    _, drift = run(values, transform="NORMALIZE", auto_adjust=True)
    count = lambda rs: sum(r.grade > 0 for r in rs[400:])
    assert count(once) <= count(plain)
    assert all(r.correction in ("NONE", "NOISE", "MULTI_MODE", "ANOMALY_IN_SHINGLE", "CONDITIONAL_FORECAST", "FORECAST", "DATA_DRIFT", "ALERT_ONCE") for rs in (plain, once, drift) for r in rs)


def test_missing_values_and_gaps():
    values = wave(500)
    d = Detector(trees=20, capacity=64, shingle=4, mode="STREAMING_IMPUTE", seed=2)
    t, got = 0, []
    for i, v in enumerate(values):
        t += 10 if i != 300 else 50
        got.append(d.step([None if i % 17 == 5 else v], t))
    assert got[300].imputes == 4 and d.quality.mean < 1
    with pytest.raises(ValueError):
        d.step([1.0], t)
    for how in ("ZERO", "FIXED_VALUES", "PREVIOUS", "RCF"):
        e = Detector(trees=5, capacity=32, imputation=how, fixed=3.0)
        assert all(e.step([None if i % 5 == 4 else float(i)], i).score >= 0 for i in range(80))


def test_settings_are_checked():
    for bad in ({"mode": "X"}, {"strategy": "X"}, {"shingle": 0}, {"transform": "X"}):
        with pytest.raises(ValueError):
            Detector(**bad)
    with pytest.raises(ValueError):
        Caster(Detector(), 0)
    with pytest.raises(ValueError):
        Caster(Detector(), 3, "X")
    with pytest.raises(ValueError):
        Caster(Detector(), 3).step([None], 0)


def test_a_pickled_detector_resumes():
    values = wave(300, [250])
    _, whole = run(values)
    d = Detector(trees=25, capacity=128, shingle=4, seed=1)
    got = []
    for i, v in enumerate(values):
        if i % 50 == 0:
            d = pickle.loads(pickle.dumps(d))
        got.append(d.step([v], i * 10))
    assert [(r.score, r.grade) for r in got] == [(r.score, r.grade) for r in whole]


@pytest.mark.parametrize("method", METHODS)
def test_transforms_invert(method):
    t = Transform(method, 1.5, 0.05, clip=1e9)
    rng = random.Random(1)
    for i in range(100):
        x = 10 + i * 0.3 + rng.gauss(0, 2)
        y = t.forward(x)
        if i:
            assert math.isclose(t.inverse(y), x, rel_tol=1e-9)
        t.update(x)
    for v, lo, hi in t.inverse_range([0.1, 0.2], [-1.0, -1.0], [1.0, 1.0]):
        assert lo <= v <= hi


def test_thresholder():
    t = Thresholder(0.01)
    assert t.grade(5.0)[0] == 1.5 and not t.ready
    rng = random.Random(2)
    for _ in range(200):
        t.observe(1 + rng.gauss(0, 0.05), 1.0, 1.0)
    assert t.grade(1.0)[1] == 0 and t.grade(3.0)[1] == 1.0
    s = Thresholder.seeded([1.0 + 0.01 * (i % 5) for i in range(50)], 0.01)
    assert s.ready and s.primary_both(5.0)[1] == 1.0 and s.primary.discount == 0.01


@pytest.mark.parametrize("calibration", ["NONE", "MINIMAL", "SIMPLE"])
def test_forecasts(calibration):
    values = wave(600)
    c = Caster(Detector(trees=20, capacity=128, shingle=8, seed=1), 5, calibration, lower_limit=-130, upper_limit=130)
    errors, hits, n = [], 0, 0
    for i, v in enumerate(values):
        _, steps = c.step([v], i)
        for h, row in enumerate(steps):
            x, lo, hi = row[0]
            assert lo <= x + 1e-9 and x <= hi + 1e-9
            if calibration != "NONE":
                assert -130 <= lo and hi <= 130
            if i > 300 and i + 1 + h < len(values):
                n += 1
                hits += lo <= values[i + 1 + h] <= hi
                errors.append(abs(x - values[i + 1 + h]))
    assert n and np.mean(errors) < 40
    assert all(0 <= d.mean <= 1 for row in c.errors.hits for d in row)
    if calibration != "NONE":
        assert hits / n > 0.6


def test_learned_errors_run():
    c = Caster(Detector(trees=10, capacity=32, shingle=2, seed=1), 2, learned=True)
    assert all(len(c.step([v], i)[1]) in (0, 2) for i, v in enumerate(wave(150)))


def test_clusters_are_recovered():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    items = [(c + rng.normal(size=2), 1.0) for c in centres for _ in range(80)]
    for reps in (1, 3):
        got = cl.cluster(items, 5, cl.l2, representatives=reps, shrinkage=0.1 if reps > 1 else 0.0)
        assert len(got) == 3 and abs(sum(c.weight for c in got) - 240) < 1e-6
        for c in centres:
            assert min(g.distance(c, cl.l2) for g in got) < 1.5
    with pytest.raises(ValueError):
        cl.cluster([(np.array([np.nan]), 1.0)], 2)
    assert cl.cluster([], 3) == []
    s = cl.summarize(np.array([x for x, _ in items]), most=5)
    assert len(s["typical"]) == 3 and (s["lower"] <= s["median"]).all() and (s["median"] <= s["upper"]).all()
    words = [(w, 1.0) for w in ["aaaaaaaa", "aaaaaaab", "aaaaaabb"] * 5 + ["zzzzzzzz", "zzzzzzzy"] * 5]
    two = cl.cluster(words, 2, cl.levenshtein, representatives=2)
    assert sorted({r[0] for r, _ in c.representatives} for c in two) == [{"a"}, {"z"}]
    assert cl.levenshtein("kitten", "sitting") == 3 and cl.l1([0, 0], [1, 2]) == 3 and cl.linf([0, 0], [1, 2]) == 2


def test_global_local_on_strings(spark):
    rows = generators.two_letter_strings(spark, 900, seed=3).orderBy("seq").collect()
    g = GlobalLocal(cl.levenshtein, capacity=64, clusters_most=4, recluster_after=32)
    odd, even = [], []
    for r in rows:
        (odd if r.injected else even).append(g.step(r.s)["score"]) if g.clusters else g.step(r.s)
    assert np.mean(odd) > np.mean(even) + 0.3
    both = GlobalLocal.merged(g, g)
    assert both.clusters and len(both.sample.items) == 64
    with pytest.raises(ValueError):
        g.step("x", -1.0)


def test_reservoirs_merge():
    a, b = Reservoir(16, 0.01, 1), Reservoir(16, 0.01, 2)
    for i in range(100):
        a.offer(("a", i))
        b.offer(("b", i))
        a.offer(("never", i), 0.0)
    m = Reservoir.merged(a, b, 16)
    assert len(m.items) == 16 and not any(x[1][0] == "never" for x in m.items)


def test_bandit_and_many_series():
    b = Bandit(3, explore=0.0)
    for _ in range(200):
        arm = b.choose()
        b.learn(arm, [0.9, 0.2, 0.5][arm])
    assert min(range(3), key=lambda i: b.losses[i].mean) == 1 and b.choose() == 1
    m = MultiSeries(2, 4, 10, 64)
    grades = {}
    for i, row in enumerate(zip(*[wave(300, [280] if k == 3 else [], seed=k) for k in range(6)])):
        for k, v in enumerate(row):
            grades[k, i] = m.step(k, v)
    assert grades[3, 280].score > np.mean([grades[k, 280].score for k in range(6) if k != 3])


def test_predictive_forest():
    p = PredictiveForest(2, 20, 128, "NORMALIZE")
    rng = random.Random(1)
    for _ in range(400):
        x = rng.uniform(0, 10)
        p.update([x, 3 * x])
    mid, low, high = (r[1] for r in p.predict([5.0, 0.0], [1]))
    assert abs(mid - 15) < 4 and low <= mid <= high
    assert p.score([5.0, -60.0]) > p.score([5.0, 15.0]) and p.density([5.0, 15.0]) > p.density([90.0, 15.0])
    assert math.isclose(sum(p.attribution([5.0, -60.0])), p.score([5.0, -60.0]), rel_tol=1e-6)
    assert p.neighbour_summary([5.0, 0.0], [1])["weight"] == 20 and len(p.distance_attribution([1.0, 1.0])) == 4


def test_stream_equals_batch_and_survives_a_restart(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ev = detection.events(spark, sf).where("user_id < 6").select(F.col("user_id").alias("key"), "t", F.col("value").alias("v0"), "event_id")
    cut = ev.approxQuantile("t", [0.5], 0)[0]
    settings = {"trees": 5, "capacity": 16, "shingle": 2}
    for part in (ev.where(F.col("t") <= cut), ev.where(F.col("t") > cut)):
        part.drop("event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key long, t long, v0 double").parquet(f"{tmp_path}/in")
        out = detect_stream(stream, "key", "t", ["v0"], **settings)
        write = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
        write.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/e={e}")).start().awaitTermination()
    got = {(r.key, r.time): r.score for r in spark.read.parquet(f"{tmp_path}/out").where("not late").collect()}
    want, models = {}, {}
    for r in ev.orderBy("key", "t", "event_id").collect():
        d = models.setdefault(r.key, Detector(base=1, **settings))
        want[r.key, r.t] = d.step([r.v0], r.t).score
    assert got == want


@pytest.mark.parametrize("command,cells", [("score", 1), ("attribution", 4), ("density", 1), ("impute", 2)])
def test_command_line(spark, tmp_path, command, cells):
    rng = random.Random(1)
    lines = ["a,b"] + [f"{rng.gauss(0, 1)},{'NA' if i % 10 == 9 and command == 'impute' else rng.gauss(0, 1)}" for i in range(120)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    args = [command, "--input", f"{tmp_path}/in.csv", "--output", f"{tmp_path}/out", "--header-row", "--number-of-trees", "10", "--sample-size", "32"]
    assert cli.main(args) == 0
    got = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(got) == 120
    assert [",".join(g.split(",")[:2]) for g in got] == lines[1:]
    tail = [g.split(",")[2:] for g in got]
    assert len(tail[-1]) == cells and all(float(x) == float(x) for x in tail[-2])
    assert command == "impute" or tail[0] == ["NA"]


def test_command_line_with_a_key_column(spark, tmp_path):
    """Each key's lines give what they give in a file of their own."""
    rng = random.Random(2)
    lines = [(f"{rng.gauss(0, 1)}", "ab"[rng.randrange(2)], f"{rng.gauss(0, 1)}") for _ in range(120)]
    options = ["--number-of-trees", "5", "--sample-size", "16"]

    def run(name: str, rows: list[tuple], *more: str) -> list[list[str]]:
        (tmp_path / f"{name}.csv").write_text("".join(",".join(r) + "\n" for r in rows))
        assert cli.main(["score", "--input", f"{tmp_path}/{name}.csv", "--output", f"{tmp_path}/{name}", *options, *more]) == 0
        return [x.split(",") for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]

    got = run("both", lines, "--key-column", "1")
    assert [tuple(g[:3]) for g in got] == lines
    for key in "ab":
        alone = run(key, [(r[0], r[2]) for r in lines if r[1] == key])
        assert [g[3] for g in got if g[1] == key] == [g[2] for g in alone]
    with pytest.raises(ValueError):
        delimited.read(spark, f"{tmp_path}/both.csv", key=3)


def test_a_stream_follows_a_table_of_one_file_or_of_many(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for folder in (sf, str(tmp_path)):
        name = f"followed_{len(folder)}"
        detection._followed(spark, folder, "events").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).exceptAll(spark.read.parquet(f"{sf}/events.parquet")).count() == 0
        assert spark.table(name).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_ragged_text_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1|2\n3\n")
    with pytest.raises(Exception, match="expected 2 cells"):
        delimited.read(spark, str(tmp_path / "bad.csv"), "|").collect()
    with pytest.raises(SystemExit):
        cli.main(["score"])


def test_generators(spark):
    n = generators.normal_mixture(spark, 3000, 2, seed=1).toPandas()
    assert 0.005 < n.anomalous.mean() < 0.15 and np.stack(n[n.anomalous].v).mean() > 2
    m = generators.multi_cosine(spark, 1000, 3).toPandas()
    assert 0 < m.is_anomaly.sum() < 40
    f = generators.fan(spark, 300).toPandas()
    assert set(f.blade) == {0, 1, 2}
    assert generators.single_cosine(spark, 100).count() == 100


@pytest.mark.parametrize("name", sorted(set(detection.QUERIES) - {"forecast_learned_errors", "glocal_text"}))
def test_queries_run(name, spark, sf):
    df = detection.QUERIES[name](spark, sf)
    assert df.count() > 0
    if "score" in df.columns:
        assert df.where("score < 0 or isnan(score)").count() == 0


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
