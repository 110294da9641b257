import math
import random

from pyspark.sql import functions as F

from arborstream.llm import topk


def brute(rows, k=5):
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in q.items():
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q.items() if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows[50] = (50, rows[60][1])  # ties
    rows[61] = (61, rows[60][1])
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] + [0.0] * 7), (1150, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (1200, [0.5] * 3), (1201, [0.5] * 3), (1250, [1e12] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(40)
    small = [r for r in rows if r[0] != 1250]
    is_query = F.col("vec_id") % 50 == 0
    assert {tuple(r) for r in topk.top_k(df.where("vec_id is null or vec_id <> 1250"), is_query).collect()} == brute(small)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 256)
    assert {tuple(r) for r in topk.top_k(df, is_query).collect()} == brute(rows)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, part int"
    is_query = F.col("vec_id") % 50 == 0
    assert topk.top_k(spark.createDataFrame([], schema), is_query).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1)], schema), is_query).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], schema), is_query).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 1)]
