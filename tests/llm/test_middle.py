import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from arborstream.llm import middle, queries

SPREAD = "a\x00\nß中🙂é<>PSM\r "


def brute(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(df, rows):
    got = middle.restore(middle.fill_in_middle(df)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(i, t) for i, t in rows), key=repr)
    texts = sorted((i is None, i or 0, t or "") for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in got) == texts
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    return got


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(SPREAD) for _ in range(rng.randrange(0, 40)))) for i in range(600)]
    rows += [(1000 + i, x) for i, x in enumerate(["<P>", "a<S>b", "<M", "<<P>", "<", "<P", "S>", "\n\n\n", "\x00"] * 20)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_edges(spark, edge, empty):
    assert middle.fill_in_middle(empty).count() == 0
    check(edge, [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])


def test_a_long_text_is_cut_whole(spark, monkeypatch):
    monkeypatch.setattr(middle, "BATCH_BYTES", 1000)
    rows = [(i, "ä<b\n" * n) for i, n in enumerate([0, 1, 400_000, 7, 300, 20])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), rows)


def test_parameters(spark):
    rows = [(i, f"text number {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forms = lambda **k: {r.form for r in middle.fill_in_middle(df, **k).select("form").collect()}
    assert forms(plain_percent=100) == {"plain"}
    assert forms(plain_percent=0, spm_percent=100) == {"spm"}
    marks = ("[pre]", "[suffix]", "[m]")
    back = middle.restore(middle.fill_in_middle(df, marks=marks, spm_percent=50), marks)
    assert back.where(F.col("restored") != F.concat(F.lit("text number "), F.col("doc_id"))).count() == 0
    assert {tuple(r)[:6] for r in middle.fill_in_middle(df, seed=9).drop("output_sha256").collect()} == {brute(i, t, 9) for i, t in rows}


def test_sql(spark, edge, tmp_path):
    """The oracle holds on nulls, empty and repeated rows too."""
    edge.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_fill_in_middle"]).fetchall()
    got = queries.op12_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
