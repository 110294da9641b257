"""The queries of this subpackage, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, html, jaccard, langid, lloyd, middle, mixing, packing, sharding, topk, toxicity, warc
from .common import load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(load(spark, sf_dir, "documents"))


def op2_signature_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op6_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(load(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path())


def op8_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), n_shards=40)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(load(spark, sf_dir, "pages"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), max_repeat=2.0)


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd.lloyd(load(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256.0, seed=2)
    # as many rows as there are centroids
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    table = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("total").alias("inertia"), digest)
    return found.assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.restore(middle.fill_in_middle(load(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_signature_tree_jaccard": op2_signature_tree_jaccard,
        "op3_exact_topk": op3_exact_topk,
        "op4_segment_toxicity": op4_segment_toxicity,
        "op5_page_differencing": op5_page_differencing,
        "op6_backoff_langid": op6_backoff_langid,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_byte_sharding": op8_byte_sharding,
        "op9_warc": op9_warc,
        "op10_temperature_mixing": op10_temperature_mixing,
        "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_benchmark_decontamination": op13_benchmark_decontamination,
    }


_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: crc32 byte by byte, with its table made by eight halvings of each index.
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
_OP8 = f"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {_CRC_STEP}) AS c FROM range(256) r(i))),
b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
k AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295::BIGINT) AS text_crc32
  FROM b, t),
o AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM k),
s AS (SELECT *, ((2 * before + size) * 40 // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""




def _op11(k: int = 40, rounds: int = 5) -> str:
    """Every round as two table expressions: nearest centroids, then floors of means."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1)::INTEGER AS c, q FROM v QUALIFY c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS s FROM (
    SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT c, list(m ORDER BY p) AS q FROM (
    SELECT c, p, (s - (((s % n) + n) % n)) // n AS m FROM (
      SELECT s.c AS c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT a{i}.s AS s, unnest(v.q) AS x, unnest(range(64)) AS p FROM v JOIN a{i} USING (r)) GROUP BY ALL)) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, s.c AS cluster, s.d AS distance, sum(s.d) OVER (PARTITION BY s.c)::BIGINT AS cluster_inertia, sum(s.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.c = s.c
"""


_OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS g FROM t),
f AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b FROM g),
o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""

_OP13_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP13_WORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_OP13_WORDS} AS ws FROM benchmark),
w AS MATERIALIZED (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS w FROM (
    SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
p AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
o AS MATERIALIZED (SELECT r, s, w.n, item FROM (SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w FROM p) p JOIN w ON w.w = p.w AND w.n = p.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT r, s, n FROM o)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_signature_tree_jaccard": _OP2,
        "op3_exact_topk": _OP3,
        "op8_byte_sharding": _OP8,
        "op9_warc": _OP9,
        "op11_dual_tree_lloyd": _op11(),
        "op12_fill_in_middle": _OP12,
        "op13_benchmark_decontamination": _OP13,
    }
