"""Fill-in-middle transformation: DuckDB rewrites each Arrow batch inside Spark's tasks.

Texts are cut into code points, two hashed cut points give prefix, middle and
suffix, and these are put together in another order between markers.  No
Python runs on rows: a batch is registered with a DuckDB connection of the
task, and SQL gives the Arrow rows that go back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, text_buffer

#: Bytes of text that DuckDB cuts at once (a longer single text is cut alone); a code point takes some 50 bytes meanwhile.
BATCH_BYTES = 1 << 20
# The markers before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def _sql(seed: int, plain_percent: int, spm_percent: int, marks: tuple[str, str, str]) -> str:
    """The transformation of a registered table `batch` (doc_id, text)."""
    p, s, m = (f"'{x}'" for x in marks)
    groups = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch),
drawn AS (SELECT doc_id, text, length(text) AS n, {groups} FROM hashed),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= 100 - {plain_percent} THEN 'plain'
                 WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
units AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN form = 'plain' THEN NULL ELSE regexp_extract_all(text, '(?s).') END AS u FROM formed),
pieces AS (
  SELECT doc_id, n, form, text, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS prefix,
    coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS middle,
    coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suffix FROM units),
done AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
                      ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM pieces)
SELECT doc_id, n, form, prefix_chars, middle_chars, output, sha256(output) AS output_sha256 FROM done
"""


def _rewrite(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        try:
            for batch in batches:
                _, off = text_buffer(batch.column(1))
                for lo, hi in chunks(off, BATCH_BYTES):
                    con.register("batch", pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return run


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 for every row.

    h1 to h4 are the first four 8-digit groups of the hex sha256 of
    `<seed>:<doc_id>`.  Of n code points the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1), the middle after the larger.  form: plain
    for an empty text, one that holds a marker, and plain_percent of the
    others; spm (suffix, prefix, middle) for spm_percent of what is left, else
    psm.  A plain output is the text, and its prefix_chars and middle_chars are
    null.  A null text is empty; a null id hashes as no digits.  Repeated rows
    give repeated rows, an empty table none; other columns are ignored.  A text
    is cut whole, however long, in some 50 bytes a code point.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rewrite(_sql(seed, plain_percent, spm_percent, marks)), _COLUMNS)


def restore(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of `fill_in_middle` with `restored`: the text, rebuilt from output and form alone.

    No text with a marker is cut and no marker can begin inside another, so
    the first occurrence of each is the one that was put there.
    """
    p, s, m = (F.lit(x) for x in marks)
    out = F.col("output")
    before_middle, middle = F.split_part(out, m, F.lit(1)), F.split_part(out, m, F.lit(2))
    second = F.when(F.col("form") == "psm", s).otherwise(p)
    first, last = F.split_part(before_middle, second, F.lit(1)), F.split_part(before_middle, second, F.lit(2))
    first = F.substr(first, F.when(F.col("form") == "psm", 1 + len(marks[0])).otherwise(1 + len(marks[1])))
    both = F.when(F.col("form") == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))
    return rows.withColumn("restored", F.when(F.col("form") == "plain", out).otherwise(both))
