"""Pipeline stages: each takes documents and returns documents, but for packing, which returns pieces.

A stage's documents are read from files that the stage before has written, so
each begins by letting go of the rows that were held for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jaccard, langid, mixing, packing, toxicity
from .common import cut, load, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified (op 6): not `und`, posterior 0.5 or more.

    Null, empty and letterless texts are `und` and go, as does everything where
    no row has a language to learn from; repeated rows are judged alike.  An
    empty table stays empty.  Columns, and their names, are as they were.
    """
    release()
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity (op 4), learnt from the labels of those left, is below 0.5.

    Null, empty and letterless texts have no toxic passage and stay, as does
    everything where the labels are of one kind or none; repeated rows are
    judged alike.  An empty table stays empty.  Columns are as they were.
    """
    release()
    return toxicity.keep_civil(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near duplicates (op 2) the document with the smallest id, once.

    Documents without words are components of their own and stay.
    """
    release()
    groups = cut(jaccard.near_duplicates(docs).select("doc_id", "component_id"))
    rows, back = _plain(docs)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone"))
    kept = rows.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    twice = groups.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice")
    if not twice.isEmpty():
        same = F.col("id").eqNullSafe(F.col("twice"))
        first = W.partitionBy("id").orderBy(F.xxhash64("body"))
        repeated = kept.join(twice, same, "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
        kept = kept.join(twice, same, "left_anti").unionByName(repeated)
    return kept.select(*back)


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """The rows under names that nothing clashes with (id and body among them), and the columns that restore the old ones."""
    names = ["id" if c == "doc_id" else "body" if c == "text" else f"p{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mixture (op 10) uses it: once at least, its source at most about twice as often.

    Texts are moved once, by a join with the number of uses; rows that share an
    id are used equally often, rounded up.
    """
    release()
    uses = mixing.mix(docs, max_repeat=2.0, keep=["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("uses"))
    rows = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    times = uses.join(rows.withColumnRenamed("doc_id", "same"), F.col("doc_id").eqNullSafe(F.col("same")))
    times = times.select(F.col("doc_id").alias("used"), F.ceil(F.col("uses") / F.col("rows")).cast("int").alias("times"))
    plain, back = _plain(docs)
    repeated = plain.join(times, F.col("id").eqNullSafe(F.col("used"))).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document in sequences of 2048 (op 7).

    A null or empty text is one piece, the closing id; very long texts are cut
    every 2048 ids; repeated rows are packed each for itself.  An empty table
    gives no pieces.  Other columns are ignored.
    """
    release()
    from .queries import tokenizer_path

    return packing.pack_documents(docs, tokenizer_path())
