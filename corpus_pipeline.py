"""Corpus pipeline: language identification, toxicity, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborstream.llm import stages
from arborstream.llm.common import cut, load

#: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("language_id", stages.identify_language),
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("source_mixing", stages.mix_sources),
    ("sequence_packing", stages.pack_sequences),
]

#: Models, shingle components and tokenization are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
