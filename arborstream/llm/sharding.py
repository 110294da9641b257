"""Sharding by global byte-size prefix sums [native].

Every document gets the byte offset at which it starts in doc_id order; the
total is cut at equal targets, so shards are contiguous and balanced to within
one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold
from .prefix import prefix_sums

OVERHEAD = 16


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 bytes of the text plus `overhead` (a null text has none;
    its crc is that of no bytes, 0).  A document goes to the shard that holds
    the middle of its byte span, so each cut is at the document border nearest
    to its target.  Rows with equal ids are ordered by crc and size; a null id
    comes first.  An empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(1).cast("long").alias("__one"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = prefix_sums(small, order, {"__before": "size", "__index": "__one"})
    # the quotient stays below n_shards, as the middle of the last span lies before the total
    exact = f"""cast((cast(2 * __before + size as decimal(38, 0)) * {n_shards})
        div (2 * cast(__before_total as decimal(38, 0))) as int)"""
    sharded = hold(placed.withColumn("shard", F.expr(exact)))
    first = sharded.groupBy("shard").agg(F.min("__index").alias("__first"))  # one row a shard: n_shards bounds it
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__index") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
