"""Contiguous shards of nearly equal bytes from global prefix sums. DataFrame operations only.

The sizes (a narrow table; texts never move) are laid out in ascending id over range partitions. Each
partition is totalled, the totals are summed up in order (a row per partition), and a running
sum inside each partition then gives every document's global byte offset and row number. The
offsets are cut at equal targets: a document goes to the shard in which its first byte falls, so a shard
misses its target by less than one document, and shards are contiguous in id order.

Defined cases: a null text has no bytes (size 1); rows with a null id come first; rows that share an
id are kept, ordered by size, then checksum; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm._shared import parts, stored


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, start (bytes before it), shard, slot (its place in the shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), narrow=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    laid = stored(sizes.repartitionByRange(parts(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"), F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = laid.join(F.broadcast(bases), "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("byte_base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("row_base") + F.row_number().over(inside) - 1).alias("row"),
        "total",
    ).withColumn("shard", F.expr(f"cast(least({shards - 1}, cast(start as decimal(38,0)) * {shards} div total) as int)"))
    placed = stored(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "start", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
