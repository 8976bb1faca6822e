"""Contiguous shards of near equal bytes, from global prefix sums.

Rows are range-partitioned by id; each partition's totals give, by a running sum
over the partitions, the bytes and rows before it.  A row's own prefix is that plus
the running sum in its partition.  The corpus is cut at equal byte targets: a row
belongs to the shard in which the middle of its bytes falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import settle


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (a null text: 1), text_crc32 that of its bytes
    (null: 0).  The order is by doc_id, then size and crc32; a null id comes first.  Rows that
    repeat an id each count.  slot numbers a shard's rows from 0 without gaps.  Other
    columns are ignored; an empty table gives no rows.  Shards of a corpus with fewer
    rows than shards, or with a text larger than a shard, may stay empty.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"))
    dealt = rows.repartitionByRange("doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id())
    dealt = settle(dealt)  # the parts must be the same for totals and rows
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition, not per document
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", F.sum("size").over(inside).alias("upto"), F.count("*").over(inside).alias("nth")).join(starts, "part")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least((middle.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes"))).cast("long"), F.lit(shards - 1)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
