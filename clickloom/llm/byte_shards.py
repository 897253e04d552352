"""Contiguous shards of nearly equal bytes, from global prefix sums of the document sizes.

Sizes are measured in one pass and kept as a narrow table. It is range-partitioned on the key; each
partition sums its bytes, the totals before each partition are added up (one row per partition), and a
window inside the partition gives every document its global prefix sum. A document belongs to the
shard in which the middle of its bytes falls, so a shard differs from the mean by one document at
most. Only DataFrame operations are used.

Cases: null and empty texts have size 1 (crc of no bytes, 0). Null keys come first. Repeated keys and rows are
ordered by checksum and size; equal rows are interchangeable. An empty table gives no rows. A document
larger than a shard leaves the shards it spans without others; shards may then be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickloom.session import scratch_path

SHARDS = 8


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, start, shard, slot) of every document; size is the UTF-8 bytes plus 1."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sizes = scratch_path(spark, "sizes")
    docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32")).write.parquet(sizes)
    order = ["_key", "text_crc32", "size"]
    path = scratch_path(spark, "placed")
    placed = spark.read.parquet(sizes).repartitionByRange(*order).sortWithinPartitions(*order)
    # written: the range bounds are sampled, and all readers must see one layout
    placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)
    totals = rows.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"),
        F.sum("b").over(every).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the layout
    summed = rows.withColumns({"_in": F.coalesce(F.sum("size").over(inside), F.lit(0)), "_nth": F.coalesce(F.count("*").over(inside), F.lit(0))}).join(F.broadcast(offsets), "_part")
    start = F.col("_in") + F.col("_bytes")
    cut = summed.select(
        "_key", "size", "text_crc32", start.alias("start"), (F.col("_nth") + F.col("_rows")).alias("_row"),
        F.expr(f"CAST(((2 * (_in + _bytes) + size) * {shards}) div (2 * _total) AS INT)").alias("shard"),
    )
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    out = cut.join(F.broadcast(first), "shard")
    return out.select(F.col("_key").alias(key), "size", "text_crc32", "start", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
