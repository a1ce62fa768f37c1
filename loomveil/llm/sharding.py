"""Contiguous byte-balanced shards from global prefix sums; DataFrame functions only.

Rows are put in one global order (doc_id, then size and checksum) by range
partitions whose layout is fixed by writing them. Each partition's total is one
row; running sums over those totals give every partition's start, and a running
sum inside a partition gives every row's. A row belongs to the shard in which the
middle of its bytes lies, so shards are contiguous and each cut is off by half a
row at most.

Only (doc_id, size, checksum) are shuffled. What is broadcast has one row a
partition or a shard. Rows of one hot doc_id are parted by size, checksum and row
number, so they spread over partitions too.

Edge cases: a null text has size 1 and the checksum of empty text; null doc_ids
come first; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomveil.llm import scratch


def shard_by_bytes(docs: DataFrame, shards: int, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs` (doc_id, text, ...)."""
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "size", "text_crc32", "tie"]
    # the layout is fixed by the written table: `part` and `tie` never change after this
    ranged = narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    rows = scratch.table(ranged, "shard-rows")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    upto = Window.orderBy("part")  # one row a partition
    starts = totals.select("part", (F.sum("bytes").over(upto) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(upto) - F.col("n")).alias("rows_before"))
    whole = totals.agg(F.sum("bytes").alias("total"))
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), "part")
        .join(F.broadcast(whole))  # a single row
        # the middle of the row: (2 * start + size) / 2, cut into equal targets
        .withColumn("shard", F.expr(f"least({shards} - 1, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * total))").cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
    )
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
