"""Operator 7: contiguous shards of near equal byte size from global prefix sums (native).

The rows are put in key order by range partitioning. Each partition's byte total is summed, the
totals give every partition its global offset, and a running sum inside the partition completes the
global prefix sum of each row. Cutting that sum at equal targets gives contiguous shards whose sizes
differ by no more than the largest document.

Null texts count one byte; empty tables give no rows; repeated rows each keep their place (ties of
the key fall to size, checksum and row number, and equal rows are interchangeable); other columns of
the input, whatever their names, are not read. Null keys come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_order


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, size, text_crc32, shard, slot)``; only these narrow columns are shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    dealt = dealt_order(narrow, ["_key", "size", "text_crc32"])
    # One row per partition, whatever the data size: the only rows that meet in a single task.
    ordered = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        dealt.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_count"))
        .withColumn("_before", F.sum("_bytes").over(ordered) - F.col("_bytes"))
        .withColumn("_rank0", F.sum("_count").over(ordered) - F.col("_count"))
        .withColumn("_all", F.sum("_bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("_bytes", "_count")
    )
    inside = Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first(), "size", "text_crc32", "_row")
    running = dealt.select(
        "_part",
        "_key",
        "size",
        "text_crc32",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("_sum"),
        (F.row_number().over(inside).cast("long") - 1).alias("_rank"),
    )
    placed = running.join(F.broadcast(totals), "_part").select(
        "_key",
        "size",
        "text_crc32",
        F.least(
            F.floor((F.col("_before") + F.col("_sum")) / F.col("_all") * shards), F.lit(shards - 1)
        ).cast("int").alias("shard"),
        (F.col("_rank0") + F.col("_rank")).alias("_place"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )
