"""Operator 6, contiguous shards by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, partitions, staged


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Documents stand in one order (hash of the text, then doc_id), so equal texts are
    neighbours, and at most one group of them is cut by each border between shards. Totals of range partitions give each partition's start, running sums inside it
    each document's start, and equal cuts of the grand total the shards: contiguous in that order,
    their sizes apart by about a document. Null text: no bytes, size 1. Ties and repeated
    rows: each takes its own slot (equal rows are interchangeable). Null doc_id: first among
    its equals. Empty table: no rows. Other columns are dropped.
    """
    spark = docs.sparkSession
    order = ["h", "text_crc32", "size", "doc_id"]
    sized = keyed_text(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    ranges = staged(sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranges.select("*", F.sum("size").over(inside).alias("upto"), F.row_number().over(Window.partitionBy("part").orderBy(*order)).alias("nth"))
    # one row for each partition: bounded by the number of partitions, not by the documents
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("rows_before"))
    grand = totals.agg(F.sum("bytes").alias("total"))
    placed = run.join(F.broadcast(starts), "part").crossJoin(F.broadcast(grand))  # the grand total is one row
    middle = (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size")  # twice the place of a document's middle
    to = F.least(F.floor(middle * F.lit(shards) / (F.col("total") * 2)), F.lit(shards - 1)).cast("int")
    cut = staged(placed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("row"), to.alias("shard")), "shard-cuts")
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
