"""What the document operators share: the session's shared folder, staged tables, key clashes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship as ship  # for the operators
from ..staging import new_path, removed_at_exit


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors, runs df once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """The folder and what is in it, at once."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Queries run inside drop their shuffle files when they end, as what they made is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only doc_id and text, null text as empty: other columns, whatever their names, never reach an operator's plan."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df's own columns do not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name + "_" * i for i in range(1, len(taken) + 2)) if x.lower() not in taken) for name in names]


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with part (its range partition) and row, its place from 0 in the order of all rows.

    Range partitions are written, their counts summed up (a row for each partition), and rows
    counted inside each. Equal rows are dealt to several partitions, so none holds a hot key alone.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ranges = staged(df.repartitionByRange(partitions(df.sparkSession), *order, spread).withColumn("part", F.spark_partition_id()), name)
    starts = before_each(ranges.groupBy("part").agg(F.count("*").alias("rows")), "rows")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranges.withColumn("nth", nth).join(F.broadcast(starts), "part")  # a row for each partition
    return placed.withColumn("row", F.col("before") + F.col("nth") - 1).drop("nth", "before")


def before_each(totals: DataFrame, size: str) -> DataFrame:
    """part, before: the sum of the sizes of all parts before it. totals: part and its size, a row for each partition of a job."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long").alias("before"))
