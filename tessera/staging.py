"""Tables written between rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where it is unset and the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        else:
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends; until then results that read it may still be asked for."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


@contextmanager
def variants_whole(spark: SparkSession):
    """Variants written inside stay one value each. By itself the writer looks for fields that many rows share and gives each a column of its own, and the reader puts the
    values together again: for documents that are opened once and whole this costs more than all else."""
    name = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, survives lost executors, runs df once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with variants_whole(spark):
        df.write.option("compression", "zstd").parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame, name: str) -> DataFrame:
    """staged, for what grows with the input: joins with it go by shuffle. The planner takes Parquet's size on disk for the size in memory, and repetitive text is
    many times larger there, so it would send such tables through the driver to every task."""
    return staged(df, name).hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
