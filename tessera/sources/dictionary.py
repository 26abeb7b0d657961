"""A dictionary of medical names read from Parquet tables: names of concepts, their semantic types, relations between concepts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "names": "cui string, str string, sab string, tty string, lat string, ispref string, ts string",
    "types": "cui string, sty string",
    "relations": "cui1 string, rela string, cui2 string",
}


@dataclass(frozen=True)
class Dictionary:
    """names: cui, str, sab, tty, lat, ispref, ts. types: cui, sty. relations: cui1, rela, cui2."""

    names: DataFrame
    types: DataFrame
    relations: DataFrame


def read(spark: SparkSession, folder: str) -> Dictionary:
    """The tables of a folder; one that is missing is empty, columns that a table lacks are null, others are dropped."""
    return Dictionary(**{name: _table(spark, f"{folder}/{name}.parquet", schema) for name, schema in SCHEMAS.items()})


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    wanted = [x.split()[0] for x in schema.split(", ")]
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in wanted))
