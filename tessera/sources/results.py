"""The table of generated cohorts: one folder of Parquet, partitioned by definition."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
COLUMNS = ["cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"]


class Results:
    """Rows of cohorts by definition id. A reader of one definition scans that definition's files alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> None:
        """An empty table; what was there before is gone."""
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").partitionBy("cohort_definition_id").parquet(self.path)
        self.spark.createDataFrame([], SCHEMA.split(", ", 1)[1]).write.mode("append").parquet(self.path)  # a file, so that the table can be read

    def append(self, rows: DataFrame) -> None:
        """Add rows, also to definitions that have some."""
        self._dealt(rows).write.mode("append").partitionBy("cohort_definition_id").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """The definitions in rows anew; others stay."""
        self._dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort_definition_id").parquet(self.path)

    def read(self, *definitions: int) -> DataFrame:
        """The rows of some definitions, or of all."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).select(*COLUMNS).where("cohort_definition_id IS NOT NULL")
        return rows.where(F.col("cohort_definition_id").isin(list(definitions))) if definitions else rows

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """Few files a definition, but no definition in one task: dealt by definition and a part of the subject's hash."""
        return rows.select(*COLUMNS).repartition(F.col("cohort_definition_id"), F.pmod(F.xxhash64("subject_id"), F.lit(8)))


def bound_scan(spark: SparkSession, statement: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """The rows of a statement over named tables, its :markers bound to values, never pasted into the text."""
    for name in tables:
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"not a table name: {name}")
    return spark.sql(statement, args=values, **tables)
