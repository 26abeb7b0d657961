"""Aggregate profiles of a site and what they say about a cohort document's concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Analysis ids of persons per concept, by domain.
ANALYSES = {"Visit": 200, "Condition": 400, "Procedure": 600, "Drug": 700, "Observation": 800, "Measurement": 1800}


def prevalence(events: dict[str, DataFrame]) -> DataFrame:
    """analysis_id, concept_id, n_persons of each domain's events."""
    parts = [df.groupBy("concept_id").agg(F.countDistinct("person_id").alias("n_persons")).select(F.lit(ANALYSES[d]).alias("analysis_id"), "concept_id", "n_persons") for d, df in sorted(events.items())]
    return reduce(DataFrame.unionByName, parts)


def suppressed(snapshot: DataFrame, small_cell: int) -> DataFrame:
    return snapshot.where(F.col("n_persons") > small_cell)


def evidence(concepts: DataFrame, snapshot: DataFrame, concept: DataFrame, small_cell: int) -> DataFrame:
    """concept_id, state, n_persons, upper_bound: populated, unknown to the vocabulary, too few to show (upper bound: the small cell), or none."""
    seen = snapshot.groupBy("concept_id").agg(F.max("n_persons").alias("n_persons"))
    known = concept.select("concept_id").withColumn("known", F.lit(True))
    state = F.when(F.col("n_persons") > 0, "populated").when(F.col("known").isNull(), "unknown_concept").when(F.lit(small_cell > 0), "suppressed_or_absent").otherwise("zero")
    bound = F.when(state == "populated", F.col("n_persons")).when(state == "suppressed_or_absent", F.lit(small_cell)).when(state == "zero", F.lit(0))
    return concepts.join(seen, "concept_id", "left").join(known, "concept_id", "left").select("concept_id", state.alias("state"), "n_persons", bound.cast("long").alias("upper_bound"))


def descendant_bound(concepts: DataFrame, snapshot: DataFrame, ancestor: DataFrame) -> DataFrame:
    """concept_id, upper_bound: sum of persons of proper descendants in all analyses, a person counted for each; null if there are none."""
    below = concepts.join(ancestor.where("ancestor_concept_id <> descendant_concept_id"), concepts["concept_id"] == F.col("ancestor_concept_id")).select("concept_id", "descendant_concept_id")
    counts = snapshot.groupBy(F.col("concept_id").alias("descendant_concept_id")).agg(F.sum("n_persons").alias("n"))
    total = below.join(counts, "descendant_concept_id").groupBy("concept_id").agg(F.sum("n").alias("s"))
    return concepts.join(total, "concept_id", "left").select("concept_id", F.when(F.col("s") > 0, F.col("s")).alias("upper_bound"))


def diagnosed(concepts: DataFrame, events: DataFrame) -> DataFrame:
    """concept_id, n_persons, advice: what to do about a concept that few persons have."""
    n = events.groupBy("concept_id").agg(F.countDistinct("person_id").alias("n"))
    c = F.coalesce("n", F.lit(0))
    return concepts.join(n, "concept_id", "left").select("concept_id", c.alias("n_persons"), F.when(c == 0, "expand").when(c < 10, "check mapping").otherwise("ok").alias("advice"))


def value_distribution(measurement: DataFrame) -> DataFrame:
    """concept_id, unit_concept_id, n, least, median, greatest."""
    return measurement.groupBy("concept_id", "unit_concept_id").agg(F.count("value_as_number").alias("n"), F.min("value_as_number").alias("least"), F.percentile("value_as_number", 0.5).alias("median"), F.max("value_as_number").alias("greatest"))
