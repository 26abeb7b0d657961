"""Cohort documents fitted to a site: concepts that nobody has there are replaced, widened, taken out of their sets, or take their rule with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rows import Rows, set_key
from ..staging import grown
from .vocabulary import proper

#: Fixed value: the share of a document's rules that may be dropped; beyond it the document stays as it was.
MOST_DROPPED = 0.4


def edits(rows: Rows, populated: DataFrame, ancestor: DataFrame, replacements: DataFrame) -> DataFrame:
    """document, rule, set_nth, nth, codeset, concept_id, action, new_id, new_name: what becomes of the items of rules' sets whose concept has no person at the site.

    A concept that a rule asks for and that populated (concept_id) does not hold is WIDENed to its descendants where one of them is populated, else REPLACEd where replacements
    (concept_id, new_id, new_name) has another one, else PRUNEd. Concepts of sets that rules only forbid stay (nobody has them anyway), and so do the entries' own.
    """
    items = rows.items.where(~F.col("is_excluded") & F.col("concept_id").isNotNull())
    asked = rows.criteria.where(~F.col("absent") & F.col("codeset").isNotNull()).select("document", "rule", "codeset").distinct()
    empty = asked.join(items, ["document", "codeset"]).select("document", "rule", "concept_id").distinct().join(populated.select("concept_id").distinct(), "concept_id", "left_anti")
    below = proper(ancestor).join(populated.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi").select(F.col("ancestor_concept_id").alias("concept_id")).distinct().withColumn("below", F.lit(True))
    other = replacements.where("new_id <> concept_id").groupBy("concept_id").agg(F.min(F.struct("new_id", "new_name")).alias("other"))
    told = empty.join(below, "concept_id", "left").join(other, "concept_id", "left")
    action = F.when(F.col("below"), "WIDEN").when(F.col("other").isNotNull(), "REPLACE").otherwise("PRUNE")
    used = rows.criteria.where("codeset IS NOT NULL").select("document", "rule", "codeset").distinct()
    every = rows.items.select("document", "set_nth", "nth", "codeset", "concept_id")
    return told.select("document", "rule", "concept_id", action.alias("action"), F.col("other.new_id").alias("new_id"), F.col("other.new_name").alias("new_name")).join(used, ["document", "rule"]).join(every, ["document", "codeset", "concept_id"])


def fitted(rows: Rows, populated: DataFrame, ancestor: DataFrame, replacements: DataFrame, most: float = MOST_DROPPED) -> tuple[Rows, DataFrame]:
    """The documents after these edits, and document, n_rules, n_dropped, aborted of each that has rules.

    Sets that keep an item lose those to be pruned; a set that would lose all stays as it is and its rules go. Where more than a share of `most` of
    a document's rules would go, nothing of it is changed.
    """
    told = grown(edits(rows, populated, ancestor, replacements), "site-edits")
    place = ["document", "set_nth", "nth"]
    gone = told.where("action = 'PRUNE'").select(*place).distinct()
    left = rows.items.join(gone, place, "left_anti").select("document", "set_nth").distinct()
    lost = told.where("action = 'PRUNE'").join(left, ["document", "set_nth"], "left_anti").select("document", "rule").distinct()
    counted = rows.rules.select("document", "rule").join(lost.withColumn("gone", F.lit(1)), ["document", "rule"], "left").groupBy("document").agg(F.count("*").alias("n_rules"), F.count("gone").alias("n_dropped"))
    report = grown(counted.withColumn("aborted", F.col("n_dropped") > F.lit(most) * F.col("n_rules")), "site-report")
    kept = report.where("NOT aborted").select("document")
    lost = grown(lost.join(kept, "document", "left_semi"), "site-dropped")
    change = told.join(kept, "document", "left_semi").where("action <> 'PRUNE'").groupBy(*place).agg(F.min("action").alias("action"), F.min("new_id").alias("new_id"), F.min("new_name").alias("new_name"))
    prune = gone.join(left, ["document", "set_nth"], "left_semi").join(kept, "document", "left_semi")
    wide = set_key(F.col("raw"), ("includeDescendants",), F.lit("true"))
    concept = F.to_json(F.struct(F.col("new_id").alias("CONCEPT_ID"), F.col("new_name").alias("CONCEPT_NAME")))
    new = F.when(F.col("action") == "WIDEN", wide).when(F.col("action") == "REPLACE", set_key(wide, ("concept",), concept)).otherwise(F.col("raw"))
    items = rows.items.join(prune, place, "left_anti").join(change, place, "left")
    items = items.withColumns({"raw": new, "concept_id": F.when(F.col("action") == "REPLACE", F.col("new_id")).otherwise(F.col("concept_id")), "include_descendants": F.col("action").isNotNull() | F.col("include_descendants")})
    without = lambda df: df.join(lost, ["document", "rule"], "left_anti")
    return rows.but(items=items.select(*rows.items.columns), rules=without(rows.rules), groups=without(rows.groups), criteria=without(rows.criteria)).written("items", "rules", "groups", "criteria"), report
