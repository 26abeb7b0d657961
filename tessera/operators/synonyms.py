"""Names through a dictionary: concepts of a text, their synonyms, and members of a class along 'isa' relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dictionary import Dictionary
from ..staging import staged
from .vocabulary import valid

#: Semantic types by domain; vocabularies whose names come first; kinds of names of substances; vocabularies of substances.
TYPES_OF = {
    "Condition": [
        "Disease or Syndrome", "Neoplastic Process", "Finding", "Sign or Symptom", "Pathologic Function", "Mental or Behavioral Dysfunction",
        "Congenital Abnormality", "Injury or Poisoning", "Cell or Molecular Dysfunction", "Acquired Abnormality",
    ],
    "Drug": [
        "Pharmacologic Substance", "Clinical Drug", "Antibiotic", "Organic Chemical", "Amino Acid, Peptide, or Protein", "Hormone", "Vitamin",
        "Immunologic Factor",
    ],
    "Procedure": [
        "Therapeutic or Preventive Procedure", "Diagnostic Procedure", "Health Care Activity", "Laboratory Procedure", "Research Activity",
    ],
    "Measurement": ["Laboratory or Test Result", "Laboratory Procedure", "Diagnostic Procedure", "Clinical Attribute"],
}
PREFERRED = ("SNOMEDCT_US", "LNC", "RXNORM", "NCI", "MSH", "CHV", "HPO")
SUBSTANCES, DRUG_VOCABULARIES = ("IN", "PIN", "MIN", "BN"), ("RxNorm", "RxNorm Extension")
#: Concepts kept from a substring search, letters up to which a query is short, concepts whose synonyms are read, synonyms returned, least members of a class.
FOUND, SHORT, READ, RETURNED, LEAST = 10, 5, 3, 5, 3
#: Letters of the pieces by which names are looked up.
PIECE = 3


def pieces_of(text: Column, size: int = PIECE) -> Column:
    """All runs of so many letters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def holding(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, cui of names that hold the query's text (lower case in `wanted`), letters taken as they are.

    A query is looked up by its rarest piece of three letters (of two or one, where it is as short) among the pieces of all names, and what is
    found there is verified.
    """
    asked = queries.select("query_id", "wanted", F.least(F.length("wanted"), F.lit(PIECE)).alias("size")).where("size > 0")
    held = names.select("cui", F.lower("str").alias("name")).distinct()
    found = None
    for size in range(1, PIECE + 1):
        posted = held.select("cui", "name", F.explode(pieces_of(F.col("name"), size)).alias("piece")).hint("merge")  # many rows a name, which the planner does not count
        rare = asked.where(F.col("size") == size).select("query_id", "wanted", F.explode(pieces_of(F.col("wanted"), size)).alias("piece"))
        counts = posted.join(rare.select("piece").distinct(), "piece", "left_semi").groupBy("piece").count()
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("count", F.lit(0)), "piece"))
        probe = rare.join(counts, "piece", "left").withColumn("nth", first).where("nth = 1 AND count IS NOT NULL").select("query_id", "wanted", "piece")
        hit = probe.join(posted, "piece").where(F.col("name").contains(F.col("wanted"))).select("query_id", "cui").distinct()
        found = hit if found is None else found.unionByName(hit)
    return found


def concepts_of(queries: DataFrame, d: Dictionary) -> DataFrame:
    """query_id, nth, cui: the dictionary's concepts of each query (query_id, text, domain), in ascending order.

    Names equal but for case; for queries without one, the ten least concepts with a name that holds the text. Of these only concepts of
    the domain's semantic types are kept, if there are any; else all, but none where the query is short or was only found inside names. Unknown or
    null domains keep all, and so does a dictionary without types. Empty and null texts find nothing.
    """
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("wanted"), "domain").where("wanted IS NOT NULL AND wanted <> ''")
    exact = staged(asked.join(d.names.select("cui", F.lower("str").alias("wanted")), "wanted").select("query_id", "cui", F.lit(True).alias("exact")).distinct(), "exact-names")
    inside = holding(asked.join(exact, "query_id", "left_anti"), d.names)
    inside = inside.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("cui"))).where(F.col("nth") <= FOUND).select("query_id", "cui", F.lit(False).alias("exact"))
    allowed = queries.sparkSession.createDataFrame([(k, v) for k, types in TYPES_OF.items() for v in types], "domain string, sty string")
    fits = d.types.join(F.broadcast(allowed), "sty").select("domain", "cui").distinct().withColumn("fit", F.lit(True))
    known, typed = F.col("domain").isin(list(TYPES_OF)), not d.types.isEmpty()
    found = exact.unionByName(inside).join(asked, "query_id").join(fits, ["domain", "cui"], "left")
    any_fit = F.max(F.coalesce("fit", F.lit(False))).over(Window.partitionBy("query_id"))
    strict = F.when(F.col("exact"), F.length("wanted") <= SHORT).otherwise(F.lit(True))
    keep = ~F.coalesce(known, F.lit(False)) | ~F.lit(typed) | F.coalesce("fit", F.lit(False)) | (~F.col("any_fit") & ~strict)
    kept = found.withColumn("any_fit", any_fit).where(keep)
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("cui"))).select("query_id", "nth", "cui")


def synonyms(queries: DataFrame, d: Dictionary, most: int = RETURNED) -> DataFrame:
    """query_id, rank, synonym: other names of the first three concepts of each query, each concept's preferred vocabularies first, then preferred forms; no name twice in any case of letters."""
    concepts = concepts_of(queries.where(F.length(F.trim("text")) >= 2), d).where(F.col("nth") <= READ)
    order = [F.desc("ispref"), F.asc("ts"), F.asc("sab"), F.asc("str")]
    once = F.row_number().over(Window.partitionBy("cui", F.lower("str")).orderBy(*order))
    names = d.names.join(concepts.select("cui").distinct(), "cui", "left_semi").withColumn("once", once).where("once = 1")
    place = F.row_number().over(Window.partitionBy("cui").orderBy((~F.col("sab").isin(list(PREFERRED))).cast("int"), *order))
    best = names.withColumn("place", place).where(F.col("place") <= 2 * most).select("cui", "place", "str")
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("own"))
    met = concepts.join(best, "cui").join(asked, "query_id").where(F.lower("str") != F.col("own"))
    first = F.row_number().over(Window.partitionBy("query_id", F.lower("str")).orderBy("nth", "place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nth", "place"))
    return met.withColumn("first", first).where("first = 1").withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", F.col("str").alias("synonym"))


def children(relations: DataFrame) -> DataFrame:
    """parent, child: what 'isa' relations and their inverses say. cui1 isa cui2 has cui2 as the child, as the dictionary writes it."""
    down = relations.where("rela = 'isa'").select(F.col("cui1").alias("parent"), F.col("cui2").alias("child"))
    up = relations.where("rela = 'inverse_isa'").select(F.col("cui2").alias("parent"), F.col("cui1").alias("child"))
    return down.unionByName(up).where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def reached(seeds: DataFrame, relations: DataFrame, hops: int | None = None) -> DataFrame:
    """seed, cui, depth: all that a seed (column seed) has below it within so many hops (None: all), at its least depth; itself is not.

    Rounds of a frontier: its children that were not seen before are the next one. Cycles end since what was seen is left out; each round is written
    in the shared folder, and the rounds are as many as the longest shortest path.
    """
    edges = staged(children(relations), "isa")
    frontier = staged(seeds.select("seed", F.col("seed").alias("cui"), F.lit(0).alias("depth")).where("seed IS NOT NULL").distinct(), "frontier")
    seen, depth = [frontier], 0
    while hops is None or depth < hops:
        depth += 1
        before = seen[0]
        for more in seen[1:]:
            before = before.unionByName(more)
        new = frontier.join(edges, F.col("cui") == F.col("parent")).select("seed", F.col("child").alias("cui")).distinct().join(before.select("seed", "cui"), ["seed", "cui"], "left_anti")
        frontier = staged(new.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    out = seen[0]
    for more in seen[1:]:
        out = out.unionByName(more)
    return out.where("depth > 0")


def class_members(classes: DataFrame, d: Dictionary, concept: DataFrame, hops: int | None = 1, least: int = LEAST) -> DataFrame:
    """query_id, concept_id: the ingredients that stand below a class of drugs (query_id, text) in the dictionary; classes with fewer than `least` give none.

    The class is the least concept of its name; each concept below it is named by its least English name of a substance, and that name is looked up
    among valid ingredients, whatever its case.
    """
    top = concepts_of(classes.select("query_id", "text", F.lit("Drug").alias("domain")), d).where("nth = 1").select("query_id", F.col("cui").alias("seed"))
    below = reached(top.select("seed"), d.relations, hops).select("seed", "cui")
    name = d.names.where(F.col("sab") == "RXNORM").where(F.col("lat") == "ENG").where(F.col("tty").isin(list(SUBSTANCES))).groupBy("cui").agg(F.min("str").alias("name"))
    kinds = valid(concept).where((F.col("concept_class_id") == "Ingredient") & F.col("vocabulary_id").isin(list(DRUG_VOCABULARIES)))
    kinds = kinds.groupBy(F.lower("concept_name").alias("key")).agg(F.min("concept_id").alias("concept_id"))
    found = top.join(below, "seed").join(name, "cui").withColumn("key", F.lower("name")).join(kinds, "key").select("query_id", "concept_id").distinct()
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(enough, "query_id", "left_semi")
