"""Expansion of seed concepts along the hierarchy: unions of named branches up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from . import vocabulary

#: Most results of a seed, levels and hops, least information content of an ancestor, how much less than the seed's it may have.
CAP, LEVELS, HOPS, LEAST_CONTENT, SLACK = 50, 3, 3, 8.0, 2.5
STRATEGIES = ("descendants", "siblings", "maps_to", "ancestor_climb", "clinical", "clinical_anchor")


def greedy(branches: DataFrame, members: DataFrame, cap: int = CAP) -> DataFrame:
    """seed_id, concept_id, branch: members of a seed's branches (seed_id, branch, place), taken branch by branch until the cap is reached.

    Of each branch (members: branch, concept_id) at most the `cap` least ids are looked at. A branch is opened while the branches before it
    brought fewer than `cap` different concepts, so the last one opened may go beyond.
    """
    least = F.row_number().over(Window.partitionBy("branch").orderBy("concept_id"))
    few = members.join(branches.select("branch").distinct(), "branch", "left_semi").distinct().withColumn("least", least).where(F.col("least") <= cap).drop("least")
    first = F.row_number().over(Window.partitionBy("seed_id", "concept_id").orderBy("place"))
    met = staged(branches.join(few, "branch").withColumn("first", first).where("first = 1").drop("first"), "branch-members")
    new = met.groupBy("seed_id", "place").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seed_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = new.withColumn("before", before).where(F.col("before") < cap).select("seed_id", "place")
    return met.join(opened, ["seed_id", "place"], "left_semi").select("seed_id", "concept_id", "branch")


def most_specific(branches: DataFrame, members: DataFrame, cap: int = CAP) -> DataFrame:
    """seed_id, concept_id, nth: all different members (branch, concept_id, ic) of all a seed's branches, the most specific first, then the least ids; no less than the first `cap` that are not the seed.

    Whoever stands behind `cap` + 1 others of a branch, one of which may be the seed, stands behind them in the whole, so a branch's members are ordered once and only its first meet seeds.
    """
    order = [F.desc("ic"), F.asc("concept_id")]
    here = F.row_number().over(Window.partitionBy("branch").orderBy(*order))
    first = members.distinct().withColumn("here", here).where(F.col("here") <= cap + 1).drop("here")
    nth = F.row_number().over(Window.partitionBy("seed_id").orderBy(*order))
    return branches.join(first, "branch").select("seed_id", "concept_id", "ic").distinct().withColumn("nth", nth).where(F.col("nth") <= cap + 1).select("seed_id", "concept_id", "nth")


def climbed(seeds: DataFrame, ancestor: DataFrame, is_a: DataFrame, cap: int = CAP, least_content: float = LEAST_CONTENT, slack: float = SLACK, whole: bool = False) -> DataFrame:
    """seed_id, concept_id, nth: up to specific enough ancestors, nearest and broadest first, and three hops down from each until the cap; of more than `cap` concepts the most specific stay.

    whole: down from all of them, to all that stands there, the most specific first.
    """
    counts = vocabulary.descendant_counts(ancestor.select(F.col("ancestor_concept_id").alias("concept_id")).distinct(), ancestor)
    counts = staged(counts.withColumn("ic", vocabulary.information_content(F.col("n_descendants"))), "contents")
    own = seeds.join(counts, "concept_id").select(F.col("concept_id").alias("seed_id"), F.col("ic").alias("seed_ic"))
    up = own.join(ancestor.where(F.col("min_levels_of_separation").between(1, HOPS)), F.col("seed_id") == F.col("descendant_concept_id"))
    up = up.select("seed_id", "seed_ic", F.col("ancestor_concept_id").alias("concept_id"), F.col("min_levels_of_separation").alias("separation")).join(counts, "concept_id")
    fit = up.where(F.col("ic") > F.greatest(F.lit(least_content), F.col("seed_ic") - slack))
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy("separation", F.desc("n_descendants"), "concept_id"))
    branches = staged(fit.select("seed_id", F.col("concept_id").alias("branch"), place.alias("place")), "branches")
    below = vocabulary.k_hop(branches.select(F.col("branch").alias("concept_id")).distinct(), is_a, HOPS).select(F.col("seed_id").alias("branch"), "concept_id").where("branch <> concept_id")
    if whole:
        ic = F.coalesce("ic", F.lit(vocabulary.LEAF_CONTENT)).alias("ic")
        return most_specific(branches.select("seed_id", "branch"), below.join(counts.select("concept_id", "ic"), "concept_id", "left").select("branch", "concept_id", ic), cap)
    taken = greedy(branches, below, cap).join(counts.select("concept_id", "ic"), "concept_id", "left")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc(F.coalesce("ic", F.lit(vocabulary.LEAF_CONTENT))), "concept_id"))
    return taken.withColumn("nth", rank).where(F.col("nth") <= cap).select("seed_id", "concept_id", "nth")


def from_parents(seeds: DataFrame, ancestor: DataFrame, is_a: DataFrame, concept: DataFrame, levels: int = LEVELS, most: int | None = None) -> DataFrame:
    """seed_id, concept_id, separation: what stands below a seed's parents. With `most`, no less than the so many nearest (then least ids): of each parent only its most + 1 nearest, one of which may be the seed."""
    up = seeds.join(is_a, seeds["concept_id"] == is_a["child"]).select(F.col("concept_id").alias("seed_id"), "parent").distinct()
    down = vocabulary.descendants_within(up.select(F.col("parent").alias("concept_id")).distinct(), ancestor, concept, levels).select(F.col("seed_id").alias("parent"), "concept_id", "min_levels_of_separation")
    if most is not None:
        down = down.groupBy("parent", "concept_id").agg(F.min("min_levels_of_separation").alias("min_levels_of_separation"))
        nth = F.row_number().over(Window.partitionBy("parent").orderBy("min_levels_of_separation", "concept_id"))
        down = down.withColumn("nth", nth).where(F.col("nth") <= most + 1).drop("nth")
    return up.join(down, "parent").groupBy("seed_id", "concept_id").agg(F.min("min_levels_of_separation").alias("separation"))


def expanded(seeds: DataFrame, strategy: str, ancestor: DataFrame, is_a: DataFrame, relationship: DataFrame, concept: DataFrame, cap: int = CAP, **climb: float) -> DataFrame:
    """seed_id, concept_id, rank, branch: a seed's expansion by a named strategy, each concept in its first branch, the seed itself left out, at most `cap`.

    descendants, siblings, maps_to, ancestor_climb: that branch alone. clinical: descendants (a leaf's: what is below its parents), siblings, mapped concepts, the whole climb, near
    ancestors. clinical_anchor: near ancestors, siblings, mapped concepts, the climb, no descendants. In a branch the nearest come first, then the least ids.
    Whoever stands behind `cap` others of its branch stands behind them in the whole, so big families are cut at the cap before they meet their members.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    wanted = {"clinical": ("descendants", "siblings", "maps_to", "ancestor_climb", "ancestors"), "clinical_anchor": ("ancestors", "siblings", "maps_to", "ancestor_climb")}.get(strategy, (strategy,))

    def branch(name: str) -> DataFrame:
        if name == "descendants":
            down = vocabulary.descendants_within(seeds, ancestor, concept, LEVELS).select("seed_id", "concept_id", F.col("min_levels_of_separation").alias("far"))
            if strategy != "clinical":
                return down
            leaves = seeds.join(down.select(F.col("seed_id").alias("concept_id")).distinct(), "concept_id", "left_anti")
            return down.unionByName(from_parents(leaves, ancestor, is_a, concept, most=cap).select("seed_id", "concept_id", F.col("separation").alias("far")))
        if name == "siblings":
            return vocabulary.siblings(seeds, is_a, cap).withColumn("far", F.lit(0))
        if name == "maps_to":
            maps = relationship.where("relationship_id = 'Maps to'").select(F.col("concept_id_1").alias("seed_id"), F.col("concept_id_2").alias("concept_id")).distinct()
            return maps.join(seeds.select(F.col("concept_id").alias("seed_id")), "seed_id", "left_semi").withColumn("far", F.lit(0))
        if name == "ancestor_climb":
            return climbed(seeds, ancestor, is_a, cap, whole=strategy == "clinical", **climb).select("seed_id", "concept_id", F.col("nth").alias("far"))
        return vocabulary.ancestors_within(seeds, ancestor, 2).select("seed_id", "concept_id", F.col("min_levels_of_separation").alias("far"))

    rows = None
    for place, name in enumerate(wanted):
        here = branch(name).select("seed_id", "concept_id", F.lit(place).alias("place"), F.lit(name).alias("branch"), F.col("far").cast("int").alias("far"))
        rows = here if rows is None else rows.unionByName(here)
    order = ["place", "far", "concept_id"]
    first = F.row_number().over(Window.partitionBy("seed_id", "concept_id").orderBy("place", "far"))
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(*order))
    once = rows.where("concept_id <> seed_id").withColumn("first", first).where("first = 1")
    return once.withColumn("rank", rank).where(F.col("rank") <= cap).select("seed_id", "concept_id", "rank", "branch")
