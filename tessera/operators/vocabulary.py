"""Terminology algebra on concept, concept_ancestor and concept_relationship. All are joins on concept ids; nothing is inlined as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Concepts in the hierarchy that information content is measured against, and that of a leaf.
TOTAL_CONCEPTS, LEAF_CONTENT = 2_750_364, 20.0


def valid(concept: DataFrame) -> DataFrame:
    return concept.where("invalid_reason IS NULL")


def standard(concept: DataFrame) -> DataFrame:
    return concept.where("standard_concept = 'S' AND invalid_reason IS NULL")


def expand(items: DataFrame, ancestor: DataFrame, relationship: DataFrame, concept: DataFrame) -> DataFrame:
    """codeset_id, concept_id reached by items: themselves if known (valid or not), valid descendants if asked, sources mapped to either if asked."""
    known = concept.select("concept_id")
    direct = items.join(known, "concept_id", "left_semi").select("codeset_id", "concept_id", "include_mapped")
    down = (
        items.where("include_descendants")
        .join(ancestor, items["concept_id"] == F.col("ancestor_concept_id"))
        .select("codeset_id", F.col("descendant_concept_id").alias("concept_id"), "include_mapped")
        .join(valid(concept).select("concept_id"), "concept_id", "left_semi")
        .select("codeset_id", "concept_id", "include_mapped")
    )
    reached = direct.unionByName(down)
    maps = relationship.where("relationship_id = 'Maps to'")
    mapped = reached.where("include_mapped").join(maps, F.col("concept_id") == F.col("concept_id_2")).select("codeset_id", F.col("concept_id_1").alias("concept_id"))
    return reached.select("codeset_id", "concept_id").unionByName(mapped).distinct()


def closure(items: DataFrame, ancestor: DataFrame, relationship: DataFrame, concept: DataFrame) -> DataFrame:
    """All concept sets at once: what included items reach minus what excluded ones reach. items: codeset_id, concept_id, include_descendants, include_mapped, is_excluded."""
    plus = expand(items.where("NOT is_excluded"), ancestor, relationship, concept)
    minus = expand(items.where("is_excluded"), ancestor, relationship, concept)
    return plus.join(minus, ["codeset_id", "concept_id"], "left_anti")


def unresolvable(items: DataFrame, concept: DataFrame) -> DataFrame:
    return items.join(concept.select("concept_id"), "concept_id", "left_anti").select("codeset_id", "concept_id").distinct()


def forwarded(ids: DataFrame, relationship: DataFrame, concept: DataFrame) -> DataFrame:
    """concept_id, replacement: standard valid ids stand for themselves; others give way to their replacement (the least one), or stay when there is none."""
    good = standard(concept).select("concept_id")
    to = relationship.where("relationship_id IN ('Maps to', 'Concept replaced by')").join(good.withColumnRenamed("concept_id", "concept_id_2"), "concept_id_2", "left_semi")
    to = to.groupBy(F.col("concept_id_1").alias("concept_id")).agg(F.min("concept_id_2").alias("to"))
    fine = good.withColumn("fine", F.lit(True))
    return ids.join(fine, "concept_id", "left").join(to, "concept_id", "left").select("concept_id", F.when(F.col("fine"), F.col("concept_id")).otherwise(F.coalesce("to", "concept_id")).alias("replacement"))


def descendants_within(ids: DataFrame, ancestor: DataFrame, concept: DataFrame, levels: int) -> DataFrame:
    near = ancestor.where(F.col("min_levels_of_separation").between(1, levels))
    found = ids.join(near, ids["concept_id"] == F.col("ancestor_concept_id")).select(F.col("concept_id").alias("seed_id"), F.col("descendant_concept_id").alias("concept_id"), "min_levels_of_separation")
    return found.join(standard(concept).select("concept_id", "concept_name"), "concept_id")


def ancestors_within(ids: DataFrame, ancestor: DataFrame, levels: int) -> DataFrame:
    near = ancestor.where(F.col("min_levels_of_separation").between(1, levels))
    return ids.join(near, ids["concept_id"] == F.col("descendant_concept_id")).select(F.col("concept_id").alias("seed_id"), F.col("ancestor_concept_id").alias("concept_id"), "min_levels_of_separation")


def proper(ancestor: DataFrame) -> DataFrame:
    return ancestor.where("ancestor_concept_id <> descendant_concept_id")


def redundant(candidates: DataFrame, ancestor: DataFrame) -> DataFrame:
    """concept_id of candidates below another candidate."""
    inside = proper(ancestor).join(candidates.select(F.col("concept_id").alias("ancestor_concept_id")), "ancestor_concept_id", "left_semi")
    return candidates.join(inside, candidates["concept_id"] == F.col("descendant_concept_id"), "left_semi").select("concept_id")


def rolled_up(candidates: DataFrame, ancestor: DataFrame) -> DataFrame:
    return candidates.join(redundant(candidates, ancestor), "concept_id", "left_anti")


def without_seed_ancestors(candidates: DataFrame, seeds: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Candidates but proper ancestors of a seed that are no seeds themselves."""
    above = proper(ancestor).join(seeds.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi").select(F.col("ancestor_concept_id").alias("concept_id")).distinct()
    return candidates.join(above.join(seeds, "concept_id", "left_anti"), "concept_id", "left_anti")


def subsumers(candidates: DataFrame, members: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Candidates with at least one proper descendant among members, and how many."""
    pairs = proper(ancestor).join(members.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi")
    pairs = pairs.join(candidates.select(F.col("concept_id").alias("ancestor_concept_id")), "ancestor_concept_id", "left_semi")
    return pairs.groupBy(F.col("ancestor_concept_id").alias("concept_id")).agg(F.countDistinct("descendant_concept_id").alias("n_members"))


def descendant_counts(ids: DataFrame, ancestor: DataFrame) -> DataFrame:
    """concept_id, n_descendants without itself; 0 for leaves and unknown ids. A row an id, however often it is given."""
    below = proper(ancestor).groupBy(F.col("ancestor_concept_id").alias("concept_id")).agg(F.countDistinct("descendant_concept_id").alias("n"))
    return ids.select("concept_id").distinct().join(below, "concept_id", "left").select("concept_id", F.coalesce("n", F.lit(0)).alias("n_descendants"))


def information_content(n_descendants: Column) -> Column:
    return F.when(n_descendants <= 0, F.lit(LEAF_CONTENT)).otherwise(-F.log2(n_descendants / F.lit(float(TOTAL_CONCEPTS))))


def not_overbroad(candidates: DataFrame, ancestor: DataFrame, threshold: int = 500) -> DataFrame:
    """Candidates with at most threshold descendants; all of them if that would leave none."""
    counted = candidates.join(descendant_counts(candidates.select("concept_id").distinct(), ancestor), "concept_id").withColumn("broad", F.col("n_descendants") > threshold)
    any_left = counted.agg(F.coalesce(F.max((~F.col("broad")).cast("int")), F.lit(0)).alias("any_left"))  # one row
    return counted.crossJoin(F.broadcast(any_left)).where((~F.col("broad")) | (F.col("any_left") == 0)).drop("broad", "any_left")


def lowest_common_ancestor(groups: DataFrame, ancestor: DataFrame, max_separation: int = 5) -> DataFrame:
    """group_id, ancestor_concept_id, separation: the common ancestor of all members whose farthest member is nearest; ties go to the least id."""
    size = groups.groupBy("group_id").agg(F.countDistinct("concept_id").alias("size"))
    up = groups.distinct().join(ancestor.where(F.col("min_levels_of_separation") <= max_separation), F.col("concept_id") == F.col("descendant_concept_id"))
    common = up.groupBy("group_id", "ancestor_concept_id").agg(F.countDistinct("concept_id").alias("n"), F.max("min_levels_of_separation").alias("separation"))
    best = F.row_number().over(Window.partitionBy("group_id").orderBy("separation", "ancestor_concept_id"))
    return common.join(size, "group_id").where("n = size").withColumn("r", best).where("r = 1").select("group_id", "ancestor_concept_id", "separation")


def siblings(ids: DataFrame, is_a: DataFrame, most: int | None = None) -> DataFrame:
    """seed_id, concept_id: other children of the seed's parents. With `most`, no less than the so many least ids: of each parent only its most + 1 least children are looked at, one of which may be the seed."""
    up = ids.join(is_a, ids["concept_id"] == is_a["child"]).select(F.col("concept_id").alias("seed_id"), "parent")
    down = is_a.select(F.col("child").alias("concept_id"), "parent")
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("parent").orderBy("concept_id"))
        down = down.distinct().withColumn("nth", nth).where(F.col("nth") <= most + 1).drop("nth")
    return up.join(down, "parent").where("concept_id <> seed_id").select("seed_id", "concept_id").distinct()


def k_hop(ids: DataFrame, is_a: DataFrame, hops: int) -> DataFrame:
    """seed_id, concept_id, depth: below the seeds by at most `hops` edges, at their least depth. One join a hop."""
    down = is_a.select(F.col("parent").alias("concept_id"), F.col("child").alias("next"))
    wave = ids.select(F.col("concept_id").alias("seed_id"), "concept_id")
    found = None
    for depth in range(1, hops + 1):
        wave = wave.join(down, "concept_id").select("seed_id", F.col("next").alias("concept_id")).distinct()
        here = wave.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
    return found.groupBy("seed_id", "concept_id").agg(F.min("depth").alias("depth"))


def climbed(seeds: DataFrame, ancestor: DataFrame, hops: int = 3, least_content: float = 8.0, slack: float = 2.5, cap: int = 40) -> DataFrame:
    """seed_id, concept_id, separation, n_descendants: from specific enough ancestors down again, nearest and broadest first, at most cap a seed."""
    counts = descendant_counts(ancestor.select(F.col("ancestor_concept_id").alias("concept_id")).distinct(), ancestor).withColumn("ic", information_content(F.col("n_descendants")))
    own = seeds.join(counts, "concept_id").select(F.col("concept_id").alias("seed_id"), F.col("ic").alias("seed_ic"))
    up = own.join(ancestor.where(F.col("min_levels_of_separation").between(1, hops)), F.col("seed_id") == F.col("descendant_concept_id")).select("seed_id", "seed_ic", F.col("ancestor_concept_id").alias("concept_id"))
    fit = up.join(counts.select("concept_id", "ic"), "concept_id").where(F.col("ic") > F.greatest(F.lit(least_content), F.col("seed_ic") - slack)).select("seed_id", F.col("concept_id").alias("top"))
    down = fit.join(ancestor.where(F.col("min_levels_of_separation") <= hops), F.col("top") == F.col("ancestor_concept_id")).select("seed_id", F.col("descendant_concept_id").alias("concept_id"), F.col("min_levels_of_separation").alias("separation"))
    near = down.where("concept_id <> seed_id").groupBy("seed_id", "concept_id").agg(F.min("separation").alias("separation")).join(counts.select("concept_id", "n_descendants"), "concept_id")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("separation", F.col("n_descendants").desc(), "concept_id"))
    return near.withColumn("r", rank).where(F.col("r") <= cap).select("seed_id", "concept_id", "separation", "n_descendants")


def members_of_class(classes: DataFrame, ancestor: DataFrame, concept: DataFrame, member_class: str, least: int = 3) -> DataFrame:
    """class_id, concept_id: members of a class among concepts of one kind; classes with fewer than `least` give none."""
    found = classes.join(proper(ancestor), classes["concept_id"] == F.col("ancestor_concept_id")).select(F.col("concept_id").alias("class_id"), F.col("descendant_concept_id").alias("concept_id"))
    found = found.join(standard(concept).where(F.col("concept_class_id") == member_class).select("concept_id"), "concept_id", "left_semi")
    enough = found.groupBy("class_id").agg(F.countDistinct("concept_id").alias("n")).where(F.col("n") >= least).select("class_id")
    return found.join(enough, "class_id", "left_semi").select("class_id", "concept_id").distinct()


def ingredients(products: DataFrame, ancestor: DataFrame, concept: DataFrame, ingredient_class: str = "Ingredient") -> DataFrame:
    """concept_id, ingredient_id: a product's ingredient by hierarchy, else one that its name holds as a word, else itself."""
    kinds = concept.where(F.col("concept_class_id") == ingredient_class).select(F.col("concept_id").alias("i"), F.lower("concept_name").alias("i_name"))
    by_tree = products.join(proper(ancestor), products["concept_id"] == F.col("descendant_concept_id")).join(kinds, F.col("ancestor_concept_id") == F.col("i")).groupBy("concept_id").agg(F.min("i").alias("tree"))
    words = products.join(concept.select("concept_id", "concept_name"), "concept_id").select("concept_id", F.explode(F.split(F.lower("concept_name"), " ")).alias("i_name"))
    by_name = words.join(kinds, "i_name").groupBy("concept_id").agg(F.min("i").alias("named"))
    return products.join(by_tree, "concept_id", "left").join(by_name, "concept_id", "left").select("concept_id", F.coalesce("tree", "named", "concept_id").alias("ingredient_id"))


def relation(pairs: DataFrame, ancestor: DataFrame) -> DataFrame:
    """a, b, relation (same, ancestor, descendant, unrelated: of a to b), separation."""
    sep = ancestor.select(F.col("ancestor_concept_id").alias("x"), F.col("descendant_concept_id").alias("y"), F.col("min_levels_of_separation").alias("s"))
    down, up = sep.toDF("a", "b", "down"), sep.toDF("b", "a", "up")
    kind = F.when(F.col("a") == F.col("b"), "same").when(F.col("down").isNotNull(), "ancestor").when(F.col("up").isNotNull(), "descendant").otherwise("unrelated")
    return pairs.join(down, ["a", "b"], "left").join(up, ["b", "a"], "left").select("a", "b", kind.alias("relation"), F.coalesce("down", "up").alias("separation"))


def used_vocabulary(used: DataFrame, ancestor: DataFrame) -> DataFrame:
    """concept_id of all used concepts with their ancestors and descendants."""
    up = ancestor.join(used, ancestor["descendant_concept_id"] == used["concept_id"], "left_semi").select(F.col("ancestor_concept_id").alias("concept_id"))
    down = ancestor.join(used, ancestor["ancestor_concept_id"] == used["concept_id"], "left_semi").select(F.col("descendant_concept_id").alias("concept_id"))
    return used.select("concept_id").unionByName(up).unionByName(down).distinct()


def recommended(seeds: DataFrame, edges: DataFrame, concept: DataFrame, per_seed: int = 10) -> DataFrame:
    """concept_id, score: neighbours of seeds by rank within a seed, 1 / (1 + 0.1 rank), the best over seeds. edges: concept_id_1, concept_id_2."""
    found = seeds.join(edges, seeds["concept_id"] == F.col("concept_id_1")).select(F.col("concept_id").alias("seed_id"), F.col("concept_id_2").alias("concept_id")).distinct()
    found = found.join(standard(concept).select("concept_id"), "concept_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("seed_id").orderBy("concept_id"))
    ranked = found.withColumn("nth", nth).where(F.col("nth") <= per_seed)
    return ranked.groupBy("concept_id").agg(F.max(1 / (1 + 0.1 * (F.col("nth") - 1))).alias("score"))


def edges(concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """concept_id_1, concept_id_2, relationship_id of 'Is a' and 'Maps to' between standard, valid concepts; none to itself."""
    good = standard(concept).select("concept_id")
    rows = relationship.where("relationship_id IN ('Is a', 'Maps to') AND concept_id_1 <> concept_id_2").select("concept_id_1", "concept_id_2", "relationship_id").distinct()
    return rows.join(good.toDF("concept_id_1"), "concept_id_1", "left_semi").join(good.toDF("concept_id_2"), "concept_id_2", "left_semi").select("concept_id_1", "concept_id_2", "relationship_id")
