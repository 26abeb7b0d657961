"""Checks and repairs of cohort criteria held as rows, for any number of documents at once.

A row is one criterion: id, document, rule, any_of (the rule asks for any of its criteria), domain, codeset, absent, w_start, w_end (days from
the index), low, high (bounds of the value, null where open), unit. Every check is a grouping or a join on the document and what it compares.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .document_checks import end_of, merged

#: The only domain whose events carry numbers; least change of a mean that counts, draws below which a smaller one says nothing.
MEASURED, FLOOR, DRAWS = "Measurement", 0.02, 6
SET = ("document", "domain", "codeset")
OPEN = 1e12


def bounded() -> Column:
    return F.col("low").isNotNull() | F.col("high").isNotNull()


def no_op_rules(rows: DataFrame) -> DataFrame:
    """document, rule that accept everyone: any of two or more absences."""
    return rows.groupBy("document", "rule").agg(F.count("*").alias("n"), F.bool_and(F.col("any_of") & F.col("absent")).alias("all_absent")).where("n >= 2 AND all_absent").select("document", "rule")


def washouts(rows: DataFrame, entry: DataFrame) -> DataFrame:
    """id, w_end, new_end: absences on an entry's own set whose window reaches the index day would empty the cohort; the window then ends the day before. entry: document, domain, codeset."""
    hit = rows.where("absent AND w_start < 0 AND w_end >= 0").join(entry.select(*SET).distinct(), list(SET), "left_semi")
    return hit.select("id", "w_end", F.lit(-1).alias("new_end"))


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def contradicted(rows: DataFrame) -> DataFrame:
    """id of what must be present though an absence forbids the same set, all values of it, in an overlapping window."""
    must = rows.where("NOT any_of AND NOT absent").alias("p")
    no = rows.where("NOT any_of AND absent AND low IS NULL AND high IS NULL").select(*SET, F.col("w_start").alias("a_start"), F.col("w_end").alias("a_end")).alias("a")
    met = reduce(and_, [F.col(f"p.{c}") == F.col(f"a.{c}") for c in SET]) & overlapping(F.col("p.w_start"), F.col("p.w_end"), F.col("a_start"), F.col("a_end"))
    return must.join(no, met, "left_semi").select("id")


def signature(*more: str) -> Column:
    """A criterion's selection as a short hash of its parts in a fixed order."""
    parts = [F.coalesce(F.col(c).cast("bigint").cast("string") if c in ("low", "high") else F.col(c).cast("string"), F.lit("-")) for c in ("domain", "codeset", "low", "high", "unit", "w_start", "w_end", *more)]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def unsatisfiable(rows: DataFrame) -> DataFrame:
    """document, signature, n_present, n_absent of selections that one document both asks for and forbids."""
    both = rows.where("NOT any_of").groupBy("document", signature().alias("signature")).agg(F.count_if(~F.col("absent")).alias("n_present"), F.count_if("absent").alias("n_absent"))
    return both.where("n_present > 0 AND n_absent > 0")


def islands(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, island, low, high, n_bands, n_distinct: closed bands joined while the next begins no higher than the highest end so far."""
    before = Window.partitionBy(*keys).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce((F.col("low") > F.max("high").over(before)).cast("int"), F.lit(1))
    marked = rows.withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    return marked.groupBy(*keys, "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n_bands"), F.countDistinct("low", "high").alias("n_distinct"))


def covered(rows: DataFrame) -> DataFrame:
    """id of measured presences whose whole range is forbidden by absences on the same set, in some unit that both sides allow.

    Neither side may be one of several choices (any_of). An absence counts if its window holds the presence's and their units are equal or one has none; for each unit that
    absences name, those with it and those without a unit count together.
    """
    must = rows.where(F.col("domain") == MEASURED).where("NOT any_of").withColumns({"lo": end_of(F.coalesce("low", F.lit(-OPEN)), F.lit(0)), "hi": end_of(F.coalesce("high", F.lit(OPEN)), F.lit(1))})
    ask = must.where("NOT absent").select("id", "document", "codeset", F.col("unit").alias("p_unit"), F.col("w_start").alias("p_start"), F.col("w_end").alias("p_end"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    no = must.where("absent").select("document", "codeset", "unit", "w_start", "w_end", "lo", "hi")
    fits = (F.col("w_start") <= F.col("p_start")) & (F.col("w_end") >= F.col("p_end")) & (F.col("unit").isNull() | F.col("p_unit").isNull() | (F.col("unit") == F.col("p_unit")))
    pairs = ask.join(no, ["document", "codeset"]).where(fits)
    none = F.lit(-1).cast("long")
    named = pairs.select("id", F.explode(F.array_distinct(F.array(none, F.coalesce("unit", none)))).alias("in_unit")).distinct()
    islands = merged(pairs.join(named, "id").where(F.col("unit").isNull() | (F.col("unit") == F.col("in_unit"))).select("id", "in_unit", "lo", "hi"), ["id", "in_unit"])
    return ask.join(islands, "id").where("lo <= p_lo AND p_hi <= hi").select("id").distinct()


def unreadable(rows: DataFrame) -> DataFrame:
    """id, no_number, bare_absence, no_unit: a bound where the table has no numbers, absence of any measurement at all, a bound without unit."""
    measured = F.col("domain") == MEASURED
    flags = rows.select("id", (~measured & bounded()).alias("no_number"), (measured & F.col("absent") & ~bounded()).alias("bare_absence"), (measured & bounded() & F.col("unit").isNull()).alias("no_unit"))
    return flags.where("no_number OR bare_absence OR no_unit")


def aliased(sets: DataFrame) -> DataFrame:
    """least_name, n_names, n_members of sets with the same members under different names. sets: name, member."""
    each = sets.groupBy("name").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return each.groupBy("members").agg(F.min("name").alias("least_name"), F.count("*").alias("n_names")).where("n_names > 1").select("least_name", "n_names", F.size("members").cast("long").alias("n_members"))


def meant_as_choice(rows: DataFrame) -> DataFrame:
    """document, rule, n_sets: alternatives (says_or) that the rule asks for all at once, in one domain and window."""
    asked = rows.where("NOT any_of AND NOT absent").groupBy("document", "rule", "domain", "w_start", "w_end").agg(F.countDistinct("codeset").alias("n_sets"), F.bool_or("says_or").alias("says_or"))
    return asked.where("says_or AND n_sets >= 2").groupBy("document", "rule").agg(F.max("n_sets").alias("n_sets"))


def wrong_domain(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """id, codeset of criteria that read a table their set does not belong to. domains: codeset, domain_id (compound ones split at '/')."""
    fits = domains.select("codeset", F.explode(F.split("domain_id", "/")).alias("domain"))
    return rows.join(fits, ["codeset", "domain"], "left_anti").select("id", "codeset")


def restated(rows: DataFrame) -> DataFrame:
    """id of absences that only say what a presence of the same rule, set, unit and window says already: no value beyond the bound that it sets."""
    asked = rows.where("NOT absent").select("document", "rule", "domain", "codeset", "w_start", "w_end", "unit", F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    no = rows.where("absent").where(F.col("low").isNull() != F.col("high").isNull())
    same = reduce(and_, [no[c] == asked[c] for c in ("document", "rule", "domain", "codeset", "w_start", "w_end")]) & no["unit"].eqNullSafe(asked["unit"])
    beyond = (no["low"].isNull() & (no["high"] <= asked["p_low"])) | (no["high"].isNull() & (no["low"] >= asked["p_high"]))
    return no.join(asked, same & beyond, "left_semi").select("id")


def split_bands(rows: DataFrame) -> DataFrame:
    """document, rule, codeset, unit, w_start, w_end, low, high: 'at least low' beside 'none above high' on one measurement, unit and window, meant as one range."""
    measured = rows.where(F.col("domain") == MEASURED).where("low IS NOT NULL AND high IS NULL")
    sides = measured.groupBy("document", "rule", "codeset", "unit", "w_start", "w_end").agg(F.count_if(~F.col("absent")).alias("n"), F.count_if("absent").alias("m"), F.min(F.when(~F.col("absent"), F.col("low"))).alias("low"), F.min(F.when(F.col("absent"), F.col("low"))).alias("high"))
    return sides.where("n = 1 AND m = 1 AND low <= high").select("document", "rule", "codeset", "unit", "w_start", "w_end", "low", "high")


def alternative_bands(rows: DataFrame) -> DataFrame:
    """Islands of two or more different closed bands on one set, unit, window and polarity, which together mean any of them."""
    return islands(rows.where("low IS NOT NULL AND high IS NOT NULL"), ("document", "domain", "codeset", "absent", "unit", "w_start", "w_end")).where("n_distinct >= 2")


def stated_bounds(rows: DataFrame) -> DataFrame:
    """id, op, value: what one-sided bounds say once 'none above x' is read as 'at most x' and so on."""
    low = F.col("high").isNull()
    op = F.when(low, F.when(F.col("absent"), "lt").otherwise("gte")).otherwise(F.when(F.col("absent"), "gt").otherwise("lte"))
    return rows.where(F.col("low").isNull() != F.col("high").isNull()).select("id", op.alias("op"), F.coalesce("low", "high").alias("value"))


def inherited(rows: DataFrame) -> DataFrame:
    """id, low, high, inherited: a criterion's own bound, or its rule's (that of the least id): a relative one always, an absolute one if the unit is the same."""
    leader = rows.where(bounded()).groupBy("document", "rule").agg(F.min_by(F.struct("low", "high", "unit", "relative"), "id").alias("g"))
    use = ~bounded() & F.col("g").isNotNull() & (F.col("g.relative") | F.col("g.unit").eqNullSafe(F.col("unit")))
    pick = lambda c: F.when(use, F.col(f"g.{c}")).otherwise(F.col(c)).alias(c)
    return rows.join(leader, ["document", "rule"], "left").select("id", pick("low"), pick("high"), use.alias("inherited"))


def reconciled(stored: DataFrame, outcomes: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """document, stored, a count for each state, reconciled: whether what became of a document's criteria adds up to what it held. stored: document, id; outcomes: id, state."""
    counts = stored.join(outcomes, "id", "left").groupBy("document").agg(F.count("*").alias("stored"), *(F.count_if(F.col("state") == s).alias(s) for s in states))
    return counts.withColumn("reconciled", F.col("stored") == reduce(lambda a, b: a + b, [F.col(s) for s in states]))


def bound_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """document, codeset, agreement of two versions' bounds (op, value): exact, value, polarity, operator, both, one_sided."""
    up = lambda c: F.col(c).isin("gt", "gte")
    both = left.select("document", "codeset", F.col("op").alias("a"), F.col("value").alias("x")).join(right.select("document", "codeset", F.col("op").alias("b"), F.col("value").alias("y")), ["document", "codeset"], "full")
    said = F.when(F.col("a").isNull() | F.col("b").isNull(), "one_sided").when((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), "exact").when(F.col("a") == F.col("b"), "value")
    return both.select("document", "codeset", said.when((up("a") != up("b")) & (F.col("x") == F.col("y")), "polarity").when(F.col("x") == F.col("y"), "operator").otherwise("both").alias("agreement"))


def verdict(delta: Column, draws: Column) -> Column:
    """What a change of a mean says: improved, regressed, or too small to say."""
    return F.when(F.abs(delta) >= FLOOR, F.when(delta > 0, "improved").otherwise("regressed")).when(draws >= DRAWS, "below floor").otherwise("unresolved")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: shared, only_left or only_right."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(True)), right.select(*keys).distinct().withColumn("r", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise("shared").alias("side"))


def without_unit(rows: DataFrame, allowed: list[int]) -> DataFrame:
    """id of presences on allow-listed sets whose unit filter goes, as sites record these values without one."""
    return rows.where(~F.col("absent") & F.col("unit").isNotNull() & F.col("codeset").isin(allowed)).select("id")


def proposals(rows: DataFrame, evidence: DataFrame, ancestor: DataFrame) -> DataFrame:
    """id, document, rule, action for criteria with a concept_id at a site: KEEP where the concept has persons, REPOINT where only concepts under it have,
    else REMAP for entries (is_entry), BENIGN_KEEP for absences and DROP for presences. evidence: concept_id of those with persons enough."""
    has = evidence.select("concept_id").distinct().withColumn("own", F.lit(True))
    under = ancestor.where("ancestor_concept_id <> descendant_concept_id").join(evidence.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi")
    below = under.select(F.col("ancestor_concept_id").alias("concept_id")).distinct().withColumn("below", F.lit(True))
    action = F.when(F.col("own"), "KEEP").when(F.col("below"), "REPOINT").when(F.col("is_entry"), "REMAP").when(F.col("absent"), "BENIGN_KEEP").otherwise("DROP")
    return rows.join(has, "concept_id", "left").join(below, "concept_id", "left").select("id", "document", "rule", "is_entry", action.alias("action"))


def applied(proposed: DataFrame, most: float = 0.4) -> DataFrame:
    """document, n_rules, n_dropped, aborted, n_left: rules all of whose criteria are dropped go, entries never; where more than a share would go nothing is done."""
    rules = proposed.where("NOT is_entry").groupBy("document", "rule").agg(F.bool_and(F.col("action") == "DROP").alias("gone"))
    n = rules.groupBy("document").agg(F.count("*").alias("n_rules"), F.count_if("gone").alias("n_dropped"))
    aborted = F.col("n_dropped") > most * F.col("n_rules")
    return n.select("document", "n_rules", "n_dropped", aborted.alias("aborted"), F.when(aborted, F.col("n_rules")).otherwise(F.col("n_rules") - F.col("n_dropped")).alias("n_left"))
