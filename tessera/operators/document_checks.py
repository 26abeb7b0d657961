"""Checks and repairs of cohort documents opened by plans.rows: contradictions between criteria by what they select, and rewrites that undo them.

Criteria are compared by the members of their sets, never by set ids, by units and windows, and by bounds as intervals with open and
closed ends. Everything is a join or grouping inside documents, so any number of them is checked at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rows import PLACE, Rows, drop_key, set_key, with_types
from ..staging import grown, staged

#: Phrases that state a bound and words for its sides, which a rule's name is rid of to see what it is about.
BOUND_PHRASES = (
    "at least", "at most", "no more than", "no less than", "not more than", "greater than", "less than", "more than", "or equal to",
    "up to", "and", "to", "above", "below", "over", "under", "from", "between",
)
LOW_WORDS = ("below", "lower", "beneath", "less", "under", "minimum", "min", "floor")
HIGH_WORDS = ("above", "upper", "higher", "greater", "over", "exceed", "exceeds", "exceeding", "maximum", "max", "ceiling")
LIMIT_WORDS = (
    "limit", "limits", "bound", "bounds", "boundary", "boundaries", "threshold", "thresholds", "range", "ranges", "value", "values",
    "cutoff", "cutoffs", "cut off", "cut offs",
)
#: What joins the halves of a rule's name, connectives of an exception, words that point elsewhere, longest exception in words.
JOINED = " + "
CONNECTIVES = ("other than", "except for", "except", "excluding", "apart from", "but not", "exclusive of")
POINTING_HEADS = ("above", "foregoing", "following", "former", "latter", "rest", "remainder", "other", "others")
POINTING_WORDS = ("specified", "allowed", "permitted", "listed", "mentioned", "stated", "described", "noted", "these", "those", "such", "aforementioned")
LONGEST_EXCEPTION = 8
OPEN = 1e300
#: Parts of a resolved set that are keyed one by one.
PARTS = 256


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words)


# ---- sets and intervals -------------------------------------------------------------------------


def members(rows: Rows) -> DataFrame:
    """document, codeset, members, n_members: a key of what the set selects (its items but the excluded), the same for the same concepts. Empty sets have none."""
    held = rows.items.where(~F.col("is_excluded") & F.col("concept_id").isNotNull())
    return _keyed(held.groupBy("document", "codeset").agg(F.sort_array(F.collect_list("concept_id")).alias("ids")))


def identities(rows: Rows) -> DataFrame:
    """document, codeset, members: a key of the set's items with their exclusions."""
    held = rows.items.where(F.col("concept_id").isNotNull())
    return _keyed(held.groupBy("document", "codeset").agg(F.sort_array(F.collect_set(F.concat_ws(":", "concept_id", "is_excluded"))).alias("ids")))


@dataclass(frozen=True)
class Closures:
    """What sets resolve to, held once for all sets of the same items, whatever documents they are in. sets: document, codeset, codeset_id. members: codeset_id, concept_id."""

    sets: DataFrame
    members: DataFrame


def closure_keys(closures: DataFrame | Closures) -> DataFrame:
    """document, codeset, members, n_members of resolved closures (Closures, or document, codeset, concept_id)."""
    if isinstance(closures, DataFrame):
        return _keyed(closures.groupBy("document", "codeset").agg(F.sort_array(F.collect_set("concept_id")).alias("ids")))
    # a set can hold the whole vocabulary: keys of parts by hash first
    part = F.pmod(F.xxhash64("concept_id"), F.lit(PARTS)).alias("part")
    parts = closures.members.groupBy("codeset_id", part).agg(F.sort_array(F.collect_set("concept_id")).alias("ids"))
    parts = parts.select("codeset_id", F.struct("part", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("key")).alias("x"), F.size("ids").alias("n"))
    whole = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat_ws(":", x["part"].cast("string"), x["key"])))
    keys = parts.groupBy("codeset_id").agg(F.sha2(whole, 256).alias("members"), F.sum("n").cast("int").alias("n_members"))
    return closures.sets.join(keys, "codeset_id").select("document", "codeset", "members", "n_members")


def _keyed(sets: DataFrame) -> DataFrame:
    return sets.select("document", "codeset", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("members"), F.size("ids").alias("n_members"))


def set_closures(rows: Rows, ancestor: DataFrame, relationship: DataFrame, concept: DataFrame) -> Closures:
    """What each set resolves to. Sets with the same items are resolved once, and their members are not repeated for each document."""
    from .vocabulary import closure

    flags = ["concept_id", "include_descendants", "include_mapped", "is_excluded"]
    items = rows.items.where(F.col("concept_id").isNotNull())
    keyed = items.groupBy("document", "codeset").agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", *flags))), ","), 256).alias("codeset_id"))
    keyed = grown(keyed, "set-ids")
    distinct = items.join(keyed, ["document", "codeset"]).select("codeset_id", *flags).distinct()
    return Closures(keyed, grown(closure(staged(distinct, "distinct-sets"), ancestor, relationship, concept), "closures"))


def closures(rows: Rows, ancestor: DataFrame, relationship: DataFrame, concept: DataFrame) -> DataFrame:
    """document, codeset, concept_id: what each set resolves to, a row for each document and member; set_closures does not repeat them."""
    found = set_closures(rows, ancestor, relationship, concept)
    return found.sets.join(found.members, "codeset_id").select("document", "codeset", "concept_id")


def end_of(value: Column, beyond: Column) -> Column:
    """An end of an interval as (value, 0 or 1): intervals are half-open between such ends, 1 being just above the value."""
    return F.struct(value.cast("double").alias("v"), beyond.cast("int").alias("e"))


def pieces(op: Column, value: Column, extent: Column) -> Column:
    """The intervals that a bound admits, as an array of (lo, hi), lo in and hi out: all values for no bound or one that cannot be read.

    gt, lt open; gte, lte, eq, bt closed; neq and !bt two open pieces. A range whose ends are the wrong way round admits nothing.
    """
    zero, one, low, high = F.lit(0), F.lit(1), F.lit(-OPEN), F.lit(OPEN)
    piece = lambda a, ae, b, be: F.struct(end_of(a, ae).alias("lo"), end_of(b, be).alias("hi"))
    below, above = lambda v, e: piece(low, zero, v, e), lambda v, e: piece(v, e, high, one)
    every = F.array(piece(low, zero, high, one))
    said = (
        F.when(op == "gt", F.array(above(value, one))).when(op == "gte", F.array(above(value, zero))).when(op == "lt", F.array(below(value, zero))).when(op == "lte", F.array(below(value, one)))
        .when(op == "eq", F.array(piece(value, zero, value, one))).when(op.isin("neq", "!eq"), F.array(below(value, zero), above(value, one)))
        .when((op == "bt") & extent.isNotNull(), F.array(piece(value, zero, extent, one))).when((op == "!bt") & extent.isNotNull(), F.array(below(value, zero), above(extent, one)))
    )
    return F.filter(F.when(value.isNull() | op.isNull() | said.isNull(), every).otherwise(said), lambda p: p["lo"] < p["hi"])


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi: a sweep over the keys' intervals joins those that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("lo") > F.max("hi").over(before)).cast("int"), F.lit(1))
    marked = ranges.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


# ---- checks -------------------------------------------------------------------------------------


def no_op_rules(rows: Rows) -> DataFrame:
    """document, rule, name of rules that ask for any of two or more groups of absences alone: everyone lacks one of them."""
    top = rows.groups.where("depth = 1").groupBy("document", "rule").agg(F.count("*").alias("n_groups"))
    under = rows.criteria.where("path <> ''").groupBy("document", "rule").agg(F.bool_and("absent").alias("all_absent"))
    return rows.rules.where("any_of").join(top.where("n_groups >= 2"), ["document", "rule"]).join(under.where("all_absent"), ["document", "rule"]).select("document", "rule", "name")


def washouts(rows: Rows) -> DataFrame:
    """document, rule, path, nth, end_day of mandatory absences over concepts of the entry's own set, unless their window provably ends before the index day: they empty the cohort."""
    rows = rows.written("items")
    first = rows.entries.where("nth = 0").select("document", "codeset")
    entry = rows.items.join(first, ["document", "codeset"], "left_semi").select("document", "concept_id").distinct()
    shared = rows.items.where(~F.col("is_excluded")).join(entry, ["document", "concept_id"], "left_semi").select("document", "codeset").distinct()
    reaching = rows.criteria.where("conjoined AND absent").where(F.col("end_day").isNull() | (F.col("end_day") >= 0))
    return reaching.join(shared, ["document", "codeset"], "left_semi").select(*PLACE, "end_day")


def overlapping(a: str, b: str) -> Column:
    """Windows that share a day; one that the document does not fix overlaps all."""
    known = F.col(f"{a}.w_start").isNotNull() & F.col(f"{b}.w_start").isNotNull()
    return ~known | (F.greatest(f"{a}.w_start", f"{b}.w_start") <= F.least(f"{a}.w_end", f"{b}.w_end"))


def contradicted(rows: Rows) -> DataFrame:
    """document, rule, path, nth of mandatory presences whose whole set a mandatory absence forbids in an overlapping window, with absent_rule, the first such rule. Sets are the same by number or by items."""
    keyed = rows.criteria.where("conjoined AND (absent OR required) AND codeset IS NOT NULL").join(identities(rows), ["document", "codeset"], "left")
    keyed = keyed.withColumn("set_key", F.coalesce("members", F.concat(F.lit("#"), F.col("codeset"))))
    met = (F.col("p.document") == F.col("a.document")) & (F.col("p.set_key") == F.col("a.set_key")) & overlapping("p", "a")
    hit = keyed.where("required").alias("p").join(keyed.where("absent AND bare").alias("a"), met)
    return hit.groupBy(*(F.col(f"p.{k}") for k in PLACE)).agg(F.min("a.rule").alias("absent_rule"))


def signed(rows: Rows, keys: DataFrame | None = None) -> DataFrame:
    """criteria with what they select: members of their set (those of keys, or as listed), window_key, selection (domain, window, residue) and bound. Null members: no set, or an empty one."""
    days = F.concat_ws(":", F.lit("days"), "w_start", "w_end")
    window = F.when(F.col("w_start").isNotNull(), days).otherwise(F.concat(F.lit("raw"), F.col("window")))
    units = F.array_join(F.col("units").cast("array<string>"), ",")
    bound = F.concat_ws("|", F.coalesce("op", F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit("")), F.coalesce(F.col("extent").cast("string"), F.lit("")), units)
    joined = rows.criteria.join(members(rows) if keys is None else keys, ["document", "codeset"], "left")
    return joined.withColumns({"window_key": window, "bound": bound})


def unsatisfiable_rules(rows: Rows) -> DataFrame:
    """document, rule, n_required of rules every one of whose required criteria a mandatory absence forbids: the same members, domain, bound, units, window and other attributes."""
    same = ["document", "members", "domain", "bound", "window_key", "residue"]
    all_ = signed(rows)
    forbidden = all_.where("conjoined AND absent AND members IS NOT NULL").select(*same).distinct().withColumn("hit", F.lit(1))
    each = all_.where("required").join(forbidden, same, "left").groupBy("document", "rule").agg(F.count("*").alias("n_required"), F.count("hit").alias("n_hit"))
    return each.where("n_required = n_hit").select("document", "rule", "n_required")


def covered(rows: Rows) -> DataFrame:
    """document, rule, path, nth of mandatory presences every value of which mandatory absences forbid, in some unit that both sides allow.

    Absences count together where they are over the same members, domain and other attributes, in a window that holds the
    presence's (or the same one, where the document does not fix it): their intervals are joined by a sweep for each unit that one of them names, those
    without unit counting in each; those without unit also count alone.
    """
    all_ = signed(rows).where("conjoined AND members IS NOT NULL").withColumn("pieces", pieces(F.col("op"), F.col("value"), F.col("extent")))
    keys = ["document", "members", "domain", "residue"]
    ask = all_.where("required").select(*PLACE, "members", "domain", "residue", "window_key", F.col("w_start").alias("p_start"), F.col("w_end").alias("p_end"), F.col("units").alias("p_units"), F.col("pieces").alias("p_pieces"))
    no = all_.where("absent").select(*keys, F.col("window_key").alias("a_key"), F.col("w_start").alias("a_start"), F.col("w_end").alias("a_end"), F.col("units").alias("a_units"), "pieces")
    holds = (F.col("window_key") == F.col("a_key")) | ((F.col("a_start") <= F.col("p_start")) & (F.col("a_end") >= F.col("p_end")))
    fits = (F.size("p_units") == 0) | (F.size("a_units") == 0) | F.arrays_overlap("p_units", "a_units")
    pairs = ask.join(no, keys).where(holds & fits)
    place = list(PLACE)
    # the units to look at: those that absences name and the presence allows, and none
    allowed = F.when(F.size("p_units") == 0, F.col("a_units")).otherwise(F.array_intersect("a_units", "p_units"))
    named = pairs.select(*place, F.explode(F.array_union(F.array(F.lit(-1).cast("long")), allowed)).alias("unit")).distinct()
    cut = pairs.select(*place, "a_units", F.explode("pieces").alias("piece"))
    by_unit = cut.join(named, place).where((F.size("a_units") == 0) | F.array_contains("a_units", F.col("unit"))).select(*place, "unit", "piece.lo", "piece.hi")
    islands = merged(by_unit, [*place, "unit"]).withColumnsRenamed({"lo": "from", "hi": "to"})
    wanted = ask.join(named, place).select(*place, "unit", F.size("p_pieces").alias("n"), F.explode_outer("p_pieces").alias("piece"))
    inside = wanted.join(islands, [*place, "unit"], "left").withColumn("in", F.coalesce((F.col("from") <= F.col("piece.lo")) & (F.col("piece.hi") <= F.col("to")), F.lit(False)))
    per_piece = inside.groupBy(*place, "unit", "n", "piece").agg(F.bool_or("in").alias("in"))
    return per_piece.groupBy(*place, "unit").agg(F.bool_and(F.col("in") | (F.col("n") == 0)).alias("all_in")).where("all_in").select(*place).distinct()


def containing(rows: Rows, resolved: DataFrame | Closures) -> DataFrame:
    """document, codeset of sets whose closure holds the whole closure of the document's entries: members met are counted against the entry's. resolved: Closures, or document, codeset, concept_id.

    With Closures, documents with the same entry sets are one entry, and each of their distinct sets is counted against it once.
    """
    named = rows.entries.select("document", "codeset").distinct()
    if isinstance(resolved, DataFrame):
        entry = resolved.join(named, ["document", "codeset"], "left_semi").select("document", "concept_id").distinct()
        n = entry.groupBy("document").agg(F.count("*").alias("n_entry"))
        met = resolved.join(entry, ["document", "concept_id"], "left_semi").groupBy("document", "codeset").agg(F.count("*").alias("n_met"))
        return met.join(n, "document").where("n_met = n_entry").select("document", "codeset")
    own = resolved.sets.join(named, ["document", "codeset"]).groupBy("document").agg(F.sort_array(F.collect_set("codeset_id")).alias("entry"))
    sets = grown(resolved.sets.join(own, "document"), "entry-sets")
    held = sets.select("entry").distinct().select("entry", F.explode("entry").alias("codeset_id")).join(resolved.members, "codeset_id").select("entry", "concept_id").distinct()
    held = grown(held, "entry-members")
    n = held.groupBy("entry").agg(F.count("*").alias("n_entry"))
    met = sets.select("entry", "codeset_id").distinct().join(resolved.members, "codeset_id").join(held, ["entry", "concept_id"], "left_semi").groupBy("entry", "codeset_id").agg(F.count("*").alias("n_met"))
    whole = met.join(n, "entry").where("n_met = n_entry").select("entry", "codeset_id")
    return sets.join(whole, ["entry", "codeset_id"], "left_semi").select("document", "codeset")


# ---- what names say -----------------------------------------------------------------------------


def subject(half: Column, limits: bool = False) -> Column:
    """What a half of a rule's name is about: without numbers, signs and bound phrases (and, with limits, words for sides and limits)."""
    rid = F.regexp_replace(half, rf"(?i)\b(?:{_any(BOUND_PHRASES)})\b|\d+(?:\.\d+)?\s*%?|[<>=≤≥()\[\]]+", " ")
    if limits:
        rid = F.regexp_replace(rid, rf"(?i)\b(?:{_any(tuple(dict.fromkeys(LOW_WORDS + HIGH_WORDS)) + LIMIT_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(F.lower(rid), r"\s+", " "))


def halves(name: Column) -> Column:
    return F.split(name, re.escape(JOINED))


def side(half: Column) -> Column:
    """'low' or 'high' where the half has words for exactly one side."""
    low, high = half.rlike(rf"(?i)\b(?:{_any(LOW_WORDS)})\b"), half.rlike(rf"(?i)\b(?:{_any(HIGH_WORDS)})\b")
    return F.when(low & ~high, "low").when(high & ~low, "high")


def exception(text: Column) -> Column:
    """The entities that a text leaves out of what it names ('cancer other than skin cancer'), as an array; null where it states none, or one that cannot be resolved.

    A trailing time window is cut off; phrases of over eight words or that point elsewhere are left alone, and so are names joined of several. Parts are cut at commas and 'or', at
    slashes only where every part is one word.
    """
    said = F.trim(F.regexp_replace(text, r"\s+", " "))
    link = _any(CONNECTIVES)
    enclosed, plain = rf"(?i)^(.*?)\s*\(\s*(?:{link})\s+([^()]+?)\s*\)\s*$", rf"(?i)^(.*?)\s+(?:{link})\s+(.+)$"
    use = F.when(said.rlike(enclosed), F.lit(True)).otherwise(F.lit(False))
    group = lambda i: F.when(use, F.regexp_extract(said, enclosed, i)).otherwise(F.regexp_extract(said, plain, i))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"^[,\s]+|[,\s]+$", ""))
    base = bare(group(1))
    window = r"(?i)\s+(?:with)?in\s+(?:the\s+)?(?:last|past|previous|preceding|prior(?:\s+to)?)?\s*\d+\s*\w+.*$"
    left_out = bare(F.regexp_replace(group(2), window, ""))
    parts = F.transform(F.filter(F.split(left_out, r"\s*,\s*|\s+or\s+"), lambda p: F.trim(p) != ""), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^(?:and|or)\s+", "")))
    slashed = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^\s*[^\s/]+(?:\s*/\s*[^\s/]+)+\s*$"), F.transform(F.split(p, "/"), lambda s: F.trim(s))).otherwise(F.array(p))))
    kept = F.filter(slashed, lambda p: ~F.lower(p).isin("and", "or", "the", "a", "an", ""))
    pointing = left_out.rlike(rf"(?i)^(?:the\s+)?(?:{_any(POINTING_HEADS)})\b") | left_out.rlike(rf"(?i)\b(?:{_any(POINTING_WORDS)})\b")
    fine = (said.rlike(enclosed) | said.rlike(plain)) & ~said.contains(JOINED) & (base != "") & (left_out != "") & ~F.lower(base).isin("and", "or", "the", "a", "an")
    return F.when(fine & (F.size(F.split(left_out, " ")) <= LONGEST_EXCEPTION) & ~pointing & (F.size(kept) > 0), kept)


# ---- repairs ------------------------------------------------------------------------------------


def rewritten(rows: Rows, changes: DataFrame) -> Rows:
    """rows whose criteria have the raw text of changes (document, rule, path, nth, new_raw) where it has one."""
    joined = rows.criteria.join(changes, list(PLACE), "left")
    return rows.but(criteria=with_types(joined.withColumn("raw", F.coalesce("new_raw", "raw")).drop("new_raw"))).written("criteria")


def washouts_before_index(rows: Rows) -> Rows:
    """Washouts on the entry's concepts that end on the index day end the day before it."""
    moved = set_key(F.col("raw"), ("StartWindow", "End"), F.lit('{"Days": 1, "Coeff": -1}'))
    hit = washouts(rows).where("end_day = 0").select(*PLACE)
    return rewritten(rows, rows.criteria.join(hit, list(PLACE), "left_semi").select(*PLACE, moved.alias("new_raw")))


def split_ranges(rows: Rows, keys: DataFrame) -> DataFrame:
    """document, rule, low, high, low_path, high_path, low_nth: rules that ask for any of 'at least low' and 'at most high' of one measurement, which means a range.

    The rule holds exactly two groups, each with one measurement that must be present and nothing else; both say the same but for
    set and bound; low is below high; their sets have the same closure (keys); the name has two halves about one subject and
    names both numbers. Strict bounds are left alone: a range includes its ends.
    """
    plain = rows.groups.where("depth = 1").where("upper(coalesce(kind, 'ALL')) IN ('ALL', 'ANY') AND coalesce(get_json_object(rest, '$.DemographicCriteriaList'), '[]') = '[]'")
    root = rows.groups.where("depth = 0 AND upper(kind) = 'ANY' AND coalesce(get_json_object(rest, '$.DemographicCriteriaList'), '[]') = '[]'").select("document", "rule")
    n_groups = rows.groups.groupBy("document", "rule").agg(F.count_if(F.col("depth") == 1).alias("n_top"), F.count_if(F.col("depth") > 1).alias("n_deep"))
    n_criteria = rows.criteria.groupBy("document", "rule").agg(F.count("*").alias("n_criteria"), F.count_if(F.col("path") == "").alias("n_root"))
    shaped = root.join(n_groups.where("n_top = 2 AND n_deep = 0"), ["document", "rule"]).join(n_criteria.where("n_criteria = 2 AND n_root = 0"), ["document", "rule"]).select("document", "rule")
    asked = rows.criteria.where("domain = 'Measurement' AND extent IS NULL AND value IS NOT NULL").join(plain.select("document", "rule", "path"), ["document", "rule", "path"], "left_semi").join(shaped, ["document", "rule"], "left_semi")
    same = drop_key(drop_key(F.col("raw"), ("Criteria", "Measurement", "CodesetId")), ("Criteria", "Measurement", "ValueAsNumber"))
    asked = asked.join(keys.select("document", "codeset", "members"), ["document", "codeset"])
    # both bounds read it: what a criterion says besides set and bound is made once
    asked = grown(asked.select("document", "rule", "path", "nth", "op", "value", "members", same.alias("same")), "asked-bounds")
    low = asked.where("op = 'gte'").select("document", "rule", "same", "members", F.col("value").alias("low"), F.col("path").alias("low_path"), F.col("nth").alias("low_nth"))
    high = asked.where("op = 'lte'").select("document", "rule", "same", "members", F.col("value").alias("high"), F.col("path").alias("high_path"))
    both = low.join(high, ["document", "rule", "same", "members"]).where("low < high").join(rows.rules.select("document", "rule", "name"), ["document", "rule"])
    cut = halves(F.col("name"))
    named = F.transform(F.regexp_extract_all("name", F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    one = (F.size(cut) == 2) & (subject(F.get(cut, F.lit(0))) == subject(F.get(cut, F.lit(1)))) & (subject(F.get(cut, F.lit(0))) != "") & F.array_contains(named, F.col("low")) & F.array_contains(named, F.col("high"))
    return both.where(one).select("document", "rule", "low", "high", "low_path", "high_path", "low_nth")


def ranges_joined(rows: Rows, keys: DataFrame) -> Rows:
    """Rules of split_ranges become one criterion with a closed range, that of the lower bound, under ALL."""
    found = grown(split_ranges(rows, keys), "split-ranges")
    at = ["document", "rule"]
    bound = F.concat(F.lit('{"Value":'), F.col("low"), F.lit(',"Extent":'), F.col("high"), F.lit(',"Op":"bt"}'))
    kept = rows.criteria.join(found, at).where("path = low_path AND nth = low_nth")
    made = kept.select("document", "rule", F.lit("").alias("path"), F.lit(0).alias("nth"), F.lit(True).alias("conjoined"), set_key(F.col("raw"), ("Criteria", "Measurement", "ValueAsNumber"), bound).alias("raw"))
    criteria = rows.criteria.join(found.select(*at), at, "left_anti").unionByName(with_types(made).select(*rows.criteria.columns))
    root = rows.groups.where("depth = 0").join(found.select(*at), at, "left_semi").withColumns({"kind": F.lit("ALL"), "conjoined": F.lit(True), "rest": set_key(F.col("rest"), ("Type",), F.lit('"ALL"')), "has_criteria": F.lit(True), "has_groups": F.lit(True)})
    groups = rows.groups.join(found.select(*at), at, "left_anti").unionByName(root)
    rules = rows.rules.join(found.select(*at, F.lit(True).alias("hit")), at, "left").withColumn("any_of", F.col("any_of") & F.col("hit").isNull()).drop("hit")
    return rows.but(criteria=criteria, groups=groups, rules=rules).written("criteria", "groups", "rules")


def restated_absences(rows: Rows, keys: DataFrame) -> DataFrame:
    """document, rule, partner: rules that forbid 'at least low' and 'at most high' of the very range that one other rule asks for: one sentence read twice, once without turning the bounds.

    The rule is ALL of exactly two absences of a measurement, one of each bound, flat or one a group; the partner is ALL of one presence with the closed range of these two numbers; sets have
    the same closure (keys), windows are the same; no other presence of these members and window may stand anywhere; each half of the name has a word for the side that its bound contradicts, and
    both rules' names are about one subject.
    """
    at = ["document", "rule"]
    joined = rows.criteria.where("domain = 'Measurement'").join(keys.select("document", "codeset", "members"), ["document", "codeset"])
    per_rule = rows.criteria.groupBy(*at).agg(F.count("*").alias("n"), F.bool_and(F.col("absent") & (F.col("domain") == "Measurement") & F.col("extent").isNull()).alias("absent_only"), F.max(F.length("path")).alias("deepest"))
    groups = rows.groups.groupBy(*at).agg(F.max(F.when(F.col("depth") == 0, F.upper("kind"))).alias("root"), F.bool_and(F.coalesce(F.get_json_object("rest", "$.DemographicCriteriaList"), F.lit("[]")) == "[]").alias("no_people"), F.bool_and((F.col("depth") == 0) | F.upper(F.coalesce("kind", F.lit("ALL"))).isin("ALL", "ANY")).alias("plain"), F.max("depth").alias("depth"))
    crowded = rows.criteria.where("path <> ''").groupBy(*at, "path").count().where("count > 1").select(*at).distinct()
    shaped = per_rule.where("n = 2 AND absent_only").join(groups.where("root = 'ALL' AND no_people AND plain AND depth <= 1"), at).join(crowded, at, "left_anti").select(*at)
    no = joined.join(shaped, at, "left_semi").groupBy(*at).agg(
        F.min("members").alias("members"), F.max("members").alias("members2"), F.min("window").alias("window"), F.max("window").alias("window2"), F.sort_array(F.collect_list(F.struct("path", "nth", "op", "value"))).alias("bounds")
    )
    no = no.where("members = members2 AND window = window2 AND size(bounds) = 2").withColumns({"low": F.get(F.filter("bounds", lambda b: b["op"] == "gte"), F.lit(0))["value"], "high": F.get(F.filter("bounds", lambda b: b["op"] == "lte"), F.lit(0))["value"]}).where("low IS NOT NULL AND high IS NOT NULL")
    yes = joined.where("required").select("document", F.col("rule").alias("partner"), "members", "window", "op", "value", "extent", "count", "path")
    sole = per_rule.where("n = 1").join(groups.where("root = 'ALL' AND no_people AND depth <= 1"), at).select("document", F.col("rule").alias("partner"), F.lit(True).alias("alone"))
    met = no.join(yes, ["document", "members", "window"]).where("partner <> rule").join(sole, ["document", "partner"], "left")
    one = met.groupBy(*at).agg(F.count_distinct("partner").alias("n"), F.min("partner").alias("partner"), F.bool_and(F.coalesce(F.col("alone"), F.lit(False)) & (F.col("op") == "bt") & (F.col("count") == 1) & (F.col("value") == F.col("low")) & (F.col("extent") == F.col("high"))).alias("verbatim"), F.first("bounds").alias("bounds"))
    names = rows.rules.select("document", "rule", "name")
    named = one.where("n = 1 AND verbatim").join(names, at).join(names.select("document", F.col("rule").alias("partner"), F.col("name").alias("partner_name")), ["document", "partner"])
    cut, other = halves(F.col("name")), halves(F.col("partner_name"))
    turned = F.forall(F.zip_with(cut, F.col("bounds"), lambda h, b: ((side(h) == "low") & (b["op"] == "gte")) | ((side(h) == "high") & (b["op"] == "lte"))), lambda ok: F.coalesce(ok, F.lit(False)))
    about = F.array_distinct(F.transform(F.concat(cut, other), lambda h: subject(h, True)))
    return named.where((F.size(cut) == 2) & turned & (F.size(about) == 1) & (F.get(about, F.lit(0)) != "")).select("document", "rule", "partner")


def restated_absences_removed(rows: Rows, keys: DataFrame) -> Rows:
    gone = grown(restated_absences(rows, keys).select("document", "rule"), "restated-absences")
    without = lambda df: df.join(gone, ["document", "rule"], "left_anti")
    return rows.but(rules=without(rows.rules), groups=without(rows.groups), criteria=without(rows.criteria))


def entry_exclusions(rows: Rows, resolved: DataFrame | Closures) -> DataFrame:
    """document, set_nth, codeset: sets of mandatory absences that reach the index day, hold the whole closure of the entries, and whose rule's name states an exception. Documents whose entry sets exclude something themselves are left alone."""
    covers = (F.coalesce("w_start", F.lit(-OPEN)) <= 0) & (F.coalesce("end_day", F.lit(OPEN)) >= 0)
    stated = rows.rules.where(exception(F.col("name")).isNotNull()).select("document", "rule")
    absent = rows.criteria.where("conjoined AND absent").where(covers).join(stated, ["document", "rule"], "left_semi").select("document", "codeset").distinct()
    own = rows.items.join(rows.entries.select("document", "codeset").distinct(), ["document", "codeset"], "left_semi")
    subtracting = own.where("is_excluded").select("document").distinct()
    hit = absent.join(containing(rows, resolved), ["document", "codeset"], "left_semi").join(subtracting, "document", "left_anti")
    return hit.join(rows.sets.select("document", "set_nth", "codeset"), ["document", "codeset"]).select("document", "set_nth", "codeset")


def entry_exclusions_mirrored(rows: Rows, resolved: DataFrame | Closures) -> Rows:
    """The entry sets' items are put at the end of such sets as exclusions, once each, but for concepts already excluded there."""
    hit = grown(entry_exclusions(rows, resolved), "entry-exclusions")
    entry = rows.items.join(rows.entries.select("document", "codeset").distinct(), ["document", "codeset"], "left_semi").where("concept_id IS NOT NULL")
    entry = entry.groupBy("document", "concept_id").agg(F.min(F.struct("set_nth", "nth", "raw", "include_descendants", "include_mapped")).alias("x")).hint("merge")
    already = rows.items.where("is_excluded").select("document", "set_nth", "concept_id")
    new = hit.join(entry, "document").join(already, ["document", "set_nth", "concept_id"], "left_anti")
    last = rows.items.groupBy("document", "set_nth").agg(F.max("nth").alias("last"))
    order = F.row_number().over(Window.partitionBy("document", "set_nth").orderBy("x.set_nth", "x.nth"))
    made = new.join(last, ["document", "set_nth"], "left").select(
        "document", "set_nth", (F.coalesce("last", F.lit(-1)) + order).cast("int").alias("nth"), "codeset", "concept_id", F.col("x.include_descendants").alias("include_descendants"), F.col("x.include_mapped").alias("include_mapped"), F.lit(True).alias("is_excluded"), set_key(F.col("x.raw"), ("isExcluded",), F.lit("true")).alias("raw"),
    )
    return rows.but(items=rows.items.unionByName(made)).written("items")


def units_dropped(rows: Rows, allowed: DataFrame) -> Rows:
    """Mandatory or optional presences with a bound whose set holds only concepts of one allow-listed analyte lose their unit filter, where all units they name are that analyte's stated ones and
    the bound lies where no value of another unit falls. allowed: analyte, concept_id, unit_id (stated), other_low, other_high (raw values in other units).
    """
    concepts = allowed.select("analyte", "concept_id").distinct()
    listed = rows.items.where(~F.col("is_excluded") & F.col("concept_id").isNotNull()).join(concepts, "concept_id", "left")
    classed = listed.groupBy("document", "codeset").agg(F.count_distinct("analyte").alias("n"), F.bool_and(F.col("analyte").isNotNull()).alias("all"), F.min("analyte").alias("analyte")).where("n = 1 AND all").select("document", "codeset", "analyte")
    units = allowed.groupBy("analyte").agg(F.collect_set("unit_id").alias("stated"), F.min("other_low").alias("other_low"), F.max("other_high").alias("other_high"))  # a row for each analyte
    asked = rows.criteria.where("required AND domain = 'Measurement' AND size(units) > 0 AND value IS NOT NULL AND op IS NOT NULL").join(classed, ["document", "codeset"]).join(units, "analyte")
    reach = F.exists(pieces(F.col("op"), F.col("value"), F.col("extent")), lambda p: (p["lo"] < end_of(F.col("other_high"), F.lit(1))) & (p["hi"] > end_of(F.col("other_low"), F.lit(0))))
    safe = asked.where((F.size(F.array_except("units", "stated")) == 0) & ~F.coalesce(reach, F.lit(False)))
    return rewritten(rows, safe.select(*PLACE, drop_key(F.col("raw"), ("Criteria", "Measurement", "Unit")).alias("new_raw")))


def repaired(rows: Rows, resolved: DataFrame | Closures, allowed: DataFrame | None = None) -> Rows:
    """All repairs in the order that they need: split ranges joined, their restated absences removed, exclusions mirrored, washouts moved, units dropped."""
    keys = grown(closure_keys(resolved), "closure-keys")
    rows = restated_absences_removed(ranges_joined(rows, keys), keys)
    rows = washouts_before_index(entry_exclusions_mirrored(rows, resolved))
    return rows if allowed is None else units_dropped(rows, allowed)
