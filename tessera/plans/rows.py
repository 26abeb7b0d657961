"""Cohort documents as rows and back, for any number of documents at once.

A document's nesting is opened level by level: rules, groups and criteria become rows keyed by where they stand, and whatever
a row does not name stays with it as JSON text, so documents_of(rows_of(x)) says what x said. Checks read the rows' columns;
repairs change a row's raw text or take rows away, and the documents are put together again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import grown, partitions

#: Keys of a criterion's body that have columns of their own; the others narrow it further and stay text.
READ = ("CodesetId", "ValueAsNumber", "Unit")
PLACE = ("document", "rule", "path", "nth")
#: What with_types reads of a criterion, of its body and of its window; variant: what must be known to be a number, and what stays text.
CRITERION = "struct<StartWindow:variant,Occurrence:struct<Type:int,Count:int>>"
BODY = "struct<CodesetId:bigint,ValueAsNumber:struct<Op:string,Value:variant,Extent:variant>,Unit:array<struct<CONCEPT_ID:bigint>>>"
WINDOW = "struct<UseIndexEnd:boolean,UseEventEnd:boolean,Start:struct<Days:variant,Coeff:variant>,End:struct<Days:variant,Coeff:variant>>"


@dataclass(frozen=True)
class Rows:
    """heads: document, rest and what lists it has. sets: document, set_nth, codeset, name, rest. items: document, set_nth, nth, codeset, concept_id,
    include_descendants, include_mapped, is_excluded, raw. entries: document, nth, domain, codeset. rules: document, rule, name, any_of, rest. groups: document, rule,
    path, parent, depth, nth, kind, conjoined, rest. criteria: document, rule, path, nth, conjoined, raw and the columns of with_types.
    """

    heads: DataFrame
    sets: DataFrame
    items: DataFrame
    entries: DataFrame
    rules: DataFrame
    groups: DataFrame
    criteria: DataFrame

    def but(self, **frames: DataFrame) -> Rows:
        return replace(self, **frames)

    def written(self, *names: str) -> Rows:
        """These frames written in the shared folder and read again, so that what made them runs once and stands in no later plan."""
        return self.but(**{name: grown(getattr(self, name), name) for name in names})


def get(path: str, kind: str, v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def number(x: Column) -> Column:
    """The number that a variant is; text and truth values are none."""
    return F.when(~F.schema_of_variant(x).isin("STRING", "BOOLEAN"), F.try_variant_get(x, "$", "double"))


#: Types that only objects and only lists can be read as; nothing inside them is copied or looked at.
SHAPES = {"OBJECT": "struct<>", "ARRAY": "array<struct<>>"}


def rest(*keys: str, of: str = "$", kind: str = "ARRAY") -> Column:
    """The object as JSON text, without those of the keys that hold a list (or, with kind, an object): these have rows of their own."""
    names = ", ".join(f"'{k}'" for k in keys)
    return F.expr(f"to_json(map_filter(coalesce(try_variant_get(v, '{of}', 'map<string,variant>'), cast(map() AS map<string,variant>)), (k, x) -> NOT (k IN ({names}) AND try_variant_get(x, '$', '{SHAPES[kind]}') IS NOT NULL)))")


def has(path: str, kind: str = "ARRAY") -> Column:
    return get(path, SHAPES[kind]).isNotNull()


def each(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """keep, nth, v, text: the elements of an array."""
    found = df.select(*keep, F.posexplode(get(path, "array<variant>")).alias("nth", "v"))
    return found.withColumn("text", F.expr("to_json(v)"))


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("v", F.try_parse_json(text))


def is_object() -> Column:
    return has("$", "OBJECT")


def opened(documents: DataFrame) -> DataFrame:
    """document, v: the expression, which may stand under the key 'expression', as an object or as text."""
    v = documents.select("document", F.try_parse_json("expression").alias("v"))
    inner = v.select("document", "v", F.try_parse_json(get("$.expression", "string")).alias("inner"))
    return inner.select("document", F.when(get("$", SHAPES["OBJECT"], "inner").isNotNull(), F.col("inner")).otherwise(F.col("v")).alias("v"))


def rejected(documents: DataFrame) -> DataFrame:
    """document of those that are no JSON object (null or empty text, broken JSON, a list): they have no rows."""
    return opened(documents).where(~F.coalesce(is_object(), F.lit(False))).select("document")


def with_types(criteria: DataFrame) -> DataFrame:
    """criteria with what raw says, by column; raw is not parsed where it stands parsed in a column v.

    domain, codeset: of its body; kind and count of its occurrence, absent (exactly none), required (one or more); w_start, w_end: days
    from the index, both null where the document does not fix them (no window, no days, counted from another date); end_day: the end alone; window: as
    text; op, value, extent: the bound; units: ascending, empty for any; bare: the body names its set alone; residue: other attributes as text.
    """
    kept = [c for c in criteria.columns if c not in (*TYPES, "v")]
    df = criteria.select(*kept, "v") if "v" in criteria.columns else parsed(criteria.select(*kept), "raw")
    body = "coalesce(try_variant_get(v, '$.Criteria', 'map<string,variant>'), try_variant_get(v, '$', 'map<string,variant>'))"
    # what the columns need is read in one walk over the criterion and one over its body
    df = df.withColumns({"found": F.expr(f"get(filter(map_entries({body}), e -> try_variant_get(e.value, '$.CodesetId', 'variant') IS NOT NULL), 0)"), "c": get("$", CRITERION)})
    df = df.withColumns({"b": get("$", BODY, "found.value"), "keys": F.map_keys(get("$", "map<string,struct<>>", "found.value")), "w": get("$", WINDOW, "c.StartWindow")})
    rebased = F.coalesce(F.col("w.UseIndexEnd"), F.lit(False)) | F.coalesce(F.col("w.UseEventEnd"), F.lit(False))
    df = df.withColumns({"start": number(F.col("w.Start.Days")) * number(F.col("w.Start.Coeff")), "end": number(F.col("w.End.Days")) * number(F.col("w.End.Coeff")), "rebased": rebased})
    fixed = ~F.col("rebased") & F.col("start").isNotNull() & F.col("end").isNotNull()
    others = ", ".join(f"'{k}'" for k in READ)
    kind, count, none = F.col("c.Occurrence.Type"), F.col("c.Occurrence.Count"), F.array().cast("array<bigint>")
    return df.select(
        *kept, F.col("found.key").alias("domain"), F.col("b.CodesetId").alias("codeset"), kind.alias("kind"), count.alias("count"),
        F.coalesce((kind == 0) & (count == 0), F.lit(False)).alias("absent"), F.coalesce((kind == 2) & (count >= 1), F.lit(False)).alias("required"),
        F.when(fixed, F.col("start")).alias("w_start"), F.when(fixed, F.col("end")).alias("w_end"), F.when(~F.col("rebased"), F.col("end")).alias("end_day"), F.coalesce(F.to_json("c.StartWindow"), F.lit("")).alias("window"),
        F.lower(F.trim(F.col("b.ValueAsNumber.Op"))).alias("op"), number(F.col("b.ValueAsNumber.Value")).alias("value"), number(F.col("b.ValueAsNumber.Extent")).alias("extent"),
        F.sort_array(F.array_except(F.coalesce(F.col("b.Unit.CONCEPT_ID"), none), F.array(F.lit(None).cast("bigint")))).alias("units"), F.coalesce(F.col("keys") == F.array(F.lit("CodesetId")), F.lit(False)).alias("bare"),
        F.when(F.size(F.array_except("keys", F.array(*map(F.lit, READ)))) > 0, F.expr(f"to_json(map_filter(try_variant_get(found.value, '$', 'map<string,variant>'), (k, x) -> k NOT IN ({others})))")).otherwise("{}").alias("residue"),
    )


TYPES = ("domain", "codeset", "kind", "count", "absent", "required", "w_start", "w_end", "end_day", "window", "op", "value", "extent", "units", "bare", "residue")


def rows_of(documents: DataFrame) -> Rows:
    """The rows of all documents (document, expression as JSON text).

    What is no JSON object has no rows (see rejected), and neither have elements that are no objects in lists of rules, groups and sets. Rules, groups or criteria may be missing or
    empty lists. The document key must be unique. Levels of nested groups are opened one after another, each written in the shared folder.
    """
    # a table of few bytes is one task's otherwise, however many documents are made of its rows
    dealt = documents.repartition(partitions(documents.sparkSession), "document")
    d = grown(opened(dealt).select("document", F.when(is_object(), F.col("v")).alias("v")), "documents").where("v IS NOT NULL")
    heads = d.select("document", rest("ConceptSets", "InclusionRules").alias("rest"), has("$.ConceptSets").alias("has_sets"), has("$.InclusionRules").alias("has_rules"))
    whole_sets = each(d, "$.ConceptSets", "document").where(is_object())
    sets = whole_sets.select("document", F.col("nth").alias("set_nth"), get("$.id", "bigint").alias("codeset"), get("$.name", "string").alias("name"), rest("expression", kind="OBJECT").alias("rest"), has("$.expression", "OBJECT").alias("has_expression"), has("$.expression.items").alias("has_items"), rest("items", of="$.expression").alias("inner_rest"))
    held = whole_sets.select("document", F.col("nth").alias("set_nth"), get("$.id", "bigint").alias("codeset"), "v")
    flag = lambda key: F.coalesce(get(f"$.{key}", "boolean"), F.lit(False))
    items = each(held, "$.expression.items", "document", "set_nth", "codeset").select(
        "document", "set_nth", "nth", "codeset", get("$.concept.CONCEPT_ID", "bigint").alias("concept_id"), flag("includeDescendants").alias("include_descendants"), flag("includeMapped").alias("include_mapped"), flag("isExcluded").alias("is_excluded"), F.col("text").alias("raw"),
    )
    entry = each(d, "$.PrimaryCriteria.CriteriaList", "document").withColumn("e", F.expr(f"get(filter(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> try_variant_get(e.value, '$', '{SHAPES['OBJECT']}') IS NOT NULL), 0)"))
    entries = entry.select("document", "nth", F.col("e.key").alias("domain"), F.expr("try_variant_get(e.value, '$.CodesetId', 'bigint')").alias("codeset"))
    whole_rules = each(d, "$.InclusionRules", "document").where(is_object())
    any_of = F.coalesce(get("$.expression.Type", "string") == "ANY", F.lit(False))
    rules = whole_rules.select("document", F.col("nth").alias("rule"), get("$.name", "string").alias("name"), any_of.alias("any_of"), rest("expression", kind="OBJECT").alias("rest"), has("$.expression", "OBJECT").alias("has_expression"))
    conjoined = F.coalesce(get("$.Type", "string"), F.lit("ALL")) == "ALL"
    # the expressions alone are taken out of the documents, once
    level = d.select("document", F.posexplode(get("$.InclusionRules", "array<struct<expression:variant>>")).alias("rule", "x")).select("document", "rule", F.col("x.expression").alias("v")).where(is_object())
    level = level.select("document", "rule", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("nth"), conjoined.alias("conjoined"), "v")
    groups, criteria, depth = [], [], 0
    while True:
        nodes = grown(level, f"groups-{depth}")
        groups.append(nodes.select("document", "rule", "path", "parent", F.lit(depth).alias("depth"), "nth", get("$.Type", "string").alias("kind"), "conjoined", rest("CriteriaList", "Groups").alias("rest"), has("$.CriteriaList").alias("has_criteria"), has("$.Groups").alias("has_groups")))
        criteria.append(each(nodes, "$.CriteriaList", "document", "rule", "path", "conjoined").select("document", "rule", "path", "nth", "conjoined", F.col("text").alias("raw"), "v"))
        if nodes.where(F.exists(F.coalesce(get("$.Groups", SHAPES["ARRAY"]), F.array()), lambda x: x.isNotNull())).isEmpty():
            break
        below = each(nodes, "$.Groups", "document", "rule", "path", "conjoined").where(is_object())
        path = F.concat(F.col("path"), F.lit("/"), F.lpad(F.col("nth").cast("string"), 4, "0"))
        level = below.select("document", "rule", path.alias("path"), F.col("path").alias("parent"), "nth", (F.col("conjoined") & conjoined).alias("conjoined"), "v")
        depth += 1
    every = criteria[0]
    for more in criteria[1:]:
        every = every.unionByName(more)
    nested = groups[0]
    for more in groups[1:]:
        nested = nested.unionByName(more)
    return Rows(heads, sets, items, entries, rules, nested, grown(with_types(every), "criteria"))


def listed(df: DataFrame, keys: list[str], nth: str, text: str, name: str) -> DataFrame:
    """keys, name: the texts of each key as one JSON list, in order."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(nth, text))).alias("x")).select(*keys, F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e[text]), ","), F.lit("]")).alias(name))


def obj(rest_text: Column, *parts: tuple[str, Column, Column]) -> Column:
    """An object of the rest's keys and of those parts (key, whether it has it, its value)."""
    inner = F.when(F.length(rest_text) > 2, F.substring(rest_text, F.lit(2), F.length(rest_text) - 2))
    pieces = [F.when(there, F.concat(F.lit(f'"{key}":'), value)) for key, there, value in parts]
    return F.concat(F.lit("{"), F.concat_ws(",", inner, *pieces), F.lit("}"))


def documents_of(rows: Rows) -> DataFrame:
    """document, expression: the documents as JSON text, put together from the deepest groups up. Lists that lost all their rows stay as empty lists."""
    none = F.lit("[]")
    groups = grown(rows.groups, "groups")
    lists = grown(listed(rows.criteria, ["document", "rule", "path"], "nth", "raw", "criteria"), "criteria-lists")
    deepest = groups.agg(F.max("depth")).head()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = groups.where(F.col("depth") == depth).join(lists, ["document", "rule", "path"], "left")
        here = here.withColumn("inner", F.lit(None).cast("string")) if below is None else here.join(below, ["document", "rule", "path"], "left")
        made = here.select("document", "rule", "path", "parent", "nth", obj(F.col("rest"), ("CriteriaList", F.col("has_criteria") | F.col("criteria").isNotNull(), F.coalesce("criteria", none)), ("Groups", F.col("has_groups") | F.col("inner").isNotNull(), F.coalesce("inner", none))).alias("text"))
        below = listed(made.withColumns({"path": F.col("parent")}), ["document", "rule", "path"], "nth", "text", "inner") if depth else made.select("document", "rule", F.col("text").alias("expression"))
    expressions = below if below is not None else rows.rules.select("document", "rule", F.lit("{}").alias("expression"))
    rules = rows.rules.join(expressions, ["document", "rule"], "left").select("document", "rule", obj(F.col("rest"), ("expression", F.col("has_expression"), F.coalesce("expression", F.lit("{}")))).alias("text"))
    items = listed(rows.items, ["document", "set_nth"], "nth", "raw", "items")
    sets = rows.sets.join(items, ["document", "set_nth"], "left")
    inner = obj(F.col("inner_rest"), ("items", F.col("has_items") | F.col("items").isNotNull(), F.coalesce("items", none)))
    sets = sets.select("document", "set_nth", obj(F.col("rest"), ("expression", F.col("has_expression"), inner)).alias("text"))
    whole = rows.heads.join(listed(sets, ["document"], "set_nth", "text", "sets"), "document", "left").join(listed(rules, ["document"], "rule", "text", "rules"), "document", "left")
    return whole.select("document", obj(F.col("rest"), ("ConceptSets", F.col("has_sets"), F.coalesce("sets", none)), ("InclusionRules", F.col("has_rules"), F.coalesce("rules", none))).alias("expression"))


def set_key(raw: Column, path: tuple[str, ...], value: Column) -> Column:
    """raw with the key at path set to the JSON text value; objects on the way are kept, other keys too."""
    return _changed(raw, path, value)


def drop_key(raw: Column, path: tuple[str, ...]) -> Column:
    """raw without the key at path."""
    return _changed(raw, path, None)


def _changed(raw: Column, path: tuple[str, ...], value: Column | None) -> Column:
    """raw is parsed once, however deep the path: what stands on the way is taken apart and put together as variants."""
    change = _members if value is None else lambda v, path, new=value: _members(v, path, F.try_parse_json(new))
    return F.get(F.transform(F.array(F.try_parse_json(raw)), lambda v: F.to_json(change(v, path))), F.lit(0))


def _members(v: Column, path: tuple[str, ...], value: Column | None = None) -> Column:
    """The members of an object, the key at path being value, or gone."""
    key, *deeper = path
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: k != key)
    if deeper:
        value = F.to_variant_object(_members(F.try_variant_get(v, f"$.{key}", "variant"), tuple(deeper), value))
    return others if value is None else F.map_concat(others, F.create_map(F.lit(key), value))
