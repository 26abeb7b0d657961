"""Queries from the JSON text of cohort documents to findings and repaired documents; the SQL starts from the same orders and customers and never sees JSON."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import query
from .operators import document_checks as checks
from .operators import site_documents
from .plans import rows as plan_rows
from .plans.rows import Rows, documents_of, rows_of
from .sources.cdm import BRAND, LEAF, Cdm, choice
from .staging import grown, partitions

#: Orders as criteria: a customer's orders are its document, dealt to four rules and four places in each. Sets 1 to 6 hold three pairs of the same concepts, 7 is the entry's.
CRIT = """crit AS (SELECT *, t0 = 'ALL' AND (spot IN (0, 3) OR t1 = 'ALL') AS conjoined, NOT absent AS required, (codeset - 1) % 3 AS members, op IS NULL AND units IS NULL AS bare FROM (SELECT o_orderkey AS id, o_custkey AS document, 'r' || o_orderkey % 4 AS rule, (o_orderkey // 4) % 4 AS spot,
  CASE WHEN (o_custkey + o_orderkey % 4) % 3 = 0 THEN 'ANY' ELSE 'ALL' END AS t0, CASE WHEN (o_custkey + o_orderkey % 4) % 5 = 0 THEN 'ANY' ELSE 'ALL' END AS t1, CASE WHEN o_orderstatus = 'F' THEN 'ConditionOccurrence' ELSE 'Measurement' END AS domain,
  1 + o_orderkey % 6 AS codeset, (o_orderkey // 2) % 3 = 0 AS absent, CASE WHEN o_orderkey % 17 > 0 THEN -180 * (1 + (o_orderkey // 3) % 2) END AS w_start, CASE WHEN o_orderkey % 17 > 0 THEN (o_orderkey // 5) % 3 - 1 END AS w_end,
  CASE WHEN o_orderstatus <> 'F' THEN ['gte', 'gt', 'lte', 'lt', 'bt', '!bt'][(o_orderkey // 7) % 7] END AS op, floor(o_totalprice / 60000) AS value, floor(o_totalprice / 60000) + (o_orderkey // 11) % 3 AS extent,
  CASE WHEN o_orderstatus <> 'F' THEN [[8554], [8554, 8753]][(o_orderkey // 13) % 3] END AS units FROM orders))"""
#: Ends as whole numbers: twice the value, one more just above it; whole values only.
PIECES = """piece AS (SELECT id, unnest(CASE WHEN op IS NULL THEN [[-2000000, 2000000]] WHEN op = 'gte' THEN [[2 * value, 2000000]] WHEN op = 'gt' THEN [[2 * value + 1, 2000000]] WHEN op = 'lte' THEN [[-2000000, 2 * value + 1]] WHEN op = 'lt' THEN [[-2000000, 2 * value]]
  WHEN op = 'bt' THEN [[2 * value, 2 * extent + 1]] ELSE [[-2000000, 2 * value], [2 * extent + 1, 2000000]] END) AS p FROM crit)"""
SETS = {n: [100 * ((n - 1) % 3 + 1) + 1, 100 * ((n - 1) % 3 + 1) + 2] for n in range(1, 7)} | {7: [101]}


def text_of(**parts: Column | str) -> Column:
    """A JSON object of columns that hold JSON text; null ones are left out."""
    pieces = [F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), c)) for k, c in ((k, F.lit(c) if isinstance(c, str) else c) for k, c in parts.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def joined(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def set_text(number: int, ids: list[int], below: bool = False) -> str:
    items = ",".join(f'{{"concept":{{"CONCEPT_ID":{i},"CONCEPT_NAME":"c{i}"}},"includeDescendants":{str(below).lower()}}}' for i in ids)
    return f'{{"id":{number},"name":"set {number}","expression":{{"items":[{items}]}}}}'


def documents(c: Cdm) -> DataFrame:
    """document, expression: all orders as the criteria of their customer's document."""
    k, over = F.col("o_orderkey"), lambda n: F.floor(F.col("o_orderkey") / n)
    value = F.floor(F.col("o_totalprice") / 60000)
    measured = F.col("o_orderstatus") != "F"
    op = F.when(measured, choice(over(7) % 7, dict(enumerate(("gte", "gt", "lte", "lt", "bt", "!bt"), 1))))
    units = F.when(measured, choice(over(13) % 3, {1: '[{"CONCEPT_ID":8554}]', 2: '[{"CONCEPT_ID":8753},{"CONCEPT_ID":8554}]'}))
    extent = F.when(op.isin("bt", "!bt"), (value + over(11) % 3).cast("string"))
    body = text_of(CodesetId=(1 + k % 6).cast("string"), ValueAsNumber=F.when(op.isNotNull(), text_of(Op=quoted(op), Value=value.cast("string"), Extent=extent)), Unit=units)
    edge = lambda d: text_of(Days=F.abs(d).cast("string"), Coeff=F.when(d < 0, "-1").otherwise("1"))
    window = F.when(k % 17 > 0, text_of(Start=edge(-180 * (1 + over(3) % 2)), End=edge(over(5) % 3 - 1)))
    occurrence = F.when(over(2) % 3 == 0, '{"Type":0,"Count":0}').otherwise('{"Type":2,"Count":1}')
    criteria = F.when(measured, text_of(Measurement=body)).otherwise(text_of(ConditionOccurrence=body))
    # an order moves once, before it is text; the partitions are not made fewer, as the text is much larger than the orders
    orders = c.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").repartition(partitions(c.spark), "o_custkey")
    entry = orders.select(F.col("o_custkey").alias("document"), (k % 4).alias("rule"), (over(4) % 4).alias("spot"), k.alias("id"), text_of(Id=k.cast("string"), Criteria=criteria, StartWindow=window, Occurrence=occurrence).alias("text"))
    at = lambda n: joined(F.transform(F.array_sort(F.collect_list(F.when(F.col("spot") == n, F.struct("id", "text")))), lambda x: x["text"]))
    lists = entry.groupBy("document", "rule").agg(*(at(n).alias(f"at{n}") for n in range(4)))
    kind = lambda n: F.when((F.col("document") + F.col("rule")) % n == 0, '"ANY"').otherwise('"ALL"')
    inner = text_of(Type='"ALL"', CriteriaList=F.col("at2"), Groups="[]")
    first = text_of(Type=kind(5), CriteriaList=F.col("at1"), Groups=joined(F.array(inner)))
    second = text_of(Type='"ALL"', CriteriaList=F.col("at3"))
    rule = text_of(name=quoted(F.concat(F.lit("r"), "rule")), expression=text_of(Type=kind(3), CriteriaList=F.col("at0"), Groups=joined(F.array(first, second))))
    whole = lists.select("document", "rule", rule.alias("text")).groupBy("document").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("rule", "text"))), lambda x: x["text"])).alias("rules"))
    sets = "[" + ",".join(set_text(n, ids) for n, ids in SETS.items()) + "]"
    primary = '{"CriteriaList":[{"ConditionOccurrence":{"CodesetId":7}}],"ObservationWindow":{"PriorDays":180,"PostDays":0}}'
    return whole.select("document", text_of(ConceptSets=sets, PrimaryCriteria=primary, InclusionRules=F.col("rules"), Note='"as written"').alias("expression"))


def opened(c: Cdm) -> Rows:
    return rows_of(documents(c))


def numbered(r: Rows, found: DataFrame) -> DataFrame:
    """found with the id that the criterion's text carries."""
    return r.criteria.join(found, list(plan_rows.PLACE), "left_semi").select("document", F.get_json_object("raw", "$.Id").cast("long").alias("id"))


@query("SELECT DISTINCT o_custkey AS document, true AS same FROM orders")
def document_round_trip(c):
    """Every document opened to rows and put together again says the same."""
    docs = documents(c)
    said = lambda df, name: df.select("document", F.to_json(F.parse_json("expression")).alias(name))
    return said(docs, "before").join(said(documents_of(rows_of(docs)), "after"), "document", "left").select("document", F.col("before").eqNullSafe(F.col("after")).alias("same"))


@query(f"WITH {CRIT} SELECT document, id, rule, domain, codeset, conjoined, absent, CAST(w_start AS DOUBLE) AS w_start, CAST(w_end AS DOUBLE) AS w_end, op, CASE WHEN op IS NOT NULL THEN CAST(value AS DOUBLE) END AS value, CASE WHEN op IN ('bt', '!bt') THEN CAST(extent AS DOUBLE) END AS extent, coalesce(len(units), 0) AS n_units, bare FROM crit")
def document_criteria(c):
    """The criteria of all documents as rows."""
    r = opened(c)
    named = r.criteria.join(r.rules.select("document", "rule", "name"), ["document", "rule"])
    return named.select("document", F.get_json_object("raw", "$.Id").cast("long").alias("id"), F.col("name").alias("rule"), "domain", "codeset", "conjoined", "absent", "w_start", "w_end", "op", "value", "extent", F.size("units").cast("long").alias("n_units"), "bare")


@query(f"WITH {CRIT} SELECT document, rule AS name FROM crit WHERE t0 = 'ANY' AND spot > 0 GROUP BY ALL HAVING bool_and(absent)")
def document_no_op_rules(c):
    r = opened(c)
    return checks.no_op_rules(r).select("document", "name")


@query(f"WITH {CRIT} SELECT document, id FROM crit WHERE conjoined AND absent AND members = 0 AND (w_end IS NULL OR w_end >= 0)")
def document_washouts(c):
    r = opened(c)
    return numbered(r, checks.washouts(r))


@query(f"""WITH {CRIT} SELECT document, id FROM crit p WHERE conjoined AND required AND EXISTS (SELECT 1 FROM crit a WHERE a.document = p.document AND a.conjoined AND a.absent AND a.bare AND a.members = p.members
  AND (a.w_start IS NULL OR p.w_start IS NULL OR (a.w_start <= p.w_end AND p.w_start <= a.w_end)))""")
def document_contradicted(c):
    r = opened(c)
    return numbered(r, checks.contradicted(r))


@query(f"""WITH {CRIT}, s AS (SELECT *, concat_ws('|', members, domain, coalesce(op, '-'), CASE WHEN op IS NOT NULL THEN value END, CASE WHEN op IN ('bt', '!bt') THEN extent END, coalesce(len(units), 0), coalesce(w_start, 0), coalesce(w_end, 0)) AS sig FROM crit),
f AS (SELECT DISTINCT document, sig FROM s WHERE conjoined AND absent) SELECT document, rule AS name, count(*) AS n_required FROM s LEFT JOIN f USING (document, sig) WHERE required GROUP BY document, rule HAVING count(*) = count(CASE WHEN (document, sig) IN (SELECT (document, sig) FROM f) THEN 1 END)""")
def document_unsatisfiable_rules(c):
    r = opened(c)
    return checks.unsatisfiable_rules(r).join(r.rules.select("document", "rule", "name"), ["document", "rule"]).select("document", "name", "n_required")


@query(f"""WITH {CRIT}, {PIECES}, must AS (SELECT * FROM crit WHERE conjoined AND required),
no AS (SELECT a.*, p[1] AS lo, p[2] AS hi FROM crit a JOIN piece USING (id) WHERE conjoined AND absent AND p[1] < p[2]),
fit AS (SELECT m.id, n.lo, n.hi, n.units AS a_units, m.units AS p_units FROM must m JOIN no n ON n.document = m.document AND n.members = m.members AND n.domain = m.domain
  AND ((m.w_start IS NULL AND n.w_start IS NULL) OR (n.w_start <= m.w_start AND n.w_end >= m.w_end)) AND (m.units IS NULL OR n.units IS NULL OR list_has_any(m.units, n.units))),
u AS (SELECT id, unit FROM (SELECT id, -1 AS unit FROM fit UNION SELECT id, unnest(CASE WHEN p_units IS NULL THEN a_units ELSE list_intersect(a_units, p_units) END) AS unit FROM fit)),
cut AS (SELECT DISTINCT u.id, u.unit, lo, hi FROM u JOIN fit ON fit.id = u.id AND (a_units IS NULL OR list_contains(a_units, u.unit))),
ask AS (SELECT u.id, u.unit, p[1] AS lo, p[2] AS hi FROM u JOIN piece ON piece.id = u.id WHERE p[1] < p[2]),
points AS (SELECT id, unit, lo AS x FROM ask UNION SELECT ask.id, ask.unit, cut.hi FROM ask JOIN cut ON cut.id = ask.id AND cut.unit = ask.unit WHERE cut.hi >= ask.lo AND cut.hi < ask.hi),
bare AS (SELECT DISTINCT id, unit FROM points WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.id = points.id AND cut.unit = points.unit AND cut.lo <= x AND x < cut.hi))
SELECT DISTINCT document, u.id FROM u JOIN must ON must.id = u.id WHERE NOT EXISTS (SELECT 1 FROM bare WHERE bare.id = u.id AND bare.unit = u.unit)""")
def document_covered_ranges(c):
    r = opened(c)
    return numbered(r, checks.covered(r))


@query(f"WITH {CRIT} SELECT document, id, CASE WHEN conjoined AND absent AND members = 0 AND w_end = 0 THEN -1 ELSE w_end END AS w_end FROM crit WHERE w_end IS NOT NULL")
def document_washouts_moved(c):
    """From JSON text to repaired JSON text, read once more: where criteria end after washouts were moved off the index day."""
    again = rows_of(documents_of(checks.washouts_before_index(opened(c))))
    return again.criteria.where("w_end IS NOT NULL").select("document", F.get_json_object("raw", "$.Id").cast("long").alias("id"), F.col("w_end").cast("long").alias("w_end"))


# ---- documents with the shapes that repairs look for -----------------------------------------------

#: Of each customer: bounds a and b, whether they are strict, under two subjects, over two sets (1 and 2 are one brand, 3 another), with a restating rule of the same or wider bounds, named with sides or not.
SHAPES = """shape AS (SELECT c_custkey AS document, 4 + c_custkey % 5 AS a, 4 + c_custkey % 5 + (c_custkey // 5) % 4 AS b, c_custkey % 7 = 0 AS strict, c_custkey % 11 = 0 AS two_subjects, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS high_set,
  (c_custkey // 2) % 3 AS restating, c_custkey % 13 = 0 AS unsided, c_custkey % 4 AS excepting FROM customer),
merged AS (SELECT *, NOT strict AND NOT two_subjects AND high_set = 2 AND a < b AS one FROM shape)"""


def shaped(c: Cdm) -> DataFrame:
    """document, expression: a rule of two bounds, one that may restate it, and one that forbids a class of drugs but for some."""
    k = F.col("c_custkey")
    a, b = 4 + k % 5, 4 + k % 5 + F.floor(k / 5) % 4
    window, yes, no = '{"Start":{"Days":180,"Coeff":-1},"End":{"Days":0,"Coeff":1}}', '{"Type":2,"Count":1}', '{"Type":0,"Count":0}'
    measure = lambda number, op, v, how: text_of(Criteria=text_of(Measurement=text_of(CodesetId=number, ValueAsNumber=text_of(Op=quoted(op), Value=v.cast("string")), Unit='[{"CONCEPT_ID":8554}]')), StartWindow=window, Occurrence=how)
    group = lambda entry: text_of(Type='"ALL"', CriteriaList=joined(F.array(entry)), Groups="[]")
    low_op, high_set = F.when(k % 7 == 0, "gt").otherwise("gte"), F.when(k % 3 == 0, "3").otherwise("2")
    low, high = measure(F.lit("1"), low_op, a, yes), measure(high_set, F.lit("lte"), b, yes)
    name = F.concat(F.lit('"HbA1c at least '), a, F.lit("% + "), F.when(k % 11 == 0, "Glucose").otherwise("HbA1c"), F.lit(" at most "), b, F.lit('%"'))
    split = text_of(name=name, expression=text_of(Type='"ANY"', CriteriaList="[]", Groups=joined(F.array(group(low), group(high)))))
    wider = F.when(F.floor(k / 2) % 3 == 1, 0).otherwise(1)
    forbidden = [measure(F.lit("1"), F.lit("gte"), a - wider, no), measure(F.lit("2"), F.lit("lte"), b + wider, no)]
    sided = F.when(k % 13 == 0, '"HbA1c out of range + HbA1c out of range"').otherwise('"HbA1c below lower limit + HbA1c above upper limit"')
    restating = F.when(F.floor(k / 2) % 3 > 0, text_of(name=sided, expression=text_of(Type='"ALL"', CriteriaList=joined(F.array(*forbidden)), Groups="[]")))
    # 0: the class without a stated exception, 1: with it, 2: only another brand with it, 3: with it but ending before the index day
    number = F.when(k % 4 == 2, "5").otherwise("6")
    ending = F.when(k % 4 == 3, '{"Start":{"Days":180,"Coeff":-1},"End":{"Days":1,"Coeff":-1}}').otherwise(window)
    said = F.when(k % 4 == 0, '"any drug"').otherwise('"any drug (excluding brand one)"')
    excepting = text_of(name=said, expression=text_of(Type='"ALL"', CriteriaList=joined(F.array(text_of(Criteria=text_of(DrugExposure=text_of(CodesetId=number)), StartWindow=ending, Occurrence=no))), Groups="[]"))
    rules = joined(F.array_compact(F.array(split, restating, excepting)))
    from .sources.cdm import ROOT

    sets = {1: [BRAND + 1], 2: [BRAND + 1], 3: [BRAND + 2], 4: [BRAND + 1], 5: [BRAND + 2], 6: [ROOT]}
    written = "[" + ",".join(set_text(n, ids, True) for n, ids in sets.items()) + "]"
    return c.raw("customer").select(k.alias("document"), text_of(ConceptSets=written, PrimaryCriteria='{"CriteriaList":[{"DrugExposure":{"CodesetId":4}}]}', InclusionRules=rules).alias("expression"))




def resolved(c: Cdm, r: Rows) -> checks.Closures:
    return checks.set_closures(r, c.concept_ancestor, c.concept_relationship, c.concept)


@query(f"WITH {SHAPES} SELECT document, CAST(a AS DOUBLE) AS low, CAST(b AS DOUBLE) AS high FROM merged WHERE one")
def document_ranges_joined(c):
    """From JSON text to repaired JSON text, read once more: the closed ranges that two bounds became."""
    r = rows_of(shaped(c))
    again = rows_of(documents_of(checks.ranges_joined(r, grown(checks.closure_keys(resolved(c, r)), "closure-keys"))))
    return again.criteria.where("op = 'bt' AND conjoined AND required AND path = ''").select("document", F.col("value").alias("low"), F.col("extent").alias("high"))


@query(f"WITH {SHAPES} SELECT document, 2 + CAST(restating > 0 AS INTEGER) - CAST(one AND restating = 1 AND NOT unsided AS INTEGER) AS n_rules FROM merged")
def document_restated_removed(c):
    """The number of rules after split ranges are joined and the absences that restate them are removed."""
    r = rows_of(shaped(c))
    keys = grown(checks.closure_keys(resolved(c, r)), "closure-keys")
    left = checks.restated_absences_removed(checks.ranges_joined(r, keys), keys)
    return rows_of(documents_of(left)).rules.groupBy("document").agg(F.count("*").cast("int").alias("n_rules"))


@query(f"WITH {SHAPES} SELECT document, {BRAND} + 1 AS concept_id FROM shape WHERE excepting = 1")
def document_exclusions_mirrored(c):
    """The entry's concepts that a set forbidding the whole entry excludes after the repair, where its rule's name states the exception."""
    r = rows_of(shaped(c))
    again = rows_of(documents_of(checks.entry_exclusions_mirrored(r, resolved(c, r))))
    return again.items.where("is_excluded").select("document", "concept_id")


#: An analyte's concepts, its stated unit, and the raw values that it has in other units.
ALLOWED = [("a1c", BRAND + 1, 8554, 15.0, 200.0)]


@query(f"""WITH {SHAPES}, m AS (SELECT document, CASE WHEN strict THEN 'gt' ELSE 'gte' END AS op, a AS v, true AS listed FROM shape UNION ALL SELECT document, 'lte', b, high_set = 2 FROM shape)
SELECT document, count(*) AS n_with_unit FROM (SELECT document FROM m WHERE NOT (op = 'lte' AND listed) UNION ALL SELECT document FROM shape WHERE restating > 0 UNION ALL SELECT document FROM shape WHERE restating > 0) GROUP BY 1""")
def document_units_dropped(c):
    """How many criteria still name a unit after the presences of an allow-listed analyte lost theirs where no value of another unit could pass the bound."""
    r = rows_of(shaped(c))
    allowed = c.spark.createDataFrame(ALLOWED, "analyte string, concept_id long, unit_id long, other_low double, other_high double")
    again = rows_of(documents_of(checks.units_dropped(r, allowed)))
    return again.criteria.where("size(units) > 0").groupBy("document").agg(F.count("*").alias("n_with_unit"))


# ---- documents at a site ---------------------------------------------------------------------------

#: Of each customer four rules over a set each: three drugs by number, of which the site knows a third, one of them a brand; every fourth rule forbids. Some drugs have a replacement.
AT_SITE = f"""item AS (SELECT c_custkey AS document, r, j, CASE WHEN r = 3 AND j = 0 THEN {BRAND} + 1 + c_custkey % 25 ELSE {LEAF} + (c_custkey * 7 + r * 31 + j * 13) % 400 END AS concept_id, (c_custkey + r) % 4 = 0 AS absent FROM customer, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(3)) AS j)),
pop AS (SELECT DISTINCT concept_id FROM drug_exposure WHERE concept_id % 3 = 0), below AS (SELECT DISTINCT ancestor_concept_id AS concept_id FROM concept_ancestor JOIN pop ON pop.concept_id = descendant_concept_id WHERE ancestor_concept_id <> descendant_concept_id),
act AS (SELECT *, {LEAF} + concept_id % 7 AS new_id, CASE WHEN absent OR concept_id IN (SELECT * FROM pop) THEN 'KEEP' WHEN concept_id IN (SELECT * FROM below) THEN 'WIDEN' WHEN concept_id % 5 = 0 AND {LEAF} + concept_id % 7 <> concept_id THEN 'REPLACE' ELSE 'PRUNE' END AS action FROM item),
st AS (SELECT document, r, bool_and(action = 'PRUNE') AS gone FROM act GROUP BY ALL), rp AS (SELECT document, count(*) AS n_rules, count(CASE WHEN gone THEN 1 END) AS n_dropped, count(CASE WHEN gone THEN 1 END) > 0.4 * count(*) AS aborted FROM st GROUP BY 1)"""


def at_site(c: Cdm) -> tuple[Rows, DataFrame]:
    k = F.col("c_custkey")
    leaf = lambda r, j: F.lit(LEAF) + (k * 7 + r * 31 + j * 13) % 400
    item = lambda i: text_of(concept=text_of(CONCEPT_ID=i.cast("string")))
    members = lambda r: F.array(*(item(F.lit(BRAND + 1) + k % 25 if (r, j) == (3, 0) else leaf(r, j)) for j in range(3)))
    written = joined(F.array(*(text_of(id=str(r + 1), name=f'"set {r}"', expression=text_of(items=joined(members(r)))) for r in range(4))))
    how = lambda r: F.when((k + r) % 4 == 0, '{"Type":0,"Count":0}').otherwise('{"Type":2,"Count":1}')
    rule = lambda r: text_of(name=f'"r{r}"', expression=text_of(Type='"ALL"', CriteriaList=joined(F.array(text_of(Criteria=f'{{"DrugExposure":{{"CodesetId":{r + 1}}}}}', Occurrence=how(r))))))
    docs = c.raw("customer").select(k.alias("document"), text_of(ConceptSets=written, InclusionRules=joined(F.array(*map(rule, range(4))))).alias("expression"))
    known = c.drug_exposure.where("concept_id % 3 = 0").select("concept_id").distinct()
    other = c.spark.range(400).select((F.lit(LEAF) + F.col("id")).alias("concept_id")).where("concept_id % 5 = 0").select("concept_id", (F.lit(LEAF) + F.col("concept_id") % 7).alias("new_id"), F.lit("another").alias("new_name"))
    return site_documents.fitted(rows_of(docs), known, c.concept_ancestor, other)


@query(f"""WITH {AT_SITE} SELECT document, 'r' || r AS rule, CASE WHEN action = 'REPLACE' AND NOT aborted THEN new_id ELSE concept_id END AS concept_id, action IN ('WIDEN', 'REPLACE') AND NOT aborted AS include_descendants
FROM act JOIN st USING (document, r) JOIN rp USING (document) WHERE aborted OR (NOT gone AND action <> 'PRUNE')""")
def site_fitted_documents(c):
    """From JSON text to documents fitted to a site, read once more: the concepts of each rule that is left."""
    r, _ = at_site(c)
    again = rows_of(documents_of(r))
    named = again.rules.select("document", "rule", "name").join(again.criteria.select("document", "rule", "codeset"), ["document", "rule"])
    return named.join(again.items, ["document", "codeset"]).select("document", F.col("name").alias("rule"), "concept_id", "include_descendants")


@query(f"WITH {AT_SITE} SELECT * FROM rp")
def site_report(c):
    """How many rules a site would cost each document, and whether that is too many."""
    return at_site(c)[1]
