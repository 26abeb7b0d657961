"""Queries on criteria held as rows: one for each check and repair, over all orders read as criteria of their customer's document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import query
from .operators import criteria, vocabulary
from .sources.cdm import BRAND, LEAF, Cdm

#: The test tables' orders as criteria: a customer is a document, five rules each; set, domain, window, bounds and flags are read off an order's columns.
CRIT = """crit AS (SELECT o_orderkey AS id, o_custkey AS document, o_orderkey % 5 AS rule, (o_orderkey // 5) % 2 = 0 AS any_of, CASE o_orderstatus WHEN 'P' THEN 'Drug' WHEN 'F' THEN 'Condition' ELSE 'Measurement' END AS domain,
  CAST(left(o_orderpriority, 1) AS BIGINT) AS codeset, (o_orderkey // 2) % 3 = 0 AS absent, -365 * CAST(1 + o_orderkey % 4 AS INTEGER) AS w_start, CAST((o_orderkey // 3) % 3 AS INTEGER) - 1 AS w_end,
  CASE WHEN (o_orderkey // 7) % 3 > 0 THEN CAST(floor(o_totalprice / 60000) AS DOUBLE) END AS low, CASE WHEN (o_orderkey // 11) % 2 > 0 THEN CAST(floor(o_totalprice / 60000) + o_orderkey % 4 AS DOUBLE) END AS high,
  CASE WHEN o_orderkey % 13 > 0 THEN CAST(8840 - 87 * (o_orderkey // 17 % 2) AS BIGINT) END AS unit, (o_orderkey // 4) % 2 = 0 AS says_or, o_orderkey % 6 = 0 AS relative FROM orders)"""


def rows(c: Cdm) -> DataFrame:
    k, over = F.col("o_orderkey"), lambda n: F.floor(F.col("o_orderkey") / n)
    price = F.floor(F.col("o_totalprice") / 60000)
    domain = F.when(F.col("o_orderstatus") == "P", "Drug").when(F.col("o_orderstatus") == "F", "Condition").otherwise("Measurement")
    return c.raw("orders").select(
        k.alias("id"), F.col("o_custkey").alias("document"), (k % 5).alias("rule"), (over(5) % 2 == 0).alias("any_of"), domain.alias("domain"), F.left("o_orderpriority", F.lit(1)).cast("long").alias("codeset"),
        (over(2) % 3 == 0).alias("absent"), (-365 * (1 + k % 4)).cast("int").alias("w_start"), ((over(3) % 3).cast("int") - 1).alias("w_end"),
        F.when(over(7) % 3 > 0, price.cast("double")).alias("low"), F.when(over(11) % 2 > 0, (price + k % 4).cast("double")).alias("high"),
        F.when(k % 13 > 0, (8840 - 87 * (over(17) % 2)).cast("long")).alias("unit"), (over(4) % 2 == 0).alias("says_or"), (k % 6 == 0).alias("relative"),
    )


def versions(c: Cdm) -> tuple[DataFrame, DataFrame]:
    """Two versions of each document: criteria of orders with even and odd numbers."""
    r = rows(c)
    return r.where("id % 2 = 0"), r.where("id % 2 = 1")


@query(f"WITH {CRIT} SELECT document, rule FROM crit GROUP BY ALL HAVING count(*) >= 2 AND bool_and(any_of AND absent)")
def lint_no_op_rules(c):
    return criteria.no_op_rules(rows(c))


@query(f"""WITH {CRIT}, entry AS (SELECT DISTINCT document, domain, codeset FROM crit WHERE rule = 0 AND NOT absent)
SELECT id, w_end, -1 AS new_end FROM crit SEMI JOIN entry USING (document, domain, codeset) WHERE absent AND w_start < 0 AND w_end >= 0""")
def lint_washout_on_entry(c):
    return criteria.washouts(rows(c), rows(c).where("rule = 0 AND NOT absent"))


@query(f"""WITH {CRIT} SELECT id FROM crit p WHERE NOT any_of AND NOT absent AND EXISTS (SELECT 1 FROM crit a WHERE NOT a.any_of AND a.absent AND a.low IS NULL AND a.high IS NULL
  AND a.document = p.document AND a.domain = p.domain AND a.codeset = p.codeset AND p.w_start <= a.w_end AND a.w_start <= p.w_end)""")
def lint_contradicted(c):
    return criteria.contradicted(rows(c))


SIGNATURE = "left(sha256(concat_ws('|', domain, codeset, coalesce(CAST(CAST(low AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(CAST(high AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(unit AS VARCHAR), '-'), w_start, w_end)), 16)"


@query(f"WITH {CRIT} SELECT document, {SIGNATURE} AS signature, count(CASE WHEN NOT absent THEN 1 END) AS n_present, count(CASE WHEN absent THEN 1 END) AS n_absent FROM crit WHERE NOT any_of GROUP BY ALL HAVING n_present > 0 AND n_absent > 0")
def lint_unsatisfiable(c):
    return criteria.unsatisfiable(rows(c))


BAND = "document, domain, codeset, absent, unit, w_start, w_end"
ISLANDS = f"""isl AS (SELECT *, sum(new) OVER (PARTITION BY {BAND} ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY {BAND} ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM bands))"""


@query(f"""WITH {CRIT}, b AS (SELECT *, 2 * coalesce(low, -1e12) AS lo, 2 * coalesce(high, 1e12) + 1 AS hi FROM crit WHERE domain = 'Measurement' AND NOT any_of),
f AS (SELECT p.id, p.lo AS p_lo, p.hi AS p_hi, a.lo, a.hi, a.unit FROM b p JOIN b a ON a.document = p.document AND a.codeset = p.codeset AND NOT p.absent AND a.absent AND a.w_start <= p.w_start AND a.w_end >= p.w_end AND (a.unit IS NULL OR p.unit IS NULL OR a.unit = p.unit)),
u AS (SELECT id, p_lo, p_hi, -1 AS u FROM f UNION SELECT id, p_lo, p_hi, coalesce(unit, -1) FROM f), points AS (SELECT id, u, p_lo AS x FROM u UNION SELECT u.id, u.u, f.hi FROM u JOIN f ON f.id = u.id AND (unit IS NULL OR unit = u.u) WHERE f.hi >= u.p_lo AND f.hi < u.p_hi)
SELECT DISTINCT id FROM u WHERE NOT EXISTS (SELECT 1 FROM points t WHERE t.id = u.id AND t.u = u.u AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = t.id AND (unit IS NULL OR unit = t.u) AND f.lo <= t.x AND t.x < f.hi))""")
def lint_covered_ranges(c):
    return criteria.covered(rows(c))


@query(f"""WITH {CRIT}, b AS (SELECT *, low IS NOT NULL OR high IS NOT NULL AS bounded, domain = 'Measurement' AS m FROM crit), f AS (SELECT id, NOT m AND bounded AS no_number, m AND absent AND NOT bounded AS bare_absence, m AND bounded AND unit IS NULL AS no_unit FROM b)
SELECT * FROM f WHERE no_number OR bare_absence OR no_unit""")
def lint_unreadable(c):
    return criteria.unreadable(rows(c))


@query("""WITH s AS (SELECT p_name, list_sort(list(DISTINCT p_type)) AS members FROM part GROUP BY 1) SELECT min(p_name) AS least_name, count(*) AS n_names, CAST(len(members) AS BIGINT) AS n_members FROM s GROUP BY members HAVING count(*) > 1""")
def lint_aliased_sets(c):
    return criteria.aliased(c.raw("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("member")))


@query(f"""WITH {CRIT}, a AS (SELECT document, rule, count(DISTINCT codeset) AS n_sets, bool_or(says_or) AS o FROM crit WHERE NOT any_of AND NOT absent GROUP BY document, rule, domain, w_start, w_end)
SELECT document, rule, max(n_sets) AS n_sets FROM a WHERE o AND n_sets >= 2 GROUP BY ALL""")
def lint_choice_as_list(c):
    return criteria.meant_as_choice(rows(c))


#: Domains of the five sets; compound ones fit more than one table.
DOMAINS = [(1, "Condition"), (2, "Condition/Measurement"), (3, "Measurement"), (4, "Drug/Condition"), (5, "Drug")]


@query(f"WITH {CRIT}, d(codeset, domain_id) AS (VALUES {', '.join(map(str, DOMAINS))}) SELECT id, crit.codeset FROM crit JOIN d ON d.codeset = crit.codeset WHERE NOT list_contains(string_split(domain_id, '/'), domain)")
def lint_wrong_domain(c):
    return criteria.wrong_domain(rows(c), c.spark.createDataFrame(DOMAINS, "codeset long, domain_id string"))


@query(f"""WITH {CRIT} SELECT id FROM crit a WHERE absent AND (low IS NULL) <> (high IS NULL) AND EXISTS (SELECT 1 FROM crit p WHERE NOT p.absent AND p.document = a.document AND p.rule = a.rule AND p.domain = a.domain AND p.codeset = a.codeset AND p.unit IS NOT DISTINCT FROM a.unit AND p.w_start = a.w_start AND p.w_end = a.w_end
  AND ((a.low IS NULL AND a.high <= p.low) OR (a.high IS NULL AND a.low >= p.high)))""")
def repair_restated_absences(c):
    return criteria.restated(rows(c))


@query(f"""WITH {CRIT}, one AS (SELECT * REPLACE (-365 AS w_start, 0 AS w_end) FROM crit), s AS (SELECT document, rule, codeset, unit, w_start, w_end, count(CASE WHEN NOT absent THEN 1 END) AS n, count(CASE WHEN absent THEN 1 END) AS m, min(CASE WHEN NOT absent THEN low END) AS low, min(CASE WHEN absent THEN low END) AS high
  FROM one WHERE domain = 'Measurement' AND low IS NOT NULL AND high IS NULL GROUP BY ALL) SELECT document, rule, codeset, unit, w_start, w_end, low, high FROM s WHERE n = 1 AND m = 1 AND low <= high""")
def repair_split_bands(c):
    """All in one window: the orders' own hardly ever agree."""
    return criteria.split_bands(rows(c).withColumns({"w_start": F.lit(-365), "w_end": F.lit(0)}))


@query(f"""WITH {CRIT}, bands AS (SELECT * FROM crit WHERE low IS NOT NULL AND high IS NOT NULL), {ISLANDS}
SELECT {BAND}, CAST(island AS BIGINT) AS island, min(low) AS low, max(high) AS high, count(*) AS n_bands, count(DISTINCT (low, high)) AS n_distinct FROM isl GROUP BY {BAND}, island HAVING n_distinct >= 2""")
def repair_alternative_bands(c):
    return criteria.alternative_bands(rows(c))


BOUNDS = "bnd AS (SELECT id, document, codeset, CASE WHEN high IS NULL THEN CASE WHEN absent THEN 'lt' ELSE 'gte' END ELSE CASE WHEN absent THEN 'gt' ELSE 'lte' END END AS op, coalesce(low, high) AS value FROM crit WHERE (low IS NULL) <> (high IS NULL))"


@query(f"WITH {CRIT}, {BOUNDS} SELECT id, op, value FROM bnd")
def stated_bounds(c):
    return criteria.stated_bounds(rows(c))


@query(f"""WITH {CRIT}, g AS (SELECT document, rule, arg_min(id, id) AS leader FROM crit WHERE low IS NOT NULL OR high IS NOT NULL GROUP BY ALL),
u AS (SELECT c.id, c.low, c.high, l.low AS gl, l.high AS gh, c.low IS NULL AND c.high IS NULL AND l.id IS NOT NULL AND (coalesce(l.relative, false) OR l.unit IS NOT DISTINCT FROM c.unit) AS inherited FROM crit c LEFT JOIN g USING (document, rule) LEFT JOIN crit l ON l.id = g.leader)
SELECT id, CASE WHEN inherited THEN gl ELSE low END AS low, CASE WHEN inherited THEN gh ELSE high END AS high, inherited FROM u""")
def inherited_bounds(c):
    return criteria.inherited(rows(c))


STATES = {"A": "emitted", "N": "dropped", "R": "skipped"}


@query("""WITH o AS (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem WHERE l_quantity > 3 GROUP BY 1), k AS (SELECT o_custkey AS document, count(*) AS stored, count(CASE WHEN f = 'A' THEN 1 END) AS emitted, count(CASE WHEN f = 'N' THEN 1 END) AS dropped, count(CASE WHEN f = 'R' THEN 1 END) AS skipped
FROM orders LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY 1) SELECT *, stored = emitted + dropped + skipped AS reconciled FROM k""")
def audit_reconciled(c):
    states = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    outcomes = c.raw("lineitem").where("l_quantity > 3").groupBy(F.col("l_orderkey").alias("id")).agg(states[F.min("l_returnflag")].alias("state"))
    return criteria.reconciled(c.raw("orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("id")), outcomes, tuple(STATES.values()))


@query(f"""WITH {CRIT}, {BOUNDS}, l AS (SELECT document, codeset, arg_min(op, id) AS a, arg_min(value, id) AS x FROM bnd WHERE id % 2 = 0 GROUP BY ALL), r AS (SELECT document, codeset, arg_min(op, id) AS b, arg_min(value, id) AS y FROM bnd WHERE id % 2 = 1 GROUP BY ALL)
SELECT document, codeset, CASE WHEN a IS NULL OR b IS NULL THEN 'one_sided' WHEN a = b AND x = y THEN 'exact' WHEN a = b THEN 'value' WHEN (a IN ('gt', 'gte')) <> (b IN ('gt', 'gte')) AND x = y THEN 'polarity' WHEN x = y THEN 'operator' ELSE 'both' END AS agreement FROM l FULL JOIN r USING (document, codeset)""")
def bound_agreement(c):
    def first(r: DataFrame) -> DataFrame:
        said = criteria.stated_bounds(r).join(r.select("id", "document", "codeset"), "id")
        return said.groupBy("document", "codeset").agg(F.min_by("op", "id").alias("op"), F.min_by("value", "id").alias("value"))

    left, right = versions(c)
    return criteria.bound_agreement(first(left), first(right))


@query("""WITH m AS (SELECT o_custkey AS document, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 1e6 AS a, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) / 1e6 AS b, least(count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END), count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END)) AS draws FROM orders GROUP BY 1)
SELECT document, draws, CASE WHEN abs(a - b) >= 0.02 THEN CASE WHEN a > b THEN 'improved' ELSE 'regressed' END WHEN draws >= 6 THEN 'below floor' ELSE 'unresolved' END AS verdict FROM m""")
def delta_verdicts(c):
    even = F.col("o_orderkey") % 2 == 0
    price = F.col("o_totalprice")
    m = c.raw("orders").groupBy(F.col("o_custkey").alias("document")).agg((F.avg(F.when(even, price)) / 1e6).alias("a"), (F.avg(F.when(~even, price)) / 1e6).alias("b"), F.least(F.count_if(even), F.count_if(~even)).alias("draws"))
    return m.select("document", "draws", criteria.verdict(F.col("a") - F.col("b"), F.col("draws")).alias("verdict"))


@query(f"""WITH {CRIT}, l AS (SELECT DISTINCT document, domain, codeset FROM crit WHERE id % 2 = 0), r AS (SELECT DISTINCT document, domain, codeset FROM crit WHERE id % 2 = 1),
s AS (SELECT domain, CASE WHEN l.document IS NULL THEN 'only_right' WHEN r.document IS NULL THEN 'only_left' ELSE 'shared' END AS side FROM l FULL JOIN r USING (document, domain, codeset)) SELECT domain, side, count(*) AS n FROM s GROUP BY ALL""")
def version_difference(c):
    left, right = versions(c)
    return criteria.set_difference(left, right, list(criteria.SET)).groupBy("domain", "side").agg(F.count("*").alias("n"))


@query(f"WITH {CRIT} SELECT id FROM crit WHERE NOT absent AND unit IS NOT NULL AND codeset IN (2, 3)")
def repair_presence_units(c):
    return criteria.without_unit(rows(c), [2, 3])


# ---- a site's evidence -----------------------------------------------------------------------------

#: Criteria's concepts: drugs by the order's number, some of which no table has, and every fourth a brand.
SITE = f"""site AS (SELECT *, rule = 0 AS is_entry, CASE WHEN id % 4 = 0 THEN {BRAND} + id % 60 ELSE {LEAF} + id % 3000 END AS concept_id FROM crit),
known AS (SELECT concept_id FROM drug_exposure GROUP BY 1 HAVING count(DISTINCT person_id) > 25), below AS (SELECT DISTINCT ancestor_concept_id AS concept_id FROM concept_ancestor JOIN known ON known.concept_id = descendant_concept_id WHERE ancestor_concept_id <> descendant_concept_id),
proposed AS (SELECT id, document, rule, is_entry, CASE WHEN concept_id IN (SELECT * FROM known) THEN 'KEEP' WHEN concept_id IN (SELECT * FROM below) THEN 'REPOINT' WHEN is_entry THEN 'REMAP' WHEN absent THEN 'BENIGN_KEEP' ELSE 'DROP' END AS action FROM site)"""


def proposed(c: Cdm) -> DataFrame:
    concept = F.when(F.col("id") % 4 == 0, BRAND + F.col("id") % 60).otherwise(LEAF + F.col("id") % 3000)
    known = c.drug_exposure.groupBy("concept_id").agg(F.countDistinct("person_id").alias("n")).where("n > 25")
    return criteria.proposals(rows(c).withColumns({"is_entry": F.col("rule") == 0, "concept_id": concept}), known, c.concept_ancestor)


@query(f"WITH {CRIT}, {SITE} SELECT * FROM proposed")
def site_proposals(c):
    return proposed(c)


@query(f"""WITH {CRIT}, {SITE}, r AS (SELECT document, rule, bool_and(action = 'DROP') AS gone FROM proposed WHERE NOT is_entry GROUP BY ALL), n AS (SELECT document, count(*) AS n_rules, count(CASE WHEN gone THEN 1 END) AS n_dropped FROM r GROUP BY 1)
SELECT *, n_dropped > 0.4 * n_rules AS aborted, CASE WHEN n_dropped > 0.4 * n_rules THEN n_rules ELSE n_rules - n_dropped END AS n_left FROM n""")
def site_applied(c):
    return criteria.applied(proposed(c))


@query("""WITH s AS (SELECT concept_id FROM concept WHERE standard_concept = 'S' AND invalid_reason IS NULL) SELECT DISTINCT concept_id_1, concept_id_2, relationship_id FROM concept_relationship WHERE relationship_id IN ('Is a', 'Maps to') AND concept_id_1 <> concept_id_2
AND concept_id_1 IN (SELECT * FROM s) AND concept_id_2 IN (SELECT * FROM s)""")
def graph_edges(c):
    """Edges of the concept graph: both ends standard and valid, none to itself."""
    return vocabulary.edges(c.concept, c.concept_relationship)
