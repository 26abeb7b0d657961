"""Queries on dictionaries of names, expansions of seeds, an index of vectors, criteria that restate others, and concordance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import ARMS, ORACLE_SQL, follow_up, nearest_of_all, query, r6, scored, vectors
from .operators import expansion, index, restatement, survival, synonyms
from .sources.cdm import LEAF, ROOT, Cdm
from .sources.dictionary import Dictionary

# ---- a dictionary over the parts' names -----------------------------------------------------------

#: Parts as names of 97 concepts, kinds of parts as names of substances under three classes, queries of every kind: whole names, parts of names, short ones, unknown ones.
DICTIONARY = """names AS (SELECT 'C' || lpad(CAST(p_partkey % 97 AS VARCHAR), 3, '0') AS cui, p_name || ' ' || lower(p_type) || ' ' || p_partkey % 11 AS str, ['SNOMEDCT_US', 'RXNORM', 'ZZZ'][1 + p_partkey % 3] AS sab, ['IN', 'SY', 'BN'][1 + (p_partkey // 3) % 3] AS tty,
  CASE WHEN p_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS ispref, CASE WHEN p_partkey % 5 = 0 THEN 'P' ELSE 'S' END AS ts FROM part),
types AS (SELECT DISTINCT cui, unnest([['Clinical Drug'], ['Finding'], ['Antibiotic', 'Injury or Poisoning'], ['Geographic Area']][1 + CAST(right(cui, 3) AS INTEGER) % 4]) AS sty FROM names),
queries AS (SELECT p_partkey AS query_id, CASE (p_partkey // 50) % 4 WHEN 0 THEN upper(p_name || ' ' || p_type || ' ' || p_partkey % 11) WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN left(p_name, 3) ELSE 'x' || p_name END AS text, ['Drug', 'Condition', NULL][1 + (p_partkey // 50) % 3] AS domain FROM part WHERE p_partkey % 50 = 0),
fit AS (SELECT DISTINCT cui, CASE WHEN sty IN ('Clinical Drug', 'Antibiotic') THEN 'Drug' ELSE 'Condition' END AS domain FROM types WHERE sty <> 'Geographic Area'),
exact AS (SELECT DISTINCT query_id, cui, true AS exact FROM queries JOIN names ON lower(str) = lower(text)),
inside AS (SELECT query_id, cui, false AS exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cui) AS r FROM (SELECT DISTINCT query_id, cui FROM queries JOIN names ON contains(lower(str), lower(text)) WHERE query_id NOT IN (SELECT query_id FROM exact))) WHERE r <= 10),
found AS (SELECT f.*, text, q.domain, f2.cui IS NOT NULL AS fits, bool_or(f2.cui IS NOT NULL) OVER (PARTITION BY query_id) AS any_fit FROM (SELECT * FROM exact UNION ALL SELECT * FROM inside) f JOIN queries q USING (query_id) LEFT JOIN fit f2 ON f2.cui = f.cui AND f2.domain = q.domain),
concepts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cui) AS nth, cui FROM found WHERE domain IS NULL OR fits OR (NOT any_fit AND exact AND length(text) > 5))"""


def dictionary(c: Cdm) -> Dictionary:
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    part = c.raw("part")
    names = part.select(
        F.concat(F.lit("C"), F.lpad((k % 97).cast("string"), 3, "0")).alias("cui"), F.concat_ws(" ", "p_name", F.lower("p_type"), (k % 11).cast("string")).alias("str"), pick(k, "SNOMEDCT_US", "RXNORM", "ZZZ").alias("sab"),
        pick(F.floor(k / 3), "IN", "SY", "BN").alias("tty"), F.lit("ENG").alias("lat"), F.when(k % 2 == 0, "Y").otherwise("N").alias("ispref"), F.when(k % 5 == 0, "P").otherwise("S").alias("ts"),
    )
    number = F.right("cui", F.lit(3)).cast("int")
    sty = F.when(number % 4 == 0, F.array(F.lit("Clinical Drug"))).when(number % 4 == 1, F.array(F.lit("Finding"))).when(number % 4 == 2, F.array(F.lit("Antibiotic"), F.lit("Injury or Poisoning"))).otherwise(F.array(F.lit("Geographic Area")))
    types = names.select("cui").distinct().select("cui", F.explode(sty).alias("sty"))
    kinds = part.select("p_type").distinct()
    fixed = lambda cui, name: kinds.select(cui.alias("cui"), name.alias("str"), F.lit("RXNORM").alias("sab"), F.lit("IN").alias("tty"), F.lit("ENG").alias("lat"), F.lit("Y").alias("ispref"), F.lit("P").alias("ts"))
    own = F.concat(F.lit("T"), "p_type")
    classes = part.select(pick(k, "K0", "K1", "K2").alias("cui")).distinct().select("cui", F.concat(F.lit("class "), "cui").alias("str"), F.lit("MSH").alias("sab"), F.lit("MH").alias("tty"), F.lit("ENG").alias("lat"), F.lit("Y").alias("ispref"), F.lit("P").alias("ts"))
    edge = lambda where, a, rela, b: kinds.where(where).select(a.alias("cui1"), F.lit(rela).alias("rela"), b.alias("cui2"))
    relations = edge("true", F.lit("K0"), "isa", own).unionByName(edge("length(p_type) = 5", own, "inverse_isa", F.lit("K1"))).unionByName(edge("length(p_type) = 6", F.lit("K2"), "isa", own))
    return Dictionary(names.unionByName(fixed(own, F.col("p_type"))).unionByName(classes), types, relations)


def asked(c: Cdm) -> DataFrame:
    k, n = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50)
    text = F.when(n % 4 == 0, F.upper(F.concat_ws(" ", "p_name", "p_type", (k % 11).cast("string")))).when(n % 4 == 1, F.concat_ws(" ", "p_name", F.lower("p_type"))).when(n % 4 == 2, F.left("p_name", F.lit(3))).otherwise(F.concat(F.lit("x"), "p_name"))
    return c.raw("part").where(k % 50 == 0).select(k.alias("query_id"), text.alias("text"), F.when(n % 3 == 0, "Drug").when(n % 3 == 1, "Condition").alias("domain"))


@query(f"WITH {DICTIONARY} SELECT query_id, nth, cui FROM concepts")
def synonym_concepts(c):
    """Concepts of texts: whole names first, then names that hold the text, then semantic types."""
    d = dictionary(c)
    return synonyms.concepts_of(asked(c), Dictionary(d.names.where("cui LIKE 'C%'"), d.types, d.relations))


@query(f"""WITH {DICTIONARY}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cui, lower(str) ORDER BY ispref DESC, ts, sab, str) AS o FROM names) WHERE o = 1),
placed AS (SELECT cui, str, row_number() OVER (PARTITION BY cui ORDER BY CASE WHEN sab IN ('SNOMEDCT_US', 'RXNORM') THEN 0 ELSE 1 END, ispref DESC, ts, sab, str) AS place FROM once),
m AS (SELECT query_id, nth, place, str, row_number() OVER (PARTITION BY query_id, lower(str) ORDER BY nth, place) AS f FROM concepts JOIN placed USING (cui) JOIN queries USING (query_id) WHERE nth <= 3 AND place <= 10 AND lower(str) <> lower(text))
SELECT query_id, rank, synonym FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY nth, place) AS rank, str AS synonym FROM m WHERE f = 1) WHERE rank <= 5""")
def synonym_expansion(c):
    d = dictionary(c)
    return synonyms.synonyms(asked(c), Dictionary(d.names.where("cui LIKE 'C%'"), d.types, d.relations))


@query("""WITH k AS (SELECT DISTINCT p_type FROM part), m AS (SELECT 'K0' AS query_id, p_type FROM k UNION ALL SELECT 'K1', p_type FROM k WHERE length(p_type) = 5 UNION ALL SELECT 'K2', p_type FROM k WHERE length(p_type) = 6),
f AS (SELECT DISTINCT query_id, concept_id FROM m JOIN concept ON lower(concept_name) = lower(p_type) AND concept_class_id = 'Ingredient' AND invalid_reason IS NULL) SELECT * FROM f WHERE query_id IN (SELECT query_id FROM f GROUP BY 1 HAVING count(*) >= 3)""")
def synonym_class_members(c):
    """Ingredients below a class along the dictionary's relations, both ways they are written."""
    d = dictionary(c)
    classes = d.names.where("sab = 'MSH'").select(F.col("cui").alias("query_id"), F.lower("str").alias("text"))
    return synonyms.class_members(classes, Dictionary(d.names, d.types.limit(0), d.relations), c.concept)


@query(f"""WITH edges AS (SELECT parent, child FROM is_a UNION SELECT {LEAF} + p_partkey, {ROOT} FROM part WHERE p_partkey % 97 = 0),
r AS (SELECT DISTINCT brand_id AS seed, brand_id AS cui FROM parts WHERE brand_id % 5 = 0 UNION SELECT seed, child FROM r JOIN edges ON parent = cui) SELECT CAST(seed AS VARCHAR) AS seed, CAST(cui AS VARCHAR) AS cui FROM r WHERE seed <> cui""")
def synonym_graph_reached(c):
    """All below a few brands in a graph with cycles, edges written both ways."""
    text = lambda name: F.col(name).cast("string")
    even = F.col("child") % 2 == 0
    tree = c.is_a.select(F.when(even, text("parent")).otherwise(text("child")).alias("cui1"), F.when(even, "isa").otherwise("inverse_isa").alias("rela"), F.when(even, text("child")).otherwise(text("parent")).alias("cui2"))
    back = c.raw("part").where("p_partkey % 97 = 0").select((LEAF + F.col("p_partkey")).cast("string").alias("cui1"), F.lit("isa").alias("rela"), F.lit(str(ROOT)).alias("cui2"))
    seeds = c._parts.where("brand_id % 5 = 0").select(text("brand_id").alias("seed")).distinct()
    return synonyms.reached(seeds, tree.unionByName(back)).select("seed", "cui")


ORACLE_SQL["synonym_graph_reached"] = ORACLE_SQL["synonym_graph_reached"].replace("WITH ", "WITH RECURSIVE ", 1)


# ---- expansion -------------------------------------------------------------------------------------

SLACK = 10.0
UP_AND_DOWN = f"""seeds AS (SELECT {LEAF} + p_partkey AS seed_id FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT DISTINCT brand_id FROM parts WHERE brand_id % 5 = 0),
dn AS (SELECT ancestor_concept_id AS c, count(DISTINCT descendant_concept_id) AS n FROM concept_ancestor WHERE ancestor_concept_id <> descendant_concept_id GROUP BY 1),
ic AS (SELECT concept_id AS c, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 20.0 ELSE -log2(n / 2750364.0) END AS ic FROM concept LEFT JOIN dn ON c = concept_id),
up AS (SELECT seed_id, a.ancestor_concept_id AS branch, a.min_levels_of_separation AS sep, i.n FROM seeds JOIN ic s ON s.c = seed_id JOIN concept_ancestor a ON a.descendant_concept_id = seed_id AND a.min_levels_of_separation BETWEEN 1 AND 3 JOIN ic i ON i.c = a.ancestor_concept_id WHERE i.ic > greatest(8.0, s.ic - {SLACK})),
pl AS (SELECT seed_id, branch, row_number() OVER (PARTITION BY seed_id ORDER BY sep, n DESC, branch) AS place FROM up),
h1 AS (SELECT parent AS branch, child FROM is_a WHERE parent IN (SELECT branch FROM pl)), h2 AS (SELECT DISTINCT branch, i.child FROM h1 JOIN is_a i ON i.parent = h1.child), h3 AS (SELECT DISTINCT branch, i.child FROM h2 JOIN is_a i ON i.parent = h2.child),
hop AS (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3),"""
#: Branch by branch of the climb until the cap, and all of its branches whole.
TO_THE_CAP = """few AS (SELECT branch, child AS concept_id FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY child) AS r FROM hop WHERE branch <> child) WHERE r <= 50),
mt AS (SELECT seed_id, concept_id, min(place) AS place FROM pl JOIN few USING (branch) GROUP BY ALL), nw AS (SELECT seed_id, place, count(*) AS n FROM mt GROUP BY ALL),
op AS (SELECT seed_id, place FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY seed_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nw) WHERE b < 50),
br_ancestor_climb AS (SELECT seed_id, concept_id, nth AS far FROM (SELECT m.seed_id, m.concept_id, row_number() OVER (PARTITION BY m.seed_id ORDER BY i.ic DESC, m.concept_id) AS nth FROM mt m JOIN op USING (seed_id, place) JOIN ic i ON i.c = m.concept_id) WHERE nth <= 50)"""
WHOLE_CLIMB = "br_ancestor_climb AS (SELECT seed_id, concept_id, row_number() OVER (PARTITION BY seed_id ORDER BY i.ic DESC, concept_id) AS far FROM (SELECT DISTINCT seed_id, child AS concept_id FROM pl JOIN hop USING (branch) WHERE branch <> child) JOIN ic i ON i.c = concept_id)"
NEAR = """good AS (SELECT concept_id FROM concept WHERE standard_concept = 'S' AND invalid_reason IS NULL),
br_descendants AS (SELECT seed_id, descendant_concept_id AS concept_id, min_levels_of_separation AS far FROM seeds JOIN concept_ancestor ON ancestor_concept_id = seed_id AND min_levels_of_separation BETWEEN 1 AND 3 WHERE descendant_concept_id IN (SELECT * FROM good)),
br_below_parents AS (SELECT seed_id, descendant_concept_id AS concept_id, min(min_levels_of_separation) AS far FROM seeds JOIN is_a ON child = seed_id JOIN concept_ancestor ON ancestor_concept_id = parent AND min_levels_of_separation BETWEEN 1 AND 3 WHERE seed_id NOT IN (SELECT seed_id FROM br_descendants) AND descendant_concept_id IN (SELECT * FROM good) GROUP BY ALL),
br_siblings AS (SELECT DISTINCT seed_id, b.child AS concept_id, 0 AS far FROM seeds JOIN is_a a ON a.child = seed_id JOIN is_a b ON b.parent = a.parent WHERE b.child <> seed_id),
br_maps_to AS (SELECT DISTINCT seed_id, concept_id_2 AS concept_id, 0 AS far FROM seeds JOIN concept_relationship ON concept_id_1 = seed_id AND relationship_id = 'Maps to'),
br_ancestors AS (SELECT seed_id, ancestor_concept_id AS concept_id, min_levels_of_separation AS far FROM seeds JOIN concept_ancestor ON descendant_concept_id = seed_id AND min_levels_of_separation BETWEEN 1 AND 2)"""


def strategy_sql(*branches: tuple[str, str], climb: str = TO_THE_CAP) -> str:
    union = " UNION ALL ".join(f"SELECT *, {place} AS place, '{name}' AS branch FROM br_{table}" for place, (name, table) in enumerate(branches))
    return f"""WITH {UP_AND_DOWN} {climb},
{NEAR}, u AS ({union}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, concept_id ORDER BY place, far) AS f FROM u WHERE concept_id <> seed_id) WHERE f = 1)
SELECT seed_id, concept_id, rank, branch FROM (SELECT seed_id, concept_id, row_number() OVER (PARTITION BY seed_id ORDER BY place, far, concept_id) AS rank, branch FROM o) WHERE rank <= 50"""


WHOLE = {
    "descendants": (("descendants", "descendants"),), "siblings": (("siblings", "siblings"),), "maps_to": (("maps_to", "maps_to"),), "ancestor_climb": (("ancestor_climb", "ancestor_climb"),),
    "clinical_anchor": (("ancestors", "ancestors"), ("siblings", "siblings"), ("maps_to", "maps_to"), ("ancestor_climb", "ancestor_climb")),
}


def strategy(name: str):
    def run(c: Cdm) -> DataFrame:
        seeds = c.raw("part").where("p_partkey % 50 = 0").select((LEAF + F.col("p_partkey")).alias("concept_id")).unionByName(c._parts.where("brand_id % 5 = 0").select(F.col("brand_id").alias("concept_id")).distinct())
        return expansion.expanded(seeds, name, c.concept_ancestor, c.is_a, c.concept_relationship, c.concept, slack=SLACK)

    return run


for _name, _branches in WHOLE.items():
    query(strategy_sql(*_branches), name=f"expanded_{_name}")(strategy(_name))
_clinical = strategy_sql(("descendants", "descendants"), ("siblings", "siblings"), ("maps_to", "maps_to"), ("ancestor_climb", "ancestor_climb"), ("ancestors", "ancestors"), climb=WHOLE_CLIMB)
query(_clinical.replace("FROM br_descendants UNION ALL", "FROM (SELECT * FROM br_descendants UNION ALL SELECT * FROM br_below_parents) UNION ALL", 1), name="expanded_clinical")(strategy("clinical"))


# ---- search in two stages --------------------------------------------------------------------------

#: Each vector stands for a part's concept; every fiftieth is a query, with a part's name as its text.
def texts(c: Cdm) -> DataFrame:
    named = c.raw("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return c.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).join(named, "query_id", "left").select("query_id", F.coalesce("text", F.lit("bolt")).alias("text"), F.lit(None).cast("string").alias("domain"))


def as_concepts(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", (LEAF + F.col("item_id")).alias("item_id"), "rank")


def neighbours(c: Cdm) -> DataFrame:
    r = c.concept_relationship.where("relationship_id IN ('Is a', 'Maps to')")
    return r.select("concept_id_1", "concept_id_2").unionByName(r.select(F.col("concept_id_2").alias("concept_id_1"), F.col("concept_id_1").alias("concept_id_2"))).distinct()


@query("""WITH knn AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
v AS (SELECT query_id, """ + str(LEAF) + """ + item_id AS item_id, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM knn) WHERE r <= 20),
good AS (SELECT concept_id, concept_name FROM concept WHERE standard_concept = 'S' AND invalid_reason IS NULL), q AS (SELECT vec_id AS query_id, coalesce(p_name, 'bolt') AS text FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE vec_id % 50 = 0),
n AS (SELECT query_id, concept_id AS item_id, r FROM (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY length(concept_name), concept_id) AS r FROM q JOIN good ON contains(lower(concept_name), lower(text))) WHERE r <= 20),
f1 AS (SELECT query_id, item_id, sum(1 / (60 + r)) AS s FROM (SELECT * FROM v UNION ALL SELECT * FROM n) GROUP BY ALL), s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM f1) WHERE r <= 20),
rel AS (SELECT concept_id_1 AS a, concept_id_2 AS b FROM concept_relationship WHERE relationship_id IN ('Is a', 'Maps to')), e AS (SELECT a, b FROM rel UNION SELECT b, a FROM rel),
nb AS (SELECT a, b, n FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM e WHERE b IN (SELECT concept_id FROM good)) WHERE n <= 5),
rc AS (SELECT query_id, b AS item_id, min(n) AS n FROM s1 JOIN nb ON a = item_id WHERE r <= 10 GROUP BY ALL), rr AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n, item_id) AS r FROM rc),
f2 AS (SELECT query_id, item_id, sum(1 / (60 + r)) AS s FROM (SELECT query_id, item_id, r FROM s1 UNION ALL SELECT * FROM rr) GROUP BY ALL)
SELECT query_id, item_id, round(s, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM f2) WHERE r <= 20""")
def two_stage_search(c):
    """Both stages over exact neighbours by vector."""
    q, v = vectors(c)
    hits = as_concepts(nearest_of_all(q, v, 20))
    return index.two_stages(hits, texts(c), c.concept, neighbours(c)).select("query_id", "item_id", *r6("score"), "rank")


def indexed(c: Cdm) -> tuple[index.Index, DataFrame]:
    e = c.raw("embeddings")
    built = index.build(e.select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("domain"), F.col("embedding").alias("v")))
    return built, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 100 == 0, F.col("label").cast("string")).alias("domain"), F.col("embedding").alias("q"))


@query()
def indexed_search(c):
    """About the 20 nearest vectors of every query, half of the queries within their own label, through the index; tests measure its recall."""
    built, queries = indexed(c)
    return index.search(built, queries).select("query_id", "item_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def indexed_two_stage_search(c):
    built, queries = indexed(c)
    hits = as_concepts(index.search(built, queries.withColumn("domain", F.lit(None).cast("string"))))
    return index.two_stages(hits, texts(c), c.concept, neighbours(c)).select("query_id", "item_id", *r6("score"), "rank")


# ---- criteria that restate others --------------------------------------------------------------------


def said(c: Cdm) -> DataFrame:
    """conv_id, turn, role, said: the sentences of every turn."""
    return c.raw("conversations").select("conv_id", "turn", "role", F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), r"\. "), F.trim), lambda s: s != "").alias("said"))


def place(turn: str = "turn", at: str = "at"):
    """Of a sentence in its conversation."""
    return F.col(turn) * 10_000 + F.col(at)


def lines(c: Cdm) -> DataFrame:
    """list, nth, text: a conversation's sentences; those of the assistant's turns make one group of alternatives a turn."""
    turns = said(c)
    own = turns.where("NOT role <=> 'assistant'").select("conv_id", "turn", F.posexplode("said").alias("at", "text"))
    group = F.concat(F.lit(restatement.GROUP), F.lit("one or more"), F.lit(restatement.JOIN), F.array_join("said", restatement.SEPARATOR))
    grouped = turns.where("role = 'assistant'").select("conv_id", "turn", F.lit(0).alias("at"), group.alias("text"))
    return own.unionByName(grouped).select(F.col("conv_id").alias("list"), place().alias("nth"), "text")


@query()
def restated_criteria(c):
    """Sentences that add nothing to the alternatives in their conversation; the tests hold them against brute force."""
    return restatement.restated(lines(c))


@query()
def covered_criteria(c):
    """Sentences of all turns where one covers seven tenths of the other's content, with the same polarity and numbers.

    A row for every sentence with the class of those that say the same (its least id); the least one of a class has a row for each class that covers it, so copies are not
    expanded into all pairs and none of their links is lost.
    """
    sentences = said(c).select("conv_id", "turn", F.posexplode("said").alias("at", "text")).select((F.col("conv_id") * 100_000_000 + place()).alias("id"), "text")
    distinct = sentences.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    links = restatement.covering(distinct, distinct).select("id", "reference_id", *r6("coverage"))
    members = sentences.join(distinct.withColumnRenamed("id", "class_id"), "text").select("id", "class_id")
    return members.join(links, "id", "left").select("id", "class_id", "reference_id", "coverage")


# ---- concordance -------------------------------------------------------------------------------------


@query("""WITH {arms}, r AS (SELECT "time", event, ps FROM fu JOIN score USING (person_id)), p AS (SELECT a.ps AS x, b.ps AS y FROM r a JOIN r b ON a.event = 1 AND (b."time" > a."time" OR (b."time" = a."time" AND b.event = 0)))
SELECT count(CASE WHEN x > y THEN 1 END) AS concordant, count(CASE WHEN x = y THEN 1 END) AS tied, count(*) AS comparable, round((count(CASE WHEN x > y THEN 1 END) + count(CASE WHEN x = y THEN 1 END) / 2) / count(*), 6) AS c_index FROM p""".format(arms=ARMS))
def concordance_index(c):
    """How well a score orders follow-up, over all comparable pairs."""
    rows = follow_up(c).join(scored(c).select("person_id", "ps"), "person_id").select(F.col("ps").alias("risk"), "time", "event")
    return survival.concordance(rows).select("concordant", "tied", "comparable", *r6("c_index"))
