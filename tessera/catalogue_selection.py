"""Queries that sample, number, cap, re-rank and vote, and those of whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import ANY_ENTRY, ARMS, BRAND1, BRAND2, KM, KNN, OUTCOME, SQL_ENTRY, TYPE, _in_set, arm, cohort, entries_of, follow_up, nearest_of_all, outcomes, query, r6, under, vectors
from .functions import text
from .operators import cohorts, dataset, survival
from .plans.definition import Counted, Criterion, Group
from .plans.definition import Window as Days
from .sources.results import bound_scan

HASHED = "(SELECT person_id, row_number() OVER (ORDER BY md5(person_id || '|42')) AS r, count(*) OVER () AS n FROM {})"


# ---- samples and numbers ----------------------------------------------------------------------


@query(f"SELECT person_id FROM {HASHED.format('person')} WHERE r <= ceil(n * 0.1)")
def hashed_sample(c):
    return cohorts.sampled(c.person, 0.1)


@query(f"SELECT person_id, CAST(900000 + r AS BIGINT) AS number FROM {HASHED.format('person')}")
def surrogate_ids(c):
    return cohorts.numbered(c.person.select("person_id"), 900_000)


@query(f"WITH {ARMS}, rest AS (SELECT person_id FROM person WHERE person_id NOT IN (SELECT person_id FROM a1)) SELECT person_id FROM {HASHED.format('rest')} WHERE r <= 250")
def fixed_comparator(c):
    return cohorts.fixed_comparator(c.person, arm(c, BRAND1), 250)


# ---- scans and filters ------------------------------------------------------------------------


@query("SELECT concept_id, count(*) AS n FROM drug_exposure WHERE start_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' GROUP BY 1")
def bound_date_scan(c):
    statement = "SELECT concept_id, count(*) AS n FROM {drugs} WHERE start_date BETWEEN CAST(:first AS DATE) AND CAST(:last AS DATE) GROUP BY concept_id"
    return bound_scan(c.spark, statement, {"drugs": c.drug_exposure}, first="1995-01-01", last="1996-06-30")


@query("SELECT person_id, CAST(year(current_date) - year_of_birth AS INTEGER) AS age FROM person")
def age_today(c):
    return c.person.select("person_id", (F.year(F.current_date()) - F.col("year_of_birth")).alias("age"))


#: Where every seventh concept is taken as unmapped (0): drugs and procedures drop those events, conditions keep them.
@query("""WITH e AS (SELECT 'Drug' AS domain, CASE WHEN concept_id % 7 = 0 THEN 0 ELSE concept_id END AS k FROM drug_exposure UNION ALL SELECT 'Procedure', CASE WHEN concept_id % 7 = 0 THEN 0 ELSE concept_id END FROM procedure_occurrence
UNION ALL SELECT 'Condition', CASE WHEN concept_id % 7 = 0 THEN 0 ELSE concept_id END FROM condition_occurrence) SELECT domain, count(*) AS n FROM e WHERE k <> 0 OR domain = 'Condition' GROUP BY 1""")
def mapped_events(c):
    def of(domain: str, events: DataFrame) -> DataFrame:
        return events.select(F.lit(domain).alias("domain"), F.when(F.col("concept_id") % 7 == 0, 0).otherwise(F.col("concept_id")).alias("k"))

    every = of("Drug", c.drug_exposure).unionByName(of("Procedure", c.procedure_occurrence)).unionByName(of("Condition", c.condition_occurrence))
    return every.where("k <> 0 OR domain = 'Condition'").groupBy("domain").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT p_partkey AS id, p_partkey % 200 AS grp, p_partkey % 200 < 100 AS open, p_size % 3 = 0 OR p_partkey % 50 = 7 AS wrong FROM part), n AS (SELECT *, count(CASE WHEN NOT wrong THEN 1 END) OVER (PARTITION BY grp) AS good FROM k)
SELECT grp, id FROM n WHERE NOT wrong OR (open AND good = 0)""")
def entity_class_filter(c):
    """Candidates of the wrong class go; where that leaves none, open groups keep all and closed ones keep none."""
    k = F.col("p_partkey")
    rows = c.raw("part").select(k.alias("id"), (k % 200).alias("grp"), (k % 200 < 100).alias("open"), ((F.col("p_size") % 3 == 0) | (k % 50 == 7)).alias("wrong"))
    good = F.count_if(~F.col("wrong")).over(Window.partitionBy("grp"))
    return rows.withColumn("good", good).where("NOT wrong OR (open AND good = 0)").select("grp", "id")


@query("SELECT concept_id, min(weight) AS weight FROM (SELECT type_id AS concept_id, CAST(p_size AS DOUBLE) AS weight FROM parts UNION ALL SELECT type_id, CAST(3 + p_partkey % 40 AS DOUBLE) FROM parts UNION ALL SELECT brand_id, 5.0 FROM parts) GROUP BY 1")
def merged_weights(c):
    """Default and derived weights of concepts; the least of a concept's wins."""
    defaults = c._parts.select(F.col("type_id").alias("concept_id"), F.col("p_size").cast("double").alias("weight"))
    derived = c._parts.select(F.col("type_id").alias("concept_id"), (3 + F.col("p_partkey") % 40).cast("double").alias("weight"))
    return defaults.unionByName(derived).unionByName(c._parts.select(F.col("brand_id").alias("concept_id"), F.lit(5.0).alias("weight"))).groupBy("concept_id").agg(F.min("weight").alias("weight"))


# ---- caps, re-ranking, votes --------------------------------------------------------------------


@query("""WITH k AS (SELECT p_brand AS grp, p_partkey AS id, p_size = 5 AS seed, p_size % 3 AS tier FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seed DESC, tier DESC, id) AS nth FROM k) SELECT grp, id, seed FROM r WHERE nth <= 20 OR seed""")
def capped_with_seeds(c):
    """At most 20 candidates a group by tier; seeds stay beyond the cap."""
    rows = c.raw("part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), (F.col("p_size") == 5).alias("seed"), (F.col("p_size") % 3).alias("tier"))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("seed").desc(), F.col("tier").desc(), "id"))
    return rows.withColumn("nth", nth).where("nth <= 20 OR seed").select("grp", "id", "seed")


FETCHED = f"{KNN}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM knn) WHERE r <= 60)"


@query(f"""WITH {FETCHED}, s AS (SELECT query_id, item_id, d / avg(d) OVER (PARTITION BY query_id) + CASE WHEN item_id % 7 = 0 THEN -0.05 ELSE 0 END AS score FROM near)
SELECT query_id, item_id, round(score, 6) AS score, q AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS q FROM s) WHERE q <= 20""")
def fetched_then_sorted(c):
    """Of 3 x 20 nearest fetched, the 20 best by adjusted score."""
    q, v = vectors(c)
    n, by_query = 20, Window.partitionBy("query_id")
    near = nearest_of_all(q, v, max(3 * n, 60))
    mean = F.avg("distance").over(by_query)  # 0 where all that was fetched are copies of the query
    score = F.when(mean > 0, F.col("distance") / F.when(mean > 0, mean)).otherwise(F.lit(float("nan"))) + F.when(F.col("item_id") % 7 == 0, -0.05).otherwise(0.0)
    ranked = near.select("query_id", "item_id", score.alias("score")).withColumn("rank", F.row_number().over(by_query.orderBy("score", "item_id")))
    return ranked.where(F.col("rank") <= n).select("query_id", "item_id", *r6("score"), "rank")


@query(f"""WITH {KNN}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM knn) WHERE r <= 20), v AS (SELECT query_id, label, count(*) AS votes FROM near JOIN embeddings ON vec_id = item_id GROUP BY ALL)
SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS q FROM v) WHERE q = 1""")
def majority_vote(c):
    q, v = vectors(c)
    votes = nearest_of_all(q, v, 20).select("query_id", "item_id").join(v.select("item_id", "label"), "item_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "label"))
    return votes.withColumn("q", first).where("q = 1").select("query_id", "label", "votes")


@query(f"""WITH m AS (SELECT brand_id, leaf_id, leaf_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({TYPE + 1}, {TYPE + 2}, {TYPE + 3})) AS excepted FROM parts), n AS (SELECT brand_id, count(*) AS n_members, count(CASE WHEN excepted THEN 1 END) AS n_excepted FROM m GROUP BY 1)
SELECT brand_id, n_members, n_excepted, n_excepted = n_members AS refused, CASE WHEN n_excepted = n_members THEN n_members ELSE n_members - n_excepted END AS n_left FROM n""")
def entity_subtraction(c):
    """Concepts under excepted classes leave their set, unless that would leave nothing of it."""
    gone = under(c, TYPE + 1).unionByName(under(c, TYPE + 2)).unionByName(under(c, TYPE + 3)).distinct().select(F.col("concept_id").alias("leaf_id"), F.lit(1).alias("x"))
    n = c._parts.select("brand_id", "leaf_id").join(gone, "leaf_id", "left").groupBy("brand_id").agg(F.count("*").alias("n_members"), F.count("x").alias("n_excepted"))
    refused = F.col("n_excepted") == F.col("n_members")
    return n.select("brand_id", "n_members", "n_excepted", refused.alias("refused"), F.when(refused, F.col("n_members")).otherwise(F.col("n_members") - F.col("n_excepted")).alias("n_left"))


# ---- text ---------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT p_partkey AS product_id, trim(unnest(string_split(p_name || ' ' || p_size || ' MG / ' || p_brand || ' 0.5 ML', ' / '))) AS part FROM part)
SELECT product_id, lower(regexp_replace(part, '\s+[0-9]+(\.[0-9]+)?\s*(MG|ML|MCG|UNT|%).*$', '')) AS ingredient FROM s""")
def product_ingredients(c):
    product = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG / "), "p_brand", F.lit(" 0.5 ML"))
    return c.raw("part").select(F.col("p_partkey").alias("product_id"), F.explode(text.ingredients(product)).alias("ingredient"))


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{w}')" for w in text.TEMPORAL) + " AS temporal FROM conversations")
def temporal_veto(c):
    return c.raw("conversations").select("conv_id", "turn", text.is_temporal(F.col("text")).alias("temporal"))


@query(r"SELECT stem, count(*) AS n, min(conv_id) AS first_id FROM (SELECT conv_id, left(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), 24) AS stem FROM conversations) WHERE stem <> '' GROUP BY 1 HAVING count(*) > 1")
def restated_clusters(c):
    return text.restated(c.raw("conversations").select(F.col("conv_id").alias("id"), "text"), 24).withColumnRenamed("first", "first_id")


# ---- datasets and simulation ----------------------------------------------------------------------


@query(f"""WITH {ARMS} SELECT fu.person_id, fu.treatment, fu.index_date, fu."time", fu.event, CAST(year(fu.index_date) - year_of_birth AS DOUBLE) AS age, CAST(gender_concept_id = 8507 AS DOUBLE) AS male FROM fu LEFT JOIN person USING (person_id)""")
def two_arm_dataset(c):
    return dataset.two_arms(arm(c, BRAND1), arm(c, BRAND2), c.person, outcomes(c))


@query(f'WITH {ARMS}, {KM} SELECT treatment, "time", round(CASE WHEN survival > 0 AND survival < 1 THEN survival ** exp(1.959964 * gw / abs(ln(survival))) END, 5) AS low, round(CASE WHEN survival > 0 AND survival < 1 THEN survival ** exp(-1.959964 * gw / abs(ln(survival))) END, 5) AS high FROM km')
def km_interval(c):
    curve = survival.with_interval(survival.kaplan_meier(follow_up(c), "treatment"))
    return curve.select("treatment", "time", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("""WITH r AS (SELECT person_id, 1 / (1 + exp(2 - 0.03 * (least(greatest(1995 - year_of_birth, 30), 70) - 50) - 0.5 * CAST(gender_concept_id = 8507 AS INTEGER))) AS risk FROM person)
SELECT person_id, round(risk, 6) AS risk, CAST(('0x' || left(md5(person_id || '|7'), 8)) AS BIGINT) / 4294967296.0 < risk AS event FROM r""")
def simulated_events(c):
    """Events drawn by a hash of the person, so that every run draws the same, at a risk that covariates within bounds decide."""
    age = F.least(F.greatest(1995 - F.col("year_of_birth"), F.lit(30)), F.lit(70))
    risk = 1 / (1 + F.exp(2 - 0.03 * (age - 50) - 0.5 * (F.col("gender_concept_id") == 8507).cast("int")))
    drawn = F.conv(F.left(cohorts.hashed_order(seed=7), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return c.person.select("person_id", F.round(risk, 6).alias("risk"), (drawn < risk).alias("event"))


@query(f"""WITH {ARMS}, x AS (SELECT person_id, start_date FROM condition_occurrence WHERE concept_id = {OUTCOME})
SELECT a.person_id, count(CASE WHEN x.start_date BETWEEN a.s - 30 AND a.s + 30 THEN 1 END) AS n_from_start, count(CASE WHEN x.start_date BETWEEN a.e - 30 AND a.e + 30 THEN 1 END) AS n_from_end FROM a1 a LEFT JOIN x ON x.person_id = a.person_id GROUP BY 1""")
def rebased_windows(c):
    """The same window counted from a cohort's start and from its end."""
    spans, x = arm(c, BRAND1), outcomes(c).select("person_id", "start_date")
    around = lambda day: F.col("start_date").between(F.date_sub(day, 30), F.date_add(day, 30))
    return spans.join(x, "person_id", "left").groupBy("person_id").agg(F.count_if(around("cohort_start_date")).alias("n_from_start"), F.count_if(around("cohort_end_date")).alias("n_from_end"))


@query(f"""WITH ev AS (SELECT person_id, start_date AS index_date, max(end_date) AS index_end FROM ({_in_set(BRAND1)}) GROUP BY ALL),
ent AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.person_id ORDER BY index_date) AS r FROM ev e JOIN observation_period p ON p.person_id = e.person_id AND e.index_date >= p.start_date + 180 AND e.index_date <= p.end_date) WHERE r = 1)
SELECT person_id, index_date FROM ent WHERE EXISTS (SELECT 1 FROM condition_occurrence x WHERE x.person_id = ent.person_id AND x.concept_id = {OUTCOME} AND x.start_date BETWEEN index_end - 90 AND index_end + 90)""")
def rule_rebased_window(c):
    """A rule whose window is counted from the day the index event ends."""
    near = Counted(Criterion("Condition", 2), Days(-90, 90, from_end=True))
    return entries_of(cohort(c, [Group(criteria=(near,))], entry=ANY_ENTRY, primary_limit="First"))


@query(f"WITH {SQL_ENTRY} SELECT person_id, index_date FROM ent WHERE EXISTS (SELECT 1 FROM ({_in_set(BRAND2)}) x WHERE x.person_id = ent.person_id AND x.start_date >= index_date - 90 AND x.end_date BETWEEN index_date AND index_date + 200)")
def rule_end_window(c):
    """A rule on when events begin and when they end."""
    return entries_of(cohort(c, [Group(criteria=(Counted(Criterion("Drug", 3), Days(-90, None), Days(0, 200)),))]))


@query(f"WITH {SQL_ENTRY} SELECT person_id, index_date FROM ent WHERE EXISTS (SELECT 1 FROM ({_in_set(BRAND2)}) x WHERE x.person_id = ent.person_id AND x.end_date BETWEEN index_date - 30 AND index_date + 90)")
def rule_event_end(c):
    """A rule whose window must hold the events' last days."""
    return entries_of(cohort(c, [Group(criteria=(Counted(Criterion("Drug", 3), Days(-30, 90, of_end=True)),))]))
