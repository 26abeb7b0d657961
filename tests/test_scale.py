"""What must not grow faster than the input: joins of documents, resolved sets, families of siblings, nearest vectors."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import cohorts, expansion, index, retrieval, sites, vocabulary
from tessera.operators import document_checks as checks
from tessera.plans import rows as R
from tessera.sources.cdm import Cdm

from .test_rows import NO, YES, document, entry, frame, group, opened, rule

FOLDER = "/root/testdata/sf0.001"


def test_repetitive_documents_do_not_go_through_the_driver(spark):
    """They are small on disk and large in memory, so the planner must not broadcast them by their size on disk."""
    made = R.documents_of(opened(spark, *[document(rule(group(entry(1), groups=[group(entry(2, NO))])))] * 20))
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 20


def test_members_of_a_set_are_held_once_for_all_documents(spark):
    concept = spark.createDataFrame([(i, None) for i in (1, 2, 3, 9)], "concept_id long, invalid_reason string")
    tree = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (3, 3), (9, 9)], "ancestor_concept_id long, descendant_concept_id long")
    maps = spark.createDataFrame([], "concept_id_1 long, concept_id_2 long, relationship_id string")
    docs = [document(rule(group(entry(1, YES))), entries=(9,), s1=[1], s2=[2], s3=[1, -3], s9=[2]), document(entries=(1, 2), s1=[1, -3], s2=[9], s4=[1, 9], s5=[2, 9]), document(entries=(7,), s1=[1])] * 3
    r = opened(spark, *docs)
    once, every = checks.set_closures(r, tree, maps, concept), checks.closures(r, tree, maps, concept)
    assert once.members.count() == 3 + 1 + 2 + 1 + 4 + 2
    sets = lambda df: {(x.document, x.codeset) for x in df.collect()}
    assert sets(checks.containing(r, once)) == sets(checks.containing(r, every)) == {(d, s) for k in (0, 3, 6) for d, s in [(k, 1), (k, 2), (k, 3), (k, 9), (k + 1, 4)]}

    def classes(keys):
        out = {}
        for x in keys.collect():
            out.setdefault((x.members, x.n_members), set()).add((x.document, x.codeset))
        return sorted((n, sorted(v)) for (_, n), v in out.items())

    assert classes(checks.closure_keys(once)) == classes(checks.closure_keys(every))


def test_families_are_cut_at_the_cap(spark):
    """A seed's siblings are those of least id; no parent's children all meet one another."""
    is_a = spark.createDataFrame([(i, 1000 + i % 2) for i in range(1, 41)] + [(i, 1002) for i in range(30, 41)], "child long, parent long")
    seeds = spark.createDataFrame([(i,) for i in range(1, 41)], "concept_id long")
    every, few = vocabulary.siblings(seeds, is_a), vocabulary.siblings(seeds, is_a, 3)
    least = lambda df: {s: sorted(r.concept_id for r in df.where(f"seed_id = {s}").collect())[:3] for s in (1, 2, 30, 39, 40)}
    assert least(every) == least(few) and few.groupBy("seed_id").count().agg(F.max("count")).first()[0] <= 8
    concept = spark.createDataFrame([(i, "x", "S", None) for i in range(1, 41)], "concept_id long, concept_name string, standard_concept string, invalid_reason string")
    tree = is_a.select(F.col("parent").alias("ancestor_concept_id"), F.col("child").alias("descendant_concept_id"), (1 + F.col("child") % 3).cast("int").alias("min_levels_of_separation"))
    best = lambda df: {s: sorted((r.separation, r.concept_id) for r in df.where(f"seed_id = {s} AND concept_id <> {s}").collect())[:3] for s in (1, 2, 30, 39, 40)}
    few = expansion.from_parents(seeds, tree, is_a, concept, most=3)
    assert best(expansion.from_parents(seeds, tree, is_a, concept)) == best(few) and few.groupBy("seed_id").count().agg(F.max("count")).first()[0] <= 8


def test_nearest_by_matrices_is_nearest(spark):
    """Also with copies, which tie, far from the origin, in several batches and by domain."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 8)).astype(np.float32) + np.float32(50)
    v[100:140] = v[3]
    label = rng.integers(0, 3, 700)
    items = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "item_id long, v array<float>, label int").repartition(3)
    queries = items.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for domain in (None, "label"):
            got = {(r.query_id, r["rank"]): (r.item_id, r.distance) for r in retrieval.nearest(queries, items, 7, domain).collect()}
            for i in range(0, 700, 2):
                d = np.sqrt(((v.astype(float) - v[i].astype(float)) ** 2).sum(1))
                order = [j for j in np.lexsort((np.arange(700), d)) if domain is None or label[j] == label[i]][:7]
                assert [got[i, k + 1][0] for k in range(7)] == order and np.allclose([got[i, k + 1][1] for k in range(7)], d[order])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_id_with_two_names(spark):
    """Where one id is two concepts: one row of counts, only the name that holds the text, persons of both analyses."""
    ids, tree = spark.createDataFrame([(1,), (1,)], "concept_id long"), spark.createDataFrame([(1, 2), (1, 3)], "ancestor_concept_id long, descendant_concept_id long")
    assert [tuple(r) for r in vocabulary.descendant_counts(ids, tree).collect()] == [(1, 2)]
    snapshot = spark.createDataFrame([(400, 2, 5), (700, 2, 7), (700, 3, 1)], "analysis_id int, concept_id long, n_persons long")
    assert sites.descendant_bound(ids.distinct(), snapshot, tree).first()["upper_bound"] == 13
    concept = spark.createDataFrame([(7, "a long name with ring", "Drug", "S", None), (7, "Brand", "Drug", "S", None), (8, "ring", "Drug", "S", None)], "concept_id long, concept_name string, domain_id string, standard_concept string, invalid_reason string")
    asked = spark.createDataFrame([(1, "ring", None)], "query_id long, text string, domain string")
    assert sorted((r.item_id, r["rank"]) for r in index.by_names(asked, concept).collect()) == [(7, 2), (8, 1)]


def test_all_fetched_are_copies_of_the_query(spark, tmp_path):
    """Their mean distance is 0: scores are no numbers, ranks go by id, and the query does not end in an error."""
    from tessera import catalogue

    spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(100)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.QUERIES["fetched_then_sorted"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in got) == [(q, i, i + 1) for q in (0, 50) for i in range(20)] and all(np.isnan(r.score) for r in got)


def test_arms_come_from_one_pass_over_their_own_exposures(spark):
    """Both arms read the items once, those of other drugs are left out before they meet orders, and persons by concept are not made distinct twice."""
    c = Cdm(spark, FOLDER)
    arms = catalogue.both_arms(c)
    assert len(set(re.findall(r"l_shipdate#\d+", arms._jdf.queryExecution().optimizedPlan().toString()))) == 1
    want = cohorts.target_wins(catalogue.arm(c, catalogue.BRAND1), catalogue.arm(c, catalogue.BRAND2))
    assert sorted(map(tuple, arms.collect())) == sorted((r.person_id, r.treatment, r.cohort_start_date) for r in want.collect())
    rows = [(1, 1, "2020-02-01"), (1, 0, "2020-01-01"), (2, 0, "2020-03-01"), (2, 0, "2020-02-02"), (3, 1, None)]
    got = cohorts.arms_of(spark.createDataFrame(rows, "person_id long, treatment int, start_date string")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, 1, "2020-02-01"), (2, 0, "2020-02-02"), (3, 1, None)]
    seen = spark.createDataFrame([(1, 7), (2, 7), (None, 7), (1, 8)], "person_id long, concept_id long").distinct()
    plan = cohorts.by_concept(seen, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and {tuple(r) for r in cohorts.by_concept(seen, "n").collect()} == {(7, 2), (8, 1)}


def test_lookbacks_and_periods_move_an_order_once(spark):
    c = Cdm(spark, FOLDER)
    index = catalogue.both_arms(c).select("person_id", "index_date")
    assert {tuple(r) for r in catalogue.drugs_before(c, index, 365).collect()} == {tuple(r) for r in cohorts.in_lookback(index, c.drug_exposure, 365).collect()}
    spans = c.drug_exposure.select("person_id", "start_date", "end_date").unionByName(c.condition_occurrence.select("person_id", "start_date", "end_date"))
    want = spans.groupBy("person_id").agg(F.min("start_date"), F.max("end_date"))
    assert sorted(map(tuple, c.observation_period.collect())) == sorted(map(tuple, want.collect()))


def test_cells_are_found_a_few_rows_at_a_time(monkeypatch):
    rng, seen = np.random.default_rng(1), []
    x, centroids, whole = rng.normal(size=(700, 4)), rng.normal(size=(30, 4)), index.squared
    monkeypatch.setattr(index, "squared", lambda a, b: seen.append(len(a)) or whole(a, b))
    got = index.nearest_cells(x, centroids, 5)
    assert max(seen) <= index.ROWS and (np.sort(got) == np.sort(whole(x, centroids).argsort(1)[:, :5])).all()
    assert (index.nearest_cells(x, centroids, 1)[:, 0] == whole(x, centroids).argmin(1)).all() and index.nearest_cells(x[:0], centroids, 5).shape == (0, 5)


def test_opened_documents_are_written_whole(spark, tmp_path):
    """No field of a staged document has a column of its own (the writer infers them from rows that share fields, and the reader puts the values together again); items are written by who reads them twice."""
    import json

    import pyarrow.parquet as pq

    d = json.dumps({"InclusionRules": [{"name": "r", "expression": {"Type": "ALL", "CriteriaList": [{"Criteria": {"Measurement": {"CodesetId": 1}}}]}}], "ConceptSets": [{"id": 1, "expression": {"items": [{"concept": {"CONCEPT_ID": 1}}]}}]})
    r = R.rows_of(spark.range(50).select(F.col("id").alias("document"), F.lit(d).alias("expression")))
    files = [f.removeprefix("file:") for f in (*r.groups.inputFiles(), *r.heads.inputFiles())]
    assert files and not any("typed_value" in str(pq.ParquetFile(f).schema) for f in files)
    assert r.items.count() == 50 and set(r.items.inputFiles()) == set(r.heads.inputFiles())


def test_tasks_grow_with_the_items(spark, monkeypatch):
    """No task gets more than so many items, and orders are not sent to all tasks; the rows stay the same. Items meet their orders once for drugs and procedures together."""
    from tessera.sources import cdm

    names = ["drug_eras", "era_collapse", "union_used_concepts"]
    before = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, FOLDER).collect())) for n in names}
    monkeypatch.setattr(cdm, "ROWS_A_TASK", 500)
    n = Cdm(spark, FOLDER).tasks("lineitem")
    assert n > 4
    for name in names:
        found = catalogue.QUERIES[name](spark, FOLDER)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == before[name]
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1 and f", {n})" in plan


def test_a_deep_key_is_reached_by_one_parse(spark):
    """Each level must not parse the text again, and two keys taken out of a criterion must not do so nine times."""
    raw = spark.createDataFrame([('{"z":1,"A":{"b":{"c":5,"k":[1,null]},"a":"t"}}',), ("broken",)], "raw string")
    without = raw.select(R.drop_key(F.col("raw"), ("A", "b", "c")).alias("x"))
    assert without._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    assert [r.x for r in without.collect()] == ['{"z":1,"A":{"a":"t","b":{"k":[1,null]}}}', None]
    assert raw.select(R.set_key(F.col("raw"), ("A", "b"), F.lit("[2]")).alias("x")).first().x == '{"z":1,"A":{"a":"t","b":[2]}}'


def test_documents_of_one_small_file_are_opened_by_all_tasks(spark, tmp_path):
    docs = [document(rule(group(entry(1), groups=[group(entry(2, NO))])))] * 40
    frame(spark, *docs).coalesce(1).write.parquet(str(tmp_path / "docs"))
    r = R.rows_of(spark.read.parquet(str(tmp_path / "docs")))
    assert r.heads.rdd.getNumPartitions() > 1
