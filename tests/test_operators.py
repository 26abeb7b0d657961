"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cohorts, matching, retrieval, survival, vocabulary
from tessera.sources import cdm
from tessera.streaming import events as streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_survival_steps(spark):
    rows = frame(spark, [(5, 1), (10, 0), (15, 0)], "time int, event int")
    assert [(r.time, round(r.survival, 4)) for r in survival.kaplan_meier(rows).collect()] == [(5, 0.6667)]
    assert survival.kaplan_meier(frame(spark, [(1, 0)], "time int, event int")).count() == 0
    last = survival.kaplan_meier(frame(spark, [(1, 1), (2, 1)], "time int, event int")).orderBy("time").collect()
    assert [r.survival for r in last] == [pytest.approx(0.5), 0.0]


def test_logrank_of_equal_arms_is_nothing(spark):
    rows = frame(spark, [(t, 1, a) for t in (1, 2, 3) for a in (0, 1)], "time int, event int, treatment int")
    assert survival.logrank(rows).first().chi_square == pytest.approx(0)
    assert survival.chi_square_tail(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_weights(spark):
    rows = frame(spark, [(0.3, 1), (0.7, 0), (0.001, 1)], "ps double, treatment int").select(survival.iptw(F.col("ps"), F.col("treatment")).alias("w")).collect()
    assert [r.w for r in rows] == [pytest.approx(1 / 0.3), pytest.approx(1 / 0.3), pytest.approx(100)]


def test_balance(spark):
    values = [(1, float(v)) for v in (10, 12, 11, 13)] + [(0, float(v)) for v in (8, 9, 10, 7)]
    rows = frame(spark, [("x", t, v, 1.0) for t, v in values], "covariate string, treatment int, value double, weight double")
    plain, even = survival.smd(rows).first().smd, survival.weighted_smd(rows).first().smd
    assert plain == pytest.approx(3 / math.sqrt(5 / 3)) == pytest.approx(even)
    assert survival.smd(rows.where("value = 10")).first().smd == 0


def test_matching_without_replacement(spark):
    rows = frame(spark, [(1, 1, 0.3), (2, 1, 0.5), (3, 1, 0.7), (4, 0, 0.32), (5, 0, 0.48), (6, 0, 0.72), (7, 0, 0.1)], "person_id long, treatment int, ps double")
    assert sorted((r.person_id, r.control_id) for r in matching.by_score(rows, 0.05).collect()) == [(1, 4), (2, 5), (3, 6)]


def test_cox_without_penalty_meets_its_score_equation(spark):
    data = [(1.0, 1, 0.0), (2.0, 1, 1.0), (3.0, 0, 0.0), (4.0, 1, 1.0), (5.0, 1, 0.0), (6.0, 0, 1.0)]
    fit = survival.cox(frame(spark, data, "time double, event int, x double"), ["x"], penalty=0.0)
    b, score = fit["x"]["log_hr"], 0.0
    for t, e, x in data:
        if e:
            risk = [(math.exp(b * z), z) for s, _, z in data if s >= t]
            score += x - sum(w * z for w, z in risk) / sum(w for w, _ in risk)
    assert score == pytest.approx(0, abs=1e-6)


def test_times_to_event(spark):
    rows = frame(spark, [("2020-01-01", "2020-07-01", None), ("2020-01-01", "2021-06-01", None), ("2020-01-01", None, "2020-01-11"), ("2020-01-01", "2020-01-01", None)], "i string, e string, o string").select(*(F.to_date(c).alias(c) for c in "ieo"))
    time, event = cohorts.censored(F.col("i"), F.col("e"), F.col("o"), 365)
    assert [tuple(r) for r in rows.select(time, event).collect()] == [(182, 1), (365, 0), (10, 0), (365, 0)]


def test_overlap_of_cohorts(spark):
    a, b = (frame(spark, [(i,) for i in x], "subject_id long") for x in ((1, 2, 3, 4, 5), (3, 4, 5, 6, 7)))
    r = cohorts.overlap(a, b).first()
    assert (r.n_both, r.only_left, r.only_right, r.f1) == (3, 2, 2, 0.6)
    none = cohorts.overlap(a, b.limit(0)).first()
    assert (none.n_right, none.precision, none.jaccard) == (0, 0.0, 0.0)


def test_eras_join_what_touches(spark):
    days = frame(spark, [(1, "2020-01-01", "2020-01-05"), (1, "2020-01-03", "2020-01-04"), (1, "2020-01-10", "2020-01-12"), (1, "2020-03-01", "2020-03-02")], "person_id long, a string, b string").select("person_id", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"))
    assert sorted(r.n for r in cohorts.eras(days, 0).collect()) == [1, 1, 2] and sorted(r.n for r in cohorts.eras(days, 5).collect()) == [1, 3]


def test_closure_keeps_direct_invalid_and_drops_invalid_below(spark):
    concept = frame(spark, [(1, None), (2, "D"), (3, None), (4, "D"), (5, None)], "concept_id long, invalid_reason string")
    tree = frame(spark, [(i, i, 0) for i in range(1, 6)] + [(1, 3, 1), (1, 4, 1)], "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int")
    maps = frame(spark, [(5, 3, "Maps to")], "concept_id_1 long, concept_id_2 long, relationship_id string")
    kind = "codeset_id int, concept_id long, include_descendants boolean, include_mapped boolean, is_excluded boolean"

    def closed(*items):
        return sorted(r.concept_id for r in vocabulary.closure(frame(spark, [(1, *i) for i in items], kind), tree, maps, concept).collect())

    assert closed((1, True, False, False), (2, False, False, False)) == [1, 2, 3]
    assert closed((1, True, True, False), (99, True, True, False)) == [1, 3, 5]
    assert closed((1, True, False, False), (3, False, False, True)) == [1]
    assert [r.concept_id for r in vocabulary.unresolvable(frame(spark, [(1, 99, True, True, False)], kind), concept).collect()] == [99]


def test_broad_concepts_stay_if_all_are(spark):
    tree = frame(spark, [(1, i, 1) for i in range(2, 6)], "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int")
    c = frame(spark, [(1,), (2,)], "concept_id long")
    assert [r.concept_id for r in vocabulary.not_overbroad(c, tree, 3).collect()] == [2]
    assert [r.concept_id for r in vocabulary.not_overbroad(c.where("concept_id = 1"), tree, 3).collect()] == [1]


def test_fusion(spark):
    lists = frame(spark, [("a", 1, 7, 1), ("b", 1, 7, 2), ("b", 1, 8, 1)], "source string, query_id int, item_id int, rank int")
    got = {r.item_id: r.score for r in retrieval.fused(lists).collect()}
    assert got[7] == pytest.approx(1 / 61 + 1 / 62) and got[8] == pytest.approx(1 / 61)


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("HbA1c >= 7.0%", [("gte", 7.0, None, "absolute", 8554)]),
        ("platelets greater than or equal to 100,000 cells/uL", [("gte", 100000.0, None, "absolute", 8784)]),
        ("ALT > 3 x ULN", [("gt", 3.0, None, "uln", None)]),
        ("LDL between 70 and 190 mg/dL", [("bt", 70.0, 190.0, "absolute", 8840)]),
        ("BMI 30 kg/m2 or more", [("gte", 30.0, None, "absolute", 9531)]),
        ("age above 50 years", []),
        ("more than 50 % stenosis", []),
        ("at least 2 of the following", []),
        (None, []),
    ],
)
def test_thresholds(said, want):
    assert [(t["op"], t["value"], t["high"], t["bound"], t["unit_concept_id"]) for t in text.thresholds(said)] == want


@pytest.mark.parametrize(("said", "want"), [("within 6 months", (-180, 0)), ("more than 30 days prior", (-9999, -30)), ("in the last 24 hours", (-1, 0)), ("aged 18 years", None), ("2 weeks after surgery", (0, 14)), ("no time here", None)])
def test_intervals(said, want):
    assert text.interval(said) == want


def test_reading_a_data_set_tolerates_missing_tables(spark, tmp_path):
    spark.range(2).select(F.col("id").alias("person_id"), F.lit(1950).alias("year_of_birth"), F.lit(8507).alias("gender_concept_id"), F.lit(0).alias("race_concept_id")).write.parquet(str(tmp_path / "person.parquet"))
    tables = cdm.read_cdm(spark, str(tmp_path))
    assert tables["person"].count() == 2 and tables["concept"].count() == 0
    cdm.register(tables, "t_")
    assert spark.sql("SELECT count(*) FROM t_person").first()[0] == 2


def test_stream_of_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(live).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM hourly").first()[0] == events.count()
    finally:
        q.stop()
