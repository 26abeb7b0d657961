"""The table of cohorts and the path from two arms to a hazard ratio."""

import datetime as dt
import math
import random

import pytest

from tessera.operators import dataset
from tessera.sources.results import Results, bound_scan

DAY = dt.date(2020, 1, 1)


def test_results_are_created_added_to_and_replaced(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(d, s, DAY, DAY) for d, s in r], "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date")
    table = Results(spark, str(tmp_path / "cohort"))
    got = lambda *d: sorted((r.cohort_definition_id, r.subject_id) for r in table.read(*d).collect())
    table.create()
    assert got() == []
    table.append(rows((1, 10), (2, 20)))
    table.append(rows((1, 11)))
    assert got(1) == [(1, 10), (1, 11)] and got() == [(1, 10), (1, 11), (2, 20)]
    table.replace(rows((1, 12)))
    assert got() == [(1, 12), (2, 20)]
    table.create()
    assert got() == []


def test_bound_values_are_not_pasted(spark):
    people = spark.createDataFrame([(1, "a"), (2, "x' OR '1'='1")], "id int, name string")
    assert [r.id for r in bound_scan(spark, "SELECT id FROM {people} WHERE name = :name", {"people": people}, name="x' OR '1'='1").collect()] == [2]
    with pytest.raises(ValueError):
        bound_scan(spark, "SELECT 1", {"a; b": people})


def arms(spark, n=300, effect=1.0):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        age, male = rnd.uniform(30, 80), float(rnd.random() < 0.5)
        treated = int(rnd.random() < 1 / (1 + math.exp(-(age - 55) / 15)))
        time = rnd.expovariate(0.004 * math.exp(effect * treated + (age - 55) / 40))
        rows.append((i, treated, int(min(time, 365)) + 1, int(time < 365), age, male, 1.0))
    return spark.createDataFrame(rows, "person_id long, treatment int, time int, event int, age double, male double, constant double")


@pytest.mark.parametrize("method", ["IPTW", "PSM", "MAHALANOBIS"])
def test_every_method_finds_the_effect_and_balances(spark, method):
    done = dataset.analysed(arms(spark), ["age", "male", "constant"], method)
    assert done.method == method and 0.4 < done.hazard["log_hr"] < 1.6
    change = {r.covariate: (r.smd_before, r.smd_after) for r in done.balance.collect()}
    assert set(change) == {"age", "male"} and change["age"][1] < change["age"][0]


def test_without_pairs(spark):
    rows = [(i, int(i < 40), 10 + i, 1, 20.0 + i + (200.0 if i < 40 else 0.0)) for i in range(80)]
    frame = spark.createDataFrame(rows, "person_id long, treatment int, time int, event int, age double")
    assert dataset.analysed(frame, ["age"], "PSM").method == "IPTW (fallback)"
    with pytest.raises(ValueError, match="no pair"):
        dataset.analysed(frame, ["age"], "MAHALANOBIS")
    with pytest.raises(ValueError, match="no such method"):
        dataset.analysed(frame, ["age"], "OTHER")


def test_two_arms_with_history(spark):
    span = lambda *r: spark.createDataFrame(list(r), "person_id long, cohort_start_date date, cohort_end_date date")
    later = lambda n: DAY + dt.timedelta(n)
    person = spark.createDataFrame([(1, 1970, 8507), (2, 1980, 8532)], "person_id long, year_of_birth int, gender_concept_id int")
    events = spark.createDataFrame([(1, 7, later(-10)), (2, 7, later(5)), (3, 9, later(-1))], "person_id long, concept_id long, start_date date")
    outcome = spark.createDataFrame([(1, later(30)), (2, later(-30)), (3, later(400))], "person_id long, start_date date")
    frame = dataset.two_arms(span((1, DAY, later(9))), span((1, DAY, later(9)), (2, DAY, later(9)), (3, DAY, later(9))), person, outcome)
    frame, names = dataset.with_history(frame, events, least=0.0)
    got = {r.person_id: r for r in frame.collect()}
    assert [(i, r.treatment, r.time, r.event, r.age, r.male) for i, r in sorted(got.items())] == [(1, 1, 30, 1, 50.0, 1.0), (2, 0, 365, 0, 40.0, 0.0), (3, 0, 365, 0, None, None)]
    assert sorted(names) == ["c_7", "c_9"] and (got[1].c_7, got[1].c_9, got[3].c_9, got[2].c_7) == (1.0, 0.0, 1.0, 0.0)
