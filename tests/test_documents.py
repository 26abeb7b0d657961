"""Cohort documents: reading, checks and rewrites."""

import json

import pytest

from tessera.plans import passes
from tessera.plans.compile import compile_cohort
from tessera.sources.cdm import Cdm
from tessera.plans.definition import Bound, Cohort, Counted, Criterion, Exit, Group, Item, Rule, Window, parse

SETS = {1: (Item(10, True),), 2: (Item(20),), 3: (Item(30),)}
MEASURED = Criterion("Measurement", 2)


def with_rules(*groups):
    return Cohort(SETS, (Criterion("Drug", 1),), rules=tuple(Rule(f"r{i}", g) for i, g in enumerate(groups)))


def document(**more):
    return {
        "ConceptSets": [{"id": 1, "name": "a", "expression": {"items": [{"concept": {"CONCEPT_ID": 10}, "includeDescendants": True}, {"concept": {}}]}}],
        "PrimaryCriteria": {"CriteriaList": [{"DrugExposure": {"CodesetId": 1, "First": True}}], "ObservationWindow": {"PriorDays": 365, "PostDays": 0}},
        **more,
    }


def test_reads_expression_as_object_or_text():
    plain = parse(document())
    assert plain == parse(json.dumps(document())) == parse({"expression": json.dumps(document())}) == parse({"expression": document()})
    assert plain.prior_days == 365 and plain.entry[0].first and plain.codesets[1] == (Item(10, True),)


def test_windows_are_signed_swapped_and_defaulted():
    rule = {"name": "x", "expression": {"Type": "ALL", "CriteriaList": [
        {"Criteria": {"ConditionOccurrence": {"CodesetId": 1}}, "StartWindow": {"Start": {"Days": 0, "Coeff": 1}, "End": {"Days": 30, "Coeff": -1}}, "Occurrence": {"Type": 0, "Count": 0}},
        {"Criteria": {"Measurement": {"CodesetId": 1}}},
    ]}}
    a, b = parse(document(InclusionRules=[rule])).rules[0].group.criteria
    assert (a.window, a.kind, a.count) == (Window(-30, 0), 0, 0) and b.window == Window(-180, 0)


def test_exits():
    assert parse(document(EndStrategy={"DateOffset": {"Offset": 90}})).exit == Exit("fixed", 90)
    assert parse(document(EndStrategy={"CustomEra": {"DrugCodesetId": 1, "GapDays": 7}})).exit == Exit("era", codeset=1, gap=7)


def test_bounds_reject_nonsense():
    for op, v, x in (("between", 1, None), ("bt", 5, 1), ("bt", 5, None)):
        with pytest.raises(ValueError):
            Bound(op, v, x)


def test_checks():
    c = with_rules(Group(criteria=(Counted(Criterion("Drug", 9, value=Bound("gt", 1))),)), Group(), Group(criteria=(Counted(Criterion("Drug", 0)),)))
    assert {e[0] for e in passes.validate(c)} == {"dangling_codeset", "empty_rule", "codeset_zero", "unreadable_value"}
    with pytest.raises(ValueError):
        passes.prepared(c)


def test_healing_and_pruning():
    c = with_rules(Group(criteria=(Counted(Criterion("Drug", 0)), Counted(MEASURED))), Group(criteria=(Counted(Criterion("Drug", 0)),)))
    healthy, report, share = passes.healed(c)
    assert report == [("r0", "PARTIAL"), ("r1", "SKIP")] and share == pytest.approx(1 / 3) and len(healthy.rules) == 1
    assert set(passes.pruned(healthy).codesets) == {1, 2}


def test_washout_on_the_entry_set_stops_a_day_before():
    c = with_rules(Group(criteria=(Counted(Criterion("Drug", 1), Window(-365, 0), None, 0, 0), Counted(Criterion("Drug", 2), Window(-365, 0), None, 0, 0))))
    a, b = passes.washout_before_index(c).rules[0].group.criteria
    assert a.window == Window(-365, -1) and b.window == Window(-365, 0)


def test_lost_criteria_are_an_error(spark):
    c = with_rules(Group(criteria=(Counted(Criterion("Drug", 0)),)))
    with pytest.raises(ValueError, match="without a concept set"):
        compile_cohort(c, Cdm(spark, "/root/testdata/sf0.001"))


def test_arms():
    made = passes.arms(with_rules(), 3)
    assert [len(made[k].rules) for k in ("target", "treatment", "comparator")] == [0, 1, 1]
    assert made["comparator"].rules[0].group.criteria[0].kind == 0
