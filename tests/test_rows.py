"""Cohort documents as rows and back, checks by what criteria select, and repairs that give documents again."""

import json

from pyspark.sql import functions as F

from tessera.operators import document_checks as checks
from tessera.plans import rows as R

WINDOW = {"Start": {"Days": 180, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}}
YES, NO = {"Type": 2, "Count": 1}, {"Type": 0, "Count": 0}


def entry(codeset, how=YES, bound=None, unit=None, window=WINDOW, domain="Measurement", **more):
    body = {"CodesetId": codeset, **more}
    if bound:
        body["ValueAsNumber"] = dict(zip(("Op", "Value", "Extent"), bound))
    if unit:
        body["Unit"] = [{"CONCEPT_ID": u} for u in unit]
    return {"Criteria": {domain: body}, "Occurrence": how} | ({"StartWindow": window} if window else {})


def group(*criteria, kind="ALL", groups=()):
    return {"Type": kind, "CriteriaList": list(criteria), "DemographicCriteriaList": [], "Groups": list(groups)}


def rule(expression, name="r"):
    return {"name": name, "expression": expression}


def sets(**members):
    items = lambda ids: [{"concept": {"CONCEPT_ID": abs(i), "CONCEPT_NAME": f"c{abs(i)}"}, "isExcluded": i < 0, "includeDescendants": True} for i in ids]
    return [{"id": int(k[1:]), "name": f"set {k}", "expression": {"items": items(v)}} for k, v in members.items()]


def document(*rules, entries=(9,), **members):
    members = members or {"s1": [10, 11], "s2": [10, 11], "s3": [30], "s9": [90]}
    return {"ConceptSets": sets(**members), "PrimaryCriteria": {"CriteriaList": [{"DrugExposure": {"CodesetId": e}} for e in entries]}, "InclusionRules": list(rules), "cdmVersionRange": ">=5.0.0"}


def frame(spark, *documents):
    return spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "document long, expression string")


def opened(spark, *documents):
    return R.rows_of(frame(spark, *documents))


def places(found):
    return sorted((r.document, r.rule, r.path, r.nth) for r in found.collect())


def again(rows):
    return {r.document: json.loads(r.expression) for r in R.documents_of(rows).collect()}


DEEP = document(
    rule(group(entry(1), groups=[group(entry(2, NO), kind="ANY", groups=[group(groups=[group(entry(3, bound=("bt", 1.5, 2)))])]), group()]), "deep é \"quoted\" \\ /"),
    {"name": "no expression"}, {"expression": {"Type": "ALL"}}, rule({}, None),
)


def test_documents_come_back_as_they_were(spark):
    plain = [
        DEEP, document(), {}, {"InclusionRules": []}, {"ConceptSets": [{"id": 1}], "InclusionRules": None}, {"ConceptSets": {"a": 1}, "InclusionRules": [{"expression": None}, {"expression": [1]}]}, {"extra": [1, {"a": None}], "ConceptSets": [], "n": 1.25, "t": True},
        document(rule({"Type": "ANY", "CriteriaList": [{"Criteria": {"DrugEra": {"CodesetId": 1, "First": True, "EraLength": {"Op": "gt", "Value": 3}}}, "Odd": [None]}], "DemographicCriteriaList": [{"Age": {"Value": 18, "Op": "gte"}}]})),
    ]
    assert again(opened(spark, *plain)) == dict(enumerate(plain))


def test_expressions_are_unwrapped_and_what_is_none_is_told(spark):
    wrapped = [{"expression": DEEP}, {"expression": json.dumps(DEEP)}, None, "", "not json", "[1]", "3", {"id": 3}]
    docs = frame(spark, *wrapped)
    assert again(R.rows_of(docs)) == {0: DEEP, 1: DEEP, 7: {"id": 3}}
    assert sorted(r.document for r in R.rejected(docs).collect()) == [2, 3, 4, 5, 6]
    assert R.documents_of(R.rows_of(docs.limit(0))).count() == 0


def test_columns_say_what_criteria_say(spark):
    d = document(rule(group(entry(1, NO, ("!bt", 5, 7), [8, 3, 8], {"Start": {"Days": 30, "Coeff": -1}, "End": {"Days": 1, "Coeff": -1}}), entry(1, window=None), entry(2, domain="DrugExposure", window=WINDOW | {"UseIndexEnd": True}), {"Criteria": {"Measurement": {"CodesetId": 3, "Abnormal": True}}, "Occurrence": {"Type": 1, "Count": 2}}, {"Criteria": {"Death": {}}}, {}, None)))
    a, b, c, e, *none = R.rows_of(frame(spark, d)).criteria.orderBy("nth").collect()
    assert (a.domain, a.codeset, a.absent, a.required, a.w_start, a.w_end, a.op, a.value, a.extent, a.units, a.bare) == ("Measurement", 1, True, False, -30, -1, "!bt", 5, 7, [3, 8], False)
    assert (b.w_start, b.end_day, b.bare, b.units) == (None, None, True, []) and (c.w_end, c.end_day, c.domain) == (None, None, "DrugExposure")
    assert json.loads(e.residue) == {"Abnormal": True} and not e.absent and not e.required
    assert [(x.domain, x.codeset, x.absent, x.required, x.units) for x in none] == [(None, None, False, False, [])] * 3


def test_any_of_absences_alone_is_told(spark):
    any_absent = group(kind="ANY", groups=[group(entry(1, NO)), group(entry(2, NO), groups=[group(entry(3, NO))])])
    r = opened(spark, document(rule(any_absent, "x"), rule(any_absent | {"Type": "ALL"}), rule(group(kind="ANY", groups=[group(entry(1, NO))])), rule(group(kind="ANY", groups=[group(entry(1, NO)), group(entry(2))])), rule(group(kind="ANY", groups=[group(), group()]))))
    assert [x.name for x in checks.no_op_rules(r).collect()] == ["x"]


def test_washouts_on_the_entry_end_before_the_index(spark):
    before = {"Start": {"Days": 365, "Coeff": -1}, "End": {"Days": 1, "Coeff": -1}}
    after = {"Start": {"Days": 0, "Coeff": 1}, "End": {"Days": 30, "Coeff": 1}}
    d = document(rule(group(entry(4, NO), entry(4, NO, window=before), entry(4, NO, window=None), entry(3, NO), entry(4), entry(4, NO, window=after), entry(5, NO))), rule(group(entry(4, NO), kind="ANY")), s3=[30], s4=[90, 40], s5=[-90, 50], s9=[90, 91])
    r = opened(spark, d)
    assert places(checks.washouts(r)) == [(0, 0, "", 0), (0, 0, "", 2), (0, 0, "", 5)]
    moved = again(checks.washouts_before_index(r))[0]
    want = json.loads(json.dumps(d))
    want["InclusionRules"][0]["expression"]["CriteriaList"][0]["StartWindow"]["End"] = {"Days": 1, "Coeff": -1}
    assert moved == want


def test_the_same_set_under_two_numbers_contradicts(spark):
    far = {"Start": {"Days": 900, "Coeff": -1}, "End": {"Days": 400, "Coeff": -1}}
    d = document(rule(group(entry(1), entry(2, bound=("gte", 6)))), rule(group(entry(2, NO))))
    e = document(rule(group(entry(1))), rule(group(entry(2, NO, ("gte", 6)), entry(3, NO), entry(1, NO, window=far))), rule(group(entry(1, NO), kind="ANY")))
    assert places(checks.contradicted(opened(spark, d, e))) == [(0, 0, "", 0), (0, 0, "", 1)]


def test_rules_all_of_whose_criteria_are_forbidden(spark):
    either = lambda *c: rule(group(kind="ANY", groups=[group(x) for x in c]))
    low, high = ("gte", 6.5), ("lte", 10.0)
    no = rule(group(entry(2, NO, low, [8]), entry(2, NO, high, [8])))
    d = [document(either(entry(1, YES, low, [8]), entry(1, YES, high, [8])), no), document(either(entry(1, YES, low, [8]), entry(1, YES, high, [7])), no), document(either(entry(1, YES, low, [8]), entry(3)), no), document(either(entry(1, YES, low, [8], Abnormal=True)), no)]
    assert [(r.document, r.rule, r.n_required) for r in checks.unsatisfiable_rules(opened(spark, *d)).collect()] == [(0, 0, 2)]


HELD = [
    # presence, absences, covered
    ((("bt", 6.5, 10), None), [(("gte", 6.5), [8554])], True),
    ((("bt", 6.5, 10), None), [(("gt", 6.5), [8554])], False),
    ((("gt", 6.5), None), [(("gt", 6.5), None)], True),
    ((("gte", 6.5), None), [(("gt", 6.5), None)], False),
    ((("gte", 6.5), None), [(("gte", 10), None)], False),
    ((("bt", 5, 9), None), [(("lte", 7), None), (("gt", 7), None)], True),
    ((("bt", 5, 9), None), [(("lt", 7), None), (("gt", 7), None)], False),
    ((("bt", 5, 9), None), [(("lt", 7), [1]), (("gte", 7), [2])], False),
    ((("bt", 5, 9), None), [(("lt", 7), [1]), (("gte", 7), None)], True),
    ((("bt", 5, 7), [1]), [(None, [2])], False),
    ((("bt", 5, 7), [1, 2]), [(None, [2])], True),
    ((("neq", 5), None), [(("lt", 5), None), (("gt", 5), None)], True),
    ((None, None), [(("neq", 5), None)], False),
    ((None, None), [(("neq", 5), None), (("eq", 5), None)], True),
    ((("!bt", 5, 9), None), [(("lt", 5), None)], False),
]


def test_ranges_that_absences_cover(spark):
    docs = [document(rule(group(entry(1, YES, *p))), *(rule(group(entry(2, NO, *a))) for a in absences)) for p, absences, _ in HELD]
    assert places(checks.covered(opened(spark, *docs))) == [(i, 0, "", 0) for i, (_, _, hit) in enumerate(HELD) if hit]


def test_absences_elsewhere_or_at_other_times_cover_nothing(spark):
    years_ago = {"Start": {"Days": 3000, "Coeff": -1}, "End": {"Days": 2000, "Coeff": -1}}
    wide = {"Start": {"Days": 3000, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}}
    bound = ("bt", 5, 7)
    docs = [
        document(rule(group(entry(1, YES, bound))), rule(group(entry(1, NO, bound, window=years_ago)))),
        document(rule(group(entry(1, YES, bound))), rule(group(entry(1, NO, bound, window=wide)))),
        document(rule(group(entry(1, YES, bound))), rule(group(entry(3, NO, bound)))),
        document(rule(group(entry(1, YES, bound))), rule(group(entry(1, NO, bound, Abnormal=True)))),
        document(rule(group(entry(1, YES, bound), kind="ANY")), rule(group(entry(1, NO, bound)))),
        document(rule(group(entry(1, YES, bound, window=None))), rule(group(entry(1, NO, bound, window=None)))),
    ]
    assert [x[0] for x in places(checks.covered(opened(spark, *docs)))] == [1, 5]


ANY_OF = lambda low, high: group(kind="ANY", groups=[group(low), group(high)])
NAME = "HbA1c at least 6.5% + HbA1c at most 10.0%"


def resolved(rows):
    """Every concept for itself: 10 and 11 are one closure whatever the set's number."""
    return rows.items.where("NOT is_excluded").select("document", "codeset", "concept_id").unionByName(rows.items.where("concept_id = 30").select("document", "codeset", F.lit(90).cast("long").alias("concept_id")))


LOW, HIGH = ("gte", 6.5), ("lte", 10.0)
#: lower bound, upper bound, name of the rule, whether they mean one range.
RANGES = [
    (LOW, HIGH, NAME, True), (("gt", 6.5), HIGH, NAME, False), (("gte", 10.0), ("lte", 6.5), NAME, False), (LOW, HIGH, "HbA1c at least 6.5% + glucose at most 10.0%", False),
    (LOW, HIGH, "HbA1c at least 6.5% + HbA1c at most 9%", False), (LOW, HIGH, "HbA1c between limits", False), (LOW, ("gte", 10.0), NAME, False), (LOW, HIGH, None, False),
]


def test_two_bounds_of_one_measurement_become_a_range(spark):
    other = WINDOW | {"Start": {"Days": 90, "Coeff": -1}}
    docs = [document(rule(ANY_OF(entry(1, YES, low, [8]), entry(2, YES, high, [8])), name), rule(group(entry(3)), "other")) for low, high, name, _ in RANGES]
    want = json.loads(json.dumps(docs))
    for d, (*_, joined) in zip(want, RANGES):
        if joined:
            d["InclusionRules"][0]["expression"] = group(entry(1, YES, ("bt", 6.5, 10.0), [8]))
    # what differs in its closure, unit, window or polarity stays two
    for high in (entry(3, YES, HIGH, [8]), entry(2, YES, HIGH, [9]), entry(2, YES, HIGH, [8], other), entry(2, NO, HIGH, [8])):
        docs.append(document(rule(ANY_OF(entry(1, YES, LOW, [8]), high), NAME)))
        want.append(docs[-1])
    r = opened(spark, *docs)
    assert again(checks.ranges_joined(r, checks.closure_keys(resolved(r)))) == dict(enumerate(want))


SIDES = "HbA1c below lower limit + HbA1c above upper limit"


#: forbidden bounds, name of the rule, whether it says a range of another rule again.
RESTATED = [
    ((LOW, HIGH), SIDES, True), ((("gte", 10.0), ("lte", 6.5)), SIDES, False), ((("lt", 6.5), ("gt", 10.0)), SIDES, False), ((("gte", 6.0), ("lte", 10.5)), SIDES, False),
    ((LOW, HIGH), "glucose below lower limit + glucose above upper limit", False), ((LOW, HIGH), "HbA1c above limit + HbA1c below limit", False), ((LOW, HIGH), "HbA1c out of range", False), ((LOW, HIGH), None, False),
]


def test_a_range_read_twice_is_asked_once(spark):
    kept = rule(group(entry(1, YES, ("bt", 6.5, 10.0))), NAME)
    docs = [document(kept, rule(group(*(entry(2, NO, b, [8]) for b in bounds)), name), rule(group(entry(3, NO)), "other")) for bounds, name, _ in RESTATED]
    want = [d | {"InclusionRules": [d["InclusionRules"][0], d["InclusionRules"][2]]} if gone else d for d, (*_, gone) in zip(docs, RESTATED)]
    docs.append(document(kept, docs[0]["InclusionRules"][1], rule(group(entry(1, YES, ("bt", 7, 9))))))  # two presences: which one is meant?
    r = opened(spark, *docs)
    assert again(checks.restated_absences_removed(r, checks.closure_keys(resolved(r)))) == dict(enumerate([*want, docs[-1]]))


def test_both_repairs_make_an_empty_cohort_possible(spark):
    d = document(rule(ANY_OF(entry(1, YES, ("gte", 6.5), [8]), entry(2, YES, ("lte", 10.0), [8])), NAME), rule(group(entry(1, NO, ("gte", 6.5), [8]), entry(2, NO, ("lte", 10.0), [8])), SIDES))
    r = opened(spark, d)
    assert checks.unsatisfiable_rules(r).count() == 1
    fixed = checks.repaired(r, resolved(r))
    assert checks.unsatisfiable_rules(fixed).count() == 0 and checks.covered(fixed).count() == 0
    assert again(fixed)[0]["InclusionRules"] == [rule(group(entry(1, YES, ("bt", 6.5, 10.0), [8])), NAME)]


def test_a_stated_exception_is_carried_out(spark):
    drug = lambda s, **k: entry(s, NO, domain="DrugExposure", **k)
    stated, before = "Endocrine disorder (excluding T2DM)", {"Start": {"Days": 9, "Coeff": -1}, "End": {"Days": 1, "Coeff": -1}}
    members = {"s3": [30], "s4": [40], "s9": [90]}  # 3 resolves to the entry's concept too
    docs = [
        document(rule(group(drug(3)), stated), **members), document(rule(group(drug(3)), "Endocrine disorder"), **members), document(rule(group(drug(3, window=before)), stated), **members),
        document(rule(group(drug(3), kind="ANY"), stated), **members), document(rule(group(drug(4)), stated), **members), document(rule(group(drug(3)), stated), **(members | {"s9": [90, -91]})), document(rule(group(drug(3)), stated), **(members | {"s3": [30, -90]})),
    ]
    r = opened(spark, *docs)
    got = again(checks.entry_exclusions_mirrored(r, resolved(r)))
    want = json.loads(json.dumps(docs[0]))
    want["ConceptSets"][0]["expression"]["items"].append({"concept": {"CONCEPT_ID": 90, "CONCEPT_NAME": "c90"}, "isExcluded": True, "includeDescendants": True})
    assert got[0] == want and all(got[i] == docs[i] for i in range(1, len(docs)))


EXCEPTIONS = [
    ("insulin other than human NPH insulin", ["human NPH insulin"]), ("Endocrine disorder (excluding T2DM)", ["T2DM"]), ("cancer other than non-melanoma skin cancer within last 3 years", ["non-melanoma skin cancer"]),
    ("agents except GLP-1/DPP-4/SGLT-2", ["GLP-1", "DPP-4", "SGLT-2"]), ("tumour except skin of head/neck", ["skin of head/neck"]), ("insulin but not human NPH, long-acting analogue, or premixed insulin", ["human NPH", "long-acting analogue", "premixed insulin"]),
    ("cancer other than specified types", None), ("any drug other than the above", None), ("less than 5 years", None), ("A + cancer other than skin cancer", None), (None, None), ("", None), ("other than x", None),
]


def test_exceptions_in_prose(spark):
    got = spark.createDataFrame([(t,) for t, _ in EXCEPTIONS], "t string").select(checks.exception(F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == [parts for _, parts in EXCEPTIONS]


def test_units_go_only_where_no_other_unit_can_pass(spark):
    allowed = spark.createDataFrame([("a1c", 10, 8554, 15.0, 200.0), ("a1c", 11, 8554, 15.0, 200.0), ("other", 30, 1, 0.0, 1.0)], "analyte string, concept_id long, unit_id long, other_low double, other_high double")
    cases = [(entry(1, YES, ("bt", 6.5, 10), [8554]), True), (entry(1, YES, ("gte", 6.5), [8554]), False), (entry(1, YES, ("lt", 15), [8554]), True), (entry(1, YES, ("lte", 15), [8554]), False), (entry(1, NO, ("bt", 6.5, 10), [8554]), False), (entry(1, YES, ("bt", 6.5, 10), [7]), False), (entry(4, YES, ("bt", 6.5, 10), [8554]), False), (entry(1, YES, None, [8554]), False)]
    d = document(rule(group(*(c for c, _ in cases))), s1=[10, 11], s4=[10, 99], s9=[90])
    got = again(checks.units_dropped(opened(spark, d), allowed))[0]["InclusionRules"][0]["expression"]["CriteriaList"]
    assert [("Unit" not in g["Criteria"]["Measurement"]) for g in got] == [hit for _, hit in cases]
