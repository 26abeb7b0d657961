"""Checks on criteria held as rows: units, windows, choices and polarity must be told apart."""

from tessera.operators import criteria

SCHEMA = "id long, document long, rule long, any_of boolean, domain string, codeset long, absent boolean, w_start int, w_end int, low double, high double, unit long"


def rows(spark, *given):
    base = {"document": 1, "rule": 1, "any_of": False, "domain": "Measurement", "codeset": 5, "absent": False, "w_start": -365, "w_end": 0, "low": None, "high": None, "unit": None}
    full = [{"id": i, **base, **g} for i, g in enumerate(given)]
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in SCHEMA.split(", ")) for f in full], SCHEMA)


def test_bands_of_other_units_and_windows_are_no_alternatives(spark):
    band = lambda low, high, **more: {"low": low, "high": high, **more}
    r = rows(spark, band(5.0, 7.0, unit=8840), band(6.0, 9.0, unit=8753), band(6.0, 8.0, unit=8840, w_start=-30), band(6.5, 8.5, unit=8840), band(5.0, 7.0), band(6.0, 9.0))
    got = sorted(((x.unit, x.w_start, x.low, x.high) for x in criteria.alternative_bands(r).collect()), key=repr)
    assert got == sorted([(8840, -365, 5.0, 8.5), (None, -365, 5.0, 9.0)], key=repr)
    assert criteria.alternative_bands(r.limit(0)).count() == 0


def test_ranges_are_covered_in_their_unit_and_window_alone(spark):
    ask = {"low": 5.0, "high": 7.0, "unit": 8840}
    cases = [
        ([{"low": 4.0, "high": 8.0, "unit": 8840}], True), ([{"low": 4.0, "high": 8.0, "unit": 8753}], False), ([{"low": 4.0, "high": 8.0}], True), ([{"low": 4.0, "high": 8.0, "unit": 8840, "w_start": -3000, "w_end": -2000}], False),
        ([{"low": 4.0, "high": 8.0, "w_start": -3000}], True), ([{"low": 4.0, "high": 8.0, "any_of": True}], False), ([{"low": 4.0, "high": 6.0}, {"low": 6.0, "high": 8.0, "unit": 8840}], True), ([{"low": 4.0, "high": 6.0}, {"low": 6.5, "high": 8.0}], False), ([{"low": 5.0}], True), ([{}], True), ([{"low": 6.0}], False),
    ]
    given, want = [], []
    for n, (absences, hit) in enumerate(cases):
        if hit:
            want.append(len(given))
        given += [{**ask, "document": n}, *({**a, "absent": True, "document": n} for a in absences)]
    assert sorted(x.id for x in criteria.covered(rows(spark, *given)).collect()) == want


def test_any_unit_asked_for_can_be_covered_in_one(spark):
    r = rows(spark, {"low": 5.0, "high": 7.0}, {"low": 4.0, "high": 6.0, "unit": 1, "absent": True}, {"low": 6.0, "high": 8.0, "unit": 2, "absent": True}, {"document": 2, "low": 5.0, "high": 7.0}, {"document": 2, "low": 4.0, "high": 9.0, "unit": 1, "absent": True})
    assert [x.id for x in criteria.covered(r).collect()] == [3]


def test_restated_and_split_bounds_share_unit_and_window(spark):
    yes, no = {"low": 5.0, "high": 9.0, "unit": 1}, {"low": 9.0, "absent": True, "unit": 1}
    r = rows(spark, yes, no, {**no, "unit": 2}, {**no, "w_start": -30}, {**no, "low": 8.0})
    assert [x.id for x in criteria.restated(r).collect()] == [1]
    r = rows(spark, {"low": 5.0, "unit": 1}, {"low": 9.0, "absent": True, "unit": 1}, {"rule": 2, "low": 5.0, "unit": 1}, {"rule": 2, "low": 9.0, "absent": True, "unit": 2}, {"rule": 3, "low": 5.0}, {"rule": 3, "low": 9.0, "absent": True})
    assert sorted((x.rule, x.unit, x.low, x.high) for x in criteria.split_bands(r).where("unit IS NOT NULL").collect()) == [(1, 1, 5.0, 9.0)]
    assert [x.rule for x in criteria.split_bands(r).where("unit IS NULL").collect()] == [3]
