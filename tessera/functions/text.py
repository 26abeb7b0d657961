"""Thresholds, units, intervals and codes in criteria text: small per-row parsers, run as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of comparators, most specific first.
COMPARATORS = (
    ("gte", ("greater than or equal to", "at least", "no less than", "not less than", "or more", "or higher", ">=", "≥", "=>")),
    ("lte", ("less than or equal to", "at most", "no more than", "not more than", "or less", "or lower", "up to", "<=", "≤", "=<")),
    ("gt", ("greater than", "more than", "higher than", "above", "over", "exceeding", ">")),
    ("lt", ("less than", "lower than", "fewer than", "below", "under", "<")),
    ("eq", ("equal to", "=")),
)
# Unit spellings and the unit concept each stands for.
UNITS = {
    "mg/dl": 8840, "mmol/l": 8753, "g/dl": 8713, "%": 8554, "percent": 8554, "kg": 9529, "mmhg": 8876, "mm hg": 8876, "kg/m2": 9531, "kg/m^2": 9531, "ml/min": 8795, "ml/min/1.73m2": 9117, "ml/min/1.73 m2": 9117,
    "iu/l": 8923, "u/l": 8645, "ng/ml": 8842, "pg/ml": 8845, "meq/l": 9557, "bpm": 8541, "cells/ul": 8784, "umol/l": 8749, "μmol/l": 8749,
}
# Days of a unit of time.
DAYS = {"hour": 1, "day": 1, "week": 7, "month": 30, "year": 365}
_NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_WORDS = {spelling: op for op, spellings in COMPARATORS for spelling in spellings}
_AHEAD = "|".join(re.escape(s) for s in sorted((s for s in _WORDS if not s.startswith("or ")), key=len, reverse=True))
_BEHIND = "|".join(s for s in _WORDS if s.startswith("or "))
_UNIT = "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))
_LIMIT = r"(?:\s*(?:x|times|×)?\s*(?:the\s+)?(uln|lln|upper limit of normal|lower limit of normal))"
_THRESHOLD = re.compile(rf"(?P<op>{_AHEAD})\s*{_NUMBER}{_LIMIT}?\s*(?P<unit>{_UNIT})?", re.I)
_TRAILING = re.compile(rf"{_NUMBER}{_LIMIT}?\s*(?P<unit>{_UNIT})?\s*(?P<op>{_BEHIND})", re.I)
_RANGE = re.compile(rf"(?:between\s+)?{_NUMBER}\s*(?P<unit>{_UNIT})?\s*(?:-|–|to|and)\s*{_NUMBER}\s*(?P<unit2>{_UNIT})?", re.I)
# What follows or leads a number that is no threshold of a measurement.
_NOT_MEASURED = re.compile(r"^\s*(?:years?|yrs?|months?|weeks?|days?|hours?|mg\b(?!/)|tablets?|doses?|of the following|criteria|vessels?)|^\s*%\s*(?:stenosis|confidence|ci)\b", re.I)
_STATISTIC = re.compile(r"\b(?:p|alpha|power|hazard ratio|hr|or|ci)\s*$", re.I)
SCHEMA = T.ArrayType(
    T.StructType([T.StructField(name, kind) for name, kind in (("op", T.StringType()), ("value", T.DoubleType()), ("high", T.DoubleType()), ("bound", T.StringType()), ("unit_text", T.StringType()), ("unit_concept_id", T.LongType()))])
)


def fold(unit: str | None) -> str | None:
    """A unit's text in one form: compatible characters, no white space around or backslashes."""
    return None if unit is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unit).replace("\\", "")).strip()


def unit_of(unit: str | None) -> int | None:
    """The unit concept of a text: as written, in lower case, or without a plural s; never the nearest."""
    u = (fold(unit) or "").lower()
    return UNITS.get(u) or (UNITS.get(u[:-1]) if u.endswith("s") else None)


def number(s: str) -> float:
    return float(s.replace(",", ""))


def thresholds(text: str | None) -> list[dict]:
    """Numeric conditions of a text in its order: op, value, high (for ranges), bound (absolute, uln, lln), unit."""
    if not text:
        return []
    found, taken = [], []

    def free(m: re.Match) -> bool:
        return not any(a < m.end() and m.start() < z for a, z in taken)

    def bound(word: str | None) -> str:
        return "absolute" if not word else "lln" if word.lower().startswith("l") else "uln"

    def usable(m: re.Match, unit: str | None) -> bool:
        return free(m) and not _STATISTIC.search(text[: m.start()]) and (unit is not None or not _NOT_MEASURED.match(text[m.end() :])) and not re.match(r"\s*%?\s*stenosis", text[m.end() :], re.I)

    for m in _RANGE.finditer(text):
        unit = m["unit2"] or m["unit"]
        low, high = number(m[1]), number(m[3])
        if (unit or m[0].lower().startswith("between")) and low <= high and usable(m, unit):
            taken.append(m.span())
            found.append((m.start(), {"op": "bt", "value": low, "high": high, "bound": "absolute", "unit_text": unit, "unit_concept_id": unit_of(unit)}))
    for pattern in (_TRAILING, _THRESHOLD):
        for m in pattern.finditer(text):
            value, limit = (m[2], m[3]) if pattern is _THRESHOLD else (m[1], m[2])
            if usable(m, m["unit"]):
                taken.append(m.span())
                found.append((m.start(), {"op": _WORDS[m["op"].lower()], "value": number(value), "high": None, "bound": bound(limit), "unit_text": m["unit"], "unit_concept_id": unit_of(m["unit"])}))
    return [x for _, x in sorted(found, key=lambda f: f[0])]


_INTERVAL = re.compile(r"(?P<cue>within|in the (?:last|past|previous)|during the (?:last|past)|prior|over the (?:last|past)|more than|at least|for the (?:next|following))?\s*(?:the\s+)?(?:last\s+|past\s+)?(?P<n>\d+)[\s-]*(?P<unit>hour|day|week|month|year)s?\s*(?P<after>prior|before|ago|after|following)?", re.I)


def interval(text: str | None) -> tuple[int | None, int | None] | None:
    """(start, end) in days from the index that a text states, or None; ages are none. 'more than N ago' reaches back without end."""
    if not text:
        return None
    for m in _INTERVAL.finditer(text):
        cue, after = (m["cue"] or "").lower(), (m["after"] or "").lower()
        if re.search(r"\bage[ds]?\b|years? old|years? of age", text[max(m.start() - 12, 0) : m.end() + 12], re.I) or not (cue or after):
            continue
        days = max(1, int(m["n"]) * DAYS[m["unit"].lower()] if m["unit"].lower() != "hour" else -(-int(m["n"]) // 24))
        if after in ("after", "following") or "next" in cue or "following" in cue:
            return 0, days
        return (-9999, -days) if cue in ("more than", "at least") and after in ("prior", "before", "ago") else (-days, 0)
    return None


@F.pandas_udf(SCHEMA)
def parse_thresholds(texts: pd.Series) -> pd.Series:
    return pd.Series([thresholds(t) for t in texts])


def code_kind(text: Column) -> Column:
    """icd10, numeric (4 to 18 digits) or text."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[A-TV-Z][0-9][0-9AB](\.[0-9A-TV-Z]{1,4})?$"), "icd10").when(t.rlike(r"^[0-9]{4,18}$"), "numeric").otherwise("text")


def distinct_first(rows, key: list[str], order: list[str]):
    """The first row by order of each key."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


# What marks a query as one about time.
TEMPORAL = ("history of", "prior", "previous", "currently", "within", "before", "after", "at least", "at most", "days", "months", "years")
_DOSE = r"\s+[0-9]+(\.[0-9]+)?\s*(MG|ML|MCG|UNT|%).*$"


def is_temporal(query: Column) -> Column:
    low = F.lower(query)
    hit = F.lit(False)
    for word in TEMPORAL:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def ingredients(product: Column) -> Column:
    """A product's ingredient names: its parts between slashes without what follows a dose."""
    return F.transform(F.split(product, " / "), lambda part: F.lower(F.regexp_replace(F.trim(part), _DOSE, "")))


def restated(rows, length: int = 40):
    """stem, n, first: descriptions (id, text) that begin alike once only letters count, with how many and the least id."""
    stem = F.left(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), F.lit(length))
    return rows.select("id", stem.alias("stem")).where("stem <> ''").groupBy("stem").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
