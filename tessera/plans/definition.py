"""The declarative cohort document as immutable objects, read from its JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

#: Days back that a criterion looks when it states no window, by domain; all end on the index day.
DEFAULT_LOOKBACK = {"Drug": -365, "Measurement": -180, "Condition": -9999, "Procedure": -9999}
#: JSON names of event types by domain.
DOMAIN_OF = {
    "DrugEra": "Drug", "DrugExposure": "Drug", "ConditionOccurrence": "Condition", "ConditionEra": "Condition",
    "Measurement": "Measurement", "ProcedureOccurrence": "Procedure",
}
OPERATORS = ("gt", "gte", "lt", "lte", "eq", "neq", "bt", "!bt")


@dataclass(frozen=True)
class Bound:
    """A numeric condition; bt is closed, !bt strictly outside."""

    op: str
    value: float
    extent: float | None = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"no such operator: {self.op}")
        if self.op in ("bt", "!bt") and (self.extent is None or self.extent < self.value):
            raise ValueError("a range needs an upper end that is not below its lower one")


@dataclass(frozen=True)
class Window:
    """Closed window in days from the index; None is unbounded. from_end: counted from the day the index event ends; of_end: the event's last day must lie in it, not its first."""

    start: int | None = None
    end: int | None = None
    from_end: bool = False
    of_end: bool = False

    def straightened(self) -> Window:
        if self.start is not None and self.end is not None and self.start > self.end:
            return replace(self, start=self.end, end=self.start)
        return self


@dataclass(frozen=True)
class Criterion:
    domain: str
    codeset: int
    first: bool = False
    value: Bound | None = None
    ratio_high: Bound | None = None
    ratio_low: Bound | None = None
    units: tuple[int, ...] = ()


@dataclass(frozen=True)
class Counted:
    """How often a criterion must hold in its window: kind 0 exactly, 1 at most, 2 at least."""

    criterion: Criterion
    window: Window = field(default_factory=Window)
    end_window: Window | None = None
    kind: int = 2
    count: int = 1


@dataclass(frozen=True)
class Demographic:
    age: Bound | None = None
    genders: tuple[int, ...] = ()


@dataclass(frozen=True)
class Group:
    """kind: ALL, ANY, AT_LEAST or AT_MOST (with count)."""

    kind: str = "ALL"
    count: int = 0
    criteria: tuple[Counted, ...] = ()
    demographics: tuple[Demographic, ...] = ()
    groups: tuple[Group, ...] = ()

    def every(self):
        yield from self.criteria
        for g in self.groups:
            yield from g.every()


@dataclass(frozen=True)
class Rule:
    name: str
    group: Group


@dataclass(frozen=True)
class Item:
    concept_id: int
    descendants: bool = False
    mapped: bool = False
    excluded: bool = False


@dataclass(frozen=True)
class Exit:
    """kind: observation_end, fixed (days from start) or era (drug codeset, gap, offset)."""

    kind: str = "observation_end"
    days: int = 365
    codeset: int | None = None
    gap: int = 30
    offset: int = 0


@dataclass(frozen=True)
class Cohort:
    codesets: dict[int, tuple[Item, ...]]
    entry: tuple[Criterion, ...]
    prior_days: int = 0
    post_days: int = 0
    primary_limit: str = "All"
    rules: tuple[Rule, ...] = ()
    qualified_limit: str = "First"
    expression_limit: str = "First"
    exit: Exit = field(default_factory=Exit)
    censoring: tuple[Criterion, ...] = ()
    era_pad: int = 0

    def referenced(self) -> set[int]:
        used = {c.codeset for c in self.entry} | {c.codeset for c in self.censoring} | {c.criterion.codeset for r in self.rules for c in r.group.every()}
        return used | ({self.exit.codeset} if self.exit.codeset is not None else set())


def _bound(d: dict | None) -> Bound | None:
    return Bound(d["Op"], float(d["Value"]), None if d.get("Extent") is None else float(d["Extent"])) if d else None


def _days(end: dict | None) -> int | None:
    return None if not end or end.get("Days") is None else int(end["Days"]) * int(end.get("Coeff", 1))


def _window(d: dict | None) -> Window:
    d = d or {}
    return Window(_days(d.get("Start")), _days(d.get("End")), bool(d.get("UseIndexEnd")), bool(d.get("UseEventEnd"))).straightened()


def _criterion(d: dict) -> Criterion:
    ((name, body),) = d.items()
    if name not in DOMAIN_OF:
        raise ValueError(f"no such event type: {name}")
    units = tuple(u["CONCEPT_ID"] for u in body.get("Unit", ()))
    return Criterion(DOMAIN_OF[name], body.get("CodesetId", 0), bool(body.get("First")), _bound(body.get("ValueAsNumber")), _bound(body.get("RangeHighRatio")), _bound(body.get("RangeLowRatio")), units)


def _group(d: dict) -> Group:
    counted = tuple(
        Counted(_criterion(c["Criteria"]), _window(c["StartWindow"]) if c.get("StartWindow") else Window(DEFAULT_LOOKBACK.get(_criterion(c["Criteria"]).domain, -9999), 0), _window(c["EndWindow"]) if c.get("EndWindow") else None, c.get("Occurrence", {}).get("Type", 2), c.get("Occurrence", {}).get("Count", 1))
        for c in d.get("CriteriaList", ())
    )
    people = tuple(Demographic(_bound(x.get("Age")), tuple(g["CONCEPT_ID"] for g in x.get("Gender", ()))) for x in d.get("DemographicCriteriaList", ()))
    return Group(d.get("Type", "ALL"), d.get("Count") or 0, counted, people, tuple(_group(g) for g in d.get("Groups", ())))


def parse(document: dict | str) -> Cohort:
    """A cohort from its document: a dict, JSON text, or either under the key 'expression'."""
    d = json.loads(document) if isinstance(document, str) else document
    if isinstance(d.get("expression"), (str, dict)):
        d = json.loads(d["expression"]) if isinstance(d["expression"], str) else d["expression"]
    sets = {
        s["id"]: tuple(Item(i["concept"]["CONCEPT_ID"], bool(i.get("includeDescendants")), bool(i.get("includeMapped")), bool(i.get("isExcluded"))) for i in s["expression"]["items"] if i.get("concept", {}).get("CONCEPT_ID") is not None)
        for s in d.get("ConceptSets", ())
    }
    p = d["PrimaryCriteria"]
    window, end = p.get("ObservationWindow", {}), d.get("EndStrategy") or {}
    if "DateOffset" in end:
        out = Exit("fixed", int(end["DateOffset"].get("Offset", 365)))
    elif "CustomEra" in end:
        era = end["CustomEra"]
        out = Exit("era", codeset=era["DrugCodesetId"], gap=int(era.get("GapDays", 30)), offset=int(era.get("Offset", 0)))
    else:
        out = Exit()
    return Cohort(
        sets, tuple(_criterion(c) for c in p["CriteriaList"]), int(window.get("PriorDays", 0)), int(window.get("PostDays", 0)), p.get("PrimaryCriteriaLimit", {}).get("Type", "All"),
        tuple(Rule(r.get("name", ""), _group(r["expression"])) for r in d.get("InclusionRules", ())), d.get("QualifiedLimit", {}).get("Type", "First"), d.get("ExpressionLimit", {}).get("Type", "First"),
        out, tuple(_criterion(c) for c in d.get("CensoringCriteria", ())), int(d.get("CollapseSettings", {}).get("EraPad", 0)),
    )


def load(path: str | Path) -> Cohort:
    return parse(Path(path).read_text(encoding="utf-8"))
