"""Checks and rewrites of cohort documents before they are compiled. Only what compiling needs; checks and repairs of many documents are in operators/criteria.py, as joins and groupings."""

from __future__ import annotations

from dataclasses import replace

from .definition import Cohort, Counted, Criterion, Group, Rule, Window

#: Event domains whose rows have a number, and so can be asked for one.
WITH_VALUE = ("Measurement",)


def validate(c: Cohort) -> list[tuple[str, str]]:
    """(code, detail) of structural errors."""
    out = []
    if not c.entry:
        out.append(("no_entry", ""))
    out += [("dangling_codeset", str(i)) for i in sorted(c.referenced() - set(c.codesets) - {0})]
    out += [("codeset_zero", r.name) for r in c.rules for k in r.group.every() if k.criterion.codeset == 0]
    out += [("empty_rule", r.name) for r in c.rules if not (r.group.criteria or r.group.groups or r.group.demographics)]
    out += [("unreadable_value", r.name) for r in c.rules for k in r.group.every() if (k.criterion.value or k.criterion.units) and k.criterion.domain not in WITH_VALUE]
    out += [("value_and_ratio", r.name) for r in c.rules for k in r.group.every() if k.criterion.value and (k.criterion.ratio_high or k.criterion.ratio_low)]
    return out


def pruned(c: Cohort) -> Cohort:
    """Only concept sets that something refers to."""
    used = c.referenced()
    return replace(c, codesets={k: v for k, v in c.codesets.items() if k in used})


def healed(c: Cohort) -> tuple[Cohort, list[tuple[str, str]], float]:
    """Without criteria on codeset 0; (rule, KEEP | PARTIAL | SKIP) and the share of criteria kept."""

    def clean(g: Group) -> Group:
        groups = tuple(x for x in (clean(x) for x in g.groups) if x.criteria or x.groups or x.demographics)
        return replace(g, criteria=tuple(k for k in g.criteria if k.criterion.codeset != 0), groups=groups)

    rules, report, total, kept = [], [], 0, 0
    for r in c.rules:
        new = clean(r.group)
        n, m = sum(1 for _ in r.group.every()), sum(1 for _ in new.every())
        total, kept = total + n, kept + m
        empty = not (new.criteria or new.groups or new.demographics)
        report.append((r.name, "SKIP" if empty else "KEEP" if n == m else "PARTIAL"))
        if not empty:
            rules.append(replace(r, group=new))
    return replace(c, rules=tuple(rules)), report, kept / total if total else 1.0


def washout_before_index(c: Cohort) -> Cohort:
    """Absence that reaches the index day on a codeset of the entry itself would empty the cohort: it ends on the day before."""
    entry = {(e.domain, e.codeset) for e in c.entry}

    def fix(k: Counted) -> Counted:
        absent = k.kind in (0, 1) and k.count == 0
        if absent and not (k.window.from_end or k.window.of_end) and (k.criterion.domain, k.criterion.codeset) in entry and (k.window.end is None or k.window.end >= 0) and (k.window.start is None or k.window.start < 0):
            return replace(k, window=replace(k.window, end=-1))
        return k

    def walk(g: Group) -> Group:
        return replace(g, criteria=tuple(map(fix, g.criteria)), groups=tuple(map(walk, g.groups)))

    return replace(c, rules=tuple(replace(r, group=walk(r.group)) for r in c.rules))


def arms(target: Cohort, drug_codeset: int, comparator_codeset: int | None = None) -> dict[str, Cohort]:
    """Target, treatment (with the drug before or on index) and comparator (never the drug so far, or with another one)."""
    ever = Window(-9999, 0)
    with_ = Rule("exposed", Group(criteria=(Counted(Criterion("Drug", drug_codeset), ever, None, 2, 1),)))
    other = Criterion("Drug", drug_codeset if comparator_codeset is None else comparator_codeset)
    without = Rule("unexposed", Group(criteria=(Counted(other, ever, None, *((0, 0) if comparator_codeset is None else (2, 1))),)))
    return {"target": target, "treatment": replace(target, rules=(*target.rules, with_)), "comparator": replace(target, rules=(*target.rules, without))}


def prepared(c: Cohort) -> tuple[Cohort, list[tuple[str, str]]]:
    """The passes that a document goes through before it is compiled, and what became of each rule (KEEP, PARTIAL, SKIP)."""
    errors = [e for e in validate(c) if e[0] != "codeset_zero"]
    if errors:
        raise ValueError(f"cohort document: {errors}")
    healthy, report, _ = healed(c)
    return pruned(washout_before_index(healthy)), report
