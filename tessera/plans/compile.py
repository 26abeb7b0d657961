"""A cohort document as a DataFrame plan.

Entry events are filtered scans against concept sets. For the rules each event domain is scanned once and joined once to all its
concept sets; the events found meet the entries in one join by person, and one aggregation counts for every criterion what falls
in its window. Rules are boolean columns after that.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Days
from pyspark.sql import functions as F

from ..operators import cohorts, vocabulary
from .definition import Bound, Cohort, Counted, Criterion, Group, Window
from .passes import prepared


def compare(x: Column, b: Bound) -> Column:
    if b.op == "bt":
        return x.between(b.value, b.extent)
    if b.op == "!bt":
        return (x < b.value) | (x > b.extent)
    return {"gt": x > b.value, "gte": x >= b.value, "lt": x < b.value, "lte": x <= b.value, "eq": x == b.value, "neq": x != b.value}[b.op]


def ratio(value: Column, reference: Column, b: Bound) -> Column:
    """A bound on value / reference where the reference is positive."""
    return F.when(reference > 0, compare(value / reference, b)).otherwise(F.lit(False))


class Compiler:
    """tables: Drug, Condition, Procedure, Measurement events by domain, and person, observation_period, concept, concept_ancestor, concept_relationship."""

    def __init__(self, cohort: Cohort, cdm):
        self.cohort, self.report = prepared(cohort)
        self.cdm = cdm
        spark = cdm.person.sparkSession
        rows = [(k, i.concept_id, i.descendants, i.mapped, i.excluded) for k, items in self.cohort.codesets.items() for i in items]
        items = spark.createDataFrame(rows, "codeset_id int, concept_id long, include_descendants boolean, include_mapped boolean, is_excluded boolean")
        self.codesets = vocabulary.closure(items, cdm.concept_ancestor, cdm.concept_relationship, cdm.concept)

    @staticmethod
    def holds(c: Criterion) -> Column:
        """Whether an event's values are what the criterion asks for."""
        tests = [F.lit(True)]
        if c.value:
            tests.append(compare(F.col("value_as_number"), c.value))
        if c.ratio_high:
            tests.append(ratio(F.col("value_as_number"), F.col("range_high"), c.ratio_high))
        if c.ratio_low:
            tests.append(ratio(F.col("value_as_number"), F.col("range_low"), c.ratio_low))
        if c.units:
            tests.append(F.col("unit_concept_id").isin(list(c.units)))
        return F.coalesce(reduce(and_, tests), F.lit(False))

    def rows(self, c: Criterion) -> DataFrame:
        """person_id, start_date, end_date of the events that a criterion selects."""
        events = self.cdm.events(c.domain)
        hit = events.join(self.codesets.where(F.col("codeset_id") == c.codeset).select("concept_id"), "concept_id", "left_semi").where(self.holds(c))
        if c.first:
            hit = cohorts.first_per_person(hit)
        return hit.select("person_id", "start_date", "end_date")

    def entries(self) -> DataFrame:
        """person_id, index_date, index_end, op_start, op_end: entry events inside an observation period long enough around them; of events of one day the last end counts."""
        c = self.cohort
        events = reduce(DataFrame.unionByName, map(self.rows, c.entry)).groupBy("person_id", F.col("start_date").alias("index_date")).agg(F.max("end_date").alias("index_end"))
        period = self.cdm.observation_period.select("person_id", F.col("start_date").alias("op_start"), F.col("end_date").alias("op_end"))
        inside = (F.col("index_date") >= F.date_add("op_start", c.prior_days)) & (F.date_add("index_date", c.post_days) <= F.col("op_end"))
        return self.limited(events.join(period, "person_id").where(inside), c.primary_limit)

    @staticmethod
    def limited(entries: DataFrame, limit: str) -> DataFrame:
        return cohorts.first_per_person(entries, "index_date") if limit == "First" else entries

    def counted(self) -> list[Counted]:
        return [k for r in self.cohort.rules for k in r.group.every()]

    def found(self, domain: str, numbered: list[tuple[int, Counted]]) -> DataFrame:
        """person_id, s, e, ok: the domain's events in any concept set of its criteria, s and e their days, ok the numbers of the criteria whose set, values and order they meet."""
        sets = sorted({k.criterion.codeset for _, k in numbered})
        hits = self.cdm.events(domain).join(self.codesets.where(F.col("codeset_id").isin(sets)), "concept_id")
        meets = {}
        for n, k in numbered:
            mine = (F.col("codeset_id") == k.criterion.codeset) & self.holds(k.criterion)
            if k.criterion.first:  # a person's first event of those that hold; the windows of all such criteria share one shuffle
                order = Days.partitionBy("person_id", "codeset_id").orderBy(F.when(mine, 0).otherwise(1), "start_date", "concept_id")
                hits = hits.withColumn(f"_first_{n}", F.row_number().over(order) == 1)
                mine = mine & F.col(f"_first_{n}")
            meets[n] = mine
        ok = F.array_compact(F.array(*(F.when(m, F.lit(n)) for n, m in meets.items())))
        return hits.select("person_id", F.col("start_date").alias("s"), F.col("end_date").alias("e"), ok.alias("ok")).where(F.size("ok") > 0)

    def judged(self) -> DataFrame:
        """Entries with a boolean column rule_i for each rule."""
        criteria = self.counted()
        rebased = any(w.from_end for k in criteria for w in (k.window, k.end_window or Window()))
        keys = ["person_id", "index_date", "op_end"] + ["index_end"] * rebased
        entries = self.entries().select(*keys)
        if criteria:
            domains: dict[str, list[tuple[int, Counted]]] = {}
            for n, k in enumerate(criteria):
                domains.setdefault(k.criterion.domain, []).append((n, k))
            found = reduce(DataFrame.unionByName, [self.found(d, ks) for d, ks in domains.items()])
            counts = []
            for n, k in enumerate(criteria):
                tests = [F.array_contains("ok", n)]
                for w, col in ((k.window, "s"), (k.end_window or Window(), "e")):
                    day, index = "e" if w.of_end else col, "index_end" if w.from_end else "index_date"
                    if w.start is not None:
                        tests.append(F.col(day) >= F.date_add(index, w.start))
                    if w.end is not None:
                        tests.append(F.col(day) <= F.date_add(index, w.end))
                counts.append(F.count_if(reduce(and_, tests)).alias(f"n_{n}"))
            # entries appear once in the plan: those that no event meets come through the outer join with counts of 0
            entries = entries.join(found, "person_id", "left").groupBy(*keys).agg(*counts)
        out = entries.join(self.cdm.person, "person_id", "left")
        number = iter(range(len(criteria)))

        def one(k: Counted) -> Column:
            n = F.coalesce(F.col(f"n_{next(number)}"), F.lit(0))
            return {0: n == k.count, 1: n <= k.count, 2: n >= k.count}[k.kind]

        def truth(g: Group) -> Column:
            parts = [one(k) for k in g.criteria] + [truth(x) for x in g.groups]
            for d in g.demographics:
                tests = [F.lit(True)]
                if d.age:
                    tests.append(compare(F.year("index_date") - F.col("year_of_birth"), d.age))
                if d.genders:
                    tests.append(F.col("gender_concept_id").isin(list(d.genders)))
                parts.append(F.coalesce(reduce(and_, tests), F.lit(False)))
            if not parts:
                return F.lit(True)
            if g.kind == "ALL":
                return reduce(and_, parts)
            if g.kind == "ANY":
                return reduce(or_, parts)
            held = reduce(lambda a, b: a + b, [p.cast("int") for p in parts])
            return held >= g.count if g.kind == "AT_LEAST" else held <= g.count

        names = [truth(r.group).alias(f"rule_{i}") for i, r in enumerate(self.cohort.rules)]
        return out.select("person_id", "index_date", "op_end", *names)

    def rule_names(self) -> list[str]:
        return [f"rule_{i}" for i in range(len(self.cohort.rules))]

    def attrition(self) -> DataFrame:
        """level, n_entries, n_persons left after the first `level` rules."""
        judged, names = self.judged(), self.rule_names()
        passed = F.lit(0)
        for i in reversed(range(len(names))):
            passed = F.when(F.col(names[i]), 1 + passed).otherwise(0)  # rules passed before the first that fails
        levels = F.explode(F.sequence(F.lit(0), F.col("passed"))).alias("level")
        return judged.select("person_id", "index_date", passed.alias("passed")).select("person_id", "index_date", levels).groupBy("level").agg(F.count("*").alias("n_entries"), F.countDistinct("person_id").alias("n_persons"))

    def cohort_rows(self) -> DataFrame:
        """person_id, cohort_start_date, cohort_end_date."""
        c = self.cohort
        good = self.judged()
        for name in self.rule_names():
            good = good.where(F.col(name))
        rows = self.limited(good.select("person_id", "index_date", "op_end"), c.qualified_limit)
        if c.exit.kind == "fixed":
            rows = rows.withColumn("end", F.least("op_end", F.date_add("index_date", c.exit.days)))
        elif c.exit.kind == "era":
            spans = cohorts.eras(self.rows(Criterion("Drug", c.exit.codeset)), c.exit.gap).select("person_id", F.col("start_date").alias("e_start"), F.date_add("end_date", c.exit.offset).alias("e_end"))
            hit = rows.join(spans, "person_id").where(F.col("index_date").between(F.col("e_start"), F.col("e_end"))).groupBy("person_id", "index_date").agg(F.max("e_end").alias("e_end"))
            rows = rows.join(hit, ["person_id", "index_date"], "left").withColumn("end", F.least("op_end", F.coalesce("e_end", "op_end")))
        else:
            rows = rows.withColumn("end", F.col("op_end"))
        if c.censoring:
            stops = reduce(DataFrame.unionByName, map(self.rows, c.censoring)).select("person_id", F.col("start_date").alias("stop"))
            first = rows.select("person_id", "index_date").join(stops, "person_id").where("stop > index_date").groupBy("person_id", "index_date").agg(F.min("stop").alias("stop"))
            rows = rows.join(first, ["person_id", "index_date"], "left").withColumn("end", F.least("end", F.coalesce("stop", "end")))
        rows = self.limited(rows, c.expression_limit)
        spans = rows.select("person_id", F.col("index_date").alias("start_date"), F.col("end").alias("end_date"))
        return cohorts.eras(spans, c.era_pad).select("person_id", F.col("start_date").alias("cohort_start_date"), F.col("end_date").alias("cohort_end_date"))


def compile_cohort(cohort: Cohort, cdm, definition_id: int | None = None, healed: bool = False) -> DataFrame:
    """The cohort's rows; with a definition id in the layout of the result table.

    healed: accept a document some of whose criteria have no concept set; what was left out is in Compiler.report. Without it such a
    document is an error, as rules without their criteria let more persons in.
    """
    compiler = Compiler(cohort, cdm)
    lost = [r for r in compiler.report if r[1] != "KEEP"]
    if lost and not healed:
        raise ValueError(f"criteria without a concept set: {lost}")
    rows = compiler.cohort_rows()
    if definition_id is None:
        return rows
    return rows.select(F.lit(definition_id).cast("long").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"), "cohort_start_date", "cohort_end_date")
