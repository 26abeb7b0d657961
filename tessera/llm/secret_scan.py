"""Operator 9, secret scans through a trigram index; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, own_columns


@dataclass(frozen=True)
class Rule:
    """pattern: what is looked for, leftmost and without overlap. group/least: matches whose group is shorter than that are dropped.
    found: a pattern that every text with a kept match has."""

    kind: str
    pattern: str
    group: int
    least: int
    found: str


# The base rules. A run of 24 or more is the same span by {24,} as by + and a length test,
# and so for the 16 after AKIA; for assign the + stays, since a short match uses up text that a longer one could start in.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)


def trigram_clauses(pattern: str, most: int = 256) -> list[frozenset[str]]:
    """The pattern's query: lower-case text with a match has all trigrams of some clause. Empty: no mandatory trigram."""
    parser, constants = re._parser, re._constants

    def strings(op, arg) -> set[str] | None:
        """All that a part can match, if these are few."""
        if op == constants.LITERAL:
            return {chr(arg).lower()}
        if op == constants.IN:
            if all(o == constants.LITERAL for o, _ in arg):
                return {chr(a).lower() for _, a in arg}
            return None
        if op == constants.SUBPATTERN:
            return run(arg[3])
        if op == constants.BRANCH:
            each = [run(x) for x in arg[1]]
            return None if any(x is None for x in each) else set().union(*each)
        if op in (constants.MAX_REPEAT, constants.MIN_REPEAT) and arg[1] == 1:
            inner = run(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def run(parts) -> set[str] | None:
        out = {""}
        for op, arg in parts:
            more = strings(op, arg)
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a, b in product(out, more)}
        return out

    queries: list[list[frozenset[str]]] = []

    def close(texts: set[str]) -> None:
        clauses = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
        if all(clauses):
            queries.append(sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted))

    current = {""}
    for op, arg in parser.parse(pattern):
        more = strings(op, arg)
        if more is None or len(current) * len(more) > most:
            close(current)
            current = {""} if more is None else more
        else:
            current = {a + b for a, b in product(current, more)}
    close(current)
    return min(queries, key=lambda q: (len(q), -sum(map(len, q)))) if queries else []


def one_of(trigrams: list[str]) -> str:
    """A pattern that stands at every place where one of the trigrams starts; its group is the trigram. First letters are told apart first."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(re.escape(c) + "(?:" + "|".join(rest) + ")" for c, rest in by_first.items()) + "))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id, h: the index over the trigrams that some rule asks for (a fixed dictionary, whatever the table's size), from one pass over each text."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(one_of(trigrams)), F.lit(1)))
    return docs.select("doc_id", "h", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, h, rules: by intersecting postings, the documents that hold all trigrams of a clause of an indexed rule.

    A document is known by doc_id and its text's hash h, so rows without a doc_id do not meet in one group.
    """
    spark = docs.sparkSession
    clauses = [(rule.kind, i, t, len(c)) for rule in rules for i, c in enumerate(trigram_clauses(rule.pattern)) for t in sorted(c)]
    if not clauses:
        return spark.createDataFrame([], "doc_id long, h long, rules array<string>")
    wanted = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int"))  # rows: as the rules say
    index = postings(docs, sorted({c[2] for c in clauses}))
    met = index.join(wanted, "trigram").groupBy("doc_id", "h", "kind", "clause", "size").agg(F.collect_set("trigram").alias("has"))
    return met.where(F.size("has") == F.col("size")).groupBy("doc_id", "h").agg(F.collect_set("kind").alias("rules"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(a: Column, join, rounds: int = 28) -> Column:
    """Each entry joined (sum, greatest) with all before it: in the k-th round with the one 2^k places before. An array of n entries costs n log n."""

    def further(x: Column, k: int) -> Column:
        if k == rounds:
            return x
        longer = lambda y: F.transform(y, lambda v, i: F.when(i >= 1 << k, join(v, F.get(y, i - (1 << k)))).otherwise(v))
        return F.when(F.size(x) > 1 << k, let(longer(x), lambda z: further(z, k + 1))).otherwise(x)

    return let(a, lambda x: further(x, 0))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's kept matches: pieces between matches and matches alternate, so running sums of lengths are places."""
    pattern = F.lit(rule.pattern)
    hits, groups, between = (F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.split(text, rule.pattern, -1))
    lengths = F.zip_with(F.transform(between, F.length), F.zip_with(F.transform(hits, F.length), F.transform(groups, F.length), lambda h, g: F.struct(h.alias("hit"), g.alias("group"))), lambda b, m: F.struct(b.alias("before"), m["hit"].alias("hit"), m["group"].alias("group")))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")

    def placed(m: Column) -> Column:  # the last piece has no match behind it
        ends = running(F.transform(F.filter(m, lambda x: x["hit"].isNotNull()), lambda x: x["before"] + x["hit"]), lambda x, y: x + y)
        all_ = F.transform(ends, lambda end, i: F.struct((end - F.get(m, i)["hit"]).alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.get(m, i)["group"].alias("group")))
        return F.transform(F.filter(all_, lambda s: s["group"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return F.when(text.rlike(rule.found), let(lengths, placed)).otherwise(none)


def numbered(n: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("nth"), s["kind"].alias("kind"), s["end"].alias("end"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def with_spans(docs: DataFrame, text: str, spans: str, rules=RULES) -> DataFrame:
    """docs with two more columns: its text (null as empty) and the spans (start, nth, kind, end in code points; by start, then in the rules' order).

    An indexed rule runs on its candidates only; a rule without mandatory trigrams runs on all texts.
    """
    known, its_id, its_h, its_rules = fresh(docs, "known", "its_id", "its_h", "its_rules")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(keyed, rules).toDF(its_id, its_h, its_rules)
    base = docs.withColumns({text: F.coalesce("text", F.lit("")), known: h})
    joined = base.join(found, (F.col(known) == F.col(its_h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)), "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    every = []
    for n, rule in enumerate(rules):
        got = spans_of(F.col(text), rule)
        if trigram_clauses(rule.pattern):
            got = F.when(F.array_contains(its_rules, rule.kind), got).otherwise(none)
        every.append(F.transform(got, numbered(n)))
    return joined.withColumn(spans, F.sort_array(F.concat(*every))).drop(known, its_id, its_h, its_rules)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, a row per input row.

    Null text: empty, no spans. Null doc_id: kept and scanned. Rows that share a doc_id: each is
    verified on its own text. Empty table: no rows. Other columns are dropped. Whole texts, of any length.
    """
    rows = with_spans(docs.select("doc_id", "text"), "whole", "found", rules)
    said = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, said.alias("spans")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


#: Code points of a chunk: a stretch of text is put together from chunks, so that finding its place costs no walk over the whole text.
CHUNK = 1024


def stretch(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points) out of its chunks."""
    first, last, a, z = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int"), start % CHUNK, end % CHUNK
    within = F.substring(F.get(chunks, first), a + 1, end - start)
    across = F.concat(F.substring(F.get(chunks, first), a + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(chunks, last), F.lit(1), z), F.lit("")))
    return F.when(end <= start, F.lit("")).when(first == last, within).otherwise(across)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark for each group of overlapping spans."""

    def written(chunks: Column, upto: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
        heads = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("at"))), lambda s: s["start"] >= s["at"])
        return F.concat(F.array_join(F.transform(heads, lambda s: F.concat(stretch(chunks, s["at"], s["start"]), F.lit(mark))), ""), stretch(chunks, F.coalesce(F.get(upto, F.size(upto) - 1), F.lit(0)), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return let(chunks, lambda c: let(ends, lambda e: written(c, e)))


def redact(docs: DataFrame, mark: str = "[secret]", rules=RULES) -> DataFrame:
    """docs with every found span replaced by a mark (overlapping spans by one), n_chars to match; all its columns stay, in their order.

    Null text: stays null. Null doc_id and repeated rows: each row by its own text. Empty table: no rows. Extra columns, whatever
    their names, stay as they are.
    """
    text, spans, new = fresh(docs, "whole", "spans", "new")
    rows = with_spans(docs, text, spans, rules)
    hit = F.size(spans) > 0
    out = rows.withColumn(new, F.when(hit, redacted(F.col(text), F.col(spans), mark)).otherwise(F.col("text")))
    columns = {"text": F.col(new)} | ({"n_chars": F.when(hit, F.length(new).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.withColumns(columns).select(*own_columns(docs))


def _sql_spans(name: str, pattern: str, group: int, least: int, nth: int) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, rid, list_filter(list_transform(range(1, len(h) + 1), lambda i: struct_pack(s := CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT), n := {nth}, k := '{name}', l := length(h[i]), g := length(g[i]))), lambda z: z.g >= {least}) AS v
      FROM (SELECT doc_id, rid, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}', 0) AS h, regexp_extract_all(text, '{p}', {group}) AS g FROM t))"""


ORACLE_SQL = "WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents), " + ", ".join(_sql_spans(r.kind, r.pattern, r.group, r.least, i) for i, r in enumerate(RULES)) + """,
u AS (SELECT assign.doc_id, len(assign.v) AS n_assign, len(access.v) AS n_access, len(hex.v) AS n_hex,
        coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(assign.v, access.v), hex.v)), lambda z: z.k || ':' || z.s || ':' || (z.s + z.l)), ','), '') AS spans
      FROM assign JOIN access USING (rid) JOIN hex USING (rid))
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM u"""
