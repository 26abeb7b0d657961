"""Restated criteria, dictionaries, expansions, the vector index, concordance and matching by distance against brute force."""

import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, expansion, index, matching, restatement, survival, synonyms
from tessera.sources import dictionary

# ---- restated criteria ---------------------------------------------------------------------------


def normal(t):
    s = re.sub(restatement.LIST_MARK.replace("(?i)", ""), "", t.strip(), flags=re.I).replace("≤", "<=").replace("≥", ">=")
    return re.sub(r"\s+", " ", s).strip().strip("*-• ").rstrip(".;,:").lower()


def words(t):
    return re.findall(restatement.TOKEN, normal(t))


def content(t):
    return [w for w in words(t) if len(w) > 1 and w not in restatement.STOPWORDS]


def caps(t):
    return {m.lower() for m in re.findall(r"\b[A-Z]{2,6}\b", t)}


def run_of(a, tokens):
    return next((i for i in range(len(tokens) - len(a) + 1) if "".join(w[0] for w in tokens[i : i + len(a)]) == a), -1) if 2 <= len(a) <= 6 and a.isalpha() else -1


def covers(c, own, r, theirs):
    if len(c) < 2:
        return 0.0
    hit = [w in r or any(SequenceMatcher(None, w, x).ratio() >= 0.85 for x in set(r)) or (w in own and run_of(w, r) >= 0) for w in c]
    for a in set(r) & theirs:
        at = run_of(a, c)
        if at >= 0:
            hit[at : at + len(a)] = [True] * len(a)
    return sum(hit) / len(c)


def turned(t):
    return bool(set(words(t)) & set(restatement.NEGATORS))


TEXTS = [
    "Prior stroke, TIA or systemic embolus", "a) transient ischemic attack (TIA) or Systemic Embolism (SE)", "Diabetes mellitus or hypertension requiring pharmacological treatment", "Hypertension requiring pharmacologic treatment.", "No history of diabetes mellitus",
    "history of diabetes mellitus", "HbA1c ≥ 6.5 % at screening", "HbA1c >= 7.5 % at screening", "LVEF at most 40 percent", "left ventricular ejection fraction LVEF", "ages drugs tumours", "age drug tumour", "1. symptomatic heart failure", "heart failure", None, "", "   ", "* one - two;",
]


def test_covering_pairs_are_those_of_brute_force(spark):
    rnd = random.Random(8)
    pool = ["stroke", "strokes", "tumor", "tumour", "renal", "failure", "failures", "TIA", "transient", "ischemic", "attack", "no", "12", "13", "heart", "hearts", "SE", "systemic", "embolus", "embolism", "the", "drug", "drugs", "pharmacologic", "pharmacological"]
    texts = TEXTS + [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    facts = [(content(t or ""), caps(t or ""), turned(t or ""), set(re.findall(r"\d+(?:\.\d+)?", t or ""))) for t in texts]
    want = set()
    for i, j in itertools.permutations(range(len(texts)), 2):
        (a, own, n, k), (b, theirs, m, q) = facts[i], facts[j]
        if n == m and k == q and covers(a, own, b, theirs) >= 0.7:
            want.add((i, j, round(covers(a, own, b, theirs), 6)))
    got = {(r.id, r.reference_id, round(r.coverage, 6)) for r in restatement.covering(df, df).collect()}
    assert got == want and len(want) > 30
    assert restatement.covering(df.limit(0), df).count() == 0


def test_similar_tokens_are_those_of_all_pairs(spark):
    rnd = random.Random(2)
    tokens = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(400)} | {"tumor", "tumour", "age", "ages", "embolism", "embolisms", "123.5", "123.55"}
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    want = {(a, b) for a in tokens for b in tokens if SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert {tuple(r) for r in restatement.similar_tokens(df, df).collect()} == want


def test_items_that_restate_a_group(spark):
    offer = "[OR-GROUP] at risk with any of: Prior stroke, TIA or systemic embolus | Hypertension requiring pharmacological treatment | Diabetes mellitus | No liver disease"
    cases = [
        ("diabetes mellitus.", True), ("Diabetes mellitus or hypertension requiring pharmacological treatment", True), ("Diabetes mellitus and hypertension requiring pharmacological treatment", False), ("transient ischemic attack (TIA) or systemic embolism", True),
        ("Hypertension", False), ("Gestational diabetes", False), ("No diabetes mellitus", False), ("no liver disease", True), ("liver disease", False), (offer, False), (None, False), ("", False), ("Hypertension requiring pharmacological treatment and rest", True),
    ]
    rows = [("a", i, t) for i, (t, _) in enumerate(cases)] + [("b", 0, "diabetes mellitus")]
    got = {(r.list, r.nth) for r in restatement.restated(spark.createDataFrame(rows, "list string, nth long, text string")).collect()}
    assert got == {("a", i) for i, (_, hit) in enumerate(cases) if hit}


def test_sentences_of_all_turns_cover_one_another(spark, tmp_path):
    """The assistant's as well, those of no role, and those that begin like a group; copies are members of a class, with the links of its least one."""
    from tessera import catalogue

    turns = [
        (1, 0, "user", "Severe renal failure. Heart failure and stroke"), (1, 1, "assistant", "Renal failure, severe. Chronic cough"), (2, 0, None, "Stroke and heart failure. Severe renal failure"),
        (2, 1, "user", "[OR-GROUP] chronic cough"), (3, 0, "system", None), (3, 1, "assistant", "Severe renal failure"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    texts = {}
    for conv, turn, _, text in turns:
        texts |= {conv * 100_000_000 + turn * 10_000 + i: s for i, s in enumerate((text or "").split(". ")) if s}
    classes = {i: min(j for j in texts if texts[j] == t) for i, t in texts.items()}
    facts = {i: (content(t), caps(t), turned(t), set(re.findall(r"\d+(?:\.\d+)?", t))) for i, t in texts.items()}
    links = {(i, j) for i in texts for j in texts if i != j and facts[i][2:] == facts[j][2:] and covers(*facts[i][:2], *facts[j][:2]) >= 0.7}
    rows = catalogue.QUERIES["covered_criteria"](spark, str(tmp_path)).collect()
    assert {r.id: r.class_id for r in rows} == classes
    between = {(r.class_id, r.reference_id) for r in rows if r.reference_id is not None}
    got = {(i, j) for i in texts for j in texts if i != j and (classes[i] == classes[j] or (classes[i], classes[j]) in between)}
    assert got == links and len(links) > len(between) > 3


# ---- dictionaries ----------------------------------------------------------------------------------


def test_frontiers_end_in_graphs_with_cycles(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(60)] + [("n1", "n2"), ("n2", "n1"), ("n3", "n3")]
    rows = [(a, "isa", b) if i % 2 else (b, "inverse_isa", a) for i, (a, b) in enumerate(edges)] + [("n1", "other", "n39"), (None, "isa", "n1"), ("n1", "isa", None)]
    relations = spark.createDataFrame(rows, "cui1 string, rela string, cui2 string")
    seeds = ["n1", "n3", "n7", "unknown", None, "n1"]
    want = set()
    for s in set(seeds) - {None}:
        seen, wave, depth = {s}, {s}, 0
        while wave:
            depth += 1
            wave = {b for a, b in edges if a in wave} - seen
            seen |= wave
            want |= {(s, x, depth) for x in wave}
    df = spark.createDataFrame([(s,) for s in seeds], "seed string")
    assert {tuple(r) for r in synonyms.reached(df, relations).collect()} == want
    assert {tuple(r) for r in synonyms.reached(df, relations, 1).collect()} == {w for w in want if w[2] == 1}
    assert synonyms.reached(df.limit(0), relations).count() == 0


def words_of(spark):
    names = [("C1", "Heart Attack", "MSH", "MH", "ENG", "Y", "P"), ("C1", "heart attack", "ZZZ", "SY", "ENG", "Y", "P"), ("C1", "MI", "ZZZ", "SY", "ENG", "N", "S"), ("C1", "Infarction", "SNOMEDCT_US", "PT", "ENG", "N", "S"), ("C2", "MI", "MSH", "MH", "ENG", "Y", "P"), ("C3", "100% pure_water", "MSH", "MH", "ENG", "Y", "P")]
    return dictionary.Dictionary(spark.createDataFrame(names, dictionary.SCHEMAS["names"]), spark.createDataFrame([("C1", "Disease or Syndrome"), ("C2", "Hormone"), ("C3", "Geographic Area")], dictionary.SCHEMAS["types"]), spark.createDataFrame([], dictionary.SCHEMAS["relations"]))


def test_names_are_found_whole_then_inside_then_by_type(spark):
    asked = [(1, " heart ATTACK ", "Condition"), (2, "mi", "Condition"), (3, "mi", None), (4, "mi", "Procedure"), (5, "attac", "Condition"), (6, "attac", "Drug"), (7, "%", None), (8, "_w", None), (9, "heart attack", "Procedure"), (10, None, None), (11, " ", None), (12, "zebra", None), (13, "mi", "Unknown")]
    df = spark.createDataFrame(asked, "query_id long, text string, domain string")
    got = sorted((r.query_id, r.nth, r.cui) for r in synonyms.concepts_of(df, words_of(spark)).collect())
    assert got == [(1, 1, "C1"), (2, 1, "C1"), (3, 1, "C1"), (3, 2, "C2"), (5, 1, "C1"), (7, 1, "C3"), (8, 1, "C3"), (9, 1, "C1"), (13, 1, "C1"), (13, 2, "C2")]
    said = [(r["rank"], r.synonym) for r in synonyms.synonyms(df.where("query_id = 1"), words_of(spark)).orderBy("rank").collect()]
    assert said == [(1, "Infarction"), (2, "MI")]


def test_dictionaries_may_lack_tables_and_columns(spark, tmp_path):
    spark.createDataFrame([("C1", "x", 3)], "cui string, str string, odd int").write.parquet(str(tmp_path / "names.parquet"))
    d = dictionary.read(spark, tmp_path.as_uri())
    assert d.names.collect()[0][:3] == ("C1", "x", None) and d.types.count() == d.relations.count() == 0
    assert synonyms.concepts_of(spark.createDataFrame([(1, "X", "Drug")], "query_id long, text string, domain string"), d).count() == 1


# ---- expansion ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("cap", [1, 3, 7, 100])
def test_branches_are_taken_until_the_cap(spark, cap):
    rnd = random.Random(cap)
    members = {b: sorted({rnd.randrange(30) for _ in range(rnd.randrange(9))}) for b in range(8)}
    order = {s: rnd.sample(range(8), rnd.randrange(1, 8)) for s in range(5)}
    want = set()
    for s, bs in order.items():
        seen = {}
        for b in bs:
            if len(seen) >= cap:
                break
            for m in members[b][:cap]:
                seen.setdefault(m, b)
        want |= {(s, m, b) for m, b in seen.items()}
    branches = spark.createDataFrame([(s, b, i) for s, bs in order.items() for i, b in enumerate(bs)], "seed_id long, branch long, place int")
    held = spark.createDataFrame([(b, m) for b, ms in members.items() for m in ms], "branch long, concept_id long")
    assert {tuple(r) for r in expansion.greedy(branches, held, cap).collect()} == want


@pytest.mark.parametrize("cap", [1, 4, 100])
def test_whole_climb_is_that_of_brute_force(spark, cap):
    """All members of all of a seed's branches count, also those of greater ids and of branches behind full ones; the seed itself takes no place."""
    rnd = random.Random(cap)
    content_of = {m: float(rnd.randrange(4)) for m in range(60)}
    members = {b: sorted(rnd.sample(range(60), rnd.randrange(25))) for b in range(8)}
    order = {s: rnd.sample(range(8), rnd.randrange(1, 8)) for s in range(20)}
    branches = spark.createDataFrame([(s, b) for s, bs in order.items() for b in bs], "seed_id long, branch long")
    held = spark.createDataFrame([(b, m, content_of[m]) for b, ms in members.items() for m in ms] * 2, "branch long, concept_id long, ic double")
    got = {s: [] for s in order}
    for r in expansion.most_specific(branches, held, cap).orderBy("seed_id", "nth").collect():
        got[r.seed_id].append(r.concept_id)
    for s, bs in order.items():
        want = sorted({m for b in bs for m in members[b]}, key=lambda m: (-content_of[m], m))
        assert [m for m in got[s] if m != s][:cap] == [m for m in want if m != s][:cap]


def test_clinical_expansion_has_the_most_specific_of_a_large_family(spark):
    """Above the seed's parent stand 70 others: those of greatest ids are leaves, the rest have children of their own and are less specific."""
    top, parent, seed, rest, leaves = 1, 2, 500, range(100, 165), range(600, 605)
    edges = [(top, parent), (parent, seed), *((top, m) for m in (*rest, *leaves)), *((m, 1000 * k + m) for m in rest for k in (1, 2, 3))]
    tree = [(p, c, 1) for p, c in edges] + [(top, seed, 2)] + [(top, 1000 * k + m, 2) for m in rest for k in (1, 2, 3)] + [(x, x, 0) for x in {x for e in edges for x in e}]
    concept = spark.createDataFrame([(x, "x", None, None) for x, y, n in tree if n == 0], "concept_id long, concept_name string, standard_concept string, invalid_reason string")
    ancestor = spark.createDataFrame(tree, "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int")
    none = spark.createDataFrame([], "concept_id_1 long, concept_id_2 long, relationship_id string")
    seeds, is_a = spark.createDataFrame([(seed,)], "concept_id long"), spark.createDataFrame(edges, "parent long, child long")
    got = [r.concept_id for r in expansion.expanded(seeds, "clinical", ancestor, is_a, none, concept, slack=20.0).orderBy("rank").collect()]
    assert got == [parent, *leaves, *range(1100, 1144)]


def test_strategies_have_names(spark):
    none = spark.createDataFrame([], "concept_id long")
    with pytest.raises(ValueError, match="no such strategy"):
        expansion.expanded(none, "sideways", none, none, none, none)


# ---- index -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("clusters", [1, 25])
def test_index_finds_nine_tenths_of_the_nearest(spark, clusters):
    rnd = np.random.default_rng(clusters)
    v = rnd.normal(size=(clusters, 16))[rnd.integers(0, clusters, 3000)] * 4 + rnd.normal(size=(3000, 16))
    items = [(i, str(i % 3), x.tolist()) for i, x in enumerate(v)] + [(5000, "0", None)]
    df = spark.createDataFrame(items, "item_id long, domain string, v array<double>")
    built = index.build(df, n=10)
    assert built.cells.count() == 3000 and built.recall >= 0.9
    queries = df.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 100 == 0, F.col("domain")).alias("domain"), F.col("v").alias("q"))
    got = {}
    for r in index.search(built, queries, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.distance))
    hit = total = 0
    for i in range(0, 3000, 50):
        ok = np.array([k for k in range(3000) if i % 100 or k % 3 == i % 3])
        d = np.sqrt(((v[ok] - v[i]) ** 2).sum(1))
        best = ok[np.lexsort((ok, d))[:10]]
        assert all(abs(x[2] - np.sqrt(((v[x[1]] - v[i]) ** 2).sum())) < 1e-9 for x in got[i])
        hit, total = hit + len(set(best) & {x[1] for x in got[i]}), total + 10
    assert hit / total >= 0.9 and 5000 not in got


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, domain string, v array<double>")
    built = index.build(none)
    assert index.search(built, spark.createDataFrame([(1, None, [0.0])], "query_id long, domain string, q array<double>")).count() == 0


def test_blocks_of_a_hot_key_all_meet(spark):
    left, right = spark.range(1, 301).select(F.lit(1).alias("k"), F.col("id").alias("a")), spark.range(1, 501).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").alias("b"))

    def pairs(x, y):
        assert len(x) < 150 and len(y) < 150
        return x.merge(y, how="cross")[["a", "b"]]

    met = blocks.met(left, right, ["k"], "a", "b", 60, pairs, "a long, b long")
    assert met.count() == met.distinct().count() == 300 * 250


# ---- concordance ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("risks, days, n", [(4, 6, 300), (10_000, 5, 400), (1, 9, 50), (50, 10_000, 300), (3, 3, 2)])
def test_concordance_equals_all_pairs(spark, risks, days, n):
    rnd = random.Random(n)
    rows = [(float(rnd.randrange(risks)) / 7, rnd.randrange(days), int(rnd.random() < 0.4)) for _ in range(n)]
    conc = tied = 0
    pairs = 0
    for (x, t, e), (y, u, f) in itertools.permutations(rows, 2):
        if e and (u > t or (u == t and not f)):
            pairs += 1
            conc, tied = conc + (x > y), tied + (x == y)
    df = spark.createDataFrame(rows + [(None, 1, 1), (1.0, None, 0), (1.0, 1, None)], "risk double, time int, event int").repartition(3)
    got = survival.concordance(df).head()
    assert (got.concordant, got.tied, got.comparable) == (conc, tied, pairs)
    assert got.c_index == (pytest.approx((conc + tied / 2) / pairs) if pairs else None)
    assert survival.concordance(df.limit(0)).head().c_index is None


# ---- matching --------------------------------------------------------------------------------------------


def test_balls_look_at_few_controls_and_lose_none(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), int(t), float(p), *map(float, x)) for i, t, p, x in zip(rnd.permutation(900), rnd.random(900) < 0.3, rnd.random(900), rnd.normal(size=(900, 3)))]
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "person_id long, treatment int, ps double, a double, b double, c double")
    inverse = matching.inverse_covariance(df, names)
    treated, controls = df.where("treatment = 1").drop("treatment"), df.where("treatment = 0").drop("treatment").withColumnRenamed("person_id", "control_id")
    balls = matching.Balls(controls, names, inverse, 0.2, 40)
    got = {(r.person_id, r.control_id) for r in matching.distance_candidates(treated, balls, None, 4).collect()}
    want = set()
    for r in (r for r in rows if r[1]):
        near = sorted((float(np.sqrt((d := np.array(r[3:]) - np.array(c[3:])) @ inverse @ d)), c[0]) for c in rows if not c[1] and abs(c[2] - r[2]) <= 0.2)
        want |= {(r[0], c) for _, c in near[:4]}
    assert got == want
    few = balls.asked(treated.withColumn("theta", F.lit(0.3)), True)
    assert few.count() < 0.5 * treated.count() * len(balls.cells)


def test_similar_tokens_meet_on_a_piece_and_its_place():
    """No similar pair is missed, and few others meet; coverage stops where it cannot reach what is asked."""
    rnd = random.Random(1)
    tokens = sorted({"".join(rnd.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rnd.randint(1, 6)))[: rnd.randint(2, 12)] for _ in range(400)})
    kept, asked, met = {t: set(restatement.kept_pieces(t)) for t in tokens}, {t: set(restatement.asked_pieces(t)) for t in tokens}, 0
    for a in tokens:
        for b in tokens:
            alike = 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= 0.85
            assert restatement.similar(a, b) == alike and (not alike or asked[a] & kept[b]), (a, b)
            met += bool(asked[a] & kept[b])
    assert met < len(tokens) ** 2 / 8
    assert restatement.coverage(["aa", "bb", "cc", "dd"], set(), ["aa", "bb", "cc"], set(), 0.75) == 0.75 and restatement.coverage(["aa", "bb", "cc", "dd"], set(), ["aa", "bb"], set(), 0.75) == 0


def test_short_rows_that_cost_much_are_spread(spark):
    assert restatement.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_items_of_a_cell_are_those_of_all_distances(monkeypatch):
    """Also of copies, far from the origin, of infinite numbers and none; few of them are compared one by one."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)) + 30
    v[100:160] = v[7]
    v[3, 0], v[4, 0] = np.nan, np.inf
    q, ids, looked, sort = np.concatenate([v[[7, 20]], rng.normal(size=(300, 16)) + 30]), rng.permutation(500), [], np.lexsort
    monkeypatch.setattr(index.np, "lexsort", lambda keys: looked.append(len(keys[0])) or sort(keys))
    got = index.firsts(np.arange(len(q)), q, ids, v, 20)
    monkeypatch.undo()
    for i, (query, items, distance) in enumerate(got):
        d = np.sqrt(((v - q[i]) ** 2).sum(1))
        first = np.lexsort((ids, d))[:20]
        assert (query == i).all() and items.tolist() == ids[first].tolist() and distance.tolist() == d[first].tolist()
    assert [len(x[1]) for x in index.firsts(np.arange(2), q[:2], ids[:5], v[:5], 20)] == [5, 5] and sorted(looked)[len(looked) // 2] < 50
