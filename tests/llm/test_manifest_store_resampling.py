"""Merkle manifest, token store and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import merkle, resampling, token_store
from tessera.llm.tokens import load, vocabulary_text

from .test_operators import SCHEMA, corpus, rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, tampered=False):
    out = []
    for f in FIELDS:
        v = row[f]
        if v is None:
            out.append("-")
            continue
        v = str(v)
        if tampered and f == "text":
            v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out.append(f"{len(v.encode())}:{v}")
    return H("".join(out))


def tree(nodes):
    siblings, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(own):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            siblings[i].append((run[: p % 8], run[p % 8 + 1 :]))
            own[i] = p // 8
        nodes = [H("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], siblings


def manifest_brute(table):
    groups = defaultdict(list)
    for r in table:
        tampered = leaf_of(r, True) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else None
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), tampered))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
    trees = {g: tree([x[2] for x in groups[g]]) for g in names}
    root, upper = tree([trees[g][0] for g in names]) if names else ("", [])
    for k, g in enumerate(names):
        for (known, doc_id, leaf, tampered), path in zip(groups[g], trees[g][1]):
            path = path + upper[k]
            folded = tampered or leaf
            for left, right in path:
                folded = H("".join(left) + folded + "".join(right))
            yield doc_id if known else None, leaf, trees[g][0], root, H("".join("".join(a) + "".join(b) for a, b in path)), folded, folded == root


def many(n, langs, seed=3):
    rnd = random.Random(seed)
    return [(i * 7 % n if i % 50 else None, f"Text {i} Über {rnd.random()}" if i % 9 else None, rnd.choice(langs), rnd.choice(["a", None]), rnd.choice([None, i]), 1, "n", "b", "p", "h", "s", "p", "r", "s") for i in range(n)]


@pytest.mark.parametrize("n, langs, parts", [(1, ["en"], 2), (8, ["en"], 3), (9, [None], 3), (700, ["en", "de", None, "", "é", "en-GB"], 5), (700, [f"l{i}" for i in range(90)] + ["big"] * 300, 7)])
def test_manifest_equals_brute_force(spark, n, langs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame(many(n, langs), SCHEMA)
        got = [tuple(r) for r in merkle.manifest(docs).collect()]
        assert sorted(got, key=repr) == sorted(manifest_brute([r.asDict() for r in docs.collect()]), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_manifest_of_repeated_rows_long_texts_and_nothing(spark):
    docs = spark.createDataFrame(rows(corpus()) * 2 + rows([(900, "LONG é " * 60_000)]), SCHEMA)
    want = sorted(manifest_brute([r.asDict() for r in docs.collect()]), key=repr)
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr) == want
    assert merkle.manifest(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 9), max_size=60), min_size=1, max_size=12), st.integers(2, 4), st.booleans())
def test_grammar_gives_back_its_ids(texts, least, repeated):
    ids = [np.array((t * 3 if repeated else t) + [1], "<u4") for t in texts]
    flat = np.concatenate(ids)
    symbols, terminals, rules, lengths = token_store.repair(flat, 1, least, 0.0)
    grammar = token_store.Grammar(terminals, rules, lengths)
    assert (grammar.expand(symbols) == flat).all() and (grammar.length[len(terminals) :] == lengths).all()
    row = token_store.packed([x.tobytes() for x in ids], list(range(len(ids))), 0, 0, 0, 1)
    opened, symbols = token_store.grammar_of(row)
    for k, x in enumerate(ids):  # each document is a slice of symbols, and each part of it is found from its lengths
        own = symbols[row["doc_symbols"][k] : row["doc_symbols"][k + 1]]
        assert (opened.expand(own) == x).all()
        a, b = len(x) // 3, len(x) * 2 // 3
        assert (opened.cut(own, a, b) == x[a:b]).all()


def test_rules_replace_frequent_pairs_again_and_again():
    ids = np.array(([5, 6, 7, 8] * 40 + [1]) * 4, "<u4")
    symbols, _, rules, lengths = token_store.repair(ids, 1, 8, 0.0)
    assert lengths.max() >= 16 and len(symbols) < len(ids) / 8


def test_wide_alphabets_keep_their_ids():
    rnd = np.random.default_rng(2)
    ids = np.concatenate([np.append(rnd.permutation(70_000) + 2, 1), np.tile(np.array([9, 10], "<u4"), 5000), [1]]).astype("<u4")
    symbols, terminals, rules, lengths = token_store.repair(ids)
    assert symbols.dtype == np.uint32 and len(rules) and (token_store.Grammar(terminals, rules, lengths).expand(symbols) == ids).all()


def stored_brute(table):
    tokenizer, at, out = load(vocabulary_text()), 0, []
    for doc_id, text in table:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_reads_back_what_it_wrote(spark):
    table = [(i, t) for i, t in corpus() if i is not None] + [(500, "<|endoftext|> in the text " * 4), (501, "word " * 90_000)]
    ids = [i for i, _ in table]
    docs = spark.createDataFrame(rows(table), SCHEMA).repartition(5)
    got = [tuple(r) for r in token_store.round_trip(docs).orderBy("start").collect()]
    single = {i: t or "" for i, t in table if ids.count(i) == 1}
    assert [r[0] for r in got] == sorted(ids) and [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    want = {i: (n, crc) for i, _, n, crc in stored_brute(single.items())}
    assert {r[0]: r[2:] for r in got if r[0] in single} == want
    twice = sorted(((i, t or "") for i, t in table if i not in single), key=repr)
    assert sorted((r[0], *r[2:]) for r in got if r[0] not in single) == sorted((i, n, crc) for i, _, n, crc in stored_brute(twice))
    assert token_store.round_trip(docs.limit(0)).count() == 0


def test_null_ids_come_first_in_the_store(spark):
    docs = spark.createDataFrame([(None, "b"), (3, "a"), (None, None), (1, "")], "doc_id long, text string")
    got = token_store.round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 3] and [r.n_tokens for r in got][2:] == [1, 2]


def test_store_finds_tokens_in_any_place(spark, tmp_path):
    table = [(i, t) for i, t in corpus() if i is not None and t]
    ids = [i for i, _ in table]
    table = [(i, t) for i, t in table if ids.count(i) == 1]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    path = (tmp_path / "store").as_uri()
    token_store.write(docs, path, shard_tokens=500)
    assert token_store.read(spark, path).count() > 3
    tokenizer, rnd = load(vocabulary_text()), random.Random(1)
    want, spans = {}, []
    for i, t in table:
        own = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for a, b in ((0, len(own)), (rnd.randrange(len(own)), rnd.randrange(len(own) + 5)), (-3, 2)):
            spans.append((i, a, b))
            want[i, a, b] = own[max(a, 0) : max(b, 0)] if b > a else []
    found = token_store.tokens_at(spark, path, spark.createDataFrame([*spans, (None, 0, 1), (-5, 0, 1)], "doc_id long, first long, last long"))
    assert {(r.doc_id, r["first"], r["last"]): r.ids for r in found.collect()} == want
    whole = {r.doc_id: r.ids for r in token_store.documents_of(spark, path).collect()}
    assert all(whole[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in table)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_brute(text, lo, hi, buckets):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for i in range(len(words)) for k in range(lo, hi + 1) if i + k <= len(words)]


def resampled_brute(table, target, lo, hi, buckets, percent, least):
    found = [(i, *grams_brute(t, lo, hi, buckets)) for i, t in table]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, grams_brute(x, lo, hi, buckets)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: len(able) * percent // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


@pytest.mark.parametrize("lo, hi, buckets, percent", [(1, 1, 10_000, 10), (1, 3, 997, 35), (2, 5, 70_000, 100), (3, 3, 5, 0)])
def test_resampling_equals_brute_force(spark, lo, hi, buckets, percent):
    target = [corpus()[3][1], "Niño-straße 7 été", None, "", "river0 STONE1"]
    docs = spark.createDataFrame(rows(corpus()), SCHEMA).repartition(3)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resample(docs, other, (lo, hi), buckets, percent).collect()]
    assert sorted(got, key=repr) == sorted(resampled_brute(corpus(), target, lo, hi, buckets, percent, 20), key=repr)


def test_resampling_of_nothing_and_towards_nothing(spark):
    docs = spark.createDataFrame(rows(corpus()), SCHEMA)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), docs.select("text")).count() == 0
    got = [tuple(r) for r in resampling.resample(docs, none, (1, 2), 100, 50).collect()]
    assert sorted(got, key=repr) == sorted(resampled_brute(corpus(), [], 1, 2, 100, 50, 20), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), min_size=1, max_size=6), st.integers(1, 3), st.integers(0, 3))
def test_buckets_of_suffix_arrays_are_those_of_all_grams(texts, lo, more):
    hi = lo + more
    got = resampling.gram_buckets(texts, lo, hi, 97)
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(zlib.crc32(b" ".join(t[i : i + k])) % 97 for i in range(len(t)) for k in range(lo, hi + 1) if i + k <= len(t))


def test_suffix_array_orders_suffixes_and_counts_prefixes():
    rnd = random.Random(4)
    texts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(8)]
    flat = [w for t in texts for w in t]
    left = np.array([len(t) - i for t in texts for i in range(len(t))])
    order, lcp = resampling.suffix_array(np.array(flat), left, 4)
    grams = [tuple(flat[p : p + min(4, left[p])]) for p in order]
    assert grams == sorted(grams) and sorted(order) == list(range(len(flat)))
    for k in range(1, len(flat)):
        assert lcp[k] == next((i for i in range(4) if i >= min(len(grams[k]), len(grams[k - 1])) or grams[k][i] != grams[k - 1][i]), 4)


def test_hot_groups_are_dealt_to_all_partitions(spark):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x y").alias("text"))
    from tessera.llm.common import numbered

    got = numbered(same, [F.col("doc_id"), F.col("text")], "hot")
    assert max(r["count"] for r in got.groupBy("part").count().collect()) < 12_000
    assert got.agg(F.min("row"), F.max("row"), F.count_distinct("row")).head()[:] == (0, 19_999, 20_000)
