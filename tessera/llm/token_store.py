"""Operator 12, token ids on disk under a Re-Pair grammar for each shard.

A row of the store is a shard: whole documents in order, as symbols of the shard's own alphabet (its terminals, then
its rules). A rule stands for two symbols; its expansion length is stored, so that a token's place is found without
decoding what stands before it. No rule reaches past a document's end, so a document is a slice of symbols.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import before_each, keyed_text, new_path, partitions, removed_at_exit, ship, shuffle_files_dropped
from .tokens import encoder, prove_whole, slices, vocabulary_text

#: Closes every document. A shard ends with the document that takes it to so many tokens.
END_ID, SHARD_TOKENS = 1, 1 << 20
#: Least number of places of a pair that becomes a rule; a round that shortens a shard by a smaller share is its last.
LEAST_USES, LEAST_GAIN = 8, 0.01
#: Entries of a worker's table of resolved chunks, twice over: some 150 MB. With 150,000 a third more chunks are merged anew.
CHUNKS = 400_000
#: Slots of the table from pair to rule; of pairs that meet in one the most frequent takes it, the others wait for the next round.
SLOT_BITS = 18

STORE = "part int, shard int, before long, n_tokens long, doc_ids array<long>, doc_symbols array<long>, doc_tokens array<long>, width int, terminals binary, rules binary, lengths binary, symbols binary"


def pair_counts(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stand at `least` places or more, most frequent first, and how many places."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    count = np.diff(edge)
    kept = np.flatnonzero(count >= least)
    kept = kept[np.argsort(-count[kept], kind="stable")]
    return keys[edge[kept]], count[kept]


def slot_of(keys: np.ndarray, wide: bool) -> np.ndarray:
    """A hash of each pair: multiplication by an odd number near the golden ratio of the word, top bits."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS) if wide else (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


def chosen_places(at: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Of the places of rules' pairs (ascending; smaller rules come first) those to replace: none overlaps another, the better rule of two neighbours wins, and every second place of a run of equals."""
    beside = np.diff(at) == 1
    best = np.ones(len(at), bool)
    best[1:] &= ~beside | (rule[1:] <= rule[:-1])
    best[:-1] &= ~beside | (rule[:-1] <= rule[1:])
    index = np.flatnonzero(best)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at[index]) > 1))) if len(index) else np.zeros(0, np.int64)
    nth = np.arange(len(index)) - np.repeat(first, np.diff(np.append(first, len(index))))
    return index[nth % 2 == 0]


def dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct ids, ascending; each id's place among them)."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    terminals = np.flatnonzero(there).astype(ids.dtype)
    place = np.zeros(len(there), np.int64 if len(terminals) > 1 << 16 else np.uint16)
    place[terminals] = np.arange(len(terminals))
    return terminals, place[ids]


def repair(ids: np.ndarray, end_id: int = END_ID, least_uses: int = LEAST_USES, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, terminals, rules, lengths): the grammar of a shard's ids.

    Rounds of Re-Pair: the pairs of neighbours that stand often enough become rules, most frequent first, all their
    places that do not overlap are replaced at once, and the pairs of the next round may hold the new symbols. Pairs whose first
    symbol ends a document are never replaced.
    """
    terminals, symbols = dense(ids)
    wide = len(terminals) > 40_000  # else terminals and rules fit 16 bits
    kind, key_kind, most = (np.uint32, np.uint64, 1 << 31) if wide else (np.uint16, np.uint32, 1 << 16)
    symbols = symbols.astype(kind)
    shift, low = key_kind(32 if wide else 16), key_kind((1 << (32 if wide else 16)) - 1)
    rules, lengths = [], [np.ones(len(terminals), np.int64)]
    ends = [terminals == end_id]
    n_symbols = len(terminals)
    while len(symbols) > 1 and n_symbols < most:
        ending, length = np.concatenate(ends), np.concatenate(lengths)
        keys = symbols[:-1].astype(key_kind)
        keys <<= shift
        keys |= symbols[1:]
        pairs, _ = pair_counts(keys, least_uses)
        pairs = pairs[~ending[pairs >> shift]][: most - n_symbols]
        if not len(pairs):
            break
        _, winner = np.unique(slot_of(pairs, wide), return_index=True)  # the first of each slot: the most frequent
        pairs = pairs[np.sort(winner)]
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[slot_of(pairs, wide)] = np.arange(len(pairs), dtype=np.int32)
        rule = table[slot_of(keys, wide)]
        at = np.flatnonzero(rule >= 0)
        rule = rule[at]
        same = pairs[rule] == keys[at]
        at, rule = at[same], rule[same]
        index = chosen_places(at, rule)
        at, rule = at[index], rule[index]
        used = np.bincount(rule, minlength=len(pairs)) >= max(2, least_uses // 2)
        at, rule = at[used[rule]], rule[used[rule]]
        if not len(at):
            break
        pairs = pairs[used]
        left, right = (pairs >> shift).astype(np.int64), (pairs & low).astype(np.int64)
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols[at] = (n_symbols + np.cumsum(used) - 1).astype(kind)[rule]
        before, symbols = len(symbols), symbols[kept]
        rules.append(np.stack([left, right], 1))
        lengths.append(length[left] + length[right])
        ends.append(ending[right])
        n_symbols += len(pairs)
        if len(at) < least_gain * before:
            break
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return symbols, terminals.astype("<u4"), pairs.astype("<u4"), np.concatenate(lengths)[len(terminals) :].astype("<i8")


class Grammar:
    """A shard's rules, unfolded once: symbol s stands for flat[first[s] : first[s] + length[s]]."""

    def __init__(self, terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray):
        n = len(terminals)
        self.length = np.concatenate((np.ones(n, np.int64), lengths))
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        small = int(self.first[-1] + self.length[-1]) < 1 << 31 if len(self.first) else True
        self.length, self.first = (x.astype(np.int32 if small else np.int64) for x in (self.length, self.first))
        self.flat = np.empty(int(self.length.sum()), "<u4")
        self.flat[:n] = terminals
        # rules only use symbols before them: those whose parts are all unfolded go together
        depth = np.zeros(n + len(rules), np.int32)
        while True:
            deeper = 1 + np.maximum(depth[rules[:, 0]], depth[rules[:, 1]])
            if (deeper == depth[n:]).all():
                break
            depth[n:] = deeper
        for level in range(1, int(depth.max(initial=0)) + 1):
            these = np.flatnonzero(depth == level)
            for part, shift in ((rules[these - n, 0], 0), (rules[these - n, 1], self.length[rules[these - n, 0]])):
                self.flat[ranges(self.first[these] + shift, self.length[part])] = self.flat[ranges(self.first[part], self.length[part])]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.first[symbols], self.length[symbols])]

    def cut(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop-1 of what the symbols stand for, from the symbols that hold them alone."""
        upto = np.cumsum(self.length[symbols])
        a, b = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left")
        before = int(upto[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[start - before : stop - before]


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range, one after another."""
    upto = np.cumsum(length, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    kind = first.dtype if total < 1 << 31 else np.int64
    out = np.repeat((first - (upto - length)).astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out


def packed(ids: list[bytes], doc_ids: list[int | None], part: int, shard: int, before: int, end_id: int) -> dict:
    """A row of the store. ids: each document's, its end among them."""
    tokens = np.array([len(b) // 4 for b in ids], np.int64)
    symbols, terminals, rules, lengths = repair(np.frombuffer(b"".join(ids), "<u4"), end_id)
    size = np.concatenate((np.ones(len(terminals), np.int64), lengths))
    upto = np.cumsum(size[symbols])
    return {
        "part": part, "shard": shard, "before": before, "n_tokens": int(tokens.sum()), "doc_ids": doc_ids, "doc_symbols": np.concatenate(([0], np.searchsorted(upto, np.cumsum(tokens)) + 1)), "doc_tokens": tokens,
        "width": symbols.itemsize, "terminals": terminals.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": symbols.astype(f"<u{symbols.itemsize}").tobytes(),
    }


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts, in ascending order of doc_id, into a new store at path.

    Null or empty text: the end id alone. Null doc_id: before all others. Repeated doc_ids stand in the order of
    their texts' hashes. Empty table: an empty store. Other columns are dropped. Memory: a shard's ids, and a text with its ids.
    """
    spark = docs.sparkSession
    ship(spark)
    text = vocabulary_text(vocabulary_path)
    shared = spark.sparkContext.broadcast((zlib.crc32(text.encode()), text, prove_whole(text)))
    end = end_id.to_bytes(4, "little")
    order = [F.col("doc_id"), F.xxhash64("text")]
    tie = F.xxhash64(F.monotonically_increasing_id())  # equal rows go to several partitions
    ranged = keyed_text(docs).repartitionByRange(partitions(spark), *order, tie).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def shards(batches):
        enc, ids, doc_ids, n, shard, before = None, [], [], 0, 0, 0
        part = None
        schema = pa.schema([(f, t) for f, t in zip((x.split()[0] for x in STORE.split(", ")), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int32(), *[pa.binary()] * 4))])
        for batch in batches:
            enc = enc or encoder(*shared.value, CHUNKS)
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            texts, numbers = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in slices(texts):
                for doc_id, b in zip(numbers[lo:hi], enc.encode(texts[lo:hi])):
                    ids.append(b + end)
                    doc_ids.append(doc_id)
                    n += len(b) // 4 + 1
                    if n >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([packed(ids, doc_ids, part, shard, before, end_id)], schema)
                        ids, doc_ids, shard, before, n = [], [], shard + 1, before + n, 0
        if ids:
            yield pa.RecordBatch.from_pylist([packed(ids, doc_ids, part, shard, before, end_id)], schema)

    with shuffle_files_dropped(spark):
        ranged.mapInArrow(shards, STORE).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with start: the tokens of the whole store before the shard."""
    store = spark.read.schema(STORE).parquet(path)
    starts = before_each(store.groupBy("part").agg(F.sum("n_tokens").alias("tokens")), "tokens").withColumnRenamed("before", "part_start")
    return store.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")  # a row for each partition of the writing job


def grammar_of(row: dict) -> tuple[Grammar, np.ndarray]:
    return Grammar(np.frombuffer(row["terminals"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<i8")), np.frombuffer(row["symbols"], f"<u{row['width']}")


def documents_of(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) ids of every document of a store, decoded from its grammar."""
    ship(spark)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                grammar, symbols = grammar_of(row)
                tokens, at = np.array(row["doc_tokens"], np.int64), row["doc_symbols"]
                start = row["start"] + np.cumsum(tokens) - tokens
                raw = memoryview(grammar.expand(symbols).tobytes())
                upto = np.concatenate(([0], np.cumsum(tokens))) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(tokens), pa.array(crc, pa.int64())]
                if not with_ids:
                    yield pa.RecordBatch.from_arrays(cols, names)
                    continue
                for k in range(0, len(tokens), 256):  # ids of few documents at a time
                    some = [pa.array([np.frombuffer(raw[a:b], "<u4").astype(np.int64) for a, b in zip(upto[k : k + 256].tolist(), upto[k + 1 : k + 257].tolist())], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([c.slice(k, 256) for c in cols] + some, names)

    return read(spark, path).drop("part", "shard", "before").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokens_at(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """doc_id, first, last, ids: tokens first..last-1 of documents (spans: doc_id, first, last), from the symbols that hold them alone.

    Ends past a document's are cut to it. A span whose doc_id is null or not in the store gives no row; of repeated doc_ids each gives one.
    """
    ship(spark)
    shards = read(spark, path)
    place = shards.select("part", "shard", F.posexplode("doc_ids").alias("nth", "doc_id"), "doc_symbols", "doc_tokens")
    place = place.select("part", "shard", "doc_id", F.element_at("doc_symbols", F.col("nth") + 1).alias("a"), F.element_at("doc_symbols", F.col("nth") + 2).alias("b"), F.element_at("doc_tokens", F.col("nth") + 1).alias("n"))
    asked = spans.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).join(place, "doc_id")
    # a list holds what one task asks of a shard
    lists = asked.groupBy("part", "shard", F.spark_partition_id().alias("piece")).agg(F.collect_list(F.struct("doc_id", "first", "last", "a", "b", "n")).alias("spans"))
    wanted = lists.join(shards, ["part", "shard"]).select("spans", "width", "terminals", "rules", "lengths", "symbols")

    def look_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                grammar, symbols = grammar_of(row)
                for x in row["spans"]:
                    lo = min(max(x["first"], 0), x["n"])
                    ids = grammar.cut(symbols[x["a"] : x["b"]], lo, min(max(x["last"], lo), x["n"]))
                    yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"]]), pa.array([x["first"]]), pa.array([x["last"]]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "first", "last", "ids"])

    return wanted.mapInArrow(look_up, "doc_id long, first long, last long, ids array<long>")


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from a store written to the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write(docs, path, vocabulary_path)
    removed_at_exit(spark, path)
    return documents_of(spark, path, with_ids=False)
