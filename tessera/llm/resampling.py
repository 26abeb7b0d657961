"""Operator 13, importance resampling towards a target distribution by hashed n-grams.

A partition's texts become one sequence of word ids; its suffix array, sorted to the longest n-gram, brings equal n-grams
together: a run of suffixes whose common prefixes have k words or more is one k-gram. Each run is hashed once and its bucket
written back to all its places.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ship, staged

#: Digits, small letters and bytes beyond ASCII are of words; A-Z become small, all else is a gap.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words that go through one suffix array; a longer text is an array of its own.
WORDS_AT_ONCE = 500_000


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words in common with the one before). left: words to the end of each place's text.

    Ranks by the first k words become ranks by 2k until they reach depth; suffixes that end sooner stand first. Common prefixes
    are counted to depth and never pass a text's end.
    """
    n, rank, width = len(ids), ids, 1
    while width < depth:
        after = np.full(n, -1, np.int64)
        inside = np.flatnonzero(left > width)
        after[inside] = rank[inside + width]
        rank, width = np.unique((rank << 32) | (after + 1), return_inverse=True)[1], width * 2
    if n and rank.max() < 1 << 16:
        rank = rank.astype(np.uint16)  # these are sorted in linear time
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n, np.int64)
    same = np.ones(len(a), bool)
    for k in range(depth):  # word by word, as far as both texts go
        same &= (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + k] == ids[b[at] + k]
        lcp[1:] += same
    return order, lcp


def gram_buckets(texts: list[list[bytes]], lo: int, hi: int, buckets: int) -> list[np.ndarray]:
    """The bucket of every n-gram of lo..hi words of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    upto = np.cumsum(size)
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
    words = list(number)
    left = np.repeat(upto, size) - np.arange(len(ids))
    order, lcp = suffix_array(ids, left, hi)
    found = []
    for k in range(lo, hi + 1):
        long_enough = left[order] >= k
        # a run of the k-gram ends where the common prefix is shorter; suffixes too short stand between runs
        head = np.flatnonzero(long_enough & (lcp < k))
        run = np.cumsum(long_enough & (lcp < k)) - 1
        first = order[head]
        hashed = np.array([zlib.crc32(b" ".join([words[j] for j in ids[p : p + k].tolist()])) % buckets for p in first.tolist()], np.int64)
        at = np.full(len(ids), -1, np.int64)
        at[order[long_enough]] = hashed[run[long_enough]]
        found.append(at)
    every = np.stack(found, 1) if len(ids) else np.zeros((0, hi - lo + 1), np.int64)
    start = upto - size
    return [(x := every[a:b].ravel())[x >= 0] for a, b in zip(start.tolist(), upto.tolist())]


def hashed(docs: DataFrame, doc_id: str | None, text: str, lo: int, hi: int, buckets: int) -> DataFrame:
    """doc_id, n_words, grams (the bucket of each n-gram, two or four bytes) of whole texts."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def cut(batches):
        for batch in batches:
            held, numbers, n = [], [], 0
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("raw"))
            for doc_id, raw in rows:
                words = (raw.as_py() or b"").translate(FOLD).split()
                if n and n + len(words) > WORDS_AT_ONCE:
                    yield table(numbers, held)
                    held, numbers, n = [], [], 0
                held.append(words)
                numbers.append(doc_id)
                n += len(words)
            if held:
                yield table(numbers, held)

    def table(numbers, held):
        grams = [g.astype(kind).tobytes() for g in gram_buckets(held, lo, hi, buckets)]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([len(t) for t in held], pa.int64()), pa.array(grams, pa.binary())], ["doc_id", "n_words", "grams"])

    key = F.lit(None).cast("long") if doc_id is None else F.col(doc_id).cast("long")
    return docs.select(key.alias("doc_id"), F.col(text).cast("binary").alias("raw")).mapInArrow(cut, "doc_id long, n_words long, grams binary")


def counted(grams: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features fall in each bucket that has any; a task sends a row for each of its buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count_up(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("grams"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return grams.select("grams").mapInArrow(count_up, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_documents: DataFrame, of_target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))): a number for each bucket, the parameter's size."""
    spark = of_documents.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(of_documents.withColumnRenamed("n", "s"), "bucket", "left").join(of_target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    made = both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row of totals
    out = np.zeros(buckets, np.int64)
    for r in made.collect():
        out[r["bucket"]] = r["gain"]
    return out


def weighed(grams: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    shared = grams.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        for batch in batches:
            features, weight = [], []
            for raw in batch.column("grams"):
                own = np.frombuffer(raw.as_buffer(), kind)
                features.append(len(own))
                weight.append(int(shared.value[own].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return grams.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = (1, 2), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank (from 1) only of those drawn.

    Weights are log ratios of hashed n-gram frequencies of target and documents, scores add Gumbel noise drawn from a hash of
    seed and doc_id, and the best `percent` of the documents with least_words words or more are drawn. Null or empty text: no
    features, weight 0. Null doc_id: hashed as an empty string, drawn after others of its score. Repeated rows: each scored and
    drawn. Empty documents: no rows; empty target: all its counts are 0. Other columns are dropped.
    """
    ship(docs.sparkSession)
    found = staged(hashed(docs, "doc_id", "text", *grams, buckets), "resampling-grams")
    gain = gains(counted(found, buckets), counted(hashed(target, None, target_text, *grams, buckets), buckets), buckets)
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = staged(weighed(found, gain, buckets).withColumn("score", F.col("weight") + noise), "resampling-scores")
    able = scored.where(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    drawn = able.count() * percent // 100
    ranked = numbered(able, order, "resampling-ranks").select("doc_id", "n_features", "weight", "score", F.when(F.col("row") < drawn, F.col("row") + 1).alias("rank"))
    others = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)
