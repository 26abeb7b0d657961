"""Operator 3, best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, partitions, ship, staged
from .tokens import encoder, prove_whole, slices, vocabulary_text

CAPACITY = 2048
#: Closes every document.
END_ID = 0


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and a closing 0, cut only where longer than capacity."""
    ship(docs.sparkSession)
    text = vocabulary_text(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((zlib.crc32(text.encode()), text, prove_whole(text)))
    end, width = END_ID.to_bytes(4, "little"), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        enc = None
        for batch in batches:
            enc = enc or encoder(*shared.value)
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in slices(texts):
                rows = []
                for doc_id, b in zip(ids[lo:hi], enc.encode(texts[lo:hi])):
                    b += end
                    rows += [(doc_id, p, at // 4, len(part := b[at : at + width]) // 4, zlib.crc32(part)) for p, at in enumerate(range(0, len(b), width))]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

    return keyed_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the largest sum up to capacity: subset sums as bits of one integer, length by length."""
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        before, copies, new = reach, min(counts[length], capacity // length), reach
        for _ in range(copies):
            grown = (new | (new << length)) & full
            if grown == new:
                break
            new = grown
        # new may hold more than `copies` of this length only if copies is capacity // length, where no more fit
        steps.append((length, before))
        reach = new
        if reach >> capacity & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def minimum_slack_plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Bins for a histogram of lengths: rows (length, first, last, bin, copies, offset).

    Each bin holds the largest length left and the fullest feasible combination beside it. Bins
    that would come out alike, one after another, are one row of the plan: the work and the plan depend on
    the number of different lengths (at most capacity), not on the number of pieces. The pieces of rank
    first..last-1 within their length take `copies` places per bin, from `bin` on, at `offset`.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    taken, plan, bins = dict.fromkeys(left, 0), [], 0
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v - (k == seed) > 0}
        chosen = fullest(rest, capacity - seed) if capacity > seed else {}
        chosen[seed] = chosen.get(seed, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            plan.append((length, taken[length], taken[length] + n * times, bins, n, offset))
            taken[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        bins += times
    return pd.DataFrame(plan, columns=["length", "first", "last", "bin", "copies", "offset"]).sort_values(["length", "first"], ignore_index=True)


def ranked(pieces: DataFrame) -> DataFrame:
    """rank from 0 within each length. Ranks are counted in (length, bucket) groups, so a common length never meets in one task, nor do rows without a doc_id."""
    n = 4 * partitions(pieces.sparkSession)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return bucketed.withColumn("nth", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("earlier") + F.col("nth") - 1).drop("nth", "earlier", "bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset: all documents in sequences of at most capacity tokens, by minimum bin slack.

    Null or empty text: the closing id alone. Repeated rows: packed each. Null doc_id: packed and
    kept null. Empty table: no rows. Other columns are dropped. To the driver go the
    counts of lengths (at most `capacity` rows); the plan it makes is broadcast (its rows
    depend on capacity alone).
    """
    pieces = staged(pieces_of(docs, capacity, vocabulary_path), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = minimum_slack_plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast({c: plan[c].to_numpy(np.int64) for c in plan})

    def place(batches):
        p = shared.value
        keys = p["length"] << 40 | p["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            nth = rank - p["first"][row]
            sequence, copy = p["bin"][row] + nth // p["copies"][row], nth % p["copies"][row]
            offset = p["offset"][row] + copy * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
