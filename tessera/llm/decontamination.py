"""Operator 1, benchmark passages in documents by pigeonhole edit matching."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, ship
from .holding import held

#: Edits allowed, as a part of a passage's length; bytes of passages that one pass over the documents takes.
EDIT_RATE, BLOCK_BYTES = 0.05, 4 << 20
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, letters and digits with single spaces between."""
    return _GAP.sub(" ", text.lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in edits + 1 pieces of nearly equal length; with `edits` errors or fewer one of them is untouched."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a]


def myers(pattern: str, text: str, edits: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of pattern in text, at most `edits` errors, the leftmost end of equals: Myers' bit vectors, free start."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        equal[c] |= 1 << i
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1) & full  # a match may start anywhere: no error before the first character
        hn = (hn << 1) & full
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0
        if score <= edits and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, at = [], defaultdict(list)
        for item_id, text in items:
            item = normal(text or "")
            if item:
                edits = math.floor(len(item) * rate)
                for offset, piece in pieces(item, edits):
                    at[piece].append((len(self.items), offset))
                self.items.append((item_id, item, edits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item's best match in the normal form of text, the leftmost of equals."""
        if not self.items:
            return []
        text = normal(text)
        hits: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                hits[item].add(end + 1 - length - offset)
        out = []
        for n, starts in hits.items():
            item_id, item, edits = self.items[n]
            best, upto = None, -1
            for start in sorted(starts):  # where the item would start if nothing before the piece was edited
                if start >= 0 and text.startswith(item, start):
                    best = (0, start, start + len(item))
                    break
            if best is None:
                for start in sorted(starts):
                    lo, hi = max(start - 2 * edits, 0), start + len(item) + 2 * edits
                    if hi <= upto:
                        continue
                    upto = hi
                    found = myers(item, text[lo:hi], edits)
                    if found and (best is None or found[0] < best[0]):
                        end = lo + found[1]
                        back = myers(item[::-1], text[max(end - len(item) - edits, 0) : end][::-1], edits)
                        best = (found[0], end - (back[1] if back and back[0] == found[0] else len(item)), end)
            if best:
                out.append((item_id, *best))
        return sorted(out)


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in lists of about block_bytes, each small enough to send to every task."""
    chosen = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_edits, start, end: documents that hold an item with at most rate x its length edits.

    Both sides are compared in lower case with single spaces for all that is no letter or digit; start and end are places in
    that form of the document. One row per matching row and item, its best match. Items are the stated query set:
    blocks of bounded size, each sent to all tasks that scan the documents. Null or empty text or item:
    no match. Null ids: kept. Repeated items count once, repeated documents each. Empty tables: no rows. Other columns are
    dropped. Whole texts.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, n_edits int, start long, end long"
    names = ["doc_id", "item_id", "n_edits", "start", "end"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        key = hashlib.sha256(repr((sorted(block, key=repr), rate)).encode()).digest()
        shared = spark.sparkContext.broadcast((key, block, rate))

        def find(batches, shared=shared):
            key, block, rate = shared.value
            matcher = held(("matcher", key), lambda: Matcher(block, rate))
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for m in matcher.matches(t.as_py())]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        part = keyed_text(docs).mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs without a match, with all their columns. A document is judged by its own text, row by row."""
    spark = docs.sparkSession
    ship(spark)
    from pyspark.sql.functions import pandas_udf

    clean = docs
    for block in item_blocks(items, "item_id", "text", BLOCK_BYTES):
        key = hashlib.sha256(repr((sorted(block, key=repr), rate)).encode()).digest()
        shared = spark.sparkContext.broadcast((key, block, rate))

        @pandas_udf("boolean")
        def holds(texts, shared=shared):
            import pandas as pd

            key, block, rate = shared.value
            matcher = held(("matcher", key), lambda: Matcher(block, rate))
            return pd.Series([bool(t) and bool(matcher.matches(t)) for t in texts], dtype=bool)

        clean = clean.where(~holds("text"))
    return clean
