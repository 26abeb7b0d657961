"""Operator 4, removal of repeated byte strings through suffix arrays made by two-stage sorting.

Sorting all suffixes of a corpus in one place does not scale, so suffixes are dealt out first. Every
50-byte window has an anchor: among its 16-byte strings the one of least hash (the leftmost of
these). It depends on the window alone, so equal windows have equal anchors, and the windows of one
anchor occurrence follow each other: one short stretch of text (a fragment) holds them all.
Anchors that one document alone has cannot lie in a repeat; the others' fragments meet in
partitions by anchor. There a suffix array is built over the fragments: only suffixes smaller than their
successor are sorted directly, the others are induced from them by one scan of the buckets, and adjacent
common prefixes of 50 bytes or more give the classes of equal windows with each class's
least doc_id. No window is left out: what is dealt out by anchor is every window that any other
document could have.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, removed, removed_at_exit, ship, shuffle_files_dropped, staged

#: Length of a repeat, of the strings that anchors are chosen among, bytes of text in a block.
SPAN, ANCHOR, BLOCK_BYTES = 50, 16, 2_000_000
#: An anchor in more documents than this sends its windows one by one, by their own content, so that no partition gathers them all.
COMMON = 1000
#: Partitions that blocks and parts are dealt to at most (Spark refuses more than 100,000 buckets).
PARTITIONS = 20_000
#: Above so many, blocks grow to eight times their size and up to eight parts are sent as one: each block has a row for each of these, so rows would grow with the square of the bytes.
MANY, TOGETHER = 256, 8
_U = np.uint64
_STEP = 1 << 18


# ---- anchors -------------------------------------------------------------------------------


def string_hashes(b: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place (k a power of two), by doubling."""
    h = (b.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < k:
        h = h[:-width] * _U(pow(factor, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ (h >> _U(32))) * _U(factor)
    return h ^ (h >> _U(32))


def spread(h: np.ndarray) -> np.ndarray:
    """32 even bits of anchors' hashes, which as minima are small themselves."""
    return h * _U(0x9E3779B97F4A7C15) >> _U(32)


def anchor_runs(b: np.ndarray, ends: np.ndarray):
    """(hash, first, last): for each anchor occurrence the windows first..last that it leads. b holds texts end to end; no window crosses an end."""
    w = SPAN - ANCHOR + 1
    out: list[tuple] = []
    for lo in range(0, max(len(b) - SPAN + 1, 0), _STEP):
        part = b[lo : lo + _STEP + SPAN - 1]
        h = string_hashes(part)
        m = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        width = 1
        while width * 2 <= w:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (w - width)], m[w - width :])
        whole = np.ones(len(m), bool)
        for e in ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + len(m) + SPAN, side="right")].tolist():
            whole[max(e - lo - SPAN + 1, 0) : max(e - lo, 0)] = False
        at = np.flatnonzero(whole)
        if len(at):
            lead = (m[at] & _U(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1)])
            last = np.r_[first[1:], len(at)] - 1
            out.append((h[lead[first]], at[first] + lo, at[last] + lo))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Block:
    """The texts of a block by (doc_id, digest), end to end."""

    def __init__(self, table: pa.Table):
        rows = sorted({(d, g): t for d, g, t in zip(*(table.column(c).to_pylist() for c in ("doc_id", "digest", "body")))}.items())
        self.ids = np.array([k[0] for k, _ in rows], np.int64)
        self.digests = [k[1] for k, _ in rows]
        self.b = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        self.ends = np.cumsum([len(t) for _, t in rows]).astype(np.int64)
        self.hash, self.first, self.last = anchor_runs(self.b, self.ends)

    def fragments(self, shared: np.ndarray, common: np.ndarray):
        """(unit, first, last, text row) of the occurrences of shared anchors, and the distinct fragments' bytes, anchors' hashes (common: content's) and least doc_id.

        Texts stand in the order of doc_id, so a fragment's first occurrence has the block's least one.
        """
        i = np.searchsorted(shared, self.hash)
        i[i == len(shared)] = 0
        hit = np.flatnonzero(shared[i] == self.hash) if len(shared) else np.zeros(0, np.int64)
        wide = common[i[hit]] if len(hit) else np.zeros(0, bool)
        h, first, last = self.hash[hit], self.first[hit], self.last[hit]
        n = np.where(wide, last - first + 1, 1)
        source = np.repeat(np.arange(len(hit)), n)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
        h, wide = h[source], wide[source]
        first, last = first[source] + nth, np.where(wide, first[source] + nth, last[source])
        raw, unit_of, units = self.b.tobytes(), {}, np.empty(len(source), np.int64)
        for j, (a, z, own) in enumerate(zip(first.tolist(), (last + SPAN).tolist(), wide.tolist())):
            units[j] = unit_of.setdefault((raw[a:z], own), len(unit_of))
        rows = np.searchsorted(self.ends, first, side="right")
        _, once = np.unique(units, return_index=True)
        return units, first, last, rows, [k[0] for k in unit_of], [zlib.crc32(k[0]) if k[1] else x for k, x in zip(unit_of, spread(h[once]).tolist())], self.ids[rows[once]] if len(once) else np.zeros(0, np.int64)


def ragged(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A blob a row, values[starts[i]:starts[i + 1]] (the last up to the end), without a step of Python for each."""
    v = np.ascontiguousarray(values)
    offsets = (np.r_[starts, len(v)] * v.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(v)])


def flat(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs end to end, and how many each row has (none for null)."""
    parts, lengths = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            off = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if off[-1] > off[0]:
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]])
            lengths.append(np.diff(off).astype(np.int64))
    return np.concatenate(parts).view(dtype), np.concatenate(lengths) // np.dtype(dtype).itemsize


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def picked(rows: np.ndarray, keep: np.ndarray, *values: np.ndarray):
    """The rows that keep something, and for each column of values its blobs of what is kept. rows: the row of each value."""
    mine = rows[keep]
    heads = starts_of(mine)
    return mine[heads], [ragged(v[keep], heads) for v in values]


# ---- two-stage suffix sorting --------------------------------------------------------------


def words_of(t: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that compares as they do."""
    return np.ndarray(len(t) - 7, ">u8", t, 0, (1,)).astype(_U)


def prefix_equal(words: np.ndarray, a: np.ndarray, z: np.ndarray, length: int = SPAN) -> np.ndarray:
    """Whether the suffixes at a and z have `length` bytes in common from their start."""
    same = np.ones(len(a), bool)
    for k in range(0, length, 8):
        live = np.flatnonzero(same)
        x = words[a[live] + k] ^ words[z[live] + k]
        if length - k < 8:
            x >>= _U(8 * (8 - (length - k)))
        same[live] = x == 0
    return same


def sort_directly(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first SPAN bytes (equal ones in any order): words in turn, only where ties go on."""
    order = at[np.argsort(words[at])]
    open_, depth = np.arange(len(order)), 0
    group = np.zeros(len(order), np.int64)
    while len(open_) and depth < SPAN:
        w = words[order[open_] + depth]
        new = np.r_[True, (w[1:] != w[:-1]) | (group[open_][1:] != group[open_][:-1]) | (open_[1:] != open_[:-1] + 1)]
        number = np.cumsum(new) - 1
        # a group whose neighbours all agree on SPAN bytes is done
        differs = np.zeros(number[-1] + 1, bool)
        j = np.flatnonzero(~new)
        differs[number[j][~prefix_equal(words, order[open_[j - 1]], order[open_[j]])]] = True
        go = differs[number]
        group[open_] = number
        open_ = open_[go]
        depth += 8
        if len(open_) and depth < SPAN:
            by = np.lexsort((words[order[open_] + depth], group[open_]))
            order[open_] = order[open_[by]]
    return order


def two_stage(t: np.ndarray, words: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array over the first counts[i] places of each fragment, correct to SPAN bytes.

    t: bytes + 1, a 0 after each fragment, a byte above 0 after the last 0, and padding. A suffix is small if less than its
    successor (as each 0's is): these are sorted directly. The scan of the buckets, least first byte first, then puts each
    other suffix in its bucket when its successor comes by; within a bucket the induced ones stand before the sorted ones.
    """
    change = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(len(t), bool)
    small[: change[-1] + 1] = np.repeat(t[change + 1] > t[change], np.diff(np.r_[-1, change]))
    smalls = np.flatnonzero(small)
    stop = smalls[np.searchsorted(smalls, firsts + counts)]  # the chain of successors ends at a directly sorted one
    reach = stop - firsts + 1
    elements = np.repeat(firsts - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
    held = np.zeros(len(t), bool)
    held[elements] = True
    direct = sort_directly(words, elements[small[elements]])
    del elements
    heads = np.searchsorted(t[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    for c in range(257):
        mine = list(induced[c])
        wave = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        while len(wave):
            before = wave[(wave > 0)] - 1
            wave = before[held[before] & (t[before] == c) & ~small[before]]
            if len(wave):
                mine.append(wave)
        mine.append(direct[heads[c] : heads[c + 1]])
        order = np.concatenate(mine)
        if not len(order):
            continue
        out.append(order)
        before = order[order > 0] - 1
        before = before[held[before] & (t[before] > c)]
        if len(before):
            first = t[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
                induced[first[lo]].append(before[lo:hi])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def later_windows(texts: bytes, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each fragment a bit mask of its windows that also stand in a fragment of a smaller doc_id."""
    masks = np.zeros(len(lengths), _U)
    if not len(lengths):
        return masks
    n = int(lengths.sum()) + len(lengths)
    t = np.zeros(n + 2 * SPAN + 16, np.uint8)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    where = np.ones(n, bool)
    where[firsts + lengths] = False
    t[:n][where] = np.frombuffer(texts, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    t[n] = 1  # so that the last 0 is small like the others, and each chain of successors ends
    counts = lengths - SPAN + 1
    words = words_of(t)
    order = two_stage(t, words, firsts, counts)
    fragment = np.searchsorted(firsts, order, side="right") - 1
    inside = order - firsts[fragment] < counts[fragment]
    order, fragment = order[inside], fragment[inside]
    new = np.r_[True, ~prefix_equal(words, order[:-1], order[1:])]
    heads = np.flatnonzero(new)
    doc = docs[fragment]
    least = np.minimum.reduceat(doc, heads)[np.cumsum(new) - 1]
    later = doc > least
    np.bitwise_or.at(masks, fragment[later], _U(1) << (order - firsts[fragment])[later].astype(_U))
    return masks


# ---- the distributed steps -----------------------------------------------------------------


def _batch(**cols) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(*v) for k, v in cols.items()})


def keep_leaders(key, texts, leaders):
    wanted = set(zip(leaders.column("doc_id").to_pylist(), leaders.column("digest").to_pylist()))
    keep = [k in wanted for k in zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist())]
    return texts.filter(pa.array(keep, pa.bool_())) if len(keep) else texts


def say_anchors(parts: int):
    """The block's anchors to the parts of their hash: part, block, hashes, in how many documents (up to 255)."""

    def run(key, texts):
        block = Block(texts)
        row = np.searchsorted(block.ends, block.first, side="right")
        by = np.lexsort((row, block.hash))
        h, row = block.hash[by], row[by]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        other = new | np.r_[True, row[1:] != row[:-1]] if len(h) else new
        heads = np.flatnonzero(new)
        many = np.minimum(np.add.reduceat(other.astype(np.int64), heads), 255).astype(np.uint8) if len(heads) else np.zeros(0, np.uint8)
        h = h[heads]
        part = (spread(h) * _U(parts) >> _U(32)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        starts = starts_of(part[by])
        return _batch(part=(part[by][starts], pa.int32()), block=(np.full(len(starts), key[0].as_py()), pa.int32()), hashes=ragged(h[by], starts), many=ragged(many[by], starts))

    return run


def find_shared(key, said):
    """To each block those of its anchors that two documents or more have: block, hashes, common."""
    blocks = said.column("block").to_numpy()
    h, lengths = flat(said.column("hashes"), _U)
    many = flat(said.column("many"), np.uint8)[0].astype(np.int64)
    by = np.argsort(h, kind="stable")
    heads = starts_of(h[by])
    total = np.zeros(len(h), np.int64)
    total[by] = np.repeat(np.add.reduceat(many[by], heads), np.diff(np.r_[heads, len(h)]))
    rows, (hashes, common) = picked(np.repeat(np.arange(len(blocks)), lengths), total > 1, h, (total > COMMON).astype(np.uint8))
    return _batch(block=(blocks[rows], pa.int32()), hashes=hashes, common=common)


def shared_anchors(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h, common = flat(told.column("hashes"), _U)[0], flat(told.column("common"), np.uint8)[0] > 0
    by = np.argsort(h, kind="stable")
    return h[by], common[by]


def say_fragments(parts: int, together: int = 1):
    """The block's fragments to the parts of their anchors, `together` parts in a row: part (of these), block, and of each fragment unit, place among the parts, doc_id, length, bytes."""

    def run(key, texts, told):
        _, _, _, _, bodies, routes, docs = Block(texts).fragments(*shared_anchors(told))
        fine = np.array(routes, np.int64) * parts >> 32
        part, sub = fine // together, (fine % together).astype(np.uint8)
        by = np.argsort(part, kind="stable")
        starts = starts_of(part[by])
        sizes = np.array([len(bodies[i]) for i in by.tolist()], np.uint8)
        text = np.frombuffer(b"".join([bodies[i] for i in by.tolist()]), np.uint8)
        places = np.r_[0, np.cumsum(sizes, dtype=np.int64)][starts]
        return _batch(part=(part[by][starts], pa.int32()), block=(np.full(len(starts), key[0].as_py()), pa.int32()), units=ragged(by.astype("<u4"), starts), subs=ragged(sub[by], starts), docs=ragged(docs[by], starts), lengths=ragged(sizes, starts), bodies=ragged(text, places))

    return run


def find_later(key, said):
    """To each block the masks of its fragments' windows that a smaller doc_id has too: block, units, masks. The parts that were sent as one are gone through in turn."""
    blocks = said.column("block").to_numpy()
    units, counts = flat(said.column("units"), "<u4")
    docs, subs = flat(said.column("docs"), np.int64)[0], flat(said.column("subs"), np.uint8)[0]
    bodies, lengths = flat(said.column("bodies"), np.uint8)[0], flat(said.column("lengths"), np.uint8)[0].astype(np.int64)
    masks = np.zeros(len(units), _U)
    for sub in np.unique(subs).tolist():
        here = subs == sub
        masks[here] = later_windows(bodies[np.repeat(here, lengths)].tobytes(), lengths[here], docs[here])
    rows, (units, masks) = picked(np.repeat(np.arange(len(blocks)), counts), masks > 0, units, masks)
    return _batch(block=(blocks[rows], pa.int32()), units=units, masks=masks)


def cut_texts(key, texts, told):
    """The block's documents without the bytes that some marked window covers."""
    block = Block(texts)
    units, first, last, rows, bodies, _, docs = block.fragments(*shared_anchors(told))
    masks = np.zeros(len(bodies), _U)
    np.bitwise_or.at(masks, flat(told.column("units"), "<u4")[0], flat(told.column("masks"), _U)[0])
    step = np.zeros(len(block.b) + 1, np.int8)  # no place begins or ends more than one window
    if len(units):
        again = block.ids[rows] > docs[units]  # the block itself has the fragment in a smaller doc_id
        n = last - first + 1
        source = np.repeat(np.arange(len(units)), n)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
        gone = again[source] | ((masks[units[source]] >> nth.astype(_U)) & _U(1) > 0)
        at = (first[source] + nth)[gone]
        step[at] += 1
        step[at + SPAN] -= 1
    removed = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = []
    lo = 0
    for doc_id, digest, hi in zip(block.ids.tolist(), block.digests, block.ends.tolist()):
        r = removed[lo:hi]
        runs = int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if hi > lo else 0
        kept = block.b[lo:hi][~r].tobytes() if runs else block.b[lo:hi].tobytes()
        out.append((doc_id, digest, hi - lo - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        lo = hi
    return out


def cut_digest(key, texts, told):
    cols = list(zip(*cut_texts(key, texts, told))) or [()] * 6
    return _batch(doc_id=(cols[0], pa.int64()), digest=(cols[1], pa.binary()), n_removed=(cols[2], pa.int64()), n_spans=(cols[3], pa.int64()), kept_sha256=(cols[4], pa.string()))


def sizes_for(total: int, least: int, block_bytes: int) -> tuple[int, int, int]:
    """(blocks, parts, partitions) for so many bytes. Blocks and parts grow with the bytes, so that one of them fits a worker at any size;
    a partition takes several in turn, so that their number stays within what Spark can deal out. Blocks are larger where there are many, so
    that a block's row to a part holds more than an anchor or two."""
    parts = max(least, math.ceil(total / block_bytes)) | 1
    blocks = max(least, math.ceil(total / min(max(block_bytes, total // min(MANY, PARTITIONS)), TOGETHER * block_bytes))) | 1
    return blocks, parts, min(blocks, PARTITIONS)


def sent_as_one(parts: int, least: int) -> int:
    """How many parts a row of a block holds: one while there are few, so that all cores have parts to work on."""
    return min(max(parts // max(MANY, least), 1), TOGETHER)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per input row.

    A document equal to one of smaller doc_id loses all if it has 50 bytes or more; only the
    first of equal texts goes through the suffix arrays. Null text: empty. Texts under 50 bytes: kept
    whole. Rows of equal doc_id are not compared with each other; equal rows get equal results. Null doc_id: no
    document is smaller and it is smaller than none: nothing removed. Empty table: no
    rows. Other columns are dropped. Whole texts of any length that a row can hold are read (a text is never split over blocks: one of
    a gigabyte is a block of its own, and its worker needs some ten times that).
    The table of texts that the steps read by block is dropped at the end.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    digest = F.unhex(F.md5("body"))
    info = staged(rows.select("doc_id", digest.alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"), F.when((F.octet_length("body") < SPAN) | F.col("doc_id").isNull(), F.sha2("body", 256)).alias("own_sha")), "repeat-info")
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    n, parts, dealt = sizes_for(total, partitions(spark), block_bytes)
    together = sent_as_one(parts, partitions(spark))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block")
    # staged, so that the join of copies to leaders below has plain shuffles on both sides and Spark can split a hot digest
    leaders = staged(info.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes")), "repeat-leaders")
    wanted = leaders.where(F.col("n_bytes") >= SPAN).select(block, "doc_id", "digest").repartition(dealt, "block")
    bodies = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("body") >= SPAN)).select(block, "doc_id", digest.alias("digest"), "body").repartition(dealt, "block")
    schema = "block int, doc_id long, digest binary, body binary"
    firsts = bodies.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(keep_leaders, schema)
    table, path = f"tessera_texts_{uuid.uuid4().hex[:12]}", new_path(spark, "repeat-texts")  # in the folder that all nodes share, wherever the warehouse is
    removed_at_exit(spark, path)
    try:
        with shuffle_files_dropped(spark):  # bucketed by block: the steps below read it without a shuffle
            firsts.write.bucketBy(dealt, "block").option("compression", "zstd").option("path", path).saveAsTable(table)
        texts = spark.table(table)
        said = texts.groupBy("block").applyInArrow(say_anchors(math.ceil(parts / together)), "part int, block int, hashes binary, many binary")
        shared = staged(said.repartition(dealt, "part").groupBy("part").applyInArrow(find_shared, "block int, hashes binary, common binary"), "repeat-anchors")
        fragments = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(say_fragments(parts, together), "part int, block int, units binary, subs binary, docs binary, lengths binary, bodies binary")
        later = staged(fragments.repartition(dealt, "part").groupBy("part").applyInArrow(find_later, "block int, units binary, masks binary"), "repeat-windows")
        none = F.lit(None).cast("binary")
        told = shared.select("block", "hashes", "common", none.alias("units"), none.alias("masks")).unionByName(later.select("block", none.alias("hashes"), none.alias("common"), "units", "masks"))
        cut = staged(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_digest, "doc_id long, digest binary, n_removed long, n_spans long, kept_sha256 string"), "repeat-cuts")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(spark, path)
    led = info.join(leaders.select("digest", F.col("doc_id").alias("leader")), "digest", "left")
    out = led.join(cut, ["doc_id", "digest"], "left")
    copy = (F.col("doc_id") > F.col("leader")) & (F.col("n_bytes") >= SPAN)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("own_sha", "kept_sha256")).alias("kept_sha256"),
    )
