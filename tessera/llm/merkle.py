"""Operator 11, a Merkle manifest of a dataset: a tree of digests for each group of rows, one root over all, proofs for every row.

Leaves are range-sorted by group and id. Counts of the partitions give each partition's place in its
groups, so that it builds every subtree that it holds whole by itself; only the nodes at its ragged borders
(fewer than two runs a level) are shuffled, by coordinate, and finished level by level. Proofs are read
off a partition's own levels and the border nodes sent to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, partitions, ship, staged

#: Children of a node, and characters of a digest.
FAN, WIDE = 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as byte count, colon and value, a null as '-'."""
    said = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said)), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree with n of them; one leaf is its own root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def parents(nodes: bytes, first: int, last: int) -> bytes:
    """Digests of the runs first..last-1 of a level whose nodes begin at run `first`."""
    return b"".join(hashlib.sha256(nodes[WIDE * FAN * j : WIDE * FAN * (j + 1)]).hexdigest().encode() for j in range(last - first))


def ragged(nodes: bytes, at: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the nodes whose run is not whole in nodes: leaves at..at+len of a group of n."""
    level, size = 0, n
    while True:
        end = at + len(nodes) // WIDE
        if size == 1:
            if nodes:
                yield level, 0, nodes.decode()
            return
        first, last = -(-at // FAN), end // FAN if end < size else -(-end // FAN)
        if last <= first:
            yield from ((level, at + i, nodes[WIDE * i : WIDE * (i + 1)].decode()) for i in range(end - at))
            return
        yield from ((level, at + i, nodes[WIDE * i : WIDE * (i + 1)].decode()) for i in range(first * FAN - at))
        yield from ((level, p, nodes[WIDE * (p - at) : WIDE * (p - at + 1)].decode()) for p in range(last * FAN, end))
        nodes, at, size, level = parents(nodes[WIDE * (first * FAN - at) :], first, last), first, -(-size // FAN), level + 1


def finished(loose: DataFrame, most: int) -> DataFrame:
    """All nodes (g, n, level, place, digest) above loose ones: runs hashed level by level, each level one shuffle by coordinate. most: the largest group's n."""
    level = loose.where("level = 0")
    levels, size = [level], F.col("n")
    for k in range(1, height(most) + 1):
        runs = level.where(size > 1).groupBy("g", "n", F.floor(F.col("place") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))
        above = runs.select("g", "n", F.lit(k).alias("level"), F.col("up").alias("place"), F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest"))
        size = F.ceil(size / FAN)
        level = above.unionByName(loose.where(F.col("level") == k))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def levels_of(n: Column) -> Column:
    """height() of a column."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(n.cast("long").alias("left"), F.lit(0).alias("levels")), lambda a, _: F.struct(F.ceil(a["left"] / FAN).alias("left"), (a["levels"] + (a["left"] > 1).cast("int")).alias("levels")))["levels"]


def paths_over(subroots: DataFrame) -> tuple[DataFrame, str]:
    """(g, subroot, lefts, rights) and the root: for each group the digests left and right of its own, level by level above its subroot. A row for each group."""
    placed = numbered(subroots, [F.col("g"), F.col("subroot")], "merkle-subroots")
    level = staged(placed.select("g", "subroot", F.col("row").alias("own"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights")), "merkle-groups")
    nodes = level.select(F.col("own").alias("place"), F.col("subroot").alias("digest"))
    n = nodes.count()
    while n > 1:
        runs = staged(nodes.groupBy(F.floor(F.col("place") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run")), "merkle-runs")
        side = lambda within: F.array_join(F.transform(F.filter("run", within), lambda x: x["digest"]), "")
        joined = level.withColumn("up", F.floor(F.col("own") / FAN)).join(runs, "up")
        joined = joined.withColumns({"lefts": F.array_append("lefts", side(lambda x: x["place"] < F.col("own"))), "rights": F.array_append("rights", side(lambda x: x["place"] > F.col("own")))})
        level = joined.select("g", "subroot", F.col("up").alias("own"), "lefts", "rights")
        nodes = runs.select(F.col("up").alias("place"), F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest"))
        n = -(-n // FAN)
    last = nodes.head()
    return level.drop("own"), last["digest"] if last else ""


def local_borders(batches, column: str = "leaf"):
    """Of a partition's leaves in order (g, place, n): its nodes that need others for their run."""
    g, at, n, held = None, 0, 0, []

    def closed():
        rows = [(g, n, *node) for node in ragged(b"".join(held), at, n)] if held else []
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["g", "n", "level", "place", "digest"])

    for batch in batches:
        for group, place, size, node in zip(*(batch.column(c).to_pylist() for c in ("g", "place", "n", column))):
            if group != g:
                yield closed()
                g, at, n, held = group, place, size, []
            held.append(node.encode())
    yield closed()


class Segment:
    """A partition's leaves of one group, and the runs around them on every level."""

    def __init__(self, at: int, n: int, leaves: list[str], border: dict[tuple[int, int], str]):
        self.at, nodes, size, level = at, "".join(leaves), n, 0
        self.levels: list[tuple[int, bytes]] = []
        first, last = at, at + len(leaves)
        while size > 1:
            start, end = first // FAN * FAN, min(size, -(-last // FAN) * FAN)
            whole = "".join(border[level, p] for p in range(start, first)) + nodes + "".join(border[level, p] for p in range(last, end))
            self.levels.append((start, whole.encode()))
            first, last, size, level = start // FAN, -(-end // FAN), -(-size // FAN), level + 1
            nodes = parents(self.levels[-1][1], first, last).decode()
        self.subroot = nodes

    def siblings(self, place: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of a leaf's ancestors in their runs, from the leaf up."""
        out = []
        for start, nodes in self.levels:
            run = (place - start) // FAN * FAN * WIDE
            own = (place - start) * WIDE
            out.append((nodes[run:own], nodes[own + WIDE : run + FAN * WIDE]))
            place //= FAN
        return out


def proofs_of(root: str, rows_a_batch: int = 5000):
    """For mapInArrow over a partition: border nodes and groups' paths first, then its leaves in order."""

    def prove(batches):
        border: dict[str, dict[tuple[int, int], str]] = {}
        over: dict[str, list[tuple[bytes, bytes]]] = {}
        g, at, n, held = None, 0, 0, []

        def closed():
            if not held:
                return
            segment = Segment(at, n, [x[1] for x in held], border.pop(g, {}))
            upper = over.pop(g)
            for lo in range(0, len(held), rows_a_batch):
                out = []
                for i, (doc_id, leaf, tampered) in enumerate(held[lo : lo + rows_a_batch], at + lo):
                    path = segment.siblings(i) + upper
                    folded = leaf if tampered is None else tampered
                    for left, right in path:
                        folded = hashlib.sha256(b"".join((left, folded.encode(), right))).hexdigest()
                    out.append((doc_id, leaf, segment.subroot, root, hashlib.sha256(b"".join(x for sides in path for x in sides)).hexdigest(), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.bool_() if k == 6 else pa.string()) for k, c in enumerate(zip(*out))], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        for batch in batches:
            for row in batch.to_pylist():
                group = row["g"]
                if row["kind"] == 0:
                    border.setdefault(group, {})[row["level"], row["place"]] = row["leaf"]
                elif row["kind"] == 1:
                    over[group] = [(a.encode(), b.encode()) for a, b in zip(row["lefts"], row["rights"])]
                else:
                    if group != g:
                        yield from closed()
                        g, at, n, held = group, row["place"], row["n"], []
                    held.append((row["doc_id"], row["leaf"], row["tampered"]))
        yield from closed()

    return prove


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang") -> DataFrame:
    """doc_id, g, leaf, tampered: g sorts null first and then by bytes; tampered is the leaf after tampering, null where the row is left alone."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = [F.translate(f, UPPER, LOWER) if f == "text" else F.col(f) for f in fields]
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), leaf([F.col(f) for f in fields]).alias("leaf"), F.when(hit, leaf(changed)).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, a row for each of docs.

    Null fields: '-' in the leaf; null lang: a group of its own, the first; null doc_id: first in its group, never
    tampered with. Repeated doc_ids stand in the order of their leaves, equal rows each take a leaf (their proofs differ by
    place). Empty table: no rows. Other columns are dropped. A task holds its own partition's
    digests, some 400 bytes a row.
    """
    spark = docs.sparkSession
    ship(spark)
    n_parts = partitions(spark)
    made = staged(leaves_of(docs), "merkle-leaves")
    rows = staged(numbered(made, [F.col(c) for c in ("g", "doc_id", "leaf", "tampered")], "merkle-ranges"), "merkle-rows")
    segments = staged(rows.groupBy("part", "g").agg(F.min("row").alias("start"), F.count("*").alias("rows")), "merkle-segments")
    groups = segments.groupBy("g").agg(F.min("start").alias("first"), F.sum("rows").alias("n"))
    segments = segments.join(groups, "g").select("part", "g", "n", "first", (F.col("start") - F.col("first")).alias("at"), "rows")
    placed = staged(rows.join(segments, ["part", "g"]).withColumn("place", F.col("row") - F.col("first")).drop("first", "rows"), "merkle-places")
    most = groups.agg(F.max("n")).head()[0] or 0
    in_order = placed.select("part", "row", "g", "place", "n", "leaf").repartitionById(n_parts, "part").sortWithinPartitions("row")
    loose = staged(in_order.mapInArrow(local_borders, "g string, n long, level int, place long, digest string"), "merkle-borders")
    nodes = staged(finished(loose, most), "merkle-nodes")
    subroots = nodes.where(F.col("level") == levels_of(F.col("n"))).select("g", F.col("digest").alias("subroot"))
    paths, root = paths_over(subroots)
    # what a segment's ends lack of their runs, level by level: coordinates of fewer than two runs each
    step = F.pow(F.lit(FAN), F.col("level")).cast("long")
    ends = segments.select("part", "g", "n", "at", "rows", F.explode(F.sequence(F.lit(0), levels_of(F.col("n")))).alias("level")).where(F.col("level") < levels_of(F.col("n")))
    ends = ends.select("part", "g", "level", F.floor(F.col("at") / step).alias("a"), F.ceil((F.col("at") + F.col("rows")) / step).alias("b"), F.ceil(F.col("n") / step).alias("size"))
    before = F.when(F.col("a") % FAN > 0, F.sequence(F.col("a") - F.col("a") % FAN, F.col("a") - 1)).otherwise(F.array().cast("array<long>"))
    to = F.least(F.ceil(F.col("b") / FAN) * FAN, F.col("size"))
    after = F.when(F.col("b") < to, F.sequence(F.col("b"), to - 1)).otherwise(F.array().cast("array<long>"))
    asked = ends.select("part", "g", "level", F.explode(F.concat(before, after)).alias("place"))
    none = lambda kind: F.lit(None).cast(kind)
    border = asked.join(nodes.drop("n"), ["g", "level", "place"]).select("part", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), "g", "place", none("long").alias("n"), none("long").alias("doc_id"), F.col("digest").alias("leaf"), none("string").alias("tampered"), "level", none("array<string>").alias("lefts"), none("array<string>").alias("rights"))
    heads = segments.select("part", "g").join(paths, "g").select("part", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("row"), "g", none("long").alias("place"), none("long").alias("n"), none("long").alias("doc_id"), none("string").alias("leaf"), none("string").alias("tampered"), none("int").alias("level"), "lefts", "rights")
    own = placed.select("part", F.lit(2).alias("kind"), "row", "g", "place", "n", "doc_id", "leaf", "tampered", none("int").alias("level"), none("array<string>").alias("lefts"), none("array<string>").alias("rights"))
    stream = border.unionByName(heads).unionByName(own).repartitionById(n_parts, "part").sortWithinPartitions("kind", "row")
    return stream.mapInArrow(proofs_of(root), PROOFS)
