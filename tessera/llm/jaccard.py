"""Operator 5, n-gram Jaccard self-join by chosen paths.

Texts of equal shingle sets are one class from the start. Each class's set is embedded as COORDINATES
minimum hashes. A run of the chosen-path tree samples coordinates at every node, on average
1 / similarity of them, and splits a bucket by the values of each; two sets of the wanted similarity keep meeting in one child on
average. Runs are repeated for the target recall, their number coming from it and from how deep a pair may have to split; a pair that must
split more often is found less surely by the runs, but ties to representatives find most of these. Small buckets are compared in full. In a large one
every member is compared with some representatives; those near one leave, as whatever is similar to
them is near that representative too and tied to it; the others split again. Ties are
loose on purpose: they gather groups in which afterwards all pairs are counted exactly on the
full sets, in blocks of members, so that group sizes bound no task and no pair becomes a row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed_text, partitions, ship, staged
from .graphs import components
from .holding import let_go

WORDS, SIMILARITY = 5, 0.8
#: Coordinates of the embedding; share of linked pairs that the ties must join on average, and levels that a pair may have to split for that.
COORDINATES, RECALL, DEPTH = 64, 0.995, 2
#: Largest bucket compared in full; representatives of a larger one; levels after which what is left counts as one group (and is counted exactly).
SMALL, REPRESENTATIVES, LEVELS = 192, 16, 12
#: Agreement of coordinates to be tied (four deviations under the similarity), tied to a representative (two distances of 0.2 and noise), to leave a bucket.
TIED, TIED_TO_ONE, LEAVES = 0.6, 0.35, 0.7
#: Members of a block in the exact count.
BLOCK = 160
_U = np.uint64


# ---- sets ------------------------------------------------------------------------------------


class Shingles:
    """Hashes of a text's word runs: lower case, words of letters, digits and underscores."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.inner = np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        inner = self.inner[points]
        edge = np.flatnonzero(np.diff(np.r_[False, inner, False].view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, _U)
        at = np.arange(len(points)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(points)]))
        mixed = points.astype(_U) * _U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U(31)
        mixed *= (at.astype(_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
        mixed[~inner] = 0
        h = np.add.reduceat(mixed, starts) + (ends - starts).astype(_U)
        h = scrambled(h)
        n = max(len(h) - self.words + 1, 1)
        run = np.zeros(n, _U)
        for j in range(min(self.words, len(h))):
            run = run * _U(0xC2B2AE3D27D4EB4F) + h[j : j + n]
        return np.unique(scrambled(run))


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


_SEEDS = scrambled(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def embedding(sets: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDINATES hash orders, 32 bits of it."""
    least = np.full(COORDINATES, ~_U(0))
    for lo in range(0, len(sets), 4096):
        part = sets[lo : lo + 4096]
        h = part[None, :] * _SEEDS[:, None]
        h ^= h >> _U(33)
        h *= _U(0x9E3779B97F4A7C15)
        least = np.minimum(least, h.min(1))
    return (least >> _U(32)).astype("<u4")


def node_of(sets: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(sets.tobytes()).digest()[:8], "little", signed=True)


def embedded(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row (a number), doc_id, node (the set's digest; null without words), embedding, text. Rows are numbered as they lie, so only what is stored has lasting numbers."""

    def run(batches):
        let_go()
        shingles = Shingles(words)
        for batch in batches:
            nodes, sigs = [], []
            for t in batch.column("text"):
                s = shingles(t.as_py())
                nodes.append(node_of(s) if len(s) else None)
                sigs.append(embedding(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), batch.column("text")], ["doc_id", "node", "embedding", "text"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, node long, embedding binary, text string").withColumn("row", F.monotonically_increasing_id())


# ---- the chosen-path tree --------------------------------------------------------------------


def children(rows: DataFrame, similarity: float) -> DataFrame:
    """path, node, embedding of the next level: a path and a coordinate's number decide whether it is sampled, so all of a bucket agree."""

    def run(batches):
        most = int(2**32 / (similarity * COORDINATES))
        numbers = np.arange(1, COORDINATES + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
        for batch in batches:
            paths = np.array(batch.column("path").to_numpy(zero_copy_only=False), np.int64).view(_U)
            sampled = scrambled(paths[:, None] ^ numbers[None, :])
            row, at = np.nonzero((sampled >> _U(32)) < _U(most))
            values = np.frombuffer(b"".join(batch.column("embedding").to_pylist()), "<u4").reshape(-1, COORDINATES)[row, at]
            new = scrambled(sampled[row, at] ^ (values.astype(_U) * _U(0x9E3779B97F4A7C15))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(new), batch.column("node").take(pa.array(row))], ["path", "node"])

    return rows.mapInArrow(run, "path long, node long")


def survival(depth: int) -> float:
    """How likely a pair of the wanted similarity still shares a bucket after so many levels of one run: a branching process of mean one."""
    s = 1.0
    for _ in range(depth):
        s = 1 - (1 - s / COORDINATES) ** COORDINATES
    return s


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair that has to go so deep shares a bucket in one of them. Half of what may be missed is left to the noise of ties."""
    return math.ceil(math.log((1 - recall) / 2) / math.log(1 - survival(depth)))


def roots(sets: DataFrame, runs: int) -> DataFrame:
    """Every set at the root of every run."""
    root = F.xxhash64(F.lit("root"), F.col("run"))
    return sets.select("node", "embedding", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).select(root.alias("path"), "node", "embedding")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of each row of a with each row of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    for j in range(a.shape[1]):
        out += a[:, j, None] == b[None, :, j]
    return out / a.shape[1]


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix: (member, root of its tree)."""
    n, seen, out = len(links), np.zeros(len(links), bool), []
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        wave = np.array([i])
        while len(wave):
            new = np.flatnonzero(links[wave].any(0) & ~seen)
            seen[new] = True
            out += [(int(x), i) for x in new]
            wave = new
    return out


def ties_within(rows: DataFrame, n: int) -> DataFrame:
    """a, b: a forest of the ties inside each small bucket. Buckets are read one after another from sorted partitions."""

    def run(batches):
        for _, nodes, sigs in grouped(batches, "path", ("node", "embedding")):
            if len(nodes) < 2:
                continue
            s = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES)
            tied = agreement(s, s) >= TIED
            pairs = forest(tied)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

    return rows.repartition(n, "path").sortWithinPartitions("path", "node").mapInArrow(run, "a long, b long")


def grouped(batches, key: str, columns: tuple[str, ...]):
    """(key, values of a column, ...) of each run of equal keys in batches sorted by key."""
    current, held = None, [[] for _ in columns]
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cols = [batch.column(c).to_pylist() for c in columns]
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                if keys[lo] != current and held[0]:
                    yield current, *held
                    held = [[] for _ in columns]
                current = keys[lo]
                for h, c in zip(held, cols):
                    h += c[lo:i]
                lo = i
    if held[0]:
        yield current, *held


def candidate_ties(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """a, b: ties that join every two sets of the wanted similarity that the runs bring together."""
    n, signature = partitions(sets.sparkSession), sets.select("node", "embedding")
    level, found = roots(sets, runs_for(recall, DEPTH)), []
    for depth in range(LEVELS):
        below = children(level, similarity)
        if depth:
            below = below.distinct()
        below = staged(below, f"paths-{depth}")
        # sizes and representatives are staged: the joins with them then have plain shuffles on both sides, and Spark can split a hot path
        sizes = staged(below.groupBy("path").count().where("count > 1"), f"sizes-{depth}")
        kept = staged(below.join(sizes, "path").join(signature, "node"), f"buckets-{depth}")
        small, large = kept.where(F.col("count") <= SMALL), kept.where(F.col("count") > SMALL)
        found.append(ties_within(small.select("path", "node", "embedding"), n))
        if not large.limit(1).count():
            return starred(staged(union(found), "ties"))
        # a bucket's representatives: about REPRESENTATIVES of its members, those of least hash, so that buckets with the same members have the same ones
        pick = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) * F.col("count") < REPRESENTATIVES << 40
        few = large.where(pick).groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("h"), "node", "embedding"))).alias("r"))
        few = staged(few.select("path", F.col("r.node").alias("r_nodes"), F.col("r.embedding").alias("r_sigs")), f"representatives-{depth}")
        judged = staged(large.select("path", "node", "embedding").join(few, "path", "left").mapInArrow(against_representatives, "path long, node long, embedding binary, leaves boolean, root array<long>"), f"judged-{depth}")
        found.append(judged.select(F.col("node").alias("a"), F.explode("root").alias("b")).where("a <> b"))
        level = judged.where(~F.col("leaves")).select("path", "node", "embedding")
        if not level.limit(1).count():
            return starred(staged(union(found), "ties"))
    # what no level has split: each bucket as one group, so that its pairs are counted exactly all the same
    rest = level.groupBy("path").agg(F.min("node").alias("b"))
    found.append(level.join(rest, "path").select(F.col("node").alias("a"), "b").where("a <> b"))
    return starred(staged(union(found), "ties"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def starred(ties: DataFrame) -> DataFrame:
    """The same groups from fewer ties: a member keeps its least root, and its other roots are tied to that one.

    A member has a tie or a few from each bucket that it was in (runs and levels bound their number), so a group of near copies comes with
    many times its members in ties; its roots are few, and so are the ties between them.
    """
    of = ties.groupBy("a").agg(F.collect_set("b").alias("roots"), F.min("b").alias("least"))
    each = of.select("a", "least", F.explode("roots").alias("root"))
    return each.select(F.when(F.col("root") == F.col("least"), F.col("a")).otherwise(F.col("root")).alias("a"), F.col("least").alias("b")).distinct()


def against_representatives(batches):
    """A member's ties in its bucket, and whether it is so near to a representative that it need not split on.

    Representatives near one another form trees, and a tie to a tree's root stands for ties to all of them: a
    bucket gives a few ties a member, however many representatives it is near.
    """
    known, roots, few = None, [], None
    for batch in batches:
        leaves, root = [], []
        for path, sig, nodes, sigs in zip(*(batch.column(c).to_pylist() for c in ("path", "embedding", "r_nodes", "r_sigs"))):
            if not nodes:
                leaves.append(False)
                root.append([])
                continue
            if path != known:
                few = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES)
                above = dict(forest(agreement(few, few) >= TIED_TO_ONE))
                known, roots = path, [nodes[above.get(i, i)] for i in range(len(nodes))]
            near = (few == np.frombuffer(sig, "<u4")).mean(1)
            leaves.append(bool((near >= LEAVES).any()))
            root.append(sorted({roots[i] for i in np.flatnonzero(near >= TIED_TO_ONE)}))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), batch.column("embedding"), pa.array(leaves, pa.bool_()), pa.array(root, pa.list_(pa.int64()))], ["path", "node", "embedding", "leaves", "root"])


# ---- the exact count -------------------------------------------------------------------------


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have the Jaccard similarity or more: products of 0/1 rows, over slices of the tokens both sides share."""
    sides = [np.concatenate(x) for x in (left, right)]
    tokens = np.intersect1d(*sides)
    meet = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    for lo in range(0, len(tokens), 16384):
        part = tokens[lo : lo + 16384]
        dense = []
        for x, side, row in zip((left, right), sides, rows):
            at = np.searchsorted(part, side)
            at[at == len(part)] = 0
            hit = part[at] == side
            d = np.zeros((len(x), len(part)), np.float32)
            d[row[hit], at[hit]] = 1
            dense.append(d)
        meet += dense[0] @ dense[1].T
    total = np.array([len(s) for s in left], np.float32)[:, None] + np.array([len(s) for s in right], np.float32)[None, :]
    return meet >= np.float32(similarity) * (total - meet) - np.float32(1e-3)


def count_links(words: int, similarity: float):
    """For each pair of blocks of a group: node, links (documents linked), b (the root of its tree in this pair's forest)."""

    def run(batches):
        let_go()
        shingles = Shingles(words)
        for _, blocks, nodes, weights, texts, ij in grouped(batches, "task", ("block", "node", "weight", "text", "pair")):
            i, j = ij[0]["i"], ij[0]["j"]
            sets = [shingles(t) for t in texts]
            good = [k for k, s in enumerate(sets) if len(s) and node_of(s) == nodes[k]]
            once = list({nodes[k]: k for k in good}.values())
            left = [k for k in once if blocks[k] == i]
            right = left if i == j else [k for k in once if blocks[k] == j]
            if not left or not right:
                continue
            linked = similar([sets[k] for k in left], [sets[k] for k in right], similarity)
            w = np.array([weights[k] for k in range(len(nodes))], np.int64)
            if i == j:
                np.fill_diagonal(linked, False)
                out = [(nodes[k], int(c)) for k, c in zip(left, linked @ w[right])]
                square = linked
                order = left
            else:
                out = [(nodes[k], int(c)) for k, c in zip(left, linked @ w[right])] + [(nodes[k], int(c)) for k, c in zip(right, linked.T @ w[left])]
                order = left + right
                square = np.zeros((len(order), len(order)), bool)
                square[: len(left), len(left) :] = linked
                square[len(left) :, : len(left)] = linked.T
            root = {nodes[order[a]]: nodes[order[b]] for a, b in forest(square)}
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([root.get(o[0], o[0]) for o in out], pa.int64())], ["node", "links", "b"])

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, set_id, class_id, n_links, a row per input row.

    set_id: least doc_id with the same set of word runs; class_id: least doc_id of the connected group
    of sets whose Jaccard similarity is `similarity` or more; n_links: documents, but this one, of such a set
    or the same. recall: the share of linked pairs of sets that must be brought together. Texts of fewer than `words` words have one run of
    all their words. Null text or no words: a class of its own, no links. Rows that share a doc_id: each has its own set; their
    classes are told apart by their sets. Null doc_id: linked like any row; set_id and class_id are null where no row of the set or class has
    an id. Empty table: no rows. Other columns are dropped. Whole texts.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    rows = staged(embedded(docs, words), "sets")
    plain = rows.select("doc_id", "node")
    # a set's text is that of one stored row, so sets without any doc_id have theirs too
    of_set = [F.min("doc_id").alias("set_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.min("row").alias("row")]
    classes = staged(rows.where(F.col("node").isNotNull()).groupBy("node").agg(*of_set), "classes")
    ties = candidate_ties(classes.select("node", "embedding"), similarity, recall)
    groups = staged(components(ties, "groups").join(classes.select("node", "row", "weight"), "node"), "grouped")
    # blocks of a group: by hash, as many as its size asks for, so that sizes stay near BLOCK
    sizes = staged(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "group-sizes")
    placed = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    # members' texts come by shuffle at every size: groups grow with the documents, and so would a broadcast
    texts = rows.select("row", "text").hint("merge").join(placed.select("row", "node", "component", "block", "weight", pairs.alias("pairs")), "row")
    tasks = texts.select("component", "block", "node", "weight", "text", F.explode("pairs").alias("pair")).withColumn("task", F.xxhash64("component", "pair"))
    counted = staged(tasks.repartition(n * 2, "task").sortWithinPartitions("task").mapInArrow(count_links(words, similarity), "node long, links long, b long"), "links")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(counted.where("node <> b").select(F.col("node").alias("a"), "b"), "near")
    named = staged(joined.join(classes.select("node", "set_id"), "node"), "named")
    least = staged(named.groupBy("component").agg(F.min("set_id").alias("class_id")), "least")
    of_node = named.join(least, "component").select("node", "class_id")
    facts = classes.select("node", "set_id", "weight").join(of_node, "node", "left").join(links, "node", "left")
    # staged as the others are, for a set that many rows have
    facts = staged(facts.select("node", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "facts")
    out = plain.join(facts, "node", "left")
    return out.select("doc_id", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs without all but the least doc_id of each class, with all their columns.

    Rows that share that doc_id all stay if their texts are of the class. Null doc_id: never dropped. Null or empty
    text: a class of its own. Empty table: no rows. Extra columns, whatever their names, stay as they are.
    """
    (gone,) = fresh(docs, "gone")
    found = near_duplicates(docs, similarity, words)
    dropped = found.where(F.col("doc_id") > F.col("class_id")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
