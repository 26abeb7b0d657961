"""An index of vectors by coarse centroids, searched for all queries at once, and the two stages of search built on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .blocks import met
from .retrieval import FUSION_K, fused
from .synonyms import holding

#: Vectors that centroids are fitted on, queries that the number of probes is chosen by: bounds of two samples. Everything is indexed.
FITTED_ON, TRIED = 20_000, 200
ROUNDS, MOST_CELLS, BLOCK = 8, 4096, 20_000
#: Rows whose distances to all cells are worked out at once, cells of theirs that are sent on at once.
ROWS, WIDE = 256, 64
#: How far a squared distance from a product of matrices may be off, as a share of the squared lengths: far more than it is.
SLACK = 1e-9
#: Results of the first stage, seeds of the second, recommendations for each seed, names looked at.
KEPT, SEEDS, PER_SEED, NAMES = 20, 10, 5, 50


@dataclass(frozen=True)
class Index:
    """cells: item_id, domain, v, cell (written). centroids: one row a cell. probes: cells that a query looks into; recall: what that number reached on the tried queries."""

    cells: DataFrame
    centroids: np.ndarray
    probes: int
    recall: float


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, not below 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from evenly spaced rows of the sample; a centroid that loses its rows stays where it is."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = squared(sample, centroids).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, a few rows at a time: all distances of a batch would take as much memory as it has rows times cells."""
    n, out = min(n, len(centroids)), [np.zeros((0, min(n, len(centroids))), np.int64)]
    for at in range(0, len(x), ROWS):
        d = squared(x[at : at + ROWS], centroids)
        out.append(d.argmin(1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n])
    return np.concatenate(out).astype(np.int64)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float) if len(column) else np.zeros((0, 1))


def build(items: DataFrame, n: int = KEPT, target: float = 0.95) -> Index:
    """An index of all items (item_id, domain, v: arrays of one length); null vectors are left out.

    There are about as many cells as the square root of the items; centroids come from a sample, and every item goes to its nearest.
    The number of probes is the least one that finds `target` of the `n` nearest items of a sample of items taken as queries.
    """
    spark = items.sparkSession
    held = staged(items.where("v IS NOT NULL").select("item_id", "domain", F.col("v").cast("array<double>").alias("v")), "index-items")
    total = held.count()
    if not total:
        return Index(held.withColumn("cell", F.lit(0).cast("long")), np.zeros((1, 1)), 1, 1.0)
    sample = matrix(held.orderBy(F.xxhash64("item_id"), "item_id").limit(FITTED_ON).select("v").toPandas()["v"])
    centroids = fitted(sample, int(min(max(np.sqrt(total), 1), MOST_CELLS, max(len(sample) // 4, 1))))
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches):
        for pdf in batches:
            pdf["cell"] = nearest_cells(matrix(pdf["v"]), shared.value, 1)[:, 0]
            yield pdf

    cells = staged(held.mapInPandas(place, "item_id long, domain string, v array<double>, cell long"), "index-cells")
    tried = held.orderBy(F.xxhash64("item_id", F.lit(1)), "item_id").limit(TRIED).select(F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("domain"), F.col("v").alias("q"))
    tried = staged(tried, "index-tried")
    k, reached, probes = len(centroids), 0.0, 1
    every = ranked(looked_up(Index(cells, centroids, k, 1.0), tried, n), n).select("query_id", "item_id")
    every = staged(every, "index-exact")
    while True:
        found = ranked(looked_up(Index(cells, centroids, probes, 1.0), tried, n), n).select("query_id", "item_id")
        reached = found.join(every, ["query_id", "item_id"], "left_semi").count() / max(every.count(), 1)
        if reached >= target or probes >= k:
            return Index(cells, centroids, probes, reached)
        probes = min(2 * probes, k)


def looked_up(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """query_id, item_id, distance: the n nearest of each cell that a query probes, in its domain where it has one. queries: query_id, domain, q. Queries and cells meet block by block."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    probes = index.probes

    def probe(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at : at + ROWS]
                near = nearest_cells(matrix(some["q"]), shared.value, probes)
                for first in range(0, near.shape[1], WIDE):
                    cells = near[:, first : first + WIDE]
                    out = some.loc[some.index.repeat(cells.shape[1])].copy()
                    out["cell"] = cells.ravel()
                    yield out

    asked = staged(queries.where("q IS NOT NULL").select("query_id", "domain", F.col("q").cast("array<double>").alias("q")).mapInPandas(probe, "query_id long, domain string, q array<double>, cell long"), "index-probes")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, ids, domains = matrix(right["v"]), right["item_id"].to_numpy(np.int64), right["domain"].to_numpy(object)
            for domain, some in left.groupby("domain", dropna=False):
                ok = np.arange(len(ids)) if pd.isna(domain) else np.flatnonzero(domains == domain)
                out += firsts(some["query_id"].to_numpy(np.int64), matrix(some["q"]), ids[ok], v[ok], n)
        names = ("query_id", "item_id", "distance")
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out))))) if out else pd.DataFrame({k: [] for k in names})

    return met(asked, index.cells, ["cell"], "query_id", "item_id", BLOCK, best, "query_id long, item_id long, distance double")


def firsts(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query its id, and ids and distances of the n nearest items, equal distances by id.

    Products of matrices choose, with room for their error, what is compared exactly; what they cannot tell (no numbers, infinite ones) is compared too.
    """
    lengths, out = (v * v).sum(1), []
    size = lengths.max(initial=0.0, where=np.isfinite(lengths))
    for at in range(0, len(q), ROWS):
        rough, room = squared(q[at : at + ROWS], v), SLACK * ((q[at : at + ROWS] ** 2).sum(1) + size)
        last = np.partition(rough, n - 1, axis=1)[:, n - 1] + room if len(ids) > n else np.full(len(rough), np.inf)
        for i in range(len(rough)):
            near = np.flatnonzero(~(rough[i] > last[i]))
            d = np.sqrt(((v[near] - q[at + i]) ** 2).sum(1))
            first = np.lexsort((ids[near], d))[:n]
            out.append((np.full(len(first), queries[at + i]), ids[near[first]], d[first]))
    return out


def ranked(hits: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n)


def search(index: Index, queries: DataFrame, n: int = KEPT) -> DataFrame:
    """query_id, item_id, distance, rank: about the n nearest items of every query (query_id, domain: null for any, q). Null vectors find nothing."""
    return ranked(looked_up(index, queries, n), n)


def by_names(queries: DataFrame, concept: DataFrame, n: int = NAMES) -> DataFrame:
    """query_id, item_id, rank: standard valid concepts whose name holds the query's text, in its domain where it has one; shortest names first. queries: query_id, text, domain."""
    good = concept.where("standard_concept = 'S' AND invalid_reason IS NULL")
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("wanted")).where("wanted <> ''")
    hit = holding(asked, good.select(F.col("concept_id").alias("cui"), F.col("concept_name").alias("str")))
    facts = good.select(F.col("concept_id").alias("cui"), "domain_id", F.length("concept_name").alias("length"), F.lower("concept_name").alias("name"))
    fit = hit.join(facts, "cui").join(asked, "query_id").where(F.col("name").contains(F.col("wanted")))  # of an id with several names only those that hold the text
    fit = fit.join(queries.select("query_id", "domain"), "query_id").where("domain IS NULL OR domain = domain_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("length", "cui"))
    return fit.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", F.col("cui").alias("item_id"), "rank")


def merged(n: int, **lists: DataFrame) -> DataFrame:
    """query_id, item_id, score, rank: the n best of several ranked lists by reciprocal ranks."""
    every = None
    for source, rows in lists.items():
        named = rows.select(F.lit(source).alias("source"), "query_id", "item_id", "rank")
        every = named if every is None else every.unionByName(named)
    scored = fused(every, k=FUSION_K)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def recommended(seeds: DataFrame, edges: DataFrame, concept: DataFrame, per_seed: int = PER_SEED) -> DataFrame:
    """query_id, item_id, rank: neighbours of each query's seeds (query_id, item_id), the first of each seed by id scoring most; the best score over seeds counts."""
    good = concept.where("standard_concept = 'S' AND invalid_reason IS NULL").select(F.col("concept_id").alias("concept_id_2"))
    near = edges.select("concept_id_1", "concept_id_2").distinct().join(good, "concept_id_2", "left_semi")
    nth = F.row_number().over(Window.partitionBy("concept_id_1").orderBy("concept_id_2"))
    first = near.join(seeds.select(F.col("item_id").alias("concept_id_1")).distinct(), "concept_id_1", "left_semi").withColumn("nth", nth).where(F.col("nth") <= per_seed)
    scored = seeds.join(first, seeds["item_id"] == F.col("concept_id_1")).groupBy("query_id", F.col("concept_id_2").alias("item_id")).agg(F.min("nth").alias("nth"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nth", "item_id"))
    return scored.withColumn("rank", rank).select("query_id", "item_id", "rank")


def two_stages(vector_hits: DataFrame, queries: DataFrame, concept: DataFrame, edges: DataFrame, n: int = KEPT) -> DataFrame:
    """query_id, item_id, score, rank: the first stage merges hits by vector (query_id, item_id, rank) with hits by name, the second adds what its ten best recommend and merges again. One plan for all queries."""
    first = staged(merged(n, vector=vector_hits, name=by_names(queries, concept, n)), "stage-one")
    seeds = first.where(F.col("rank") <= SEEDS).select("query_id", "item_id")
    return merged(n, first=first, recommended=recommended(seeds, edges, concept))
