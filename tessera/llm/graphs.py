"""Connected components of sparse edges, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) for the nodes of edges (a, b).

    Each round every node takes the least label among its neighbours', then its label's own label; labels and
    rounds' results live in staged tables, nothing but a count of changes reaches the driver. A hub's
    neighbours are aggregated before the shuffle and its join may be split.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = staged(lower.join(above, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-{round_}")
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
