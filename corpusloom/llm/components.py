"""Connected components of a link table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Far more rounds than any graph needs: labels travel twice as far in each.
MOST_ROUNDS = 64


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for links (a, b): root is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and then that label's own label. Minima are
    combined before the shuffle, so a node with very many links costs no more than others.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        fresh = nearer.join(jump, "root").select("node", "old", F.least("root", "next").alias("root"))
        fresh = scratch.save(fresh.select("node", "root", (F.col("old") != F.col("root")).alias("moved")), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = fresh.select("node", "root")
        if not fresh.where("moved").limit(1).count():
            return labels
    raise RuntimeError("labels still change")
