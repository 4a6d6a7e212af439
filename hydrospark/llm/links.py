"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.scratch import cut


def _stars(both: DataFrame) -> DataFrame:
    """Every link (node, other), and the least node of node's neighbourhood."""
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return both.join(least, "node").withColumn("least", F.least("node", "least"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the least node reachable.

    Large and small stars in turn, until a pair of them changes nothing; the number of
    rounds grows with the logarithm of the longest chain.  Each round is written to the
    shared scratch folder, so no plan grows and a lost executor costs one round.
    """
    edges = links.select(F.greatest(left, right).alias("node"), F.least(left, right).alias("other"))
    edges, size = cut(edges.where("node <> other").distinct(), n=F.count("*"), s=F.sum(F.xxhash64("node", "other") % 1000003))
    while size["n"]:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _stars(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = large.where("node <> other").distinct()
        star = _stars(large)
        small = star.select(F.col("other").alias("node"), F.col("least").alias("other")).unionByName(
            star.select("node", F.col("least").alias("other")))
        last = size
        edges, size = cut(small.where("node <> other").distinct(), n=F.count("*"), s=F.sum(F.xxhash64("node", "other") % 1000003))
        if size == last:
            break
    return edges.select("node", F.col("other").alias("root"))
