"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """`(id, component)` for every node of `edges(a, b)`; the component is its smallest id.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest
    one, then its smaller neighbours likewise. Each step is a grouped minimum, combined before the
    shuffle, and a join back on the node, which adaptive execution splits for a node of very high degree.
    Rounds grow with the logarithm of the longest path. Each round is checkpointed.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    joined = nodes.join(roots, nodes["id"] == roots["a"], "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and to itself."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
