"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Edges a partition of a round holds.
ROWS = 200_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates two steps until the edges no longer change: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Both are a minimum per node (combined before the shuffle, so a node with very many
    edges stays cheap) joined back to the edges (a join that AQE can split). Each round is checkpointed. Edges with a
    null end are ignored, repeated edges and loops count once; no edges give no rows.
    """
    # few edges stay in few partitions: every round writes files for each of them
    narrow = lambda df, n: df.coalesce(max(1, -(-n // ROWS)))
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), (F.col(left) != F.col(right)).alias("differ"))
    current = checkpoint(pairs.where(F.col("differ") & F.col("u").isNotNull()).select("u", "v").distinct())
    seen = _digest(current)
    while seen[0]:
        current = narrow(current, seen[0])
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = checkpoint(near.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _digest(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and two order-free sums over them."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(k)) .cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    return tuple(edges.agg(F.count("*").alias("n"), *sums).first())
