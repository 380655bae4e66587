"""Splitting and sampling by query, and splits without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import free_name, shuffle_key
from ..session import shared_dir

SPLITS = ("train", "validation", "test")


def _shuffled(queries: DataFrame, seed: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(distinct queries as a checkpoint (anchor, h, s), how many begin with each s): h is what a seeded shuffle orders them by. Null is a query, too.

    s is the first three hex digits of h, so there are 4096 counts at most and no task sorts all queries.
    """
    shared_dir(queries.sparkSession)
    keyed = queries.select("anchor").distinct().withColumn("h", shuffle_key(seed, F.col("anchor"))).withColumn("s", F.substring("h", 1, 3)).checkpoint()
    return keyed, sorted(tuple(r) for r in keyed.groupBy("s").agg(F.count("*").alias("n")).collect())


def _before(keyed: DataFrame, sizes: list[tuple[str, int]], place: int, seed: int) -> Column:
    """Whether a row's anchor comes before a place of the shuffled order: a comparison with the query that stands there."""
    seen = 0
    for s, n in sizes:
        if place < seen + n:
            inside = F.row_number().over(W.partitionBy("s").orderBy("h", "anchor"))
            at = keyed.where(F.col("s") == s).withColumn("place", inside).where(F.col("place") == place - seen + 1).first()
            h = shuffle_key(seed, F.col("anchor"))
            return (h < at["h"]) | ((h == at["h"]) & F.coalesce(F.col("anchor") < at["anchor"], F.lit(False)))
        seen += n
    return F.lit(True)


def split_by_query(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows with column split: all rows of a query together, 80/10/10 of the queries (a fifth held out, half of that test).

    Sizes round up as a two-step hold-out does. Rows without a query are those of one query. Raises ValueError below three.
    Two queries of the shuffled order are where splits change, so a row's split is two comparisons and nothing is joined.
    """
    keyed, sizes = _shuffled(rows, seed)
    n = sum(x for _, x in sizes)
    if n < 3:
        raise ValueError("a split needs at least three queries")
    out = -(-n // 5)
    test = -(-out // 2)
    return rows.withColumn("split", F.when(_before(keyed, sizes, test, seed), "test").when(_before(keyed, sizes, out, seed), "validation").otherwise("train"))


def only(rows: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split {split!r} isn't one of {SPLITS}")
    return rows.where(F.col("split") == split)


def query_fraction(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Rows of a seeded share of the queries: half-even rounded, one query at least; all rows at 1."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    if fraction == 1:
        return rows
    keyed, sizes = _shuffled(rows, seed)
    return rows.where(_before(keyed, sizes, max(1, round(sum(x for _, x in sizes) * fraction)), seed))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) over edges (a, b) of strings: the smallest node reachable.

    Labels spread along edges and are then looked up through each other, so long chains need few rounds; each round is
    checkpointed to the shared folder.
    """
    shared_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct()
    both = both.checkpoint()
    labels = (both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node")).checkpoint()
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("best"))
        spread = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("root", "best").alias("root"), F.col("root").alias("old"))
        jump = spread.select(F.col("node").alias("via"), F.col("root").alias("further"))
        now = spread.join(jump, spread["root"] == jump["via"]).select("node", F.least("root", "further").alias("root"), "old").checkpoint()
        changed = now.where("root <> old").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels


def split_without_leakage(rows: DataFrame, keys: list[str], seed: int = 42, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """rows with column split such that no value of the key columns occurs in two splits: whole components, by seeded hash.

    A null key links nothing: a row belongs with the keys it has, and all rows without any key are one component.
    """
    node, root, key = (free_name(rows, x) for x in ("node", "root", "key"))
    named = [F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string")) for k in keys]
    tagged = rows.withColumn(key, F.coalesce(*named, F.lit("")))
    edges = tagged.select(F.col(key).alias("a"), F.explode(F.array(*named)).alias("b")).where("b is not null")
    roots = components(edges).select(F.col("node").alias(node), F.col("root").alias(root))
    joined = tagged.join(roots, F.col(key) == F.col(node), "left")
    u = F.conv(F.substring(shuffle_key(seed, F.coalesce(F.col(root), F.col(key))), 1, 8), 16, 10).cast("double") / 2**32
    name = F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test")
    return joined.withColumn("split", name).drop(key, node, root)


def overlap(rows: DataFrame, key: str) -> DataFrame:
    """(n_splits, values): how many values of key occur in how many splits."""
    spread = rows.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("n_splits"))
    return spread.groupBy("n_splits").agg(F.count("*").alias("values"))
