"""Stateless seeded draws: the same key always gives the same number, on any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir


def draw(seed: int, key: Column, name: str) -> Column:
    """A number in [0, 2**32) from seed, key and the name of the draw."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def randint(seed: int, key: Column, name: str, low: Column | int, high: Column | int) -> Column:
    """A whole number from low to high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + draw(seed, key, name) % (high - low + 1)).cast("int")


def shuffle_key(seed: int, key: Column) -> Column:
    """What to order rows by for a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def sample_array(seed: int, key: Column, name: str, values: Column, n: Column) -> Column:
    """n members of an array without replacement, in random order. Members are told apart by their place."""
    order = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name), i.cast("string")).cast("binary"))
    tagged = F.transform(values, lambda v, i: F.struct(order(i).alias("k"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(tagged), 1, n), lambda t: t["v"])


def rank_in_groups(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """df with column name: 0, 1, 2... by the column order within groups (none: over all rows); df should hold keys, not texts.

    Rows are dealt out by ranges of (groups, order), whose borders Spark samples, so neither a large group nor a far value
    fills a task. Within a range a row's place is its distance from the first one of its group, and what a group has in the
    ranges before is counted first. The ranged rows are written to the shared folder once, so that places stay what they
    are. order must not be null; rows of a group with one value of it stay together.
    """
    shared_dir(df.sparkSession)
    at, slot, first, n, base = (free_name(df, x) for x in ("at", "slot", "first", "n", "base"))
    ranged = df.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    kept = ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(slot, F.spark_partition_id()).checkpoint()
    counts = kept.groupBy(*groups, slot).agg(F.count("*").alias(n), F.min(at).alias(first))
    if groups:
        before = F.sum(n).over(W.partitionBy(*groups).orderBy(slot).rowsBetween(W.unboundedPreceding, -1))
    else:
        before = F.sum(n).over(W.orderBy(slot).rowsBetween(W.unboundedPreceding, -1))  # a row per range
    begins = counts.select(*groups, slot, (F.coalesce(before, F.lit(0)) - F.col(first)).alias(base))
    return kept.join(begins, [*groups, slot]).withColumn(name, F.col(at) + F.col(base)).drop(*{at, slot, base} - {name})


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left join right where both grow with the input, by sorting.

    Spark estimates a table by its file's size, and a file of repeated words is a small part of its rows, so it would send
    millions of rows through the driver to every executor.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like the wanted one that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while f"_{wanted}".lower() in taken:
        wanted = f"_{wanted}"
    return f"_{wanted}"
