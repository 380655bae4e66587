"""Triplets from a catalogue: representatives, same-category and other-category negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import draw, merge_join, rank_in_groups, shuffle_key
from ..functions.text import category_or_unknown


def representatives(records: DataFrame, seed: int = 42) -> DataFrame:
    """One record per product, chosen by a seeded hash of its key."""
    order = F.struct(shuffle_key(seed, F.col("key")), F.col("key"))
    columns = [c for c in records.columns if c != "product_id"]
    chosen = records.groupBy("product_id").agg(F.min_by(F.struct(*columns), order).alias("r"))
    return chosen.select("product_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def group_members(records: DataFrame, group: str) -> DataFrame:
    """(group, key, place, n): the members of each group by key, from place 0, and how many it has; no group is gathered anywhere."""
    ranked = rank_in_groups(records.select(group, "key"), [group], "key", "place")
    return ranked.join(records.groupBy(group).agg(F.count("*").alias("n")), group)


def _other_in_group(records: DataFrame, groups: list[str], seed: int, name: str) -> DataFrame:
    """(key, <name>): another product of the same groups, drawn without building the pairs: an index into the group without its own place."""
    ranked = rank_in_groups(records.select("key", *groups), groups, "key", "place")
    sizes = records.groupBy(*groups).agg(F.count("*").alias("n"))
    others = ranked.join(sizes, groups).where("n > 1").withColumn("pick", draw(seed, F.col("key"), name) % (F.col("n") - 1))
    wanted = others.select("key", *groups, F.when(F.col("pick") >= F.col("place"), F.col("pick") + 1).otherwise(F.col("pick")).alias("place"))
    return merge_join(wanted, ranked.select(*groups, "place", F.col("key").alias(name)), [*groups, "place"]).select("key", name)


def hard_negatives(records: DataFrame, seed: int = 42, match_color: bool = False) -> DataFrame:
    """(key, hard_key): a different product of the same category; with match_color of the same colour where there is one.

    records have key (a whole number, one row per product), category and color.
    """
    plain = _other_in_group(records, ["category"], seed, "hard_key")
    if not match_color:
        return plain
    same = _other_in_group(records, ["category", "color"], seed, "same_key")
    return merge_join(plain, same, "key", "full").select("key", F.coalesce("same_key", "hard_key").alias("hard_key"))


def easy_negatives(records: DataFrame, seed: int = 42) -> DataFrame:
    """(key, easy_key): a product of another category. Ordered by category a category is one stretch of places, so the draw
    is an index into the rest, found by an equi-join."""
    sizes = records.groupBy("category").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("category").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.select("category", "n", before.alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))  # a row per category
    ranked = rank_in_groups(records.select("key", "category"), ["category"], "key", "inner_place").join(blocks, "category")
    ranked = ranked.withColumn("place", F.col("start") + F.col("inner_place"))
    wanted = ranked.where("total > n").withColumn("pick", draw(seed, F.col("key"), "easy") % (F.col("total") - F.col("n")))
    wanted = wanted.select("key", F.when(F.col("pick") >= F.col("start"), F.col("pick") + F.col("n")).otherwise(F.col("pick")).alias("place"))
    return merge_join(wanted, ranked.select("place", F.col("key").alias("easy_key")), "place").select("key", "easy_key")


def triplets(records: DataFrame, seed: int = 42, match_color: bool = False, max_examples: int | None = None) -> DataFrame:
    """(key, hard_key, easy_key) of products that have both negatives; max_examples of them in shuffled order.

    Raises ValueError where all records are of one category, since none then has an easy negative.
    """
    kinds = records.select(category_or_unknown(F.col("category")).alias("category")).distinct().limit(2).count()
    if kinds < 2:
        raise ValueError("there is just one category: no product has an easy negative")
    own = records.withColumn("category", category_or_unknown(F.col("category")))
    found = merge_join(hard_negatives(own, seed, match_color), easy_negatives(own, seed), "key")
    return found.orderBy(shuffle_key(seed, F.col("key")), "key").limit(max_examples) if max_examples else found


def with_boxes(partition: DataFrame, boxes: DataFrame) -> DataFrame:
    """Left join of box rows by image_name, the last of repeated ones; blank types and an empty box where there is none."""
    last = boxes.groupBy("image_name").agg(F.max_by(F.struct("clothes_type", "pose_type", "bbox"), "row_id").alias("b"))
    joined = partition.join(last, "image_name", "left")
    return joined.select(partition["*"], F.coalesce("b.clothes_type", F.lit("")).alias("clothes_type"), F.coalesce("b.pose_type", F.lit("")).alias("pose_type"), F.coalesce("b.bbox", F.array().cast("array<int>")).alias("bbox"))


def clothes_type_name(code):
    """Name of a clothes type code; unknown for any other."""
    names = {"1": "upper_body", "2": "lower_body", "3": "full_body"}  # fixed values
    out = F.lit("unknown")
    for k, name in names.items():
        out = F.when(code.cast("string") == k, name).otherwise(out)
    return out
