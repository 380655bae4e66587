"""Attribute buckets, conjunctive queries over them and edit distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import randint, sample_array

BUCKETS = ("pos", "neg", "common", "neither")
#: Assignments brute_force_distance lists at once.
BLOCK = 1 << 14


def _strings(a: Column) -> Column:
    return a.cast("array<string>")


def common(a: Column, b: Column) -> Column:
    """Attributes of both, each once, in a's order."""
    return F.array_intersect(_strings(a), _strings(b))


def only_first(a: Column, b: Column) -> Column:
    """Attributes of a that b lacks, each once."""
    return F.array_except(_strings(a), _strings(b))


def neither(a: Column, b: Column, vocabulary: Column) -> Column:
    """Attributes of the vocabulary that neither has."""
    return F.array_except(_strings(vocabulary), F.array_union(_strings(a), _strings(b)))


def satisfies(attributes: Column, required: Column, forbidden: Column) -> Column:
    """Has every required attribute and no forbidden one?"""
    return F.forall(required, lambda r: F.array_contains(attributes, r)) & ~F.coalesce(F.arrays_overlap(attributes, forbidden), F.lit(False))


def distance(attributes: Column, required: Column, forbidden: Column) -> Column:
    """Least number of attribute changes that make the conjunction true: required ones missing plus forbidden ones present."""
    return F.size(F.array_except(required, attributes)) + F.size(F.array_intersect(forbidden, attributes))


def brute_force_distance(rows: DataFrame, key: str, features: str, signs: str) -> DataFrame:
    """(key, distance): the least Hamming distance from a row's feature bits to any assignment that its signs accept.

    features: array<boolean>; signs: array<int> of 1 (required) or -1 (forbidden), 62 at most. All 2**n assignments are tried,
    in blocks, so a row never holds them all; the time still doubles with each condition. This is the reference form the
    closed one is tested against.
    """
    bits = lambda a, test: F.aggregate(F.transform(a, lambda v, i: F.when(test(v), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    last = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(features)) - 1
    # No test for nulls or empty sequences is left for Spark to add: it would work out features and signs again, below the
    # joins they come from. No assignment is -1 or null, so rows without features or signs have no distance all the same.
    want = F.coalesce(bits(F.col(signs), lambda v: v > 0), F.lit(-1).cast("bigint"))
    own = rows.select(key, bits(F.col(features), lambda v: v).alias("own"), want.alias("want"), last.alias("last"))
    blocks = own.select("*", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(BLOCK).cast("bigint"))).alias("first"))
    blocks = blocks.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # by the work they make, of which their bytes tell nothing
    tried = blocks.select(key, "own", "want", F.explode_outer(F.sequence("first", F.least(F.col("first") + (BLOCK - 1), "last"))).alias("z"))
    accepted = tried.where(F.col("z") == F.col("want"))
    return accepted.groupBy(key).agg(F.min(F.bit_count(F.col("z").bitwiseXOR(F.col("own")))).alias("distance"))


def violation(sign: Column, present: Column) -> Column:
    """1 where a condition of sign +1 or -1 isn't met by present 0 or 1, else 0: (1 - s(2z-1)) / 2."""
    return (1 - sign * (2 * present - 1)) / 2


def signed_difference(signs: Column, first: Column, second: Column) -> Column:
    """Sum of s(z1 - z2) over the conditions."""
    change = F.zip_with(first, second, lambda x, y: x - y)
    return F.aggregate(F.zip_with(signs, change, lambda s, d: s * d), F.lit(0), lambda t, x: t + x)


def generate_queries(pairs: DataFrame, key: str, seed: int = 42, max_distance: int = 10) -> DataFrame:
    """Draw a conjunction for every pair with columns item and full_pos, full_neg, full_common, full_neither.

    A target distance is drawn; positives up to it, then negatives up to what is left; common and neither ones up to it.
    At least one of positive and common and one of negative and neither is taken where there is one, so the recorded
    distance (positives plus negatives taken) can be one above the target, or 0.
    """
    k = F.col(key)
    size = lambda b: F.size(f"full_{b}")
    upto = lambda name: randint(seed, k, name, 0, F.col("target"))
    out = pairs.withColumn("target", randint(seed, k, "target", 1, max_distance))
    out = out.withColumn("n_pos", F.least(upto("pos"), size("pos")))
    out = out.withColumn("n_neg", F.least(F.col("target") - F.col("n_pos"), size("neg")))
    out = out.withColumn("n_common", F.least(upto("common"), size("common"))).withColumn("n_neither", F.least(upto("neither"), size("neither")))
    for first, second in (("pos", "common"), ("neg", "neither")):
        none = (F.col(f"n_{first}") == 0) & (F.col(f"n_{second}") == 0)
        a = F.when(none, F.least(F.lit(1), size(first))).otherwise(F.col(f"n_{first}"))
        b = F.when(none & (size(first) == 0), F.least(F.lit(1), size(second))).otherwise(F.col(f"n_{second}"))
        out = out.select("*", a.alias("_a"), b.alias("_b")).drop(f"n_{first}", f"n_{second}").withColumnsRenamed({"_a": f"n_{first}", "_b": f"n_{second}"})
    for b in BUCKETS:
        out = out.withColumn(f"selected_{b}", sample_array(seed, k, b, F.col(f"full_{b}"), F.col(f"n_{b}")))
    required = F.concat("selected_pos", "selected_common")
    forbidden = F.concat("selected_neg", "selected_neither")
    out = out.withColumns({"required": required, "forbidden": forbidden})
    return out.withColumns({
        "nl_query": render(F.col("item"), F.col("required"), F.col("forbidden")),
        "query_distance": F.size("selected_pos") + F.size("selected_neg"),
        "num_attributes": F.size("required") + F.size("forbidden"),
    }).drop("n_pos", "n_neg", "n_common", "n_neither")


def render(item: Column, required: Column, forbidden: Column) -> Column:
    """The query as text."""
    return F.format_string('I am looking for: "%s" that has: %s; and does not have: %s', item, F.array_join(required, ", "), F.array_join(forbidden, ", "))
