"""Mining triplets from judged product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import draw, rank_in_groups

PRODUCT = ("product_id", "product_title", "product_text")
NEGATIVE_LABELS = ("Substitute", "Irrelevant")


def first_rows(judged: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in source order, before any other filter; all of them where n is None or 0."""
    return judged.where(F.col("row_id") < n) if n else judged


def label_counts(judged: DataFrame, locale: str = "us") -> DataFrame:
    return judged.where(F.col("product_locale") == locale).groupBy("esci_label").agg(F.count("*").alias("n"))


def hard_pairs(judged: DataFrame, locale: str = "us") -> DataFrame:
    """A row per negative-labelled row whose query has an Exact row: the negative's columns and the positive's, prefixed.

    The positive is the Exact row with the smallest row_id. Complement rows never become hard negatives.
    """
    own = judged.where(F.col("product_locale") == locale)
    columns = F.struct(*PRODUCT, "lang")
    exact = own.where("esci_label = 'Exact'").groupBy("query_id").agg(F.min_by(columns, "row_id").alias("positive"))
    negative = own.where(F.col("esci_label").isin(*NEGATIVE_LABELS))
    return negative.withColumn("hard", columns).join(exact, "query_id").select("row_id", "query_id", "query", "esci_label", "positive", "hard")


def reduction(judged: DataFrame, locale: str = "us") -> DataFrame:
    """(rows, kept, share) of one locale's rows by the pairing."""
    rows = judged.where(F.col("product_locale") == locale).agg(F.count("*").alias("rows"))
    kept = hard_pairs(judged, locale).agg(F.count("*").alias("kept"))
    return rows.crossJoin(kept).withColumn("share", F.coalesce(F.try_divide(F.col("kept"), F.col("rows")), F.lit(0.0)))  # one row each


def triplets(judged: DataFrame, seed: int = 42, locale: str = "us", language: str = "en") -> DataFrame:
    """Hard pairs in the language, each with an easy negative drawn from all the locale's rows in the language (any label)."""
    pairs = hard_pairs(judged, locale).where((F.col("positive.lang") == language) & (F.col("hard.lang") == language))
    own = judged.where((F.col("product_locale") == locale) & (F.col("lang") == language))
    pool = rank_in_groups(own.select("row_id"), [], "row_id", "place").withColumnRenamed("row_id", "easy_id")
    size = pool.agg(F.count("*").alias("pool_size"))
    drawn = pairs.join(F.broadcast(size)).withColumn("place", draw(seed, F.col("row_id"), "easy") % F.col("pool_size"))  # one row
    easy = own.select(F.col("row_id").alias("easy_id"), F.struct(*PRODUCT).alias("easy_neg_product"))
    found = drawn.join(pool, "place").join(easy, "easy_id")
    product = lambda c: F.struct(*[F.col(f"{c}.{p}") for p in PRODUCT])
    return found.select("row_id", "query_id", "query", product("positive").alias("positive_product"), product("hard").alias("hard_neg_product"), "easy_neg_product", F.col("esci_label").alias("negative_example_source"))
