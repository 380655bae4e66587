"""From generated examples to training rows, labels and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import close_to

SENTINEL = -1.0
SHAPES = ("linear",)
STYLES = ("triplet", "margin", "reversed-margin", "pairwise")
AUXILIARY = ("query_distance", "negative_example_source", "split", "label_raw")


def no_overlap(left: DataFrame, right_columns: list[str]) -> None:
    """Raise where generated columns would hide those of the input."""
    both = sorted(set(left.columns) & set(right_columns))
    if both:
        raise ValueError(f"columns on both sides: {both}")


def rename_query(rows: DataFrame, generated: list[str]) -> DataFrame:
    no_overlap(rows.drop("query"), generated)
    return rows.withColumnRenamed("query", "original_query")


def _sides(mode: str, max_distance: int) -> tuple[Column, Column]:
    """The hard and the easy row of an example, as structs of the same fields."""
    if mode not in ("sentinel", "double_max"):
        raise ValueError(f"mode {mode!r} isn't sentinel or double_max")
    value = SENTINEL if mode == "sentinel" else 2.0 * max_distance
    shared = [*(F.col(c) for c in ("row_id", "original_query", "nl_query", "rephrased_query")), F.col("positive_text").alias("positive_example")]
    hard = F.struct(*shared, F.col("hard_text").alias("negative_example"), F.col("negative_example_source"), F.col("query_distance").cast("double").alias("query_distance"))
    easy = F.struct(*shared, F.col("easy_text").alias("negative_example"), F.lit("random").alias("negative_example_source"), F.lit(value).alias("query_distance"))
    return hard, easy


def hard_rows(examples: DataFrame) -> DataFrame:
    """Positive against the hard negative, with its source and recorded distance."""
    return examples.select(_sides("sentinel", 0)[0].alias("r")).select("r.*")


def easy_rows(examples: DataFrame, mode: str = "sentinel", max_distance: int = 10) -> DataFrame:
    """Positive against the easy negative; its distance is the sentinel, or twice the largest distance."""
    return examples.select(_sides(mode, max_distance)[1].alias("r")).select("r.*")


def training_rows(examples: DataFrame, mode: str = "sentinel", max_distance: int = 10) -> DataFrame:
    """The hard and the easy row of each example, from one pass over the examples."""
    return examples.select(F.inline(F.array(*_sides(mode, max_distance))))


def anchors(rows: DataFrame, query: str = "nl_query", drop_blank: bool = False) -> DataFrame:
    """The chosen query column becomes anchor, the other two go; rows with equal sides go, and blank anchors where asked."""
    kinds = ("original_query", "nl_query", "rephrased_query")
    if query not in rows.columns:
        raise ValueError(f"there is no query column {query!r}")
    out = rows.drop(*[c for c in kinds if c != query]).withColumnRenamed(query, "anchor").withColumnsRenamed({"positive_example": "positive", "negative_example": "negative"})
    out = out.where(~F.col("positive").eqNullSafe(F.col("negative")))
    return out.where(F.trim(F.coalesce("anchor", F.lit(""))) != "") if drop_blank else out


def keep_for_style(rows: DataFrame, style: str) -> DataFrame:
    """Only the columns a training style reads."""
    if style not in STYLES:
        raise ValueError(f"style {style!r} isn't one of {STYLES}")
    label = [] if style == "triplet" else ["label"]
    wanted = ["anchor", "positive", "negative", *label, *[c for c in ("negative_example_source", "split") if c in rows.columns]]
    return rows.select(*wanted)


def drop_auxiliary(rows: DataFrame) -> DataFrame:
    return rows.drop(*AUXILIARY)


def swap_sides(rows: DataFrame) -> DataFrame:
    """anchor, negative, positive, then the rest: the positional form the reversed style reads."""
    missing = {"anchor", "positive", "negative"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return rows.select("anchor", "negative", "positive", *[c for c in rows.columns if c not in ("anchor", "positive", "negative")])


def label(distance: Column, easy_value: float, scale: float, shape: str = "linear") -> Column:
    """The training label: the sentinel becomes easy_value, then everything is divided by scale."""
    if scale <= 0:
        raise ValueError("scale must be above zero")
    if shape not in SHAPES:
        raise ValueError(f"shape {shape!r} isn't one of {SHAPES}")
    remapped = F.when(close_to(distance, SENTINEL), F.lit(float(easy_value))).otherwise(distance)
    return (remapped / scale).cast("float")


def is_easy(rows: DataFrame) -> Column:
    """Which rows hold easy negatives: by source, else by the sentinel, else by the largest label."""
    if "negative_example_source" in rows.columns:
        return F.coalesce(F.col("negative_example_source") == "random", F.lit(False))
    if "label" not in rows.columns:
        return close_to(F.col("query_distance"), SENTINEL)
    top = rows.agg(F.max("label").alias("m")).first()["m"]
    return F.lit(False) if top is None else F.col("label") >= top - 1e-5


def pairs(rows: DataFrame) -> DataFrame:
    """Each triple as (anchor, positive, 1) and (anchor, negative, 1 - label), in that order."""
    one = F.struct(F.col("anchor").alias("sentence_A"), F.col("positive").alias("sentence_B"), F.lit(1.0).cast("float").alias("label"))
    two = F.struct(F.col("anchor").alias("sentence_A"), F.col("negative").alias("sentence_B"), (1 - F.col("label")).cast("float").alias("label"))
    return rows.select(*[c for c in rows.columns if c == "row_id"], F.inline(F.array(one, two)))
