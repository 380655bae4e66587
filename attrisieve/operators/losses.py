"""Cosine averages, triplet accuracy and losses over encoded triples (q, p, n: arrays of double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, minus


def with_cosines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos_sim", cosine(F.col("q"), F.col("p"))).withColumn("neg_sim", cosine(F.col("q"), F.col("n")))


def cosine_summary(rows: DataFrame) -> DataFrame:
    """One row of averages and accuracies, overall and by easy and hard negatives; those without rows are null. rows have pos_sim, neg_sim and easy."""
    right = (F.col("pos_sim") > F.col("neg_sim")).cast("double")
    hard = ~F.col("easy")
    return rows.agg(
        F.avg("pos_sim").alias("avg_pos_sim"), F.avg("neg_sim").alias("avg_neg_sim"), F.avg(right).alias("triplet_accuracy"),
        F.avg(F.when(F.col("easy"), F.col("neg_sim"))).alias("avg_easy_neg_sim"), F.avg(F.when(F.col("easy"), right)).alias("triplet_accuracy_easy"),
        F.avg(F.when(hard, F.col("neg_sim"))).alias("avg_hard_neg_sim"), F.avg(F.when(hard, right)).alias("triplet_accuracy_hard"),
        F.count_if(F.col("easy")).alias("n_easy"), F.count_if(hard).alias("n_hard"),
    )


def losses(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    """One row of mean losses: triplet (cosine distance), margin and its reversed form, pairwise, attribute-Hamming.

    rows have q, p, n, pos_sim, neg_sim and label, the distance over its scale.
    """
    gap = F.col("pos_sim") - F.col("neg_sim")
    y = F.col("label").cast("double")
    pair = (F.pow(F.col("pos_sim") - 1, 2) + F.pow(F.col("neg_sim") - (1 - y), 2)) / 2
    hamming = F.pow(dot(F.col("q"), minus(F.col("p"), F.col("n"))) - y, 2)
    return rows.agg(
        F.avg(F.greatest(F.lit(0.0), (1 - F.col("pos_sim")) - (1 - F.col("neg_sim")) + margin)).alias("triplet_loss"), F.avg(F.pow(gap - y, 2)).alias("margin_loss"),
        F.avg(F.pow(-gap - y, 2)).alias("reversed_margin_loss"), F.avg(pair).alias("pairwise_loss"), F.avg(hamming).alias("attribute_hamming_loss"),
    )


def probe_residuals(rows: DataFrame, tolerance: float, *more: Column) -> DataFrame:
    """(attribute, holds, largest): does a linear probe b, beta recover bit z of all rows' vectors f to the tolerance? More aggregates come from the same pass."""
    residual = F.abs(dot(F.col("b"), F.col("f")) + F.col("beta") - F.col("z"))
    return rows.withColumn("e", residual).groupBy("attribute").agg(F.every(F.col("e") < tolerance).alias("holds"), F.max("e").alias("largest"), *more)


def probe_by_deletion(queries: DataFrame) -> DataFrame:
    """(attribute, b): probes from a query's vector and that of the query without one condition.

    queries have conditions (sorted array of attribute:sign) and f. b is the sign times the difference of vectors.
    """
    return _deletions(queries.withColumn("f_of", F.col("f"))).select("attribute", "b")


def _deletions(queries: DataFrame, probed: Column | None = None) -> DataFrame:
    """queries (conditions, f, ...) with attribute, b, one row per condition without which the query is there, too.

    Only probed queries (none: all) are taken apart; the others are what is left of them. A condition list is looked up by its canonical form: conditions sorted, each once. Null vectors give no probe.
    """
    canonical = queries.withColumn("conditions", F.array_sort(F.array_distinct("conditions"))).where("f is not null")
    each = (canonical if probed is None else canonical.where(probed)).withColumnRenamed("f", "f_all").withColumn("condition", F.explode("conditions")).withColumn("rest", F.array_remove("conditions", F.col("condition")))
    rest = canonical.groupBy(F.col("conditions").alias("rest")).agg(F.first("f").alias("f_rest"))  # equal queries have equal vectors
    parted = F.split("condition", ":(?=[^:]*$)")  # an attribute may hold colons
    joined = each.join(rest, "rest").withColumn("attribute", F.element_at(parted, 1)).withColumn("sign", F.element_at(parted, 2).cast("double"))
    return joined.withColumn("b", F.zip_with(minus(F.col("f_all"), F.col("f_rest")), F.array_repeat("sign", F.size("f_all")), lambda d, s: d * s)).drop("f_rest", "rest", "sign")


def probes_with_intercept(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(reference, conditions, attribute, b, beta): probes by deletion, beta from a product that fits the whole query.

    queries have conditions, f and reference, the key of a product that fits (a query's positive does); products have key,
    attributes and f. beta is the reference's bit of the attribute less its product with b. A reference that isn't there, or
    doesn't fit, gives no probe; a query without one (null) is taken apart no further.
    """
    probes = _deletions(queries.select("conditions", "f", "reference"), F.col("reference").isNotNull())
    known = products.select(F.col("key").alias("reference"), F.col("attributes").alias("_has"), F.col("f").alias("_f"))
    required = F.transform(F.filter("conditions", lambda c: c.endswith(":1")), lambda c: F.regexp_replace(c, ":1$", ""))
    forbidden = F.transform(F.filter("conditions", lambda c: c.endswith(":-1")), lambda c: F.regexp_replace(c, ":-1$", ""))
    joined = probes.join(known, "reference").where((F.size(F.array_except(required, "_has")) == 0) & (F.size(F.array_intersect(forbidden, "_has")) == 0))
    z = F.when(F.array_contains("_has", F.col("attribute")), 1.0).otherwise(0.0)
    return joined.select("reference", "conditions", "attribute", "b", (z - dot(F.col("b"), F.col("_f"))).alias("beta"))
