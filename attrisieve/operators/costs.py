"""Token costs of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dollars per million tokens in and out (fixed values).
PRICES = (
    ("gpt-5", 1.25, 10.0),
    ("gpt-5-mini", 0.25, 2.0),
    ("gpt-5-nano", 0.05, 0.4),
    ("gemini-2.5-pro", 1.25, 10.0),
    ("gemini-2.5-flash", 0.3, 2.5),
    ("gemini-2.5-flash-lite", 0.075, 0.3),
    ("gemini-2.0-flash", 0.075, 0.3),
    ("gemini-2.0-flash-lite", 0.0375, 0.15),
    ("gemini-2.0-flash-exp", 0.075, 0.3),
    ("gemini-1.5-flash", 0.075, 0.3),
    ("gemini-1.5-flash-8b", 0.0375, 0.15),
    ("gemini-1.5-pro", 1.25, 5.0),
    ("gemini-1.5-pro-128k", 1.25, 5.0),
)


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model_id string, price_in double, price_out double")


def ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model_id, tokens_in, tokens_out) with their cost; models without a price cost nothing, local ones aren't tracked."""
    tracked = calls.where(F.col("model_id").startswith("gpt-") | F.col("model_id").startswith("gemini-"))
    priced = tracked.join(F.broadcast(prices), "model_id", "left")  # a handful of rows
    cost = F.col("tokens_in") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    return priced.withColumn("cost", cost).withColumn("priced", F.col("price_in").isNotNull()).drop("price_in", "price_out")


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals and per-call averages, 0 without calls; dollars per million tokens, null where nothing was paid."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    total = rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"), F.count("*").alias("total_calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"))
    return total.withColumns({
        "tokens_per_call": F.coalesce(F.try_divide(F.col("total_tokens"), F.col("total_calls")), F.lit(0.0)),
        "cost_per_call": F.coalesce(F.try_divide(F.col("total_cost"), F.col("total_calls")), F.lit(0.0)),
        "cost_per_million": F.when(F.col("total_cost") > 0, F.try_divide(F.col("total_cost") * 1e6, F.col("total_tokens"))),
    })


def report(rows: DataFrame) -> str:
    """The totals as text."""
    r = summary(rows).first()
    lines = [f"calls: {r['total_calls']}", f"tokens: {r['total_tokens']}", f"cost: ${r['total_cost']:.4f}"]
    if r["cost_per_million"] is not None:
        lines.append(f"$ per 1M tokens: {r['cost_per_million']:.2f}")
    return "\n".join(lines)
