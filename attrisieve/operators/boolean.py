"""Random Boolean expressions over features: generated as SQL text, evaluated by Catalyst, never executed as Python."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def random_tokens(n: int, seed: int) -> list[str]:
    """A random expression over n variables in order, as tokens: args[i], not, and, or and parentheses, closed at the end."""
    draw = random.Random(seed)
    tokens: list[str] = []
    depth = 0
    for i in range(n):
        while draw.random() < 0.25:
            tokens.append("(")
            depth += 1
        if draw.random() < 0.3:
            tokens.append("not")
        tokens.append(f"args[{i}]")
        while depth and draw.random() < 0.3:
            tokens.append(")")
            depth -= 1
        if i + 1 < n:
            tokens.append(draw.choice(["and", "or"]))
    return tokens + [")"] * depth


def to_sql(tokens: list[str], array: str) -> str:
    """The expression over a column of type array<boolean>."""
    return " ".join(t.replace("args[", f"{array}[") for t in tokens)


def to_text(tokens: Column, features: Column) -> Column:
    """Tokens with each args[i] replaced by feature i, joined by blanks."""
    place = lambda t: F.regexp_extract(t, r"^args\[(\d+)\]$", 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(place(t) != "", F.get(features, F.try_to_number(place(t), F.lit("999")).cast("int"))).otherwise(t)), " ")


#: Low bits of an assignment that one row of the first pass holds, values of the low bits a group of the second one takes.
LOW_BITS, CHUNK = 12, 256
_FAR = 1 << 14


def relax(distance: np.ndarray, bits: int) -> np.ndarray:
    """Least of distance plus changed bits, over all changes of the bits that number the first axis. Bit by bit: two passes are never needed."""
    for i in range(bits):
        pairs = distance.reshape(-1, 2, 1 << i, *distance.shape[1:])
        without, with_ = pairs[:, 0].copy(), pairs[:, 1].copy()
        pairs[:, 0], pairs[:, 1] = np.minimum(without, with_ + 1), np.minimum(with_, without + 1)
    return distance


def distance_table(spark: SparkSession, n: int, expression: str) -> DataFrame:
    """(assignment, distance) for all 2**n assignments of n variables, bit i for z[i]: least changes until the expression over z accepts.

    A distance transform over the hypercube: the accepted assignments start from 0 and each bit is relaxed once, n 2**n steps
    in all. The low bits are relaxed in rows that hold all their values, then the values change places, in one shuffle, and
    the high bits are relaxed. An expression that accepts nothing gives no rows.
    """
    low = min(LOW_BITS, n)
    high, size = n - low, min(CHUNK, 1 << low)
    bit = lambda i: F.call_function("shiftright", F.col("id"), F.lit(i)).bitwiseAND(F.lit(1).cast("bigint")) == 1
    every = spark.range(1 << n).withColumn("z", F.array(*[bit(i) for i in range(n)]) if n else F.array().cast("array<boolean>"))
    accepted = every.where(expression).select(F.call_function("shiftright", F.col("id"), F.lit(low)).alias("high"), F.col("id").bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("low"))
    rows = accepted.groupBy("high").agg(F.collect_list("low").alias("low"))  # 2**low numbers at most

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distance = np.full(1 << low, _FAR, dtype=np.int16)
                distance[found.values.to_numpy()] = 0
                parts = relax(distance, low).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), at), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "high", "distances"])

    def second(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        distance = np.full((1 << high, size), _FAR, dtype=np.int16)
        for at, part in zip(table["high"].to_pylist(), table["distances"].to_pylist(), strict=True):
            distance[at] = np.frombuffer(part, dtype=np.int16)
        relax(distance, high)
        numbers = (np.arange(1 << high)[:, None] << low) + chunk * size + np.arange(size)
        return pa.table({"assignment": pa.array(numbers.ravel(), pa.int64()), "distance": pa.array(distance.ravel().astype(np.int32))})

    return rows.mapInArrow(first, "chunk int, high bigint, distances binary").groupBy("chunk").applyInArrow(second, "assignment bigint, distance int")


def edit_distances(rows: DataFrame, key: str, features: str, n: int, expression: str) -> DataFrame:
    """(key, distance) from n feature bits to the nearest assignment that the expression (over column z) accepts; no row where none does.

    Only the function's number of variables bounds the work on it, not the rows: each looks its distance up.
    """
    value = F.transform(F.col(features), lambda v, i: F.when(v, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    own = F.aggregate(F.slice(value, 1, n) if n else value, F.lit(0).cast("bigint"), lambda s, x: s + x)
    table = distance_table(rows.sparkSession, n, expression)
    return rows.select(key, own.alias("assignment")).join(table, "assignment").select(key, "distance")
