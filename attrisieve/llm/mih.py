"""Operator 7: exact top-k by incremental multi-index hashing of binary codes.

A code is cut into ``m`` segments, each indexed by its value. The search radius grows by one bit at a time: step r probes
segment r mod m for all values that differ from the query's in just r div m bits. Two codes within r bits are so met by step
r at the latest, as their r differences can't exceed what was probed in every segment; so a query is finished as soon as its
kth verified distance is no larger than r. A code is verified at the first step that meets it and never again.

Equal codes are one index entry with their k smallest ids, so a vector that a third of all rows share costs one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, own_columns, parallelism

BITS = 64
SEGMENTS = 4
#: Radius up to which all segments are probed in one go: these steps are cheap, and few queries end there.
TOGETHER = 1
_PROBES = 1 << 17


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set where component i of the vector is above zero.

    Components past the 64th are ignored and missing ones count as zero; a null vector or id gives no row, a null or NaN
    component no bit (NaN isn't taken as above zero). Repeated rows stay, other columns are ignored.
    """
    source = own_columns(rows, id=id_col, v=vector_col).where("id is not null and v is not null")
    at = F.sequence(F.lit(0), F.lit(BITS - 1))
    bit = lambda i: F.when((F.get("v", i) > 0) & ~F.isnan(F.get("v", i)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    return source.select("id", F.aggregate(at, F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(bit(i))).alias("code"))


def edges(segments: int) -> list[int]:
    """First bit of each segment, and BITS."""
    return [round(BITS * k / segments) for k in range(segments + 1)]


def _segment(code: Column, low: int, high: int) -> Column:
    mask = (1 << (high - low)) - 1
    return F.call_function("shiftrightunsigned", code, F.lit(low)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def flips(width: int, radius: int) -> np.ndarray:
    """All numbers of so many bits of which ``radius`` are set."""
    if not radius:
        return np.zeros(1, dtype=np.int64)
    chosen = np.array(list(combinations(range(width), radius)), dtype=np.int64).reshape(-1, radius)
    return (np.int64(1) << chosen).sum(axis=1, dtype=np.int64)


def _probes(open_: DataFrame, cuts: list[int], steps: list[tuple[int, int]]) -> DataFrame:
    """(q, bound, s, value) for the steps (segment, radius)."""
    tables = [(s, cuts[s], (1 << (cuts[s + 1] - cuts[s])) - 1, flips(cuts[s + 1] - cuts[s], radius)) for s, radius in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, bound = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, low, mask, table in tables:
                own = ((q.view(np.uint64) >> np.uint64(low)) & np.uint64(mask)).view(np.int64)
                rows = max(1, _PROBES // len(table))
                for at in range(0, len(q), rows):
                    some = slice(at, at + rows)
                    value = (own[some, None] ^ table[None, :]).ravel()
                    columns = [np.repeat(q[some], len(table)), np.repeat(bound[some], len(table)), np.full(len(value), s, dtype=np.int32), value]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "bound", "s", "value"])

    return open_.select("q", "bound").mapInArrow(run, "q bigint, bound int, s int, value bigint")


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, id, distance, rank, covered): the k nearest rows of base by Hamming distance, ties by id; both have (id, code).

    Every query gets min(k, rows of base) rows, itself included where base holds it. covered: the distance up to which every
    code had been met when the query was finished. Repeated ids are rows of their own, repeated queries get one answer; rows
    with a null code are neither found nor asked for, other columns are ignored; empty tables give no rows. A segment should
    have about as many bits as the number of distinct codes.
    """
    base = base.select("id", "code").where("code is not null")
    nth = F.row_number().over(W.partitionBy("code").orderBy("id"))
    nearest_ids = base.withColumn("n", nth).where(F.col("n") <= k)
    index = checkpoint(nearest_ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    wanted, cuts = min(k, total), edges(segments)
    parts = F.array(*[F.struct(F.lit(i).alias("s"), _segment(F.col("code"), cuts[i], cuts[i + 1]).alias("value")) for i in range(segments)])
    entries = checkpoint(index.select("code", "ids", F.explode(parts).alias("p")).select("code", "ids", "p.s", "p.value"))
    asked = checkpoint(queries.where("code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct())
    spread = parallelism(base.sparkSession)
    open_ = checkpoint(asked.select("q").distinct().withColumn("bound", F.lit(BITS)))  # bound: the kth distance so far
    best = checkpoint(open_.where("false").select("q", F.lit(0).alias("distance"), F.lit(0).cast(base.schema["id"].dataType).alias("id"), F.lit(0).alias("n")))
    finished = []  # (q, distance, id, covered)
    step = 0
    while wanted and step <= BITS and not open_.isEmpty():
        level = step // segments
        last = (level + 1) * segments - 1 if level <= TOGETHER else step
        steps = [(r % segments, r // segments) for r in range(step, last + 1)]
        apart = F.col("q").bitwiseXOR(F.col("code"))
        in_segment = [F.bit_count(_segment(apart, cuts[i], cuts[i + 1])) for i in range(segments)]
        # not met by an earlier step: further off in the segments before, as far off at least in those behind
        new = reduce(lambda x, y: x & y, [F.col("s").isin([s for s, _ in steps]), *[F.when(F.col("s") > i, in_segment[i] > level).when(F.col("s") < i, in_segment[i] >= level).otherwise(F.lit(True)) for i in range(segments)]])
        probes = _probes(open_.repartition(spread, "q"), cuts, steps)
        met = probes.hint("merge").join(entries.where(F.col("s").isin([s for s, _ in steps])), ["s", "value"])  # there are far more probes than Spark can tell
        met = met.where(new & (F.bit_count(apart) <= F.col("bound")))
        found = met.select("q", F.bit_count(apart).alias("distance"), F.posexplode("ids").alias("n", "id")).select("q", "distance", "id", "n")
        order = F.row_number().over(W.partitionBy("q").orderBy("distance", "id", "n"))
        best = checkpoint(best.unionByName(found).withColumn("place", order).where(F.col("place") <= k).drop("place"))
        state = best.groupBy("q").agg(F.count("*").alias("have"), F.max("distance").alias("kth"))
        kth = F.when(F.col("have") >= wanted, F.col("kth")).otherwise(BITS)
        done = (F.col("have") >= wanted) & ((F.col("kth") <= last) | F.lit(wanted == total))
        now = checkpoint(open_.select("q").join(state, "q", "left").select("q", kth.alias("bound"), F.coalesce(done, F.lit(False)).alias("done")))
        closed = best.join(now.where("done").select("q"), "q", "left_semi")
        finished.append(checkpoint(closed.withColumn("covered", F.lit(last))))
        open_ = now.where(~F.col("done")).select("q", "bound")
        best = best.join(open_.select("q"), "q", "left_semi")
        step = last + 1
    if not finished:
        return asked.join(best, "q").select("query_id", "id", "distance", F.lit(1).alias("rank"), F.lit(0).alias("covered"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id", "n"))
    return asked.join(reduce(DataFrame.unionByName, finished), "q").withColumn("rank", rank).select("query_id", "id", "distance", "rank", "covered")
