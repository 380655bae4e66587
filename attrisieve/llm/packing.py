"""Operator 5: packing token sequences by minimum bin slack.

Only how many pieces there are of each length decides the bins, and there are at most ``capacity`` lengths. The driver gets
that histogram alone and fills bins: the longest piece left opens a bin, a bitset subset-sum over the lengths left finds
the fullest way to complete it, and the combination is taken as often as the counts allow, so the number of distinct
combinations doesn't grow with the corpus. Executors then give each piece its place by its rank among pieces of its
length; ranks come from counts per (length, bucket), so a length that a third of all pieces have is still dealt out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, own_columns, tidy
from .tokens import ChunkTokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces of a length ranked together; a length with more is dealt into buckets of about so many.
BUCKET_ROWS = 500


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of a document's ids; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkTokenizer(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, found in enumerate(encoder.encode_many(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = found + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    at.append(row)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = own_columns(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(tidy(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum that room holds: {length: how many}; longest lengths first among equals."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(how many bins, {length: pieces of it in each})] that use up the histogram."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    found = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        inside = fullest(counts, capacity - longest)
        counts[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in inside.items())
        for length, n in inside.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        found.append((times, inside))
    return found


def slots(found: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, pieces in a bin, first sequence, first offset), in order of rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, inside in found:
        offset = 0
        for length in sorted(inside, reverse=True):
            n = inside[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def ranked(parts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """parts with rank: 0, 1, 2... among the pieces of its length, without bringing a length to one task.

    Where a piece stands in parts takes part in its bucket's hash, so that repeated rows are dealt out like any others.
    """
    many = [(length, -(-n // BUCKET_ROWS)) for length, n in histogram.items()]
    buckets = parts.sparkSession.createDataFrame(many, "length bigint, buckets bigint")
    keyed = parts.withColumn("stands", F.monotonically_increasing_id()).join(F.broadcast(buckets), "length")  # a row per length, at most as many as the capacity
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "stands"), "buckets")).drop("buckets", "stands")
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    bases = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    local = keyed.withColumn("own", own)
    return local.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("bucket", "own", "base")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32; already cut to the capacity) with sequence_id and offset.

    Every piece gets one place; offsets in a sequence run from 0 without gaps. Pieces with equal lengths are taken in
    the order of a hash, then of doc_id; repeated rows are pieces of their own; an empty table gives no rows. parts is
    read twice and has to be a checkpoint, whose rows stand where they are.
    """
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    places = slots(plan(histogram, capacity))
    shipped = parts.sparkSession.sparkContext.broadcast(places)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if own.size:
                    size = int(length[own[0]])
                    rows = known[size]
                    row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                    inside = rank[own] - row[:, 0]
                    sequence[own] = row[:, 2] + inside // row[:, 1]
                    offset[own] = row[:, 3] + inside % row[:, 1] * size
            yield pdf.assign(sequence_id=sequence, offset=offset)

    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    dealt = ranked(parts, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return dealt.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents; null and empty texts are the end id alone. Null ids and repeated rows are packed like any other; other columns are ignored."""
    return pack(checkpoint(pieces(docs, tokenizer, id_col, text_col, capacity, end_id)), capacity)
