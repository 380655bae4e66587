"""Operator 13: token counts of whole texts by a compiled tokenizer.

Texts are cut into blocks of bytes, most of them into one. A task takes each of its blocks through the transducer and gives
the block's state map, {state it begins in: (state it ends in, tokens)}; a block behind another one is entered in the state
guessed from the characters in front of it. A state that a predecessor ends in and the next map lacks is walked from in
another round, until none is lacking; then the maps of a text are composed in order. So a text of any length is spread over
tasks, and no text goes further than from its reader to the task that counts it: only blocks whose guess isn't sure are kept
for another round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_columns, slices, tidy
from .transducer import LOOK_BACK, Transducer, together

#: Bytes of a block.
BLOCK = 1 << 16
#: Tokens a text may have.
LIMIT = 4096
_BACK = 4 * LOOK_BACK


def _inside(raw: bytes, block: int, size: int) -> tuple[bytes, bytes]:
    """(characters in front of a block, its own): a character belongs to the block its first byte is in."""
    back = min(_BACK, block * size)
    begin, end = back, min(back + size, len(raw))
    while block and begin < len(raw) and begin < back + 3 and raw[begin] & 0xC0 == 0x80:
        begin += 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    lead = 0
    while lead < begin and raw[lead] & 0xC0 == 0x80:
        lead += 1
    return raw[lead if block else 0 : begin], raw[begin:end]


def _maps(raws: list[bytes], blocks: list[int], names: list[str | None], path: str, size: int) -> Iterator[tuple[str, str, int, bool]]:
    """(start, end, tokens, whether the start is sure) per block; a name of None is a start to be guessed."""
    machine = Transducer.of_worker(path)
    parts = [_inside(raw, block, size) for raw, block in zip(raws, blocks, strict=True)]
    at = 0
    for some in together([a + b for a, b in parts]):
        mine = slice(at, at + len(some))
        at += len(some)
        classes, cuts = machine.classes(some)
        skip = np.array([len(a.decode("utf-8", "replace")) for a, _ in parts[mine]], dtype=np.int64)
        starts = [machine.first if not block else None if name is None else machine.state(name) for block, name in zip(blocks[mine], names[mine], strict=True)]
        for k, found in enumerate(machine.maps(classes, cuts, starts, skip)):
            ((start, (end, tokens)),) = found.items()
            if not blocks[at - len(some) + k]:
                yield "", machine.named(end), tokens + bool(some[k]), True
            else:
                yield machine.named(start), machine.named(end), tokens, machine.forgets(classes[cuts[k] : cuts[k] + skip[k]])


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs, tokens as sentencepiece's encode counts them.

    ``model`` is the file of a merging model with byte fallback. Null and empty texts have no tokens; rows with a null id and
    repeated rows are counted like any other, an empty table gives no rows, other columns are ignored. Texts of any length are
    counted whole; bytes that aren't UTF-8 count as U+FFFD.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = own_columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), F.monotonically_increasing_id().alias("row"))
    n_bytes = F.octet_length("raw").cast("bigint")
    many = F.greatest(F.lit(1), F.ceil(n_bytes / block)).cast("int")
    begin = lambda b: F.greatest(F.lit(0), b * block - _BACK)
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.struct(b.alias("block"), F.when(many == 1, F.col("raw")).otherwise(F.substring("raw", begin(b) + 1, (b + 1) * block + 3 - begin(b))).alias("raw")))
    parts = source.select("doc_id", n_bytes.alias("n_bytes"), "row", many.alias("blocks"), F.explode(cut).alias("part")).select("doc_id", "n_bytes", "row", "blocks", "part.block", "part.raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            raws, blocks = batch.column(5).to_pylist(), batch.column(4).to_pylist()
            found = list(_maps(raws, blocks, [None] * len(raws), model, block))
            start, end, tokens, sure = (list(x) for x in zip(*found, strict=True))
            single = [n == 1 for n in batch.column(3).to_pylist()]
            start, end = ([None if one else x for one, x in zip(single, names, strict=True)] for names in (start, end))
            kept = [None if one or ok else x for one, ok, x in zip(single, sure, raws, strict=True)]
            columns = [*batch.columns[:5], pa.array(start, pa.string()), pa.array(end, pa.string()), pa.array(tokens, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "row", "blocks", "block", "start", "end", "tokens", "raw"])

    schema = f"doc_id {kind}, n_bytes bigint, row bigint, blocks int, block int, start string, end string, tokens bigint, raw binary"
    counted = checkpoint(parts.mapInArrow(tidy(run), schema))
    whole = counted.where("blocks = 1").select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))
    cut_up = counted.where("blocks > 1")
    found = _composed(_complete(cut_up, model, block))
    texts = cut_up.where("block = 0").select("doc_id", "n_bytes", "row")
    joined = texts.join(found, "row").select("doc_id", "n_bytes", "n_tokens")
    return whole.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)


def _complete(cut_up: DataFrame, model: str, block: int) -> DataFrame:
    """The state maps (row, block, start, end, tokens) of blocks, with every start that the block before can end in."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = list(_maps(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), model, block))
            start, end, tokens, _ = (list(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(start, pa.string()), pa.array(end, pa.string()), pa.array(tokens, pa.int64())], names=["row", "block", "start", "end", "tokens"])

    known = cut_up.select("row", "block", "start", "end", "tokens")
    while True:
        ends = known.select("row", (F.col("block") + 1).alias("block"), F.col("end").alias("start")).distinct()
        unsure = cut_up.where("raw is not null").select("row", "block", "raw")
        lacking = ends.join(known.select("row", "block", "start"), ["row", "block", "start"], "left_anti").join(unsure, ["row", "block"])
        more = checkpoint(lacking.select("row", "block", "start", "raw").mapInArrow(tidy(again), "row bigint, block int, start string, end string, tokens bigint"))
        if more.isEmpty():
            return known
        known = known.unionByName(more)


def _composed(maps: DataFrame) -> DataFrame:
    """(row, n_tokens) by the maps of a row's blocks, one after another."""
    by_block = maps.groupBy("row", "block").agg(F.map_from_entries(F.collect_list(F.struct("start", F.struct("end", "tokens")))).alias("goes"))
    chain = F.sort_array(F.collect_list(F.struct("block", F.map_entries("goes").alias("goes"))))
    begin = F.struct(F.lit("").alias("state"), F.lit(0).cast("bigint").alias("n"))

    def onward(so_far, x):
        entry = F.get(F.filter(x["goes"], lambda e: e["key"] == so_far["state"]), F.lit(0))
        return F.struct(entry["value"]["end"].alias("state"), (so_far["n"] + entry["value"]["tokens"]).alias("n"))

    return by_block.groupBy("row").agg(F.aggregate(chain, begin, onward, lambda x: x["n"]).alias("n_tokens"))
