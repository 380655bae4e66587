"""Operator 1: benchmark decontamination by greedy string tiling.

Benchmark items are tokenised on the driver in blocks of a fixed size; documents are passed over once per block, so what
travels to executors has a bound whatever the benchmark's size. A document and an item meet when they share a seed (a run
of ``min_tile`` tokens). Tiling then repeatedly finds the longest runs that both still have unmarked, by Karp-Rabin hashes
over all runs of a length, and marks them without overlap; the share of the item's tokens under tiles decides, so a passage
whose parts come in another order is still found.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import distinct, own_columns, tidy

#: Tokens of benchmark text that one pass over the documents carries.
BLOCK_TOKENS = 2_000_000
_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
_WORDS = re.compile(r"\w+").findall
#: A character that is past ASCII and not a word character.
_ODD = re.compile(r"[^\w\x00-\x7f]").search
_APART = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of word characters, in UTF-8.

    Where only ASCII characters can stand between words, blanks put in their place do what the pattern would, faster.
    """
    low = (text or "").lower()
    if not low.isascii() and _ODD(low):
        return [w.encode() for w in _WORDS(low)]
    return low.encode().translate(_APART).split()


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` ids, modulo 2**64."""
    values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    if len(ids) < size:
        return np.zeros(0, dtype=np.uint64)
    out, done, power = None, 0, None
    # hashes of runs of powers of two, joined from the left: H(xy) = H(x) * base**|y| + H(y)
    run, length, scale = values, 1, _BASE
    while length <= size:
        if size & length:
            if out is None:
                out, done = run[: len(run)], length
            else:
                tail = out[length:]
                head = run[: len(tail)]
                out = head * power + tail
                done += length
            power = scale if power is None else power * scale
        if length * 2 <= size:
            run = run[: len(run) - length] * scale + run[length:]
            scale = scale * scale
        length *= 2
    return out[: len(ids) - size + 1]


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among keys, which are in order."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def tiles(item: np.ndarray, text: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, text position, length) of non-overlapping equal runs, longest first.

    Ids below zero equal nothing. Equal lengths are taken by item position, then text position.
    """
    free_item, free_text = item >= 0, text >= 0
    found = []

    def open_runs(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        upto = np.cumsum(np.r_[0, free])
        whole = upto[size:] - upto[:-size] == size
        at = np.flatnonzero(whole)
        return at, rolling(ids, size)[at]

    def share(size: int) -> bool:
        return bool(among(open_runs(item, free_item, size)[1], np.sort(open_runs(text, free_text, size)[1])).any())

    high = min(len(item), len(text))
    while high >= min_tile and share(min_tile):
        low = min_tile
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if share(middle) else (low, middle - 1)
        item_at, item_hash = open_runs(item, free_item, low)
        text_at, text_hash = open_runs(text, free_text, low)
        order = np.argsort(text_hash, kind="stable")
        text_at, text_hash = text_at[order], text_hash[order]
        marked = 0
        cursors: dict[int, int] = {}
        for i, h in zip(item_at.tolist(), item_hash.tolist(), strict=True):
            if not free_item[i : i + low].all():
                continue
            at = cursors.get(h)
            if at is None:
                at = int(np.searchsorted(text_hash, np.uint64(h)))
            while at < len(text_at) and int(text_hash[at]) == h:
                j = int(text_at[at])
                at += 1
                if free_text[j : j + low].all() and (item[i : i + low] == text[j : j + low]).all():
                    free_item[i : i + low] = False
                    free_text[j : j + low] = False
                    found.append((i, j, low))
                    marked += 1
                    break
            cursors[h] = at
        if not marked:
            high = low - 1
    return found


class Block:
    """Tokens and seeds of some benchmark items."""

    @classmethod
    def of_worker(cls, key: str, rows: list[tuple], min_tile: int) -> Block:
        """The block a worker process keeps between the tasks of one pass."""
        kept = pa.__dict__.get("_attrisieve_block", (None, None))
        if kept[0] != key:
            kept = key, cls(rows, min_tile)
            pa.__dict__["_attrisieve_block"] = kept
        return kept[1]

    def __init__(self, rows: list[tuple], min_tile: int):
        self.names = [name for name, _ in rows]
        split = [words(text) for _, text in rows]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for x in split for w in x))}
        self.items = [np.array([self.ids[w] for w in x], dtype=np.int64) for x in split]
        self.tile = [min(min_tile, len(x)) for x in self.items]
        self.sizes = sorted({t for t in self.tile if t})
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            own = [(k, rolling(x, size)) for k, x in enumerate(self.items) if self.tile[k] == size]
            keys = np.concatenate([h for _, h in own])
            item = np.concatenate([np.full(len(h), k) for k, h in own])
            at = np.concatenate([np.arange(len(h)) for _, h in own])
            order = np.argsort(keys, kind="stable")
            self.seeds[size] = keys[order], item[order], at[order]

    def number(self, text: str | None) -> np.ndarray:
        """Item-word ids of a text; -1 for words no item has."""
        own = words(text)
        return np.fromiter(map(self.ids.get, own, repeat(-1)), dtype=np.int64, count=len(own))

    def match(self, text: np.ndarray, min_share: float) -> Iterator[tuple[int, int, int]]:
        """(item, tokens under tiles, tiles) of items whose tiled share reaches min_share."""
        for size in self.sizes:
            keys, item, at = self.seeds[size]
            known = np.convolve(text < 0, np.ones(size, dtype=np.int64), "valid") == 0 if len(text) >= size else np.zeros(0, dtype=bool)
            where = np.flatnonzero(known)
            if not where.size:
                continue
            hashes = rolling(text, size)[where]
            hit = among(hashes, keys)
            where, hashes = where[hit], distinct(hashes[hit])
            if not where.size:
                continue
            first, last = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
            covered = np.zeros(len(text), dtype=bool)
            for k in range(size):
                covered[where + k] = True
            near = np.where(covered, text, -1)
            near = near[covered | np.r_[False, covered[:-1]]]  # one stranger stays between any two stretches
            rows = rows[np.argsort(item[rows], kind="stable")]
            for own in np.split(rows, np.flatnonzero(np.diff(item[rows])) + 1):
                k = item[own[0]]
                mine = np.zeros(len(self.items[k]), dtype=bool)
                for s in range(size):
                    mine[at[own] + s] = True
                if mine.sum() >= min_share * len(mine):  # tiles lie within shared runs, so this bounds them
                    laid = tiles(np.where(mine, self.items[k], -1), near, size)
                    tokens = sum(x[2] for x in laid)
                    if tokens >= min_share * len(mine):
                        yield int(k), tokens, len(laid)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Benchmark rows in blocks of at most BLOCK_TOKENS tokens (one longer item is a block of its own)."""
    rows, size = [], 0
    for name, text in own_columns(benchmark, name=id_col, text=text_col).toLocalIterator():
        n = len(words(text))
        if rows and size + n > BLOCK_TOKENS:
            yield rows
            rows, size = [], 0
        if n:
            rows.append((name, text))
            size += n
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = 5, min_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, tiles, share) per document and item whose tiles cover at least min_share of the item.

    Items shorter than min_tile match as a whole; items and documents without words match nothing (nulls included). Each
    row of docs is judged on its own, so repeated rows give repeated results; null ids are carried; empty tables give no
    rows; other columns are ignored. item_id is a bigint where the benchmark's ids are whole numbers, else a string. A text
    of any length is matched whole, by one task.
    """
    spark: SparkSession = docs.sparkSession
    source = own_columns(docs, doc_id=id_col, text=text_col)
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    item_kind = pa.int64() if isinstance(kinds[1], IntegralType) else pa.string()
    named = benchmark.select(F.col(f"`{item_col}`").cast("bigint" if item_kind == pa.int64() else "string").alias("name"), F.col(f"`{item_text_col}`").alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {'bigint' if item_kind == pa.int64() else 'string'}, covered int, item_tokens int, tiles int, share double"
    out = None
    for rows in _blocks(named, "name", "text"):
        shipped, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key) -> Iterator[pa.RecordBatch]:
            block = Block.of_worker(key, shipped.value, min_tile)
            for batch in batches:
                at, item, covered, total, count = [], [], [], [], []
                for row, text in enumerate(batch.column(1)):
                    for k, tokens, laid in block.match(block.number(text.as_py()), min_share):
                        at.append(row)
                        item.append(block.names[k])
                        covered.append(tokens)
                        total.append(len(block.items[k]))
                        count.append(laid)
                share = np.array(covered, dtype=float) / np.maximum(1, np.array(total, dtype=float))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_kind), *(pa.array(x, pa.int32()) for x in (covered, total, count)), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "covered", "item_tokens", "tiles", "share"])

        part = source.mapInArrow(tidy(run), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = 5, min_share: float = 0.5) -> DataFrame:
    """docs without the rows in which tiles cover min_share of an item; all columns stay, no row moves. Nulls as above."""
    at = docs.columns.index(text_col)
    for rows in _blocks(benchmark, item_col, item_text_col):
        shipped, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key) -> Iterator[pa.RecordBatch]:
            block = Block.of_worker(key, shipped.value, min_tile)
            for batch in batches:
                keep = [next(block.match(block.number(text.as_py()), min_share), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
