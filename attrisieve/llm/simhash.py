"""Operator 8: near duplicates by SimHash, found in BK-trees.

Fingerprints within ``radius`` bits are linked. By the pigeonhole principle two such codes agree on some ``blocks -
radius`` of ``blocks`` bit blocks, so codes that agree on some bits of one such choice are a shard, of a few thousand codes
whatever the size of the corpus. A BK-tree is built over each shard, children keyed by their Hamming distance to the parent,
and a probe follows only edges within the radius. Each tree travels to one task, with the probes of its shard: a broadcast
of all trees, or of one group of them after another, would send the whole corpus to every executor. A shard above
``tree_rows`` codes first takes all bits of its blocks; if that isn't enough it is dealt into sub-trees of about that size,
and each goes to every probe block of its shard. Tasks return a spanning forest of the links they find, never all
pairs of a group; the forests' components are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, roots_of
from .common import checkpoint, free_name, own_columns, parallelism
from .components import connected_components

_PIECE = 255 * 256
#: Codes a shard should have: a tree that large is some eight levels deep, and prunes. Codes a tree may have.
SHARD_ROWS, TREE_ROWS = 2048, 8192


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text as an unsigned integer; 0 when it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _PIECE):
        some = words[at : at + _PIECE + shingle - 1]
        joined = map(b" ".join, zip(*[some[k:] for k in range(shingle)], strict=False)) if shingle > 1 else some
        hashes = np.fromiter((digest(x, seed) for x in joined), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) - len(bits) % 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp) per row; fp is the fingerprint as a signed 64-bit number, text_key a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], names=["doc_id", "text_key", "fp"])

    source = own_columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def shard_masks(radius: int, distinct: int, shard_rows: int = SHARD_ROWS) -> list[tuple[int, int]]:
    """(mask, whole mask) pairs such that two codes within the radius agree under the whole masks of at least one pair.

    The mask is as much of the whole one as leaves shards of about shard_rows codes, if codes are spread evenly.
    """
    need = math.ceil(math.log2(max(1, distinct / shard_rows)))
    if not need:
        return [(0, 0)]  # one shard of all
    blocks = radius + 1
    while 64 // blocks * (blocks - radius) < need and blocks < radius + 4:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    found = []
    for choice in combinations(range(blocks), blocks - radius):
        bits = [b for k in choice for b in range(edges[k], edges[k + 1])]
        found.append((sum(1 << b for b in bits[:need]), sum(1 << b for b in bits)))
    return found


def _signed(mask: int) -> F.Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def links(codes: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS, group_rows: int = 50_000, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct codes of column fp whose components are those of all links within the radius."""
    distinct = codes.count()
    masks = shard_masks(radius, distinct, shard_rows)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key"), F.col("fp").bitwiseAND(_signed(w)).alias("whole")) for i, (m, w) in enumerate(masks)])
    rows = codes.select("fp", F.explode(keys).alias("s")).select("fp", "s.t", "s.key", "s.whole")
    wide = rows.groupBy("t", "key").agg(F.count("*").alias("n"))
    # a shard that holds too many takes all bits of its blocks, which linked codes share, too
    rows = rows.join(wide, ["t", "key"]).where("n > 1").select("fp", "t", F.when(F.col("n") > tree_rows, F.struct(F.lit(1).alias("depth"), F.col("whole").alias("bits"))).otherwise(F.struct(F.lit(0).alias("depth"), F.col("key").alias("bits"))).alias("key"))
    sizes = checkpoint(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / tree_rows).cast("int")
    dealt = rows.join(sizes, ["t", "key"]).select("fp", "t", "key", blocks.alias("k")).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "k").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "t", "key", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") == F.col("other")).alias("same"))
    written = sizes.agg(F.sum(F.col("n") * blocks)).first()[0] or 0  # with what the sub-trees of large shards repeat
    groups = max(parallelism(codes.sparkSession), math.ceil(written / group_rows))
    dealt = dealt.withColumn("g", F.pmod("shard", F.lit(groups)).cast("int"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, fp = pdf["shard"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        tree, same = pdf["tree"].to_numpy(), pdf["same"].to_numpy()
        order = np.lexsort((fp, shard))
        shard, fp, tree, same = shard[order], fp[order], tree[order], same[order]
        names, ident = np.unique(fp, return_inverse=True)
        root = np.arange(len(names))
        grown, probing = np.flatnonzero(tree), np.flatnonzero(~tree | same)
        forest = Forest(shard[grown], fp[grown])
        for probe, node in forest.search(shard[probing], fp[probing], radius):
            root = roots_of(len(names), ident[probing[probe]], ident[grown[node]], root)
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved].view(np.int64), "b": names[root[moved]].view(np.int64)})

    return dealt.select("g", "shard", "fp", "tree", "same").groupBy("g").applyInPandas(find, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, text_key, fp, component_id) per row of docs.

    component_id is the smallest doc_id whose fingerprint can be reached over links of at most ``radius`` differing bits.
    Null and empty texts have fingerprint 0 and are linked like any other; equal fingerprints always share a component,
    so exact copies and repeated rows do. A row with a null id keeps its row and links others, but gives no component its
    name. An empty table gives no rows; columns other than the two named are ignored. A text of any length is read whole, by
    one task.
    """
    return _rooted(docs, id_col, text_col, shingle, radius, seed, tree_rows).drop("root")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int = 42, tree_rows: int = TREE_ROWS) -> DataFrame:
    """simhash_components() and the least fingerprint of each component, as its root."""
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, seed))
    codes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    stars = connected_components(links(codes.select("fp"), radius, tree_rows))
    rooted = codes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_code = rooted.join(names, "root").select("fp", "component_id", "root")
    return prints.join(by_code, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def hex_of(code: str) -> F.Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each component: the smallest id (a null one last), then the smallest hash of its text.

    All columns stay. Of fully repeated rows one is kept.
    """
    return keep_first(docs, _rooted(docs, id_col, text_col, shingle, radius), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each root in found (doc_id, text_key, root), chosen as keep_one does."""
    found = checkpoint(found.select("doc_id", "text_key", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    chosen = found.groupBy("root").agg(F.min(order).alias("k"))
    key, name = free_name(docs, "text_key"), free_name(docs, "kept_id")
    keep = chosen.select(F.col("k.doc_id").alias(name), F.col("k.text_key").alias(f"{key}_"))
    repeated = not found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    kept = keyed.join(keep, (F.col(key) == F.col(f"{key}_")) & F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi")
    return (kept.dropDuplicates([id_col, key]) if repeated else kept).drop(key)
