"""Near copies by SimHash in BK-trees with an exact check, for the near-duplicate stage of the pipeline.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least LEAST. Candidates are texts
whose 128-bit SimHashes of those sets differ in RADIUS bits or fewer; a pair at a similarity of 0.8 differs in 19 on average
and in more than RADIUS with a chance of some 2 in 10,000. So wide a radius is past what blocks of bits can promise by the
pigeonhole principle, so shards are drawn: the codes that agree on a random choice of bits, by tables() many choices. The
number of bits follows the number of texts, so that shards stay small, and the number of tables the bits, so that a pair at
a similarity of 0.8 escapes all of them with a chance of ESCAPES at most. A BK-tree over each shard finds its candidates.

Texts with one set are one node. The candidates of all shards, reduced to a forest per shard, give groups of nodes that may
be linked; nodes without any candidate are done, and texts are fetched once, for the others. Each node is first checked
against its nearest candidate and the least and greatest node of its group, which joins a large group in linear work. Where
that leaves several parts of a group, every node outside the largest part is sought in trees over the group, with the whole
sets at hand, and only links that join parts are returned. So no pairs are written out, and none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import Forest, roots_of
from .common import checkpoint, distinct, give_back, own_columns, parallelism, slices, tidy
from .components import connected_components

WORDS = 5
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BITS, RADIUS = 128, 34
#: Nodes in a shard on average, and the chance that all tables miss a pair that differs in EXPECTED bits.
SHARD_ROWS, ESCAPES, EXPECTED = 64, 0.01, 20
#: Rows of a sub-tree and of the shards one task gets at a time, and shingles of a sub-tree whose sets are at hand.
TREE_ROWS, GROUP_ROWS, TREE_SHINGLES = 2048, 25_000, 1_000_000
_PIECE = 255 * 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; a shorter one is a single shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    return distinct(np.fromiter((digest(x) for x in map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False))), dtype=np.uint64))


def code(found: np.ndarray) -> np.ndarray:
    """SimHash (two words) of a set of hashes: a bit is set where it is set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), _PIECE):
        some = found[at : at + _PIECE]
        mixed = (some ^ (some >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        both = np.stack([some, mixed ^ (mixed >> np.uint64(29))], axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) - len(bits) % 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, lo, hi) per row; node is a hash of the text's shingle set, lo and hi (null without words) its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            codes = np.array([code(s) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            none = np.array([not len(s) for s in sets], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), *(pa.array(codes[:, k], mask=none) for k in (0, 1))], names=["doc_id", "text_key", "node", "lo", "hi"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, node bigint, lo bigint, hi bigint")


def tables(nodes: int) -> list[tuple[int, int]]:
    """Masks (of lo, of hi) of the bits that a shard's codes agree on, one pair per table."""
    bits = max(8, math.ceil(math.log2(max(1, nodes) / SHARD_ROWS)))
    agree = math.prod((BITS - EXPECTED - k) / (BITS - k) for k in range(bits))
    draw, out = np.random.default_rng(8), []
    for _ in range(math.ceil(math.log(ESCAPES) / math.log1p(-agree))):
        mask = sum(1 << int(k) for k in draw.choice(BITS, bits, replace=False))
        out.append((mask & (1 << 64) - 1, mask >> 64))
    return out


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def _sets(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found) for nodes (node, text_key): the shingle set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    texts = source.select("text_key", "text").join(nodes.select("node", "text_key"), "text_key").dropDuplicates(["node"])
    return checkpoint(texts.select("node", "text").mapInArrow(tidy(run), "node bigint, found array<bigint>"))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("s"))
    return checkpoint(shared.where(F.col("s") * LEAST[1] >= (F.col("n") - F.col("s")) * LEAST[0]).select("a", "b"))


def _dealt(spark: SparkSession, rows: int, per_task: int, shard: Column) -> Column:
    """A number that deals shards to tasks, about so many rows at a time."""
    return F.pmod(shard, F.lit(max(parallelism(spark), math.ceil(rows / per_task)))).cast("int").alias("g")


def _candidates(keyed: DataFrame, rows: int) -> DataFrame:
    """(node, least, best, d) for nodes of shards (key, node, lo, hi) that may have a candidate.

    best: the nearest candidate in the node's sub-tree, d bits away; least: the least node reached over candidates, where all
    nodes of a shard that is cut into sub-trees count as reached. Each may be the node itself.
    """
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TREE_ROWS)
    least = checkpoint(keyed.join(large, "key").groupBy("key", "n").agg(F.min("node").alias("centre")))
    shard = F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce(F.ceil(F.col("n") / TREE_ROWS), F.lit(1))))
    dealt = keyed.join(least, "key", "left").select(_dealt(keyed.sparkSession, rows, GROUP_ROWS, shard), shard.alias("shard"), "node", "lo", "hi", F.coalesce("centre", "node").alias("centre"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "node"], kind="stable")
        shard, node, centre = (pdf[x].to_numpy() for x in ("shard", "node", "centre"))
        codes = np.stack([pdf["lo"].to_numpy(), pdf["hi"].to_numpy()], axis=1).view(np.uint64)
        best, local = np.full(len(node), np.iinfo(np.int64).max), np.arange(len(node))
        forest = Forest(shard, codes)
        for probe, hit in forest.search(shard, codes, RADIUS):
            probe, hit = probe[probe != hit], hit[probe != hit]
            np.minimum.at(best, probe, forest.apart(codes[probe], hit) << 32 | hit)
            local = roots_of(len(node), probe, hit, local)
        found = best < np.iinfo(np.int64).max
        place = np.where(found, best & 0xFFFFFFFF, np.arange(len(node)))
        out = pd.DataFrame({"node": node, "least": np.where(centre != node, centre, node[local]), "best": node[place], "d": np.where(found, best >> 32, BITS).astype(np.int32)})
        give_back()
        return out[found | (centre != node)]

    return dealt.groupBy("g").applyInPandas(find, "node bigint, least bigint, best bigint, d int")


def _joined(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, lo, hi, part, root) of a part that join its roots."""
    sized = sets.select("node", "found", F.size("found").alias("size"))
    by_root = rooted.join(sized.select("node", "size"), "node").groupBy("part", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    torn = by_root.groupBy("part").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("roots > 1")
    trees = F.greatest(F.ceil(F.col("n") / TREE_ROWS), F.ceil(F.col("size") / TREE_SHINGLES)).cast("int")
    torn = checkpoint(torn.select("part", "main", "size", trees.alias("trees")))
    total = torn.agg(F.sum("size")).first()[0] or 0
    # a node stands in its own sub-tree; one outside the largest root also goes to the part's other ones
    dealt = rooted.join(torn.drop("size"), "part").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "trees").cast("int")).withColumn("probe", F.col("root") != F.col("main"))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("trees") - 1)).otherwise(F.array("own"))))
    shard = F.xxhash64("part", "at")
    dealt = dealt.join(sized.select("node", "found"), "node").select(_dealt(rooted.sparkSession, total, TREE_SHINGLES, shard), shard.alias("shard"), "node", "lo", "hi", "root", "probe", (F.col("at") == F.col("own")).alias("tree"), "found")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "node"], kind="stable")
        shard, node = pdf["shard"].to_numpy(), pdf["node"].to_numpy()
        names, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        merged = np.arange(len(names))
        codes = np.stack([pdf["lo"].to_numpy(), pdf["hi"].to_numpy()], axis=1).view(np.uint64)
        sizes = np.array([len(x) for x in pdf["found"]], dtype=np.int64)
        hashes, word = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["found"]]), return_inverse=True)
        start = np.cumsum(sizes) - sizes
        grown, probing = np.flatnonzero(pdf["tree"].to_numpy()), np.flatnonzero(pdf["probe"].to_numpy())
        forest = Forest(shard[grown], codes[grown])
        present = np.zeros(len(hashes), dtype=np.int32)
        links = []
        for probe, hit in forest.search(shard[probing], codes[probing], RADIUS):
            x, y = probing[probe], grown[hit]
            apart = merged[root[x]] != merged[root[y]]
            for one in np.unique(x[apart]):
                others = y[apart & (x == one)]
                present[word[start[one] : start[one] + sizes[one]]] = 1
                flat = np.repeat(start[others] - (np.cumsum(sizes[others]) - sizes[others]), sizes[others]) + np.arange(int(sizes[others].sum()))
                shared = np.add.reduceat(present[word[flat]], np.cumsum(sizes[others]) - sizes[others])
                present[word[start[one] : start[one] + sizes[one]]] = 0
                for other in others[shared * LEAST[1] >= (sizes[one] + sizes[others] - shared) * LEAST[0]]:
                    a, b = sorted((int(merged[root[one]]), int(merged[root[other]])))
                    if a != b:
                        merged[merged == b] = a
                        links.append((int(node[one]), int(node[other])))
        give_back()
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return checkpoint(dealt.groupBy("g").applyInPandas(find, "a bigint, b bigint"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, root) per row of docs; rows share a root when links join their texts.

    Null and empty texts are copies of one another; null ids and repeated rows are rows like any other; an empty table gives
    no rows; other columns are ignored. A text of any length is read whole, by one task.
    """
    source = own_columns(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    read = checkpoint(_read(source.select("doc_id", "text_key", "text")))
    nodes = checkpoint(read.where("lo is not null").groupBy("node").agg(F.min(F.struct("text_key", "lo", "hi")).alias("k")).select("node", "k.text_key", "k.lo", "k.hi"))
    count = nodes.count()
    masks = tables(count)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("lo").bitwiseAND(_signed(x)), F.col("hi").bitwiseAND(_signed(y))) for k, (x, y) in enumerate(masks)])
    keyed = nodes.select("node", "lo", "hi", F.explode(keys).alias("key"))
    met = checkpoint(_candidates(keyed, count * len(masks)))
    parts = connected_components(met.select(F.col("node").alias("a"), F.col("least").alias("b")))
    parts = checkpoint(parts.select("node", F.col("root").alias("part")))
    nearest = met.groupBy("node").agg(F.min(F.struct("d", "best")).alias("k")).select("node", F.col("k.best").alias("best"))
    ends = parts.groupBy("part").agg(F.max("node").alias("high"))
    pairs = parts.join(ends, "part").join(nearest, "node", "left").select("node", F.explode(F.array("part", "high", "best")).alias("end")).where("end <> node")
    pairs = checkpoint(pairs.select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b")).distinct())
    placed = checkpoint(nodes.join(parts, "node"))
    sets = _sets(source, placed)
    linked = _checked(pairs, sets)
    first = connected_components(linked).withColumnRenamed("node", "m")
    rooted = checkpoint(placed.join(first, placed["node"] == first["m"], "left").select("node", "lo", "hi", "part", F.coalesce("root", "node").alias("root")))
    linked = linked.union(_joined(rooted, sets))
    found = connected_components(linked).withColumnRenamed("node", "m")
    return read.join(found, read["node"] == found["m"], "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
