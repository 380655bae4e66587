"""Corpora, relevance, exact cosine top-k in blocks, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import rank_in_groups
from ..session import shared_dir
from . import encoding, tiles

CUTOFFS = (1, 5, 10, 50, 100, 1000)
#: Queries of a tile, at least, and corpus vectors: as many scores as their product are held at once.
QUERY_BLOCK, CORPUS_BLOCK = 2048, 4096
#: Corpus vectors of a tile, at most; entries of lists that a task returns or merges, about.
BASE_TILE, LISTED = 262_144, 8_388_608
#: One corpus vector in so many tells where a query's kth score may lie.
SAMPLED = 16
#: Decimals of a score; far more than rounding errors reach, so equal cosines are equal scores however they were summed up.
DECIMALS = 9


def corpus(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(corpus_id, text): distinct texts of the columns, numbered from 0 in text order."""
    texts = None
    for c in columns:
        part = rows.select(F.col(c).alias("text"))
        texts = part if texts is None else texts.union(part)
    distinct = texts.where("text is not null").distinct()
    # ranges of whole texts keep the numbering from running in one task, however many texts open alike
    shared_dir(rows.sparkSession)
    keyed = distinct.repartitionByRange("text").withColumn("s", F.spark_partition_id()).checkpoint()
    sizes = keyed.groupBy("s").agg(F.count("*").alias("n"))
    bases = sizes.select("s", F.coalesce(F.sum("n").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("s").orderBy("text"))
    return keyed.withColumn("p", place).join(F.broadcast(bases), "s").select((F.col("base") + F.col("p") - 1).alias("corpus_id"), "text")


def query_ids(rows: DataFrame, query: str = "anchor", order: str = "row_id") -> DataFrame:
    """(query_id, anchor): distinct queries numbered from 0 in first-seen order; order holds a different whole number in each row."""
    first = rows.where(F.col(query).isNotNull()).groupBy(F.col(query).alias("anchor")).agg(F.min(order).alias("seen"))
    return rank_in_groups(first, [], "seen", "query_id").select("query_id", "anchor")


def qrels(rows: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, corpus_id), each once: the positives of each query."""
    return rows.join(ids, "anchor").join(docs, rows["positive"] == docs["text"]).select("query_id", "corpus_id").distinct()


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of length one; NaN for vectors without length."""
    numbers = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    m = numbers.reshape(len(vectors), len(numbers) // len(vectors))
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that k of its columns reach, close to the kth; -inf where fewer than k are numbers."""
    rows, n = scores.shape
    if n < k:
        return np.full(rows, -np.inf, dtype=scores.dtype)
    part = scores[:, ::SAMPLED]
    at = int(k / SAMPLED + 4 * (k / SAMPLED) ** 0.5 + 4)
    if at < part.shape[1]:
        level = -np.partition(np.where(np.isnan(part), np.inf, -part), at, axis=1)[:, at]
        missed = np.flatnonzero(~((scores >= level[:, None]).sum(axis=1) >= k))
    else:
        level, missed = np.full(rows, -np.inf, dtype=scores.dtype), np.arange(rows)
    if len(missed):
        whole = scores[missed]
        level[missed] = -np.partition(np.where(np.isnan(whole), np.inf, -whole), k - 1, axis=1)[:, k - 1]
    return level


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each group stand, in order of group, falling score and id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group) < k]


def _best(names: np.ndarray, vectors: np.ndarray, bound: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, exclude_same_id: bool) -> tuple[np.ndarray, ...]:
    """(row of names, row of ids, cosine in units of the last decimal) of the k best per name that reach its bound, ties by id.

    names are sorted. Products of single precision tell which pairs can be among the k best; a margin above their rounding
    error takes along what is near, and the sum over each pair's own products settles it. Scores are rounded before they are
    compared, so that equal cosines are equal however they were summed up.
    """
    narrow, wide = others.astype(np.float32), vectors.astype(np.float32)
    margin = np.float32((others.shape[1] + 8) * 2.0**-23 + 10.0**-DECIMALS)
    at_once = max(1, QUERY_BLOCK * CORPUS_BLOCK // max(1, len(ids)))
    parts = []
    for low in range(0, len(names), at_once):
        own = names[low : low + at_once]
        scores = wide[low : low + at_once] @ narrow.T
        if exclude_same_id:
            place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            same = np.flatnonzero(own[place] == ids)
            scores[place[same], same] = np.nan
        level = np.fmax(_kth(scores, k), bound[low : low + at_once].astype(np.float32)) - margin
        i, j = np.divmod(np.flatnonzero(scores >= level[:, None]), len(ids))
        exact = np.concatenate([np.einsum("ij,ij->i", vectors[low + i[a : a + 65_536]], others[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)] or [np.zeros(0)])
        score = np.rint(exact * 10**DECIMALS).astype(np.int32)
        reach = np.flatnonzero(score >= np.rint(np.fmax(bound[low + i], -2.0) * 10**DECIMALS))
        kept = reach[_first(i[reach], score[reach], ids[j[reach]], k)]
        parts.append((low + i[kept], j[kept], score[kept]))
    return tuple(np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, dtype=t) for x, t in enumerate((np.int64, np.int64, np.int32)))


#: Lists of some queries in one row: an entry's query, corpus vector, score and whether it has the query's group.
_LISTS = "block bigint, query binary, corpus binary, score binary, same binary"
_FIELDS = {"query": np.int64, "corpus": np.int64, "score": np.int32, "same": np.bool_}


def _ranked(queries: DataFrame, base: DataFrame, k: int, exclude_same_id: bool, last: Callable[[dict[str, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """What last makes of a block of queries' lists, as arrays in order of query and rank with fields query, corpus, score, same and rank.

    queries (query_id, v, group) and base (corpus_id, v, group) meet tile by tile; there are about as many pairs of tiles as
    tasks, so how often a vector is sent grows with neither side until tiles are full. Lists travel as arrays, a row for a
    block of queries; a round's kth scores bound what the next round's tasks return.
    """
    kind = lambda df: "array<float>" if dict(df.dtypes)["v"] == "array<float>" else "array<double>"
    group = F.col("group").cast("string").alias("group")
    asked = queries.where("query_id is not null and v is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("v").cast(kind(queries)).alias("v"), group).dropDuplicates(["query_id"])
    source = base.where("corpus_id is not null and v is not null").select(F.col("corpus_id").cast("bigint").alias("corpus_id"), F.col("v").cast(kind(base)).alias("v"), group)
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    source, base_tiles = tiles.deal(source, "base_tile", BASE_TILE, BASE_TILE)
    most = max(QUERY_BLOCK, min(tiles.MOST, LISTED // k))
    asked, query_tiles = tiles.deal(asked, "query_tile", most, QUERY_BLOCK, -(-tasks // base_tiles))
    at_first = max(1, tasks // query_tiles)
    per = max(1, LISTED // (2 * k * min(at_first, base_tiles)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("query_id")
            names, ids = left["query_id"].to_numpy(), right["corpus_id"].to_numpy()
            bound, there = left["bound"].to_numpy(), {}
            mine, theirs = (np.array([-1 if x is None else there.setdefault(x, len(there)) for x in t["group"].to_pylist()]) for t in (left, right))
            i, j, score = _best(names, _unit(left["v"]), bound, ids, _unit(right["v"]), k, exclude_same_id)
            same = (mine[i] == theirs[j]) & (mine[i] >= 0)
            tile = left["query_tile"][0].as_py()
            for b in range(0, len(names), per):
                low, high = np.searchsorted(i, [b, b + per])
                cut = slice(low, high)
                if high > low:
                    rows.append([(tile << 32) + b // per, *(x.tobytes() for x in (names[i[cut]], ids[j[cut]], score[cut], same[cut]))])
        types = [pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["block", *_FIELDS])

    def merged(lists: pa.Table) -> dict[str, np.ndarray]:
        found = {c: np.frombuffer(b"".join(lists[c].to_pylist()), dtype=t) for c, t in _FIELDS.items()}
        kept = _first(found["query"], found["score"].astype(np.int64), found["corpus"], k)
        found = {c: x[kept] for c, x in found.items()}
        return found | {"rank": np.arange(len(kept)) - np.searchsorted(found["query"], found["query"]) + 1}

    def again(lists: pa.Table) -> pa.Table:
        found = merged(lists)
        return pa.table([pa.array([lists["block"][0].as_py()], pa.int64()), *[pa.array([found[c].tobytes()], pa.binary()) for c in _FIELDS]], names=["block", *_FIELDS])

    def kth(lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lists:
            for query, score in zip(batch.column("query").to_pylist(), batch.column("score").to_pylist(), strict=True):
                query, score = np.frombuffer(query, dtype=np.int64), np.frombuffer(score, dtype=np.int32)
                at = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
                yield pa.RecordBatch.from_arrays([pa.array(query[at]), pa.array(score[at] / 10**DECIMALS)], names=["query_id", "kth"])

    best, met, least = None, None, F.lit(float("-inf"))
    for span in tiles.rounds(base_tiles, at_first):
        bounded = asked.withColumn("bound", least)
        if met is not None:
            best = met.groupBy("block").applyInArrow(again, _LISTS).checkpoint()
            bounded = asked.join(best.mapInArrow(kth, "query_id bigint, kth double"), "query_id", "left").withColumn("bound", F.coalesce("kth", least)).drop("kth")
        found = tiles.meet(bounded, source, query_tiles, span, run, _LISTS)
        met = found if best is None else best.unionByName(found)
    if met is None:
        return base.sparkSession.createDataFrame([], schema)
    return met.groupBy("block").applyInArrow(lambda lists: last(merged(lists)), schema).checkpoint()


def top_k(queries: DataFrame, base: DataFrame, k: int, exclude_same_id: bool = False) -> DataFrame:
    """(query_id, corpus_id, score, rank): the k best corpus vectors per query by cosine to DECIMALS, ties by id.

    queries (query_id, v) and base (corpus_id, v). Vectors without length score nothing; all have the same number of
    dimensions; repeated query ids are one query, repeated rows of the base are rows of their own.
    """
    none = F.lit(None).alias("group")

    def last(found: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({"query_id": found["query"], "corpus_id": found["corpus"], "score": found["score"] / 10**DECIMALS, "rank": found["rank"].astype(np.int32)})

    return _ranked(queries.select("query_id", "v", none), base.select("corpus_id", "v", none), k, exclude_same_id, last, "query_id bigint, corpus_id bigint, score double, rank int")


def top_k_by_kind(queries: DataFrame, base: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, kind), (kind, corpus_id, score, rank)): top_k() for vectors of which many are equal; queries of a kind share a vector and a list.

    Different vectors are compared, so the work is their product. A vector of the base stands for its smallest id: a row among
    a query's k best belongs to one of the k best vectors and is among the k smallest ids of it. Ids of the base are different.
    """
    shared_dir(base.sparkSession)
    queries, base = (df.select(name, "v").checkpoint().where(f"{name} is not null and v is not null") for df, name in ((queries, "query_id"), (base, "corpus_id")))
    asked = queries.groupBy("v").agg(F.min("query_id").alias("kind")).checkpoint()
    least = tiles.first_of(base, ["v"], [F.col("corpus_id")], k)
    members = least.groupBy("v").agg(F.array_sort(F.collect_list("corpus_id")).alias("members")).withColumn("first", F.element_at("members", 1)).checkpoint()
    best = top_k(asked.select(F.col("kind").alias("query_id"), "v"), members.select(F.col("first").alias("corpus_id"), "v"), k)
    found = best.select(F.col("query_id").alias("kind"), F.col("corpus_id").alias("first"), "score", "rank").join(members.select("first", "members"), "first")
    nearer = W.partitionBy("kind").orderBy(F.rint(F.col("score") * -(10**DECIMALS)).cast("bigint")).rangeBetween(W.unboundedPreceding, -1)
    listed = found.withColumn("nearer", F.coalesce(F.sum(F.size("members")).over(nearer), F.lit(0))).where(F.col("nearer") < k)
    rows = listed.select("kind", "score", F.explode(F.slice("members", F.lit(1), F.lit(k + 1) - F.col("rank"))).alias("corpus_id"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "corpus_id")).alias("rank")
    ranked = rows.select("kind", "corpus_id", "score", place).where(F.col("rank") <= k).checkpoint()
    return queries.join(asked, "v").select("query_id", "kind"), ranked


def group_hits(queries: DataFrame, base: DataFrame, k: int, exclude_same_id: bool = False) -> DataFrame:
    """(query_id, rank, hit): where the query's own group stands among its k best, as top_k() ranks them, counted by hit from 1.

    queries (query_id, v, group) and base (corpus_id, v, group); a null group is nobody's. The k best themselves stay in the tasks.
    """

    def last(found: dict[str, np.ndarray]) -> pa.Table:
        query, rank = found["query"][found["same"]], found["rank"][found["same"]]
        hit = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.table({"query_id": query, "rank": rank.astype(np.int32), "hit": hit.astype(np.int32)})

    return _ranked(queries, base, k, exclude_same_id, last, "query_id bigint, rank int, hit int")


def per_query_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, k, accuracy, recall, precision, mrr, ndcg, map) for every query with a relevant document.

    ranked has (query_id, corpus_id, rank); relevant (query_id, corpus_id) gives the denominators, so a relevant document
    that isn't retrieved counts against recall. Precision divides by k even where the corpus is smaller.
    """
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.join(relevant, ["query_id", "corpus_id"], "left_semi").select("query_id", "corpus_id", "rank")
    return metrics_from_hits(hits, totals, cutoffs)


def metrics_from_hits(hits: DataFrame, totals: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """The same from hits (query_id, rank, and hit, counting a query's by rank, if it is known) and how many documents are relevant (query_id, n_relevant)."""
    if "hit" not in hits.columns:
        hits = hits.withColumn("hit", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    at = [f.alias(f"{n}_{k}") for k in cutoffs for n, f in (
        ("h", F.count(F.when(F.col("rank") <= k, 1))),
        ("r", F.min(F.when(F.col("rank") <= k, F.col("rank")))),
        ("d", F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)))),
        ("p", F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.col("rank")))),
    )]
    summed = totals.join(hits.groupBy("query_id").agg(*at), "query_id", "left")
    rows = []
    for k in cutoffs:
        h, ideal_n = F.coalesce(f"h_{k}", F.lit(0)), F.least(F.lit(k).cast("bigint"), F.col("n_relevant"))
        ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), ideal_n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        rows.append(F.struct(
            F.lit(k).alias("k"), F.when(h > 0, 1.0).otherwise(0.0).alias("accuracy"), (h / F.col("n_relevant")).alias("recall"), (h / k).alias("precision"),
            F.coalesce(1 / F.col(f"r_{k}"), F.lit(0.0)).alias("mrr"), (F.coalesce(f"d_{k}", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce(f"p_{k}", F.lit(0.0)) / ideal_n).alias("map"),
        ))
    return summed.select("query_id", F.inline(F.array(*rows)))


def mean_metrics(per_query: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Means of all metrics by k and the given columns."""
    names = ("accuracy", "recall", "precision", "mrr", "ndcg", "map")
    return per_query.groupBy(*(groups or []), "k").agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n_queries"))


def encoded_metrics(rows: DataFrame, encoder: encoding.Encoder, cutoffs: tuple[int, ...] = CUTOFFS, dims: int | None = None) -> DataFrame:
    """per_query_metrics() of rows (row_id, anchor, positive, negative) whose texts an encoder turns into vectors.

    The corpus is all distinct positives and negatives; each distinct text is encoded once and each distinct vector ranked
    once. dims keeps the first dimensions of every vector.
    """
    shared_dir(rows.sparkSession)
    rows = rows.select("row_id", "anchor", "positive", "negative").checkpoint()  # read for the corpus, the queries and what is relevant
    docs, ids = corpus(rows, ["positive", "negative"]).checkpoint(), query_ids(rows).checkpoint()
    vector = encoding.truncated(F.col("v"), dims).alias("v")
    asked = encoding.encode(ids, "anchor", encoder).select("query_id", vector)
    base = encoding.encode(docs, "text", encoder).select("corpus_id", vector)
    kinds, ranked = top_k_by_kind(asked, base, max(cutoffs))
    relevant = qrels(rows, ids, docs).checkpoint()
    hits = relevant.join(kinds, "query_id").join(ranked, ["kind", "corpus_id"]).select("query_id", "corpus_id", "rank")
    return metrics_from_hits(hits, relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant")), cutoffs)


def clamp_cutoffs(cutoffs: tuple[int, ...], size: int) -> tuple[int, ...]:
    """Cut-offs no larger than the corpus, each once, in order."""
    return tuple(sorted({min(k, size) for k in cutoffs if k > 0 and size > 0}))


def last_metadata(rows: DataFrame) -> DataFrame:
    """(anchor, text, kind, query_distance): what a text was to a query when last seen, a positive after the negative of its row."""
    easy = F.coalesce(F.col("negative_example_source") == "random", F.lit(False))
    negative = F.struct(F.col("negative").alias("text"), F.when(easy, "Easy").otherwise("Hard").alias("kind"), "query_distance", F.lit(0).alias("side"))
    positive = F.struct(F.col("positive").alias("text"), F.lit("Positive").alias("kind"), "query_distance", F.lit(1).alias("side"))
    seen = rows.select("row_id", "anchor", F.inline(F.array(negative, positive)))
    return seen.groupBy("anchor", "text").agg(F.max_by(F.struct("kind", "query_distance"), F.struct("row_id", "side", "query_distance")).alias("m")).select("anchor", "text", "m.kind", "m.query_distance")


def prediction_listing(ranked: DataFrame, docs: DataFrame, ids: DataFrame, metadata: DataFrame, k: int = 50) -> DataFrame:
    """(anchor, predictions): per query its k best texts in order, each with score, kind and distance."""
    named = ranked.where(F.col("rank") <= k).join(docs, "corpus_id").join(ids, "query_id").join(metadata, ["anchor", "text"], "left")
    line = F.format_string("[%s] %s (Type: %s, Distance: %s)", F.format_string("%.4f", "score"), "text", F.coalesce("kind", F.lit("Random")), F.coalesce(F.col("query_distance").cast("string"), F.lit("N/A")))
    listed = named.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return listed.select("anchor", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("predictions"))
