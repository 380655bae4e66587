"""Operator 12: hard negatives by bit-sliced integer products.

Components become whole numbers. A tile's rows are cut into bit planes; the anchors' products with the planes are added up
from the sign and the highest bit down. What the planes still to come can add lies between (2^k - 1) times the sum of an
anchor's negative components and as much of its positive ones, so each pair's score has an interval that halves with every
plane, and a pair goes as soon as its interval can no longer qualify: as a positive, when it ends below the kth best; as a
negative, when it misses every positive's window or what the window has found already. While many pairs are left a plane is
one matrix product, then only the pairs left are gone through; after the last plane what is left has its exact score.

Anchors and rows meet tile by tile (``operators.tiles``), first for the positives, then for the negatives.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators import tiles
from .common import give_back, own_columns, parallelism

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's: from, to.
WINDOW = (50, 95)
#: Anchors of a tile, and rows whose planes are worked on at once.
ANCHORS, ROWS = 1024, 2048
#: Below this share of pairs left they are gone through one by one.
SPARSE = 0.1
_PAIRS = 1 << 16
#: Below every score and above; ids of rows without one come last.
_LOW, _HIGH = -(1 << 62), 1 << 62
_LAST = (1 << 63) - 1

Qualify = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def on_grid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, x): rows that take part, components as whole numbers; shorter vectors end in zeros."""
    source = own_columns(rows, id=id_col, v=vector_col, label=label_col).where("v is not null and label is not null").withColumn("v", F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return source.where(~odd).select("id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _numbers(x: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    x = x.combine_chunks()
    size = x.value_lengths().to_numpy()
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = x.flatten().to_numpy()
    return out


def products(a: np.ndarray, x: np.ndarray, qualify: Qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of x, inner product) of the pairs that qualify to the end.

    qualify(i, j, low, high) tells which pairs still may, by intervals that hold their products; its arguments are lists of
    pairs, or, broadcast against each other, all pairs.
    """
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    largest = int(np.abs(x).max(initial=0))
    reach = largest.bit_length()
    bound = (int(np.abs(a).astype(object).sum(axis=1).max()) if a.size else 0) << (reach + 1)
    if bound >= 1 << 62:
        raise ArithmeticError("inner products don't fit a long")
    kind = np.float64 if bound < 1 << 53 else np.int64  # sums of whole numbers are exact in either
    a = a.astype(kind)
    least, most = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    i, j = np.arange(len(a))[:, None], np.arange(len(x))[None, :]
    score, alive = np.zeros((len(a), len(x)), dtype=kind), None
    for bit in range(reach, -1, -1):
        plane = (x >> bit) & 1
        weight, rest = (-(1 << bit) if bit == reach else 1 << bit), (1 << bit) - 1
        if alive is None:
            score += (a * weight) @ plane.T.astype(kind)
            left = np.broadcast_to(qualify(i, j, score + (rest * least)[:, None], score + (rest * most)[:, None]), score.shape)
            if left.sum() <= SPARSE * left.size or bit == 0:
                alive = np.nonzero(left)
                score = score[alive]
        else:
            plane = plane.astype(kind)
            more = [np.einsum("pd,pd->p", a[alive[0][p : p + _PAIRS]], plane[alive[1][p : p + _PAIRS]]) for p in range(0, len(score), _PAIRS)]
            score = score + weight * np.concatenate(more or [np.zeros(0, dtype=kind)])
            left = qualify(*alive, score + rest * least[alive[0]], score + rest * most[alive[0]])
            alive, score = (alive[0][left], alive[1][left]), score[left]
    return alive[0], alive[1], score.astype(np.int64)


def _first(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k per slot, by score from the highest, then id."""
    order = np.lexsort((ids, -score, slot))
    own = slot[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def nearest_alike(a: dict, x: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of x, score) of each anchor's first k other rows of its label; bar: what a score must reach.

    Rows of x are in order of id: a row that only equals the kth of the rows before it comes behind it.
    """
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    order = np.argsort(a["label"], kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(a["label"][order])) + 1):
        rows = np.flatnonzero(x["label"] == a["label"][own[0]]) if len(own) else own
        bar = np.maximum(a["bar"][own], _LOW)
        kept = (np.zeros(0, dtype=np.int64),) * 3
        full = np.full(len(own), _LOW)  # the kth score of the rows so far
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]

            def qualify(i, j, low, high, some=some, bar=bar, full=full, own=own):
                other = a["row"][own][i] != x["row"][some][j]
                if low.ndim == 2 and low.shape[1] > k:
                    known = np.where(other, low, _LOW)
                    kth = np.partition(known, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                    return other & (high >= np.maximum(bar, kth)[:, None]) & (high > full[:, None])
                return other & (high >= bar[i]) & (high > full[i])

            i, j, score = products(a["x"][own], x["x"][some], qualify)
            kept = tuple(np.r_[p, q] for p, q in zip(kept, (i, some[j], score), strict=True))
            best = _first(kept[0], kept[2], x["order"][kept[1]], k)
            kept = tuple(p[best] for p in kept)
            place = np.arange(len(best)) - np.searchsorted(kept[0], kept[0])
            full[kept[0][place == k - 1]] = kept[2][place == k - 1]
        found.append((own[kept[0]], kept[1], kept[2]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def within_windows(a: dict, x: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, window, row of x, score) of each window's first k rows of other labels.

    An anchor's windows are a["low"][i, w] to a["high"][i, w], both included, and scores below a["bar"][i, w] don't count.
    """
    windows = a["low"].shape[1]
    kept = (np.zeros(0, dtype=np.int64),) * 4
    full = np.full(a["low"].shape, _LOW)
    if not windows:
        return kept
    for at in range(0, len(x["label"]), ROWS):
        some = slice(at, at + ROWS)
        floor = np.maximum(a["low"], a["bar"])
        # a window whose best possible score its rows have already takes nothing more: later rows come behind
        shut = full >= a["high"]
        reach = np.where(shut, _LOW, a["high"])
        low_hull, high_hull = np.where(shut, _HIGH, np.maximum(floor, full)).min(axis=1), reach.max(axis=1)

        def qualify(i, j, low, high, some=some, floor=floor, full=full, reach=reach, low_hull=low_hull, high_hull=high_hull):
            other = a["label"][i] != x["label"][some][j]
            if low.ndim == 2:
                return other & (low <= high_hull[i]) & (high >= low_hull[i])
            fits = np.zeros(low.shape, dtype=bool)
            for w in range(windows):
                top = np.minimum(high, reach[i, w])
                fits |= (low <= reach[i, w]) & (top >= floor[i, w]) & (top > full[i, w])
            return other & fits

        i, j, score = products(a["x"], x["x"][some], qualify)
        pair, w = np.nonzero((score[:, None] >= floor[i]) & (score[:, None] <= a["high"][i]))
        new = i[pair], w, at + j[pair], score[pair]
        kept = tuple(np.r_[p, q] for p, q in zip(kept, new, strict=True))
        slot = kept[0] * windows + kept[1]
        best = _first(slot, kept[3], x["order"][kept[2]], k)
        kept = tuple(p[best] for p in kept)
        slot = slot[best]
        last = np.arange(len(slot)) - np.searchsorted(slot, slot) == k - 1
        full[kept[0][last], kept[1][last]] = kept[3][last]
    return kept


def _side(table: pa.Table) -> dict:
    """A tile's rows as arrays, in order of id."""
    ids = table["id"].to_numpy() if not table["id"].null_count else np.array([_LAST if v is None else v for v in table["id"].to_pylist()], dtype=np.int64)
    order = np.lexsort((table["row"].to_numpy(), ids))
    return {"order": ids[order], "row": table["row"].to_numpy()[order], "label": table["label_no"].to_numpy()[order], "x": _numbers(table["x"])[order], "at": order}


def _positive_tile(left: pa.Table, right: pa.Table) -> pa.Table:
    i, j, score = (np.zeros(0, dtype=np.int64),) * 3
    rows = right
    if left.num_rows and right.num_rows:
        a, x = _side(left), _side(right)
        a["bar"] = left["bar"].to_numpy()[a["at"]]
        i, j, score = nearest_alike(a, x, POSITIVES)
        i, j = a["row"][i], x["at"][j]
    out = pa.table({"anchor": pa.array(i, pa.int64()), "id": rows["id"].take(pa.array(j, pa.int64())), "row": rows["row"].take(pa.array(j, pa.int64())), "score": pa.array(score, pa.int64())})
    give_back()
    return out


def _negative_tile(left: pa.Table, right: pa.Table) -> pa.Table:
    anchor, positive, j, score = (np.zeros(0, dtype=np.int64),) * 4
    if left.num_rows and right.num_rows:
        a, x = _side(left), _side(right)
        lists = {name: _numbers(left[name])[a["at"]] for name in ("wanted", "bars")}
        size = left["wanted"].combine_chunks().value_lengths().to_numpy()[a["at"]]
        there = np.arange(lists["wanted"].shape[1]) < size[:, None]
        low, high = limits(lists["wanted"])
        a["low"], a["high"], a["bar"] = np.where(there, low, _HIGH), np.where(there, high, _LOW), np.where(there, lists["bars"], _LOW)
        i, w, j, score = within_windows(a, x, NEGATIVES)
        anchor, positive, j = a["row"][i], lists["wanted"][i, w], x["at"][j]
    out = pa.table({"anchor": pa.array(anchor, pa.int64()), "positive_score": pa.array(positive, pa.int64()), "id": right["id"].take(pa.array(j, pa.int64())), "score": pa.array(score, pa.int64())})
    give_back()
    return out


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest score of a negative for a positive's score."""
    return -(-WINDOW[0] * positive // 100), WINDOW[1] * positive // 100


def mine(rows: DataFrame, anchor: str = "id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on id.

    Rows without a label or vector, or with a null, NaN or infinite component, take no part; a vector shorter than another
    one ends in zeros. Each row is one of its own: a repeated row is another row of its label, and an anchor's answer comes
    as often as the anchor. Ids are whole numbers, labels of any type; a null one comes last among equal scores and is no anchor unless the
    condition says so. An anchor without a positive, or a positive without a negative, gives no row; nor does an empty table.
    Other columns are ignored. Products that don't fit a long raise an error.
    """
    spark = rows.sparkSession
    grid = on_grid(rows, id_col, vector_col, label_col)
    kind = grid.schema["id"].dataType.simpleString()
    label = F.col("label").cast("bigint") if isinstance(grid.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    grid = grid.select(F.col("id").cast("bigint").alias("id"), label.alias("label_no"), "x", F.monotonically_increasing_id().alias("row"))
    base, base_tiles = tiles.deal(grid, "base_tile")
    anchors, anchor_tiles = tiles.deal(base.where(anchor).drop("base_tile"), "query_tile", ANCHORS, ANCHORS)
    spans = list(tiles.rounds(base_tiles, -(-parallelism(spark) // anchor_tiles)))

    best = None
    for span in spans:
        asked = anchors.withColumn("bar", F.lit(_LOW).cast("bigint"))
        if best is not None:
            kth = best.groupBy("anchor").agg(F.when(F.count("*") >= POSITIVES, F.min("score")).alias("kth"))
            asked = anchors.join(kth, anchors["row"] == kth["anchor"], "left").withColumn("bar", F.coalesce("kth", F.lit(_LOW)).cast("bigint")).drop("kth", "anchor")
        met = tiles.meet(asked, base, anchor_tiles, span, _positive_tile, "anchor bigint, id bigint, row bigint, score bigint")
        best = tiles.first_of(met if best is None else best.unionByName(met), ["anchor"], [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], POSITIVES)
    positives = best
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("wanted"))  # at most POSITIVES

    best = None
    for span in spans:
        asked = anchors.join(windows, anchors["row"] == windows["anchor"]).withColumn("bars", F.transform("wanted", lambda s: F.lit(_LOW).cast("bigint")))
        if best is not None:
            kth = best.groupBy("anchor", "positive_score").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= NEGATIVES)
            listed = kth.groupBy(F.col("anchor").alias("told")).agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "kth"))).alias("kths"))
            asked = asked.join(listed, asked["anchor"] == listed["told"], "left").withColumn("bars", F.transform("wanted", lambda s: F.coalesce(F.try_element_at("kths", s), F.lit(_LOW).cast("bigint")))).drop("kths", "told")
        met = tiles.meet(asked.drop("anchor"), base, anchor_tiles, span, _negative_tile, "anchor bigint, positive_score bigint, id bigint, score bigint")
        best = tiles.first_of(met if best is None else best.unionByName(met), ["anchor", "positive_score"], [F.desc("score"), F.asc_nulls_last("id")], NEGATIVES)

    ranked = best.groupBy("anchor", "positive_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("nameless"), "id"))).alias("found"))  # at most NEGATIVES
    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    each = named.join(ranked, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "f"))
    own = lambda c: F.col(c).cast(kind).alias(c.replace("f.id", "negative_id"))
    return each.select(own("anchor_id"), own("positive_id"), (F.col("at") + 1).alias("rank"), own("f.id"), "positive_score", (-F.col("f.down")).alias("negative_score"))


def shifted(rows: DataFrame) -> DataFrame:
    """rows with the labels of every seventh id one further, as some wrong ones among ten labels."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
