"""Operator 9: toxicity by a classifier chain.

One logistic model per category, in order; each later model also sees the probabilities of the categories before it. While
training, those are out-of-fold predictions, so a later model never learns from probabilities its own row has shaped.
Features are presence of words and of word beginnings, so inflected and compounded terms share weight.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, own_columns, slices, tidy

#: Labelled documents the models are fitted on at most, chosen by a hash of the id, and bytes of them all and of each.
FIT_ROWS, FIT_BYTES, FIT_TEXT_BYTES = 4000, 64 << 20, 1 << 20
FOLDS = 5
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)
_MIX = 40503
#: Features kept per model: in so many rows at least, of so much chi-square at least, and so many at most.
MIN_ROWS, LEAST_CHI, SELECTED = 3, 12.0, 2500
#: Categories in the order of the chain, and the one that decides, which comes last and so hears from all others. Which words
#: are toxic depends on a text's language, and what junk looks like on both: the first comes from the documents' column lang,
#: the others from quality and toxic of the labels.
CATEGORIES = ("other_language", "low_quality", "toxic")
DECIDES = "toxic"
#: The language that isn't another one.
MAIN_LANGUAGE = "en"
_WORDS = re.compile(r"[^\W\d_]+").findall


def _features_of(word: str) -> array:
    parts = [f"={word}", *(f"{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return array("i", [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts])


def features(text: str | None, memo: dict[str, array] | None = None) -> np.ndarray:
    """Hashed features of the whole text; a null or wordless one has none.

    Each feature of a word counts as present, as had by two distinct words and by three; so does the number of distinct
    words, in powers of two, since a long clean text meets more word beginnings by chance.
    """
    memo = {} if memo is None else memo
    if len(memo) > 150_000:
        memo.clear()
    found = array("i")
    words = set(_WORDS((text or "").lower()))
    for word in words:
        own = memo.get(word)
        if own is None:
            own = memo[word] = _features_of(word)
        found += own
    if not found:
        return np.zeros(0, dtype=np.int64)
    ids, counts = np.unique(np.frombuffer(found, dtype=np.int32), return_counts=True)
    ids = ids.astype(np.int64)
    again = [(ids[counts >= k] * _MIX + k) % BUCKETS for k in (2, 3)]
    length = np.arange(1, len(words).bit_length() + 1) * _MIX % BUCKETS
    return distinct(np.concatenate([ids, *again, length]))


@dataclass
class Linear:
    """A logistic model: weights of hashed features, of earlier categories, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def logit(self, rows: np.ndarray, columns: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[columns], minlength=n) + before @ self.earlier + self.constant


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(rows: np.ndarray, columns: np.ndarray, before: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 3e-5, rate: float = 0.1) -> Linear:
    """Logistic loss with a small L2 penalty, by Adam over all rows, on the features that chi-square keeps.

    rows and columns: a pair per feature present; before: earlier categories' probabilities.
    """
    n, positive = max(1, len(y)), y.sum()
    seen = np.bincount(columns, minlength=BUCKETS).astype(float)
    with_ = np.bincount(columns, y[rows], minlength=BUCKETS)
    expected = seen * positive / n
    spread = expected * (1 - positive / n) * (1 - seen / n)
    chi = np.where((seen >= MIN_ROWS) & (spread > 0), (with_ - expected) ** 2 / np.maximum(spread, 1e-12), 0)
    kept = np.argsort(-chi, kind="stable")[:SELECTED]
    kept = np.sort(kept[chi[kept] >= LEAST_CHI])
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    at = place[columns]
    rows, at = rows[at >= 0], at[at >= 0]
    size, extra = len(kept), before.shape[1]
    theta = np.zeros(size + extra + 1)
    theta[-1] = np.log((positive + 1) / (n - positive + 1))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, theta[at], minlength=len(y)) + before @ theta[size : size + extra] + theta[-1])
        slack = (p - y) / n
        slope = np.concatenate([np.bincount(at, slack[rows], minlength=size), before.T @ slack, [slack.sum()]])
        slope[:-1] += l2 * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[kept] = theta[:size]
    return Linear(weights, theta[size : size + extra], float(theta[-1]))


class Chain:
    """Models for categories in order."""

    def __init__(self, categories: tuple[str, ...], models: list[Linear]):
        self.categories, self.models = categories, models
        self.table = np.stack([m.weights for m in models], axis=1)

    def predict(self, texts: list[str | None], memo: dict | None = None) -> np.ndarray:
        """Probabilities, a column per category."""
        found = [features(t, memo) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        columns = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        before = np.zeros((len(texts), 0))
        for model in self.models:
            p = sigmoid(model.logit(rows, columns, len(texts), before))
            before = np.column_stack([before, p])
        return before


def fit_chain(texts: list[str | None], labels: np.ndarray, categories: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Fit one model per category on texts and labels (a 0/1 column each)."""
    found = [features(t) for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    columns = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    # equal texts share a fold, so copies don't leak into their own out-of-fold probability
    fold = np.array([zlib.crc32((t or "").encode()) % folds for t in texts], dtype=np.int64)
    before, models = np.zeros((len(texts), 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        models.append(fit_linear(rows, columns, before, y))
        if k + 1 < len(categories):
            p = np.zeros(len(texts))
            for f in range(folds):
                out = fold == f
                renumber = np.cumsum(~out) - 1
                inside = ~out[rows]
                model = fit_linear(renumber[rows[inside]], columns[inside], before[~out], y[~out])
                p[out] = sigmoid(model.logit(rows, columns, len(texts), before))[out]
            before = np.column_stack([before, p])
    return Chain(categories, models)


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(place, text, label per category) of at most fit_rows labelled documents, by the hash of their id.

    Ids may have any type. An id that several labels or documents share counts once: toxic or of low quality if one label
    says so, with the text whose hash is smallest. Rows with a null id, label or text are left out; a null language, or none
    in the table, is the main one.
    """
    own = own_columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").dropna()
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max((F.col("quality").cast("int") == 0).cast("int")).alias("low_quality"))
    chosen = own.withColumn("place", F.xxhash64(F.col("doc_id").cast("string"), F.lit(9))).orderBy("place", "doc_id").limit(fit_rows)
    other = F.coalesce(F.col("lang").cast("string") != MAIN_LANGUAGE, F.lit(False)) if "lang" in docs.columns else F.lit(False)
    texts = docs.select(F.col("doc_id"), F.col("text"), other.cast("int").alias("other_language")).where(F.octet_length("text") <= FIT_TEXT_BYTES)
    joined = texts.join(F.broadcast(chosen), "doc_id")  # chosen has fit_rows rows at most
    one = joined.groupBy("doc_id", "place", "toxic", "low_quality").agg(F.min_by(F.struct("text", "other_language"), F.struct(F.xxhash64("text"), "other_language")).alias("t"))
    return one.select("place", "t.text", "t.other_language", "low_quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Chain:
    """The chain fitted on a bounded sample of labelled documents; without any, it finds nothing toxic."""
    texts, y, room = [], [], FIT_BYTES
    for row in training_rows(docs, labels, fit_rows).orderBy("place", "text").toLocalIterator():
        room -= len(row["text"].encode("utf-8", "surrogatepass"))
        if room < 0:
            break
        texts.append(row["text"])
        y.append([row[c] for c in CATEGORIES])
    labels_ = np.array(y, dtype=float).reshape(len(texts), len(CATEGORIES))
    return fit_chain(texts, labels_, CATEGORIES)


def _shipped(docs: DataFrame, chain: Chain):
    kept = np.flatnonzero(chain.table.any(axis=1))
    return docs.sparkSession.sparkContext.broadcast((chain.categories, kept, chain.table[kept], [(m.earlier, m.constant) for m in chain.models]))


def _chain(value: tuple) -> Chain:
    categories, kept, table, rest = value
    models = []
    for k, (earlier, constant) in enumerate(rest):
        weights = np.zeros(BUCKETS)
        weights[kept] = table[:, k]
        models.append(Linear(weights, earlier, constant))
    return Chain(categories, models)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a probability per category, toxic_flag) per row of docs.

    The whole text counts; null and empty texts get the chain's constants. Null ids and repeated rows are scored like any
    other, an empty table gives no rows, other columns are ignored. toxic_flag: the category DECIDES reaches the threshold. A
    text of any length is read whole, by one task.
    """
    source = own_columns(docs, doc_id=id_col, text=text_col)
    shipped = _shipped(docs, chain)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = _chain(shipped.value), {}
        for batch in slices(batches):
            p = own.predict(batch.column(1).to_pylist(), memo)
            columns = [batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, own.categories.index(DECIDES)] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *own.categories, "toxic_flag"])

    return source.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} double" for c in chain.categories) + ", toxic_flag boolean")


def clean(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose category DECIDES reaches the threshold; all columns stay, no row moves.

    Null and empty texts get the chain's constants; null ids, repeated rows and columns of any name are kept as they are.
    """
    at, shipped = docs.columns.index(text_col), _shipped(docs, chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = _chain(shipped.value), {}
        for batch in slices(batches):
            p = own.predict(batch.column(at).to_pylist(), memo)
            yield batch.filter(pa.array(p[:, own.categories.index(DECIDES)] < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
