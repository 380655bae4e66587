"""Operator 2: language-model scoring with a causal self-attention model trained in numpy.

Tokens are subword ids of a public tokenizer, each document ended by one more id. The model reads overlapping windows: the
first CONTEXT positions of a window are context only, so each token is scored once, and no position sees a later one. Its
input is a symbol per id (the commonest ids have one of their own, the rest share some), its output a gate over MIXTURES
shares of all ids: p(id | context) = sum over k of gate_k(context) * share_k(id). The gates are what attention computes; the
shares are a table learnt with them by expectation maximisation. So a token costs a few dozen numbers, not a row per id, and
the probabilities of all ids add up to one.

Training reads every training document once, all its windows, each partition from the same start, which a bounded sample
gives (WARM_DOCS whole texts of at most WARM_BYTES, WARM_IDS). The weights of the partitions are averaged by tokens and their expected counts added up, in
groups of FAN_IN, so no task and not the driver ever holds more than a few models, however many partitions there are. The
same pass counts words. The shares therefore rest on every training token.

A word's probability is a mixture of what attention gives its ids and of its smoothed share of the training text. The weight
of the share is fitted in the training pass: each block of texts is predicted from the words and weights before it.

Word counts are a table, not a dictionary: the commonest words (a fixed number) travel to every task, the counts of all
others are joined to the documents that have them. How many travel changes no result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_columns, tidy
from .tokens import ChunkTokenizer

SYMBOLS, OWN = 512, 496
MIXTURES, DIM, WINDOW, CONTEXT = 32, 16, 24, 8
STRIDE = WINDOW - CONTEXT
START, PAD = SYMBOLS, SYMBOLS + 1
END_ID = 1
#: Documents and ids the start of training is fitted on at most, how often and for about how many batches, and windows of a batch.
WARM_DOCS, WARM_IDS, WARM_PASSES, WARM_BATCHES, BATCH = 800, 600_000, 20, 1000, 128
#: Bytes of each of these documents at most: they are held at once, whole.
WARM_BYTES = 1 << 18
#: Batches between two looks at the shares, and tokens' worth of the ids' own frequencies in each share.
REFRESH, PRIOR = 96, 20.0
WARM_RATE, RATE = 0.02, 0.004
#: Windows scored at once; no score depends on it.
AT_ONCE = 256
#: Models averaged at once, texts read together.
FAN_IN, BLOCK = 16, 256
#: Words whose counts travel to every task, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 262_144, 64
_LN10 = float(np.log(10))
_SHAPES = {"bias": (MIXTURES,), "distance": (WINDOW,), "embed": (SYMBOLS + 2, DIM), "hidden": (DIM, DIM), "key": (DIM, DIM), "mix": (DIM, DIM), "out": (DIM, MIXTURES), "query": (DIM, DIM), "value": (DIM, DIM)}
_FROM_EMBED = ("query", "key", "value", "hidden")
#: Rows of a table of shares worked on at once, so that they stay in a core's cache.
_ROWS = 2048
_CELLS = np.arange((SYMBOLS + 2) * DIM // 2).reshape(-1, DIM // 2)
_SEES = np.tril(np.ones((WINDOW, WINDOW), dtype=bool))[CONTEXT:]
_BACK = np.maximum(np.arange(WINDOW)[CONTEXT:, None] - np.arange(WINDOW)[None, :], 0)


@dataclass
class Model:
    """Weights by name, the symbol of each id, the shares (ids, MIXTURES), and the weight of a word's share of the text."""

    weights: dict[str, np.ndarray]
    symbol_of: np.ndarray
    shares: np.ndarray
    word_weight: float


def symbols(counts: np.ndarray) -> np.ndarray:
    """Symbol of each id: one of its own for the commonest, shared by powers of two of the id's number for the others."""
    order = np.argsort(-counts, kind="stable")
    symbol_of = OWN + np.minimum(np.log2(np.arange(len(counts)) + 1.0), SYMBOLS - OWN - 1).astype(np.int32)
    symbol_of[order[:OWN]] = np.arange(min(OWN, len(counts)))
    return symbol_of


def fresh_weights(seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights to begin with."""
    draw = np.random.default_rng(seed)
    return {k: (draw.normal(size=shape) * 0.3).astype(np.float32) if len(shape) > 1 else np.zeros(shape, dtype=np.float32) for k, shape in _SHAPES.items()}


def shares_of(expected: np.ndarray) -> np.ndarray:
    """Shares from expected counts (ids, MIXTURES): each also gets PRIOR tokens dealt as all text is, one added to each id."""
    ones = np.ones(MIXTURES, dtype=expected.dtype)
    parts = [slice(at, at + _ROWS) for at in range(0, len(expected), _ROWS)]
    total = np.concatenate([expected[x] @ ones for x in parts])
    total += 1
    extra, whole = total * (PRIOR / total.sum(dtype=float)), np.zeros(MIXTURES)
    out = np.empty(expected.shape, dtype=np.float32)
    for x in parts:
        smoothed = expected[x] + extra[x, None]
        whole += smoothed.sum(axis=0)
        out[x] = smoothed
    scale = (1 / whole).astype(np.float32)
    for x in parts:
        out[x] *= scale
    return out


def lay_windows(ids: np.ndarray, lengths: np.ndarray, symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen, target) of the overlapping windows of documents whose ids are laid end to end.

    seen (n, WINDOW) are symbols, CONTEXT of them before the first scored position; START stands before a document and
    padding before that. target (n, STRIDE) are the ids that follow the scored positions, -1 where there is none; read row
    by row they are the documents' ids in order.
    """
    rooms = -(-lengths // STRIDE)
    first = np.cumsum(rooms + 1) - rooms  # in strides; a stride of padding stands before each document
    at = np.repeat(first * STRIDE - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))
    line = np.full(int((rooms + 1).sum()) * STRIDE, PAD, dtype=np.int32)
    aim = np.full(len(line), -1, dtype=np.int32)
    line[at[1:]] = symbol_of[ids[:-1]]
    line[first * STRIDE] = START
    aim[at] = ids
    rows = np.repeat(first - (np.cumsum(rooms) - rooms), rooms) + np.arange(int(rooms.sum()))
    seen = np.lib.stride_tricks.sliding_window_view(line, WINDOW)[STRIDE - CONTEXT :: STRIDE]
    return seen[rows - 1], aim.reshape(-1, STRIDE)[rows]


def by_symbol(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What a symbol brings along wherever it stands: its query (scaled), key, value, what is heard of it, and its own way."""
    e = w["embed"]
    v = e @ w["value"]
    return {"q": e @ (w["query"] * np.float32(DIM**-0.5)), "k": e @ w["key"], "v": v, "heard": v @ w["mix"], "own": e @ w["hidden"]}


def below(x: np.ndarray, limit: float) -> np.ndarray:
    """x in place, nothing of it above limit. Looking first is cheaper than writing: no trained logit comes near."""
    return np.minimum(x, limit, out=x) if x.max(initial=limit) > limit else x


def nearness(w: dict[str, np.ndarray], of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """Exponentials of what a symbol has to do with each other one, and of distances: weights that stay need them only once.

    None where their products could leave the range in which exponentials are exact.
    """
    s = of["q"] @ of["k"].T
    if np.abs(s).max() + np.abs(w["distance"]).max() > 40:
        return None
    s = np.exp(s)
    s[:, PAD] = 0
    return s, np.exp(w["distance"])[_BACK] * _SEES


def heats(w: dict[str, np.ndarray], seen: np.ndarray, of: dict[str, np.ndarray], near: tuple[np.ndarray, np.ndarray] | None = None, alike: bool = False) -> dict[str, np.ndarray]:
    """What the scored positions of windows (n, WINDOW) compute, up to their gates (n * STRIDE, MIXTURES) times their sums.

    Queries, keys and values depend on the symbol alone, so they are worked out once for each symbol and looked up. Attention
    s is likewise kept before its division by its sums, z. ``alike`` multiplies window by window, so that equal windows come
    out equal to the last bit wherever they stand; one product of all, rounded by the place of a row, is quicker.
    """
    everywhere, here = (x.astype(np.intp).ravel() for x in (seen, seen[:, CONTEXT:]))
    heard = of["heard"].take(everywhere, axis=0).reshape(-1, WINDOW, DIM)
    q = k = None
    if near is None:
        q, k = of["q"].take(here, axis=0).reshape(-1, STRIDE, DIM), of["k"].take(everywhere, axis=0).reshape(-1, WINDOW, DIM)
        s = q @ k.transpose(0, 2, 1)
        s += np.where(_SEES, w["distance"][_BACK], np.float32(-1e4))  # the exponential of which is 0
        np.exp(below(s, 40), out=s)
        if len(some := np.flatnonzero((seen == PAD).any(axis=1))):
            s[some] *= (seen[some] != PAD).astype(s.dtype)[:, None, :]
    else:
        s = near[0].take((here * len(near[0])).reshape(-1, STRIDE, 1) + everywhere.reshape(-1, 1, WINDOW))
        s *= near[1]
    z = np.maximum(s.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=s.dtype), np.float32(1e-20))[:, None]
    a = (s @ heard).reshape(-1, DIM)
    a /= z
    pre = of["own"].take(here, axis=0)
    pre += a
    h = np.maximum(pre, np.zeros_like(pre))
    h += w["embed"].take(here, axis=0)
    g = (h.reshape(-1, STRIDE, DIM) @ w["out"]).reshape(-1, MIXTURES) if alike else h @ w["out"]
    g.reshape(len(seen), -1)[:] += np.tile(w["bias"], STRIDE)
    np.exp(below(g, 60), out=g)
    return {"everywhere": everywhere, "here": here, "q": q, "k": k, "heard": heard, "s": s, "z": z, "a": a, "pre": pre, "h": h, "g": g}


def forward(w: dict[str, np.ndarray], seen: np.ndarray, of: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """heats(...), and the gates, which add up to one in each row."""
    f = heats(w, seen, of or by_symbol(w))
    f["gates"] = f.pop("g")
    f["gates"] /= (f["gates"] @ np.ones(MIXTURES, dtype=f["gates"].dtype))[:, None]
    return f


def log_probs(model: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each id of documents laid end to end."""
    seen, target = lay_windows(ids, lengths, model.symbol_of)
    of = by_symbol(model.weights)
    near = nearness(model.weights, of)
    parts, ones = [np.zeros(0, dtype=np.float32)], np.ones(MIXTURES, dtype=np.float32)
    for at in range(0, len(seen), AT_ONCE):
        aim = target[at : at + AT_ONCE].ravel()
        g = heats(model.weights, seen[at : at + AT_ONCE], of, near, alike=True)["g"]
        whole = g @ ones
        g *= model.shares.take(np.maximum(aim, 0), axis=0)
        parts.append((g @ ones / whole)[aim >= 0])
    return np.log10(np.maximum(np.concatenate(parts), np.float32(1e-37))).astype(np.float64)


def gradients(w: dict[str, np.ndarray], shares: np.ndarray, seen: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(gradients of the mean negative log probability, what each mixture is answerable for of each target, probabilities).

    Where there is no target, no mixture is answerable. Slopes are summed up by symbol first and led through the weights
    then, a row for each symbol instead of one for each position.
    """
    of = by_symbol(w)
    f = forward(w, seen, of)
    aim = target.ravel()
    counted = aim >= 0
    blame = shares.take(np.maximum(aim, 0), axis=0)
    blame *= f["gates"]
    p = np.maximum(blame @ np.ones(MIXTURES, dtype=blame.dtype), np.float32(1e-37))
    blame *= (counted / p)[:, None]
    slack = f["gates"]
    slack[np.flatnonzero(~counted)] = 0
    slack -= blame
    part = np.float32(1 / max(1, np.count_nonzero(counted)))
    g = {"out": f["h"].T @ slack * part, "bias": np.ones(len(slack), dtype=slack.dtype) @ slack * part}
    dh = slack @ (w["out"].T * part)
    dpre = dh * (f["pre"] > 0)
    q, k, s = f["q"], f["k"], f["s"]
    da = dpre / f["z"]
    mean = (da * f["a"]) @ np.ones(DIM, dtype=da.dtype)
    da = da.reshape(q.shape)
    dheard = s.transpose(0, 2, 1) @ da
    ds = da @ f["heard"].transpose(0, 2, 1)
    ds -= mean.reshape(-1, STRIDE, 1)
    ds *= s
    g["distance"] = np.bincount(_BACK.ravel(), np.ones(len(ds), dtype=ds.dtype) @ ds.reshape(len(ds), -1), minlength=WINDOW).astype(ds.dtype)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    here, everywhere = _CELLS.take(f["here"], axis=0).ravel(), _CELLS.take(f["everywhere"], axis=0).ravel()
    dq, down, de = (add_rows(np.zeros(w["embed"].shape, dtype=x.dtype), here, x) for x in (dq, dpre, dh))
    dk, dheard = (add_rows(np.zeros(w["embed"].shape, dtype=x.dtype), everywhere, x) for x in (dk, dheard))
    g["mix"] = of["v"].T @ dheard
    dq *= np.float32(DIM**-0.5)
    slopes = np.concatenate([dq, dk, dheard @ w["mix"].T, down], axis=1)
    led = w["embed"].T @ slopes
    g |= {x: led[:, at * DIM : (at + 1) * DIM] for at, x in enumerate(_FROM_EMBED)}
    de += slopes @ np.concatenate([w[x].T for x in _FROM_EMBED])
    g["embed"] = de
    return g, blame, p


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """table, with rows of the same width added to its own; at are the places of their pairs of numbers in it.

    Two numbers are added at once, as one complex number, which is several times faster than sorting rows and summing them up.
    """
    pair = np.result_type(table.dtype, np.complex64)
    np.add.at(table.reshape(-1).view(pair), at, rows.reshape(-1).view(pair))
    return table


class Trainer:
    """Adam for the weights, expectation maximisation for the shares, in one pass over windows."""

    def __init__(self, weights: dict[str, np.ndarray], expected: np.ndarray, rate: Callable[[int], float], forget: float = 1.0):
        self.flat = np.concatenate([weights[k].ravel() for k in sorted(weights)])
        self.w = _views(self.flat)
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.before, self.rate, self.forget = expected, rate, forget
        self.expected, self.fresh = np.zeros_like(expected), np.zeros_like(expected)
        self.shares = shares_of(expected)
        self.steps, self.tokens, self.waiting = 0, 0, 0

    def settle(self) -> None:
        """Add what has come in since to the expected counts and look at the shares again."""
        if self.waiting:
            for at in range(0, len(self.fresh), _ROWS):
                fresh, expected, both = (x[at : at + _ROWS] for x in (self.fresh, self.expected, self.shares))
                expected += fresh
                fresh[:] = 0
                np.add(self.before[at : at + _ROWS], expected, out=both)
            self.waiting = 0
            self.shares = shares_of(self.shares)

    def step(self, seen: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Probabilities of the targets (any where there is none), and one step that learns from them."""
        found, blame, p = gradients(self.w, self.shares, seen, target)
        self.steps += 1
        self.tokens += int((target >= 0).sum())
        t, rate = self.steps, np.float32(self.rate(self.steps))
        slope = np.concatenate([found[k].ravel() for k in sorted(found)])
        self.first += np.float32(0.1) * (slope - self.first)
        slope *= slope
        slope -= self.second
        slope *= np.float32(0.01)
        self.second += slope
        even = (1 - 0.99**t) ** 0.5  # of the second moment, taken out of the root
        np.sqrt(self.second, out=slope)
        slope += np.float32(1e-8 * even)
        np.divide(self.first, slope, out=slope)
        slope *= rate * np.float32(even / (1 - 0.9**t))
        self.flat -= slope
        at = np.maximum(target.ravel(), 0).astype(np.intp) * (MIXTURES // 2)
        add_rows(self.fresh, (at[:, None] + np.arange(MIXTURES // 2)).ravel(), blame)
        self.waiting += 1
        if t % REFRESH == 0:
            if self.forget != 1:
                self.expected *= self.forget
            self.settle()
        return p

    def learn(self, ids: np.ndarray, lengths: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
        """log10 probability of each id, each given before it was learnt from; windows are taken in a fixed random order."""
        seen, target = lay_windows(ids, lengths, symbol_of)
        found = np.ones(target.shape, dtype=np.float32)
        order = np.random.default_rng(len(seen)).permutation(len(seen))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            found[some] = self.step(seen[some], target[some]).reshape(-1, STRIDE)
        return np.log10(found[target >= 0]).astype(np.float64)


def warm_start(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(weights, expected counts, symbol of each id) from a sample of documents laid end to end, read again and again."""
    counts = np.bincount(ids, minlength=size).astype(np.float64)
    symbol_of = symbols(counts)
    draw = np.random.default_rng(2)
    begun = (counts + 1e-3)[:, None] * np.exp(draw.normal(size=(size, MIXTURES)) * 0.5) / MIXTURES
    if not len(ids):
        return fresh_weights(), np.zeros((size, MIXTURES), dtype=np.float32), symbol_of
    trainer = Trainer(fresh_weights(), (begun / max(1.0, begun.sum())).astype(np.float32), lambda t: WARM_RATE * (1 - 0.9 * min(1.0, t / WARM_BATCHES)), 0.95)
    trainer.shares = (begun / begun.sum(axis=0)).astype(np.float32)
    for _ in range(WARM_PASSES):
        trainer.learn(ids, lengths, symbol_of)
        if trainer.steps >= WARM_BATCHES:
            break
    trainer.settle()
    return trainer.w, trainer.expected * np.float32(min(1.0, len(ids) / max(1.0, trainer.expected.sum()))), symbol_of


def mixed(share: np.ndarray, attention: np.ndarray, weight: float) -> np.ndarray:
    """log10 of the mixture of two probabilities given by their log10; the first is a share of a text, never near 0."""
    return np.log10(weight * np.exp(share * _LN10) + (1 - weight) * np.exp(attention * _LN10))


def held_out(doc_id: object, fold: int = 2, folds: int = 7) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@dataclass
class Words:
    """The words of some texts: the different ones, which of them each word is, and how many words each text has."""

    different: pa.Array
    which: np.ndarray
    n: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """ASCII-lower-cased runs of other than ASCII white space of texts in UTF-8; null is empty."""
    import pyarrow.compute as pc

    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()).view(pa.string()), "")))
    n, flat = pc.list_value_length(found).to_numpy().astype(np.int64), found.flatten()
    empty = pc.binary_length(flat).to_numpy() == 0  # before the first white space and behind the last
    if empty.any():
        n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    told = flat.dictionary_encode()
    return Words(told.dictionary.view(pa.binary()), told.indices.to_numpy().astype(np.int64), n)


class Lexicon:
    """Ids and a count of each word a task has met."""

    LIMIT = 1_000_000

    @classmethod
    def of_worker(cls, key: str, tokenizer: str, head: dict[bytes, int] | None = None) -> Lexicon:
        """The lexicon a worker process keeps; in each pass its counts start at the head's, else at 0, its words' ids stay."""
        import tokenizers

        was, kept = tokenizers.__dict__.get("_attrisieve_lexicon", (None, None))
        if was != key:
            kept = kept if kept is not None and kept.tokenizer == tokenizer else cls(tokenizer)
            kept.begin(head)
            tokenizers.__dict__["_attrisieve_lexicon"] = key, kept
        return kept

    def __init__(self, tokenizer: str, head: dict[bytes, int] | None = None):
        self.tokenizer, self.encoder = tokenizer, ChunkTokenizer(tokenizer)
        self._reset()
        self.begin(head)

    def begin(self, head: dict[bytes, int] | None) -> None:
        """Set the counts of the words met before to where a pass begins."""
        self.head, self.forgotten = head, []
        self.count[: len(self.words)] = self._from(self.words)

    def _from(self, words: list[bytes]) -> list[int] | int:
        return 0 if self.head is None else [self.head.get(w, -1) for w in words]

    def _reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.size, self.count = (np.zeros(1 << 14, dtype=t) for t in (np.int64, np.int64, np.int64))
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        ids, size = self.encoder.encode_flat(words, (self.place, self.ids, self.start, self.size))
        n, at = len(self.words), self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.start):
            for name in ("start", "size", "count"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.zeros_like(own)]))
        self.ids[at : at + len(ids)] = ids
        self.start[n : n + len(words)], self.size[n : n + len(words)] = at + np.cumsum(size) - size, size
        self.count[n : n + len(words)] = self._from(words)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.words += words
        self.used = at + len(ids)

    def counted(self) -> Iterator[pa.RecordBatch]:
        """(word, c) of the words counted, which then stand at 0 again."""
        used = np.flatnonzero(self.count[: len(self.words)])
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([self.words[k] for k in some.tolist()], pa.binary()), pa.array(self.count[some])], names=["word", "c"])
        self.count[:] = 0

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of the different words, ids of each word, ids of all texts with END_ID behind each, ids of each text).

        Places are good until the next call; forgotten tells when one has taken all earlier words away.
        """
        listed = words.different.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.place.get, listed, repeat(-1)), dtype=np.int64, count=len(listed))
        if len(unknown := np.flatnonzero(own < 0)):
            if self.place and len(self.place) + len(unknown) > self.LIMIT:
                self.forgotten += [*self.counted()] if self.head is None else []
                self._reset()
                unknown = np.arange(len(listed))
            own[unknown] = len(self.words) + np.arange(len(unknown))
            self._learn([listed[k] for k in unknown.tolist()])
        size = self.size[own][words.which]
        total = np.r_[0, np.cumsum(size)]
        stops = np.cumsum(words.n)
        lengths = total[stops] - total[stops - words.n] + 1
        ids = np.full(int(lengths.sum()), END_ID, dtype=np.int32)
        inside = np.ones(len(ids), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        ids[inside] = self.ids[np.repeat(self.start[own][words.which] - total[:-1], size) + np.arange(total[-1])]
        return own, size, ids, lengths


def word_sums(points: np.ndarray, size: np.ndarray, n_words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of its ids' points for each word, points of each text's end)."""
    upto = np.r_[0.0, np.cumsum(points)]
    first = np.cumsum(size) - size + np.repeat(np.arange(len(n_words)), n_words)
    return upto[first + size] - upto[first], points[np.cumsum(lengths) - 1]


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Record batches of at most BLOCK texts, and their words."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, words_of(part.column(text_at))


_FOUND = "word binary, c bigint, shard bigint, n double, words double, share double, weights binary, ids binary, expected binary"


def _no_model(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, f.type) for f in list(schema)[2:])], schema=schema)


_FOUND_ARROW = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("shard", pa.int64()), ("n", pa.float64()), ("words", pa.float64()), ("share", pa.float64()), ("weights", pa.binary()), ("ids", pa.binary()), ("expected", pa.binary())])


def train(training: DataFrame, tokenizer: str) -> tuple[DataFrame, Model]:
    """(word, c) of all words of columns doc_id and text, and the model, from one pass over all windows after a warm start."""
    spark = training.sparkSession
    chosen = training.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), "doc_id").limit(WARM_DOCS).distinct()
    short = training.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= WARM_BYTES)
    sample = short.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").limit(WARM_DOCS).repartition(1)

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkTokenizer(tokenizer)
        texts = sorted((t.as_py() or b"" for batch in batches for t in batch.column(0).cast(pa.binary())), key=zlib.crc32)
        found, left = [], WARM_IDS
        for text in texts:
            own = np.r_[np.frombuffer(encoder.encode(text), dtype="<u4").astype(np.int32), np.int32(END_ID)]
            if len(own) <= left:
                found.append(own)
                left -= len(own)
        weights, expected, symbol_of = warm_start(np.concatenate(found) if found else np.zeros(0, dtype=np.int32), np.array([len(x) for x in found], dtype=np.int64), len(encoder.ends))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (_flat(weights), expected.astype("<f4").tobytes(), symbol_of.astype("<i4").tobytes())], names=["w", "e", "s"])

    (begun,) = sample.mapInArrow(warm, "w binary, e binary, s binary").collect() or [r.to_pylist()[0] for r in warm(iter(()))]
    symbol_of = np.frombuffer(begun["s"], dtype="<i4")
    size = len(symbol_of)
    start = spark.sparkContext.broadcast((_unflat(begun["w"]), np.frombuffer(begun["e"], dtype="<f4").reshape(size, MIXTURES), symbol_of))
    key = uuid.uuid4().hex

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, expected, symbol_of = start.value
        lexicon, trainer = Lexicon.of_worker(key, tokenizer), Trainer(weights, expected, lambda t: RATE / (1 + t / 500) ** 0.5)
        lexicon.count[:], lexicon.forgotten = 0, []  # a task that failed may have left some
        share, fitted, seen, met = 0.5, 0.0, 0, 0
        for _, words in _blocks(batches, 0):
            own, size, ids, lengths = lexicon.read(words)
            if lexicon.forgotten:
                yield from (_no_model(x, _FOUND_ARROW) for x in lexicon.forgotten)
                lexicon.forgotten, seen, met = [], 0, 0
            attention, _ = word_sums(trainer.learn(ids, lengths, symbol_of), size, words.n, lengths)
            count = lexicon.count[own]
            if seen:  # how much of each word its share so far explains, the share of the mixture as it stands
                by_share = share * (count[words.which] + 1.0) / (seen + met + 1)
                part = by_share / (by_share + (1 - share) * np.exp(attention * _LN10))
                fitted += len(part)
                share += (part.sum() - share * len(part)) / max(1.0, fitted)
            met += np.count_nonzero(count == 0)
            lexicon.count[own] += np.bincount(words.which, minlength=len(own))
            seen += len(words.which)
        yield from (_no_model(x, _FOUND_ARROW) for x in lexicon.counted())
        trainer.settle()
        if trainer.tokens:
            used = np.flatnonzero(trainer.expected.any(axis=1))
            values = [None, None, TaskContext.get().partitionId(), float(trainer.tokens), fitted, share, _flat(trainer.w), used.astype("<i4").tobytes(), trainer.expected[used].astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    found = checkpoint(training.select("text").mapInArrow(tidy(learn), _FOUND))
    models = found.where("word is null").drop("word", "c")
    left = models.count()
    while left > 1:  # sums of sums, so none holds more than FAN_IN models
        left = -(-left // FAN_IN)
        models = checkpoint(models.withColumn("shard", F.floor(F.col("shard") / FAN_IN) if left > 1 else F.lit(0).cast("bigint")).groupBy("shard").applyInPandas(_together(size), models.schema))
        left = models.count()
    last = models.first()
    if last is None:
        model = Model(start.value[0], symbol_of, shares_of(np.zeros((size, MIXTURES))), 0.5)
    else:
        model = Model(_unflat(last["weights"]), symbol_of, shares_of(_expected(last["ids"], last["expected"], size)), float(np.clip(last["share"], 0.01, 0.99)))
    return found.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), model


def _flat(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def _unflat(raw: bytes) -> dict[str, np.ndarray]:
    return _views(np.frombuffer(raw, dtype="<f4").astype(np.float32))


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name that lie one behind another in flat, in the order of their names."""
    at, out = 0, {}
    for k in sorted(_SHAPES):
        size = int(np.prod(_SHAPES[k]))
        out[k] = flat[at : at + size].reshape(_SHAPES[k])
        at += size
    return out


def _expected(ids: bytes, values: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, MIXTURES))
    out[np.frombuffer(ids, dtype="<i4")] = np.frombuffer(values, dtype="<f4").reshape(-1, MIXTURES)
    return out


def _together(size: int):
    """One model from some: weights averaged by tokens, expected counts added."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        tokens = max(1e-9, pdf["n"].sum())
        weights = sum(np.frombuffer(w, dtype="<f4").astype(np.float64) * (n / tokens) for w, n in zip(pdf["weights"], pdf["n"], strict=True))
        total = sum(_expected(i, x, size) for i, x in zip(pdf["ids"], pdf["expected"], strict=True))
        used = np.flatnonzero(total.any(axis=1))
        words = pdf["words"].sum()
        share = (pdf["share"] * pdf["words"]).sum() / words if words else 0.5
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "n": [tokens], "words": [words], "share": [share], "weights": [weights.astype("<f4").tobytes()], "ids": [used.astype("<i4").tobytes()], "expected": [total[used].astype("<f4").tobytes()]})

    return join


def score(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score) per row of docs.

    Learns from rows whose crc32(doc_id as text) mod folds isn't fold. Tokens of the base: words, then one end. score is the
    log10 probability of the text by the mixture, attention_score by attention alone. Null and empty texts are the end
    alone; a row with a null id is in training; repeated rows count and are scored as often as they occur; an empty table
    gives no rows; other columns are ignored. A text of any length is scored whole, by one task. The attention weights
    depend on how the table is split into partitions; the columns of the base don't.
    """
    source = own_columns(docs, doc_id=id_col, text=text_col)
    spark = source.sparkSession
    out_of = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    marked = source.withColumn("held_out", out_of)
    training = marked.where(~F.col("held_out"))
    words, model = train(training, tokenizer)
    words = checkpoint(words)
    ends = training.count()
    sums = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (1 if ends else 0)
    floor = float(np.log10(total + distinct + 1))
    end_share = float(np.log10(ends + 1)) - floor
    top = words.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    key = uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast((model, dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head = shipped.value
        lexicon = Lexicon.of_worker(key, tokenizer, head)
        for part, words in _blocks(batches, 1):
            places, size, ids, lengths = lexicon.read(words)
            attention, end = word_sums(log_probs(own, ids, lengths), size, words.n, lengths)
            n_texts = part.num_rows
            owner = np.repeat(np.arange(n_texts), words.n)
            by_owner = lambda at, x, n=n_texts: np.bincount(owner[at], x, minlength=n)  # noqa: B023, E731
            count = lexicon.count[places]
            known = (count >= 0)[words.which]
            share = (np.log10(np.maximum(count, 0) + 1.0) - floor)[words.which[known]]
            base = by_owner(known, share) + end_share
            score_ = by_owner(known, mixed(share, attention[known], own.word_weight)) + mixed(np.full(n_texts, end_share), end, own.word_weight)
            alone = np.bincount(owner, attention, minlength=n_texts) + end
            n_known = np.bincount(owner[known], minlength=n_texts).astype(np.int64)
            rare = np.flatnonzero(~known)
            offsets = pa.array(np.searchsorted(owner[rare], np.arange(n_texts + 1)).astype(np.int32))
            names = words.different.take(pa.array(words.which[rare]))
            columns = [part.column(0), part.column(2), pa.array(words.n + 1), pa.array(n_known), pa.array(base), pa.array(score_), pa.array(alone), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(attention[rare].astype(np.float32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "attention_score", "tail", "tail_a"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = marked.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, attention_score double, tail array<binary>, tail_a array<float>")
    scored = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "tail_a")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_a").alias("a"))
    share = F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(floor)
    weight = model.word_weight
    mixture = F.log10(F.lit(weight) * F.pow(F.lit(10.0), "b") + F.lit(1 - weight) * F.pow(F.lit(10.0), F.col("a").cast("double")))
    met = rare.join(words, "word", "left").withColumn("b", share).groupBy("row").agg(F.count("c").alias("more"), F.sum("b").alias("more_base"), F.sum(mixture).alias("more_score"))
    joined = scored.drop("tail", "tail_a").join(met, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0)))
    return joined.select("doc_id", "held_out", "n_tokens", (plus("n_known", "more") + (1 if ends else 0)).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"), "attention_score")
