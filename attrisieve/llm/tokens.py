"""Token ids of whole texts by a public BPE with word ends, with a memo per white-space-free chunk."""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks a Python worker remembers at most, in two generations. Bounds memory only, never the result.
MEMO_CHUNKS = 600_000
#: Words sent to the merges in one string.
_RUN = 256

_SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: ASCII signs that may stand behind a word without changing its ids; not the apostrophe, which opens contractions.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))


def _memos() -> dict:
    """One memo per worker process and tokenizer file, kept between tasks."""
    import tokenizers

    return tokenizers.__dict__.setdefault("_attrisieve_memos", {})


class ChunkTokenizer:
    """Ids as little-endian uint32 bytes, equal to those of tokenizers' encode(text, add_special_tokens=False).

    Holds for files that lower-case, drop white space, mark word ends and never join two sides of white space: a text's ids
    are then those of its chunks between ASCII white space. Latin letters at the start of a chunk skip the normaliser, which
    leaves them as they are, and go to the merges among others, told apart by their word ends; ASCII signs behind them are
    a piece of their own; any other chunk takes the library's whole path. ``special`` False takes the strings of special
    tokens in a text for ordinary text, as the library does only when told to.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocab = self.whole.get_vocab()
        self.specials = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()] if special else []
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.memo, self.old = _memos().setdefault((path, special), ({}, {}))
        self.key = (path, special)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.stand_in = {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def chunks(self, text: bytes | None) -> list[bytes]:
        """A text's chunks, lower-cased; one that would only then hold a special token's string keeps its case."""
        text = text or b""
        low = text.lower()
        found = low.split()
        if self.specials and any(low.count(s.lower()) != text.count(s) for s in self.specials):
            changed = lambda raw, c: any(c.count(s.lower()) != raw.count(s) for s in self.specials)
            return [raw if changed(raw, c) else c for raw, c in zip(text.split(), found, strict=True)]
        return found

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _merge(self, words: list[bytes]) -> None:
        """Learn words of Latin letters."""
        runs = [words[k : k + _RUN] for k in range(0, len(words), _RUN)]
        shown = ["\n".join([w.decode() if w.isascii() else w.decode("latin-1").translate(self.stand_in) for w in run]) for run in runs]
        for run, found in zip(runs, self.merges.encode_batch_fast(shown, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            self.memo.update(zip(run, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _mark(self, signs: bytes) -> bytes:
        """Ids of ASCII signs behind a word; few are remembered, as there is no end to runs of signs."""
        known = self.marks.get(signs)
        if known is None:
            known = self._ids(self.whole.encode(signs.decode(), add_special_tokens=False).ids)
            if len(self.marks) < 10_000 and len(signs) < 64:
                self.marks[signs] = known
        return known

    def encode_flat(self, chunks: list[bytes], known: tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all of some chunks one behind another, ids of each chunk), without the memo.

        Chunks are lower-cased and without ASCII white space. ``known`` are the places of chunks whose ids are known already,
        ids, and where those of a place start and how many they are: a word with signs behind it takes the word's from there.
        """
        words: dict[bytes, int] = {}
        met, lent = ({} if known is None else known[0]), {}
        front, signs, other = np.full(len(chunks), -1, dtype=np.int64), {}, []
        for k, chunk in enumerate(chunks):
            word = chunk.rstrip(_SIGNS)
            if word.isalpha() or _SIMPLE(word.decode()):
                if len(word) < len(chunk):
                    signs[k] = self._mark(chunk[len(word) :])
                    if word in met:
                        front[k] = -1 - lent.setdefault(met[word], len(lent))
                        continue
                front[k] = words.setdefault(word, len(words))
            else:
                other.append(k)
        listed = list(words)
        runs = [listed[k : k + _RUN] for k in range(0, len(listed), _RUN)]
        shown = ["\n".join([w.decode() if w.isascii() else w.decode("latin-1").translate(self.stand_in) for w in run]) for run in runs]
        parts = [np.array(x.ids, dtype=np.int32) for x in self.merges.encode_batch_fast(shown, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        starts = np.r_[0, stops[:-1]] if len(stops) else stops
        # pieces: words, then signs, then other chunks, then known words; a chunk is one piece or a word and its signs
        tail = [self._ids(x.ids) for x in self.whole.encode_batch_fast([chunks[k].decode() for k in other], add_special_tokens=False)]
        tail = [*signs.values(), *tail]
        sizes = np.array([len(x) for x in tail], dtype=np.int64) // 4
        begin = np.r_[starts, len(ids) + np.cumsum(sizes) - sizes]
        size = np.r_[stops - starts, sizes]
        flat = np.concatenate([ids, np.frombuffer(b"".join(tail), dtype="<u4").astype(np.int32)])
        second = np.fromiter(signs, dtype=np.int64, count=len(signs))
        front[other] = len(listed) + len(second) + np.arange(len(other))
        if lent:
            front = np.where(front < 0, len(size) - 1 - front, front)
            place = np.fromiter(lent, dtype=np.int64, count=len(lent))
            sizes = known[3][place]
            before = np.cumsum(sizes) - sizes
            begin, size = np.r_[begin, len(flat) + before], np.r_[size, sizes]
            flat = np.concatenate([flat, known[1][np.repeat(known[2][place] - before, sizes) + np.arange(int(sizes.sum()))]])
        chunk_of = np.r_[np.arange(len(chunks)), second]
        piece = np.r_[front, len(listed) + np.arange(len(second))]
        order = np.argsort(chunk_of, kind="stable")
        piece = piece[order]
        n = size[piece]
        total = int(n.sum())
        out = flat[np.repeat(begin[piece] - (np.cumsum(n) - n), n) + np.arange(total)]
        return out, np.bincount(chunk_of[order], n, minlength=len(chunks)).astype(np.int64)

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.memo) + len(chunks) > MEMO_CHUNKS // 2:
            self.memo, self.old = {}, self.memo
            _memos()[self.key] = self.memo, self.old
        memo, old = self.memo, self.old
        words, marked, other = set(), [], []
        for chunk in chunks:
            if chunk in old:
                memo[chunk] = old[chunk]
                continue
            word = chunk.rstrip(_SIGNS)
            if word.isalpha() or _SIMPLE(word.decode()):
                if word not in memo:
                    words.add(word)
                if len(word) < len(chunk):
                    marked.append((chunk, word))
            else:
                other.append(chunk)
        self._merge(list(words))
        memo.update((chunk, memo[word] + self._mark(chunk[len(word) :])) for chunk, word in marked)
        texts = [c.decode() for c in other]
        memo.update((c, self._ids(e.ids)) for c, e in zip(other, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True))

    def encode_each(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct chunks, lower-cased and without ASCII white space; the memo stays as it is."""
        kept = self.memo, self.old
        self.memo, self.old = {}, {}
        out = []
        for at in range(0, len(chunks), MEMO_CHUNKS // 4):
            some = chunks[at : at + MEMO_CHUNKS // 4]
            self._learn(set(some))
            out += [self.memo[c] for c in some]
            self.memo, self.old = {}, {}
        self.memo, self.old = kept
        _memos()[self.key] = kept
        return out

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text."""
        return self._joined(self.chunks(text))

    def _joined(self, chunks: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.memo.__getitem__, chunks))
        except KeyError:
            wanted = set(chunks)
            self._learn(wanted.difference(self.memo))
            if len(wanted) <= MEMO_CHUNKS // 2 and not wanted.difference(self.memo):
                return b"".join(map(self.memo.__getitem__, chunks))
            half = len(chunks) // 2  # a swap of generations took some away, or they are too many for one
            if half:
                return self._joined(chunks[:half]) + self._joined(chunks[half:])
            self._learn(wanted)
            return b"".join(map(self.memo.__getitem__, chunks))

    def encode_many(self, texts: list[bytes | None], block: int = 64) -> list[bytes]:
        """Ids of each of some UTF-8 texts; what a block of them has new is learnt at once."""
        out: list[bytes] = []
        for at in range(0, len(texts), block):
            some = texts[at : at + block]
            split = [self.chunks(t) for t in some]
            if new := set().union(*split).difference(self.memo):
                self._learn(new)
            get = self.memo.__getitem__
            try:
                out += [b"".join(map(get, chunks)) for chunks in split]
            except KeyError:  # a swap of generations took some away
                out = out[:at] + [self.encode(t) for t in some]
        return out
