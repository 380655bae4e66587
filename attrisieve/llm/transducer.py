"""A subword tokenizer as a deterministic transducer whose transitions carry token counts, and its chunk state maps.

Greedy pair merging leaves a sequence of tokens t1..tk exactly where no neighbours, merged alone, come out otherwise than
as they went in: the first merge across a border would be the best one among its two tokens as well. So each prefix of a
text has one last token, the token that ends there and stands behind the last token of what is before it, and all a prefix
has to remember are the starts from which a longer token may still come: how far that token has got, the last token in
front of it, and how many tokens that start is behind the prefix. These are the states; reading a character leads to one
other state and changes the count of tokens by the number on the transition (below one where tokens fuse). Characters
without a token are their UTF-8 bytes and forget everything.

States are built when a text first leads to them and numbered as they come, transitions live in a hash table of arrays, and
chunks of text walk side by side, one character of each at a time. Where a chunk begins in the middle of a text its state
isn't known: it is guessed by reading a few characters more, and a chunk's map tells for each state it may begin in the
state it ends in and the tokens counted. States that turn out to be missing from a map are added until none is; then maps
compose by a prefix scan.
"""

from __future__ import annotations

import json

import numpy as np

#: Characters of a chunk, and characters in front of it that are read to guess the state it begins in.
CHUNK = 256
LOOK_BACK = 24
#: States a worker keeps before it begins anew. Bounds memory only, never the result.
MAX_STATES = 300_000
#: Characters that walk side by side at most.
_RUN = 1 << 20
_CLASSES = 1 << 16
_FREE = -1


class _Node:
    """A prefix of tokens; token: whether it is one itself."""

    __slots__ = ("next", "text", "token")

    def __init__(self, text: str):
        self.next: dict[str, _Node] = {}
        self.text = text
        self.token = False


class _Table:
    """int64 keys to int64 values, by open addressing over arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, _FREE, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, where there is none)."""
        slot = self._slots(keys)
        seen = self.keys[slot]
        off = np.flatnonzero(seen != keys)
        while len(off):
            off = off[seen[off] != _FREE]
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            seen[off] = self.keys[slot[off]]
            off = off[seen[off] != keys[off]]
        return self.values[slot], np.flatnonzero(seen == _FREE)

    def put(self, key: int, value: int) -> None:
        if self.used * 3 > 1 << self.bits:
            kept = self.keys != _FREE
            keys, values = self.keys[kept], self.values[kept]
            self.__init__(self.bits + 1)
            for k, v in zip(keys.tolist(), values.tolist(), strict=True):
                self._put(k, v)
            self.used = len(keys)
        self._put(key, value)
        self.used += 1

    def _put(self, key: int, value: int) -> None:
        slot, last = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - self.bits), (1 << self.bits) - 1
        while self.keys[slot] != _FREE:
            slot = (slot + 1) & last
        self.keys[slot], self.values[slot] = key, value


class Transducer:
    """Token counts of a sentencepiece model that merges pairs and falls back on bytes.

    Only models that leave texts as they are but for a space put in front, and that know nothing of special pieces inside
    texts, are taken; any other raises ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, how = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix and rules.escape_whitespaces
        if how.model_type != how.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix or not plain:
            raise ValueError("not a merging model with byte fallback that keeps texts as they are")
        kinds = model.SentencePiece.Type
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't taken")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        letters = sorted({c for p in self.score for c in p})
        if not all(c in self.score for c in letters) or len(letters) + 4 > _CLASSES:
            raise ValueError("a character inside of a piece is no piece")
        #: Whether no token goes on over a space behind something else, so that a space there begins anew.
        self.spaces_begin = not any(a != "▁" and b == "▁" for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.letters = ["", "", "", "", *letters]
        self.class_of = np.zeros(0x110000, dtype=np.uint16)  # unknown characters by their bytes, 1 to 4
        for size, least in ((1, 0x80), (2, 0x800), (3, 0x10000)):
            self.class_of[least:] = size
        self.class_of[[ord(c) for c in letters]] = 4 + np.arange(len(letters))
        self.class_of[ord(" ")] = self.class_of[ord("▁")]
        self.root = _Node("")
        for piece in self.score:
            node = self.root
            for c in piece:
                node = node.next.setdefault(c, _Node(node.text + c))
            node.token = True
        self._begin()

    @classmethod
    def of_worker(cls, path: str) -> Transducer:
        """The one of this worker process, kept between tasks with the states it has built."""
        import sentencepiece

        kept = sentencepiece.__dict__.setdefault("_attrisieve_transducers", {})
        if path not in kept:
            kept[path] = cls(path)
        if len(kept[path].states) > MAX_STATES:
            kept[path]._begin()
        return kept[path]

    def _begin(self) -> None:
        self.states, self.number, self.stays = [], {}, {}
        self.table = _Table()
        self.opening = self._numbered(((self.root, "", 0),))  # nothing read, or nothing that matters
        self.first, _ = self._step(self.opening, int(self.class_of[ord(" ")]))

    def _numbered(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def merged(self, text: str) -> list[str]:
        """The tokens of a text's characters by greedy merging: the best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay(self, left: str, right: str) -> bool:
        """Whether two tokens side by side stay what they are."""
        found = self.stays.get((left, right))
        if found is None:
            wanted = [left, right] if left else [right]
            found = self.stays[left, right] = (self.spaces_begin and left[-1:] not in ("", "▁") and right[0] == "▁" and self._stay("", right)) or self.merged(left + right) == wanted
        return found

    def _step(self, state: int, kind: int) -> tuple[int, int]:
        """(state, change of the count) behind a character."""
        if kind < 4:
            return self.opening, kind + 1
        letter, token, more, going = self.letters[kind], None, 0, []
        live = self.states[state]
        if letter == "▁" and self.spaces_begin and live[-1][1][-1:] not in ("", "▁"):
            live = ((self.root, "", 0),)
        for node, before, behind in live:
            node = node.next.get(letter)
            if node is not None:
                if token is None and node.token and self._stay(before, node.text):
                    token, more = node.text, behind + 1
                if node.next:
                    going.append((node, before, behind))
        new = (*[(node, before, behind - more) for node, before, behind in going], (self.root, token, 0))
        return self._numbered(new), more

    def _walk(self, state: np.ndarray, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, note: np.ndarray) -> tuple[np.ndarray, ...]:
        """(state at the end, count, state and count after ``note`` characters) of each lane; lanes are spans of classes."""
        order = np.argsort(-length, kind="stable")
        at, left = begin[order], np.sort(length)[::-1]
        now, count = state[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        marks = note[order]
        noted, counted = now.copy(), count.copy()
        lanes = len(order)
        for k in range(int(left[0]) if lanes else 0):
            if k:
                here = marks == k
                noted[here], counted[here] = now[here], count[here]
            while left[lanes - 1] <= k:
                lanes -= 1
            keys = now[:lanes] * _CLASSES + classes[at[:lanes] + k]
            found, missing = self.table.get(keys)
            if len(missing):
                for key in np.unique(keys[missing]).tolist():
                    to, change = self._step(key // _CLASSES, key % _CLASSES)
                    self.table.put(key, (to << 8) + change + 128)
                found, _ = self.table.get(keys)
            now[:lanes] = found >> 8
            count[:lanes] += (found & 255) - 128
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return now[back], count[back], noted[back], counted[back]

    def maps(self, classes: np.ndarray, cuts: np.ndarray, starts: list[int | None], skip: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """The state map of each text: {state it begins in: (state it ends in, tokens)}.

        Text k is classes[cuts[k]:cuts[k+1]]; it begins in starts[k], or, where that is None, in a state guessed from its
        first skip[k] characters, which are in front of it and not counted.
        """
        size = np.diff(cuts) - skip
        chunks = np.maximum(1, -(-size // CHUNK))
        text = np.repeat(np.arange(len(size)), chunks)
        first = np.cumsum(chunks) - chunks
        nth = np.arange(len(text)) - first[text]
        begin = cuts[:-1][text] + skip[text] + nth * CHUNK
        length = np.minimum(CHUNK, size[text] - nth * CHUNK)
        back = np.where(nth > 0, LOOK_BACK, np.where([s is None for s in starts], skip, 0)[text]) if len(text) else np.zeros(0, dtype=np.int64)
        state = np.array([self.opening if s is None else s for s in starts], dtype=np.int64)[text]
        state[nth > 0] = self.opening
        end, count, noted, counted = self._walk(state, classes, begin - back, length + back, back)
        short = length <= 0  # nothing but what is in front of it
        noted[short], counted[short] = end[short], count[short]
        start = np.where(back > 0, noted, state)
        domain, image, tokens = start[:, None], end[:, None], (count - counted)[:, None]
        while True:  # an end that the next chunk doesn't know as a beginning is walked from
            inner = np.flatnonzero(nth > 0)
            new = [(k, s) for k, s in zip(*self._unknown(domain, image, inner), strict=True)]
            if not new:
                break
            lane = np.array([k for k, _ in new])
            more = np.array([s for _, s in new], dtype=np.int64)
            end, count, _, _ = self._walk(more, classes, begin[lane], length[lane], np.zeros(len(lane), dtype=np.int64))
            place = np.arange(len(lane)) - np.r_[0, np.cumsum(np.unique(lane, return_counts=True)[1])[:-1]].repeat(np.unique(lane, return_counts=True)[1])
            wide = [np.full((len(domain), int(place.max()) + 1), fill, dtype=np.int64) for fill in (_FREE, _FREE, 0)]
            for table, column in zip(wide, (more, end, count), strict=True):
                table[lane, place] = column
            domain, image, tokens = (np.c_[a, b] for a, b in zip((domain, image, tokens), wide, strict=True))
        image, tokens = compose(domain, image, tokens, nth)
        last = first + chunks - 1
        return [{int(domain[a, 0]): (int(image[b, 0]), int(tokens[b, 0]))} for a, b in zip(first, last, strict=True)]

    @staticmethod
    def _unknown(domain: np.ndarray, image: np.ndarray, inner: np.ndarray) -> tuple[list[int], list[int]]:
        """(chunk, state) for the ends of its predecessor that a chunk's map lacks, in order of chunks."""
        if not len(inner):
            return [], []
        ends = image[inner - 1]
        known = (ends[:, :, None] == domain[inner][:, None, :]).any(axis=2) | (ends == _FREE)
        at, column = np.nonzero(~known)
        found = np.unique(np.c_[inner[at], ends[at, column]], axis=0)
        return found[:, 0].tolist(), found[:, 1].tolist()

    def classes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(character classes of UTF-8 texts one behind another, where each begins and the last one ends)."""
        decoded = [t.decode("utf-8", "replace") for t in texts]
        cuts = np.r_[0, np.cumsum([len(t) for t in decoded], dtype=np.int64)].astype(np.int64)
        return self.class_of[np.frombuffer("".join(decoded).encode("utf-32-le"), dtype="<u4")], cuts

    def forgets(self, classes: np.ndarray) -> bool:
        """Whether some characters lead to the same state whatever was before them."""
        space = classes == self.class_of[ord(" ")]
        return bool((classes < 4).any() or (self.spaces_begin and (space[1:] & ~space[:-1]).any()))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each of some UTF-8 texts."""
        out = []
        for some in together(texts):
            classes, cuts = self.classes(some)
            found = self.maps(classes, cuts, [self.first] * len(some), np.zeros(len(some), dtype=np.int64))
            out += [m[self.first][1] + 1 if t else 0 for m, t in zip(found, some, strict=True)]  # one for the space in front
        return np.array(out, dtype=np.int64)

    def named(self, state: int) -> str:
        """A state in a form that other workers read."""
        return json.dumps([[node.text, before, behind] for node, before, behind in self.states[state]], ensure_ascii=False)

    def state(self, name: str) -> int:
        """The number a state has in this worker."""
        live = []
        for text, before, behind in json.loads(name):
            node = self.root
            for c in text:
                node = node.next[c]
            live.append((node, before, behind))
        return self._numbered(tuple(live))


def compose(domain: np.ndarray, image: np.ndarray, tokens: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of all chunks of a text up to each chunk, as (image, tokens) over the domain of the text's first chunk.

    Chunk k takes domain[k, d] to image[k, d] with so many tokens; nth is its place in its text. Each round joins maps over
    twice as many chunks.
    """
    spots = np.arange(len(nth))
    # d of a chunk's image within the domain of the next one
    index = np.zeros_like(image)
    inner = np.flatnonzero(nth > 0)
    index[inner - 1] = (image[inner - 1][:, :, None] == domain[inner][:, None, :]).argmax(axis=2)
    image, tokens, reach = image.copy(), tokens.copy(), 1
    while reach <= (nth.max() if len(nth) else 0):
        later = spots[nth >= reach]
        via = index[later - reach]
        rows = later[:, None]
        index_new, image_new, tokens_new = index[rows, via], image[rows, via], tokens[later - reach] + tokens[rows, via]
        index[later], image[later], tokens[later] = index_new, image_new, tokens_new
        reach *= 2
    return image, tokens


def together(texts: list[bytes]) -> list[list[bytes]]:
    """Texts in lists of at most _RUN bytes or a single text."""
    out, size = [], 0
    for t in texts:
        if not out or size + len(t) > _RUN:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out
