"""Operator 3: recovering chat turns from plain transcripts with a hidden Markov model.

States are a role at a turn's first line with a speaker marker, at one without, or at a later line. A line shows which kind
of marker it opens with, whether that marker is written as the transcript mostly writes it, how long the line is and whether
a blank line stands before it. Emissions and transitions are counted over labelled transcripts (one added to each). Viterbi
decoding finds the states; a marker is taken off in the marked state alone, so a turn's own opening words stay, and turns
are rendered in one canonical form with every line they had, blank ones too.

Rows are sorted by ranges, and each task cuts its stretch into blocks of turns, so neither a conversation nor the rows of one
turn number are ever gathered. Each block yields, for every state it may be entered in, the best path to every state it may
be left in. The tables of a conversation's blocks are folded per stretch and then over its stretches, of which there are no
more than partitions; that picks the states at the borders, and each block then finds its own path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_columns

ROLES = ("user", "assistant", "system")
STATES = tuple((role, opening) for role in ROLES for opening in ("marked", "bare", "later"))
#: Turns, and characters of them, that are decoded together; a longer turn is a block of its own.
BLOCK_TURNS, BLOCK_CHARS = 64, 1 << 20
#: Speaker words of each role, lower-cased (fixed values).
SPEAKERS = {
    "user": ("user", "human", "q", "question", "me", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "gpt"),
    "system": ("system", "sys", "instruction", "instructions", "context"),
}
_ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*\s*|<\|\s*|\[\s*|>\s*)?(" + "|".join(sorted(_ROLE_OF, key=lambda w: (-len(w), w))) + r")(?:\s*\|>|\s*\]|\s*\*\*)?\s*(?::|>|-(?=\s)|(?<=[|\]*]>)|(?<=\]))(?:\*\*)?[ \t]?", re.IGNORECASE)
MARKER_KINDS = ("none", *ROLES)
LENGTHS = 4
#: Kinds by whether the marker is written as usual, lengths, and a blank line before or not.
SYMBOLS = len(MARKER_KINDS) * 2 * LENGTHS * 2
#: Conversations with this remainder of crc32(id as text) are kept out of the fit.
FOLDS, HELD_OUT = 7, 2


def marker(line: str) -> tuple[str, str]:
    """(role a line's speaker marker names or 'none', the line without it and one blank after it)."""
    m = MARKER.match(line)
    return (_ROLE_OF[m[1].lower()], line[m.end() :]) if m else ("none", line)


def look(line: str, after_blank: bool) -> tuple[int, str]:
    """(symbol of a line whose marker isn't the usual one, its kind's number and the marker as written, '' without one)."""
    m = MARKER.match(line)
    kind = MARKER_KINDS.index(_ROLE_OF[m[1].lower()]) if m else 0
    length = min(LENGTHS - 1, (len(line) - (m.end() if m else 0)).bit_length() // 3)
    return (kind * 2 * LENGTHS + length) * 2 + bool(after_blank), f"{kind}{m[0].strip()}" if m else ""


def symbols(looks, forms, usual) -> np.ndarray:
    """What the model sees: looks with a place for markers written as usual. usual None: every marker is."""
    known = None if usual is None else set(usual)
    own = np.array([f != "" and (known is None or f in known) for f in forms], dtype=np.int64)
    return np.asarray(looks, dtype=np.int64) + own * LENGTHS * 2


class Model:
    """Log probabilities: start (states), move (states, states), show (states, symbols)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, show: np.ndarray):
        norm = lambda x: np.log((x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True))
        self.start, self.move, self.show = norm(start), norm(move), norm(show)
        kinds = np.arange(SYMBOLS) // (4 * LENGTHS)
        for i, (a, _) in enumerate(STATES):
            for j, (b, opening) in enumerate(STATES):
                if opening == "later" and a != b:
                    self.move[i, j] = -np.inf  # a later line belongs to the same speaker
        for k, (role, opening) in enumerate(STATES):
            if opening == "later":
                self.start[k] = -np.inf  # a transcript opens with the first line of a turn
            if opening == "marked":
                self.show[k, kinds != MARKER_KINDS.index(role)] = -np.inf  # a marker names the speaker

    def through(self, seen: np.ndarray) -> np.ndarray:
        """Best log probability from each state before the block to each at its end."""
        best = None
        for s in seen:
            step = self.move + self.show[:, s]
            best = step if best is None else (best[:, :, None] + step[None]).max(axis=1)
        return best

    def opening(self, seen: np.ndarray) -> np.ndarray:
        """Best log probability of each state at the end of a transcript's first block."""
        score = self.start + self.show[:, seen[0]]
        for s in seen[1:]:
            score = (score[:, None] + self.move).max(axis=0) + self.show[:, s]
        return score

    def path(self, seen: np.ndarray, before: int | None, last: int | None) -> list[int]:
        """Best states of a block entered from state before (None: it opens the transcript) and left in state last (None: any)."""
        score = self.start + self.show[:, seen[0]] if before is None else self.move[before] + self.show[:, seen[0]]
        back = []
        for s in seen[1:]:
            options = score[:, None] + self.move
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + self.show[:, s]
        states = [int(score.argmax()) if last is None else last]
        for pointer in reversed(back):
            states.append(int(pointer[states[-1]]))
        return states[::-1]


def transcript_turns(turns: DataFrame) -> DataFrame:
    """Labelled turns as pieces of plain transcripts: (conv_id, turn, tie, text, role, marked).

    A style chosen by conv_id fixes the speaker markers; every seventh turn of a transcript has none. tie orders rows that
    share a turn number.
    """
    own = own_columns(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    forms = {"user": ("User: ", "Human: ", "### User: ", "Q: ", "[user]: "), "assistant": ("Assistant: ", "AI: ", "### Assistant: ", "A: ", "[assistant]: "), "system": ("System: ", "System: ", "### System: ", "Context: ", "[system]: ")}
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5)).cast("int") + 1
    mark = F.lit("")
    for role, own_forms in forms.items():
        mark = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(x) for x in own_forms]), style)).otherwise(mark)
    mark = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0, "").otherwise(mark)
    return own.select("conv_id", "turn", F.xxhash64("text", "role").alias("tie"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"), "role", (mark != "").alias("marked"))


def blocks(pieces: DataFrame, block_turns: int = BLOCK_TURNS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(conv_id, block, rows): pieces in order of turn and tie, so many together; block numbers rise along a conversation.

    Sorting is by ranges of (conv_id, turn, tie, a draw), so repeated rows are split, too. block >> 32 is the partition. A row
    without a conversation is a block of its own.
    """
    order = ["conv_id", "turn", "tie", "_draw"]
    ranged = pieces.withColumn("_draw", F.rand(3)).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    row = f"struct<turn:{kinds['turn']},text:string,role:string,marked:boolean>"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, n = TaskContext.get().partitionId() << 32, 0
        held, owner, chars = [], None, 0
        for pdf in frames:
            ids, numbers, rows = [], [], []
            for conv_id, turn, text, role, marked in zip(pdf["conv_id"], pdf["turn"], pdf["text"], pdf["role"], pdf["marked"], strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if held and (conv_id is None or conv_id != owner or len(held) >= block_turns or chars + len(text) > block_chars):
                    ids.append(owner), numbers.append(base + n), rows.append(held)
                    held, chars, n = [], 0, n + 1
                owner = conv_id
                held.append({"turn": None if pd.isna(turn) else int(turn), "text": text, "role": role, "marked": bool(marked)})
                chars += len(text)
            yield pd.DataFrame({"conv_id": pd.Series(ids, dtype=object), "block": numbers, "rows": rows})
        if held:
            yield pd.DataFrame({"conv_id": pd.Series([owner], dtype=object), "block": [base + n], "rows": [held]})

    return ranged.select("conv_id", "turn", "text", "role", "marked").mapInPandas(cut, f"conv_id {kinds['conv_id']}, block bigint, rows array<{row}>")


def lines_of(rows) -> tuple[list[str], list[tuple[str, list[str], int, bool]]]:
    """(blank lines that open a block, (line, blank lines after it, piece, first of its piece that isn't blank) of the others)."""
    leading: list[str] = []
    out: list[tuple[str, list[str], int, bool]] = []
    for k, row in enumerate(rows):
        first = True
        for line in (row["text"] or "").split("\n"):
            if line.strip():
                out.append((line, [], k, first))
                first = False
            else:
                (out[-1][1] if out else leading).append(line)
    if not out:
        return [], [(leading[0], leading[1:], 0, True)]
    return leading, out


def lookings(cut: DataFrame) -> DataFrame:
    """(conv_id, block, looks, forms, labels, held_out, opening, n, usual) of blocks, without their texts.

    labels are states, -1 without a known role; opening is the conversation's first block, n how many it has, usual the form
    each kind of marker mostly has in the conversation, the earlier one of a tie.
    """
    kind = cut.schema["conv_id"].dataType.simpleString()

    def see(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for rows in pdf["rows"]:
                leading, lines = lines_of(rows)
                blank, seen, labels = bool(leading), [], []
                for line, tail, k, first in lines:
                    seen.append(look(line, blank))
                    role, blank = rows[k]["role"], bool(tail)
                    opening = "later" if not first else "marked" if rows[k]["marked"] and marker(line)[0] == role else "bare"
                    labels.append(STATES.index((role, opening)) if role in ROLES else -1)
                out.append(([x for x, _ in seen], [f for _, f in seen], labels))
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], **{name: [x[i] for x in out] for i, name in enumerate(("looks", "forms", "labels"))}})

    held = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    seen = checkpoint(cut.mapInPandas(see, f"conv_id {kind}, block bigint, looks array<int>, forms array<string>, labels array<int>").withColumn("held_out", held))
    named = seen.where("conv_id is not null")
    spread = named.groupBy("conv_id").agg(F.min("block").alias("opening"), F.count("*").alias("n"))
    written = named.select("conv_id", "block", F.explode("forms").alias("form")).where("form <> ''").groupBy("conv_id", "form").agg(F.count("*").alias("times"), F.min("block").alias("at"))
    most = written.groupBy("conv_id", F.substring("form", 1, 1).alias("kind")).agg(F.max_by("form", F.struct(F.col("times"), -F.col("at"), F.col("form"))).alias("form"))
    usual = most.groupBy("conv_id").agg(F.sort_array(F.collect_list("form")).alias("usual"))  # a form for each of three roles at most
    return checkpoint(seen.join(spread.join(usual, "conv_id", "left"), "conv_id", "left"))


def _opens(block, opening) -> bool:
    return pd.isna(opening) or block == opening


def fit(seen: DataFrame) -> Model:
    """Count starts, moves and emissions over all labelled blocks that aren't held out; the driver gets the sums alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(STATES) * (1 + len(STATES) + SYMBOLS))
        start, move, show = _views(total)
        for pdf in frames:
            for block, opening, looks, forms, usual, labels in zip(pdf["block"], pdf["opening"], pdf["looks"], pdf["forms"], pdf["usual"], pdf["labels"], strict=True):
                before = None
                for k, (state, shown) in enumerate(zip(labels, symbols(looks, forms, usual), strict=True)):
                    if state < 0:
                        before = None
                        continue
                    show[state, shown] += 1
                    if before is not None:
                        move[before, state] += 1
                    elif k == 0 and _opens(block, opening):
                        start[state] += 1
                    before = state
        used = np.flatnonzero(total)
        yield pd.DataFrame({"at": used, "n": total[used]})

    total = np.zeros(len(STATES) * (1 + len(STATES) + SYMBOLS))
    known = seen.where("not held_out").select("block", "opening", "looks", "forms", "usual", "labels")
    for row in known.mapInPandas(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["at"]] = row["n"]
    return Model(*_views(total))


def _views(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(STATES)
    return total[:n], total[n : n + n * n].reshape(n, n), total[n + n * n :].reshape(n, SYMBOLS)


def fold(tables: list[np.ndarray]) -> np.ndarray:
    """One table for a run of blocks; the first may hold the scores after a transcript's opening block instead."""
    best = tables[0]
    for table in tables[1:]:
        best = (best[..., :, None] + table).max(axis=-2)
    return best


def borders(tables: list[np.ndarray], before: int | None = None, last: int | None = None) -> list[int]:
    """Best state at the end of each block of a run that is entered from before (None: it opens the transcript)."""
    score, back = tables[0] if before is None else tables[0][before], []
    for table in tables[1:]:
        options = score[:, None] + table
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    states = [int(score.argmax()) if last is None else last]
    for pointer in reversed(back):
        states.append(int(pointer[states[-1]]))
    return states[::-1]


def _table(scores) -> np.ndarray:
    flat = np.asarray(scores, dtype=float)
    return flat if len(flat) == len(STATES) else flat.reshape(len(STATES), len(STATES))


def _limits(seen: DataFrame, model: Model, kind: str) -> DataFrame:
    """(block, before, last) of the blocks of conversations that have several."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            tables = []
            for block, opening, looks, forms, usual in zip(pdf["block"], pdf["opening"], pdf["looks"], pdf["forms"], pdf["usual"], strict=True):
                shown = symbols(looks, forms, usual)
                tables.append((model.opening(shown) if _opens(block, opening) else model.through(shown).ravel()).tolist())
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "scores": tables})

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            whole = [fold([_table(x["scores"]) for x in run]).ravel().tolist() for run in pdf["run"]]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "scores": whole})

    def joints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for conv_id, parts in zip(pdf["conv_id"], pdf["parts"], strict=True):
                ends = borders([_table(x["scores"]) for x in parts])
                yield pd.DataFrame({"conv_id": conv_id, "part": [x["part"] for x in parts], "before": [-1, *ends[:-1]], "last": ends})

    def inner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for run, before, last in zip(pdf["run"], pdf["before"], pdf["last"], strict=True):
                ends = borders([_table(x["scores"]) for x in run], None if before < 0 else int(before), int(last))
                yield pd.DataFrame({"block": [x["block"] for x in run], "before": [before, *ends[:-1]], "last": ends})

    several = seen.where("n > 1").select("conv_id", "block", "opening", "looks", "forms", "usual")
    scored = several.mapInPandas(score, f"conv_id {kind}, block bigint, scores array<double>").withColumn("part", F.shiftright("block", 32))
    runs = checkpoint(scored.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", "scores"))).alias("run")))  # blocks of one partition
    stretches = runs.mapInPandas(folded, f"conv_id {kind}, part bigint, scores array<double>")
    gathered = stretches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "scores"))).alias("parts"))  # one for each partition
    ends = gathered.mapInPandas(joints, f"conv_id {kind}, part bigint, before int, last int")
    return runs.join(ends, ["conv_id", "part"]).select("run", "before", "last").mapInPandas(inner, "block bigint, before int, last int")


def said(rows, before: int, states) -> list[list]:
    """[turn, role, continues, lines, source role] of a block's turns; before is the state the block is entered from, or -1."""
    leading, lines = lines_of(rows)
    out: list[list] = []

    def turn(piece: int, role: str, continues: bool) -> list:
        out.append([rows[piece]["turn"], role, continues, [], rows[piece]["role"]])
        return out[-1][3]

    if leading and before >= 0:
        turn(0, STATES[before][0], True).extend(leading)
    for k, ((line, tail, piece, _), state) in enumerate(zip(lines, states, strict=True)):
        role, opening = STATES[state]
        if opening != "later" or not out:
            words = turn(piece, role, opening == "later")
            if k == 0 and before < 0:
                words.extend(leading)
        out[-1][3].append(marker(line)[1] if opening == "marked" else line)
        out[-1][3].extend(tail)
    return out


def recover(cut: DataFrame, seen: DataFrame, model: Model) -> DataFrame:
    """(conv_id, block, seq, turn, role, continues, text, source_role, held_out) per recovered turn of blocks.

    text is the canonical rendering, the role on a line of its own before the words, which keep their blanks and blank lines.
    Only line feeds end a line. continues: the turn goes on from the block before. turn and source_role are those of the piece
    the turn's first line came from; held_out: the conversation wasn't fitted to. A row without a conversation is a transcript
    of its own, a null text is an empty turn, a null turn number comes first; repeated rows are turns of their own, rows of
    one turn number in an order fixed by their texts; a text of any length is one block; an empty table gives no rows. Blank
    lines at the start of a turn without a marker count to the turn before it.
    """
    kind = cut.schema["conv_id"].dataType.simpleString()
    turn_kind = cut.schema["rows"].dataType.elementType["turn"].dataType.simpleString()

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for looks, forms, usual, before, last in zip(pdf["looks"], pdf["forms"], pdf["usual"], pdf["before"], pdf["last"], strict=True):
                alone = pd.isna(last)
                found.append(model.path(symbols(looks, forms, usual), None if alone or before < 0 else int(before), None if alone else int(last)))
            yield pd.DataFrame({"block": pdf["block"], "held_out": pdf["held_out"], "before": pdf["before"].fillna(-1).astype(int), "states": found})

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "block", "seq", "turn", "role", "continues", "text", "source_role", "held_out"]
        for pdf in frames:
            out = []
            for conv_id, block, rows, before, path, held in zip(pdf["conv_id"], pdf["block"], pdf["rows"], pdf["before"], pdf["states"], pdf["held_out"], strict=True):
                for seq, (turn, role, continues, words, source) in enumerate(said(rows, before, path)):
                    out.append([None if pd.isna(conv_id) else conv_id, block, seq, turn, role, continues, f"<|{role}|>\n" + "\n".join(words), source, held])
            frame = pd.DataFrame({name: pd.Series([x[i] for x in out], dtype=object) for i, name in enumerate(names)})
            yield frame

    limits = _limits(seen, model, kind)
    ready = seen.select("block", "looks", "forms", "usual", "held_out").join(limits, "block", "left")
    found = ready.mapInPandas(states, "block bigint, held_out boolean, before int, states array<int>")
    return cut.join(found, "block").select("conv_id", "block", "rows", "before", "states", "held_out").mapInPandas(
        render, f"conv_id {kind}, block bigint, seq bigint, turn {turn_kind}, role string, continues boolean, text string, source_role string, held_out boolean"
    )


def format_conversations(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Render labelled turns as plain transcripts, fit the model to the conversations that aren't held out and recover all turns.

    Columns, nulls, ties, repeated rows, long texts and empty tables: see recover. Only conv_id, turn, role and text are read,
    so other columns of any name do no harm. Where every conversation is held out the model is the uniform one.
    """
    cut = checkpoint(blocks(transcript_turns(turns), block_turns))
    seen = lookings(cut)
    return recover(cut, seen, fit(seen))
