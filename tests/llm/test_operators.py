"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attrisieve.llm import arc, bktree, chat, components, decontaminate, licences, lm, mih, nearcopies, packing, registry, simhash, tokens, toxicity, urlrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path()


# ---- components and trees


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(3)
    n = 60
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30)], "random": [(draw.randrange(n), draw.randrange(n)) for _ in range(40)], "none": []}[shape]
    df = spark.createDataFrame(edges + edges[:2] + [(None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    want = union_find(n, edges)
    assert got == {x: want[x] for x in {y for a, b in edges if a != b for y in (a, b)}}


def test_bk_forest_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(12)]))
    shard = np.sort(rng.integers(0, 3, len(codes)))
    found = set()
    for probe, node in bktree.Forest(shard, codes).search(shard, codes, 3):
        found |= set(zip(probe.tolist(), node.tolist()))
    assert found == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if shard[i] == shard[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}


# ---- 1 decontamination


def test_decontamination_with_odd_rows(spark):
    """Repeated rows, null ids and texts, empty tables, clashing columns, and an opening that many items share."""
    opening = "which of the following is the best description of"
    items = spark.createDataFrame([(k, f"{opening} thing{k} and nothing{k} else{k} at all{k}", "x") for k in range(50)] + [(None, None, "x"), (99, " ", "x")], "item_id long, text string, share string")
    rows = [(1, f"so {opening} thing7 and nothing7 else7 at all7 there"), (1, f"so {opening} thing7 and nothing7 else7 at all7 there"), (None, f"{opening} thing3 and nothing3 else3 at all3"), (2, None), (3, opening), (4, "")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, covered double")
    own = lambda r: (str(r["doc_id"]), r["item_id"])
    got = [own(r) for r in decontaminate.contaminated(docs, items, min_share=0.8).collect()]
    assert sorted(got) == sorted([("1", 7), ("1", 7), ("None", 3)])
    kept = decontaminate.clean(docs, items, min_share=0.8)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def slow_tiles(a, b, least):
    fa, fb, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best, matches = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, matches = k, [(i, j)]
                elif k == best:
                    matches.append((i, j))
        if not matches:
            return out
        for i, j in matches:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                out.append((i, j, best))
                fa[i : i + best], fb[j : j + best] = [False] * best, [False] * best


def test_tiles_equal_the_definition():
    draw = random.Random(0)
    for _ in range(400):
        top = draw.choice([1, 2, 8])
        a, b = ([draw.randint(-1 if draw.random() < 0.1 else 0, top) for _ in range(draw.randint(0, 22))] for _ in range(2))
        least = draw.randint(1, 4)
        assert decontaminate.tiles(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), least) == slow_tiles(a, b, least)


def test_words_are_what_the_pattern_finds():
    draw = random.Random(4)
    for _ in range(500):
        t = "".join(draw.choice("aB_1 .,-\n\x00éÉßÑ\u2014\u201c\xa0日İ½²") for _ in range(draw.randint(0, 20)))
        assert decontaminate.words(t) == [w.encode() for w in re.findall(r"\w+", t.lower())]


def test_contamination(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank today"
    w = item.split()
    texts = [f"intro {item.upper()}! end", "x " + " ".join(w[8:]) + " y z " + " ".join(w[:8]), " ".join(w[:5]), "nothing here", None, "", item + " " + item, "hi", "say hi there", "filler " * 5000 + item]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, "hi there"), (3, None), (4, "")], "item_id long, text string")
    want = {(0, 1): 1, (1, 1): 2, (6, 1): 1, (8, 2): 1, (9, 1): 1}
    for block in (decontaminate.BLOCK_TOKENS, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", block)
        got = decontaminate.contaminated(docs, bench).collect()
        assert {(r["doc_id"], r["item_id"]): r["tiles"] for r in got} == want and all(r["share"] >= 0.5 for r in got)
        assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 4, 5, 7]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_against_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in registry.op1_greedy_tiling(spark, sf).collect()}
    want = set()
    for d in docs.collect():
        text = decontaminate.words(d["text"])
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for b in bench:
            item = decontaminate.words(b["text"])
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                ids = {x: k for k, x in enumerate(set(item))}
                covered = sum(x[2] for x in slow_tiles([ids[x] for x in item], [ids.get(x, -1) for x in text], 5))
                if covered >= 0.5 * len(item):
                    want.add((d["doc_id"], b["item_id"], covered))
    assert got == want and want


# ---- 2 language model


def random_model(rng, size=700):
    w = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float64) for k, v in lm.fresh_weights().items()}
    shares = rng.random((size, lm.MIXTURES))
    return lm.Model(w, lm.symbols(rng.integers(0, 99, size).astype(float)), shares / shares.sum(axis=0), 0.4)


def slow_log_prob(model, before, wanted):
    """log10 p(wanted | ids before, seen through the window that scores it), position by position."""
    w, t = model.weights, len(before)
    line = [lm.START, *(int(model.symbol_of[x]) for x in before)]
    line = line[max(0, t - t % lm.STRIDE - lm.CONTEXT) :]  # what its window holds up to it
    e = [w["embed"][x] for x in line]
    q = e[-1] @ w["query"]
    far = [len(line) - 1 - j for j in range(len(line))]
    heat = np.exp([q @ (x @ w["key"]) / lm.DIM**0.5 + w["distance"][d] for x, d in zip(e, far)])
    heard = sum(h * (x @ w["value"]) for h, x in zip(heat / heat.sum(), e))
    hidden = np.maximum(e[-1] @ w["hidden"] + heard @ w["mix"], 0) + e[-1]
    gates = np.exp(hidden @ w["out"] + w["bias"])
    return math.log10(gates / gates.sum() @ model.shares[wanted])


def test_attention_scores_equal_the_definition():
    rng = np.random.default_rng(0)
    model = random_model(rng)
    docs = [rng.integers(0, 700, n).astype(np.int32) for n in (1, 2, lm.STRIDE, lm.STRIDE + 1, 61, 3)]
    got = lm.log_probs(model, np.concatenate(docs), np.array([len(d) for d in docs]))
    want = [slow_log_prob(model, d[:k], d[k]) for d in docs for k in range(len(d))]
    assert np.abs(got - want).max() < 1e-4


def test_probabilities_of_all_ids_add_up_to_one():
    model = random_model(np.random.default_rng(3), 50)
    assert math.isclose(sum(10 ** slow_log_prob(model, [4, 7, 7], x) for x in range(50)), 1)


def test_gradients():
    rng = np.random.default_rng(0)
    model = random_model(rng)
    w = model.weights
    seen, target = lm.lay_windows(rng.integers(0, 700, 61).astype(np.int32), np.array([1, 30, 13, 17]), model.symbol_of)

    def loss():
        p = (lm.forward(w, seen)["gates"] * model.shares[target.ravel()]).sum(axis=1)
        return -np.log(p[target.ravel() >= 0]).mean()

    slopes, blame, _ = lm.gradients(w, model.shares, seen, target)
    assert np.allclose(blame.sum(axis=1), target.ravel() >= 0)
    for name, value in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape) if name != "embed" else (int(seen[0, lm.CONTEXT]), int(rng.integers(0, lm.DIM)))
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 1e-4


def test_attention_looks_back_only():
    w = lm.fresh_weights()
    a = np.arange(lm.WINDOW)[None, :] % lm.SYMBOLS
    b = a.copy()
    b[0, -1] = 5
    assert np.array_equal(lm.forward(w, a)["gates"][:-1], lm.forward(w, b)["gates"][:-1])


@pytest.fixture(scope="module")
def scored(spark, sf):
    return {r["doc_id"]: r for r in registry.op2_causal_attention(spark, sf).collect()}


def test_base_scores(spark, sf, scored):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    count, ends = Counter(), 0
    for d, words in docs.items():
        if not out[d]:
            count.update(words)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    assert set(scored) == set(docs)
    for d, words in docs.items():
        r = scored[d]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in words) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(words) + 1, sum(count[x] > 0 for x in words) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_model_score_beats_base_on_held_out(scored):
    out = [r for r in scored.values() if r["held_out"]]
    tokens_ = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] - r["base_score"] for r in out) / tokens_ > 0


def test_attention_alone_learns(scored):
    out = [r for r in scored.values() if r["held_out"]]
    assert sum(r["attention_score"] for r in out) / sum(r["n_tokens"] for r in out) > -5.2  # ids by their frequencies alone: below -6


def test_scores_follow_from_the_model(spark, path):
    texts = [" ".join(f"w{(k * j) % 11}" for k in range(1, 40)) for j in range(1, 9)] + [None, "two words"]
    docs = docs_of(spark, texts)
    training = docs.where(~(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2))
    words, model = lm.train(training, path)
    count = {bytes(r["word"]): r["c"] for r in words.collect()}
    kept = [t or "" for i, t in enumerate(texts) if not lm.held_out(i)]
    assert count == Counter(w for t in kept for w in t.encode().split()) and 0 < model.word_weight < 1
    encoder = tokens.ChunkTokenizer(path)
    total = sum(count.values()) + len(kept) + len(count) + 2
    got = {r["doc_id"]: r for r in lm.score(docs, path).collect()}
    for i, t in enumerate(texts):
        ids, want = [], 0.0
        for word in [*(t or "").encode().split(), None]:
            own = [lm.END_ID] if word is None else np.frombuffer(encoder.encode(word), dtype="<u4").tolist()
            alone = 0.0
            for x in own:
                alone += slow_log_prob(model, ids, x)
                ids.append(x)
            c = len(kept) if word is None else count.get(word, 0)
            want += math.log10(model.word_weight * (c + 1) / total + (1 - model.word_weight) * 10**alone)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-3)


def test_training_takes_every_token_once(spark, path):
    texts = [None, "", "a", *[" ".join(f"w{k % 7}" for k in range(n)) for n in (5, 11, 12, 13, 40, 700)], *["same words in a copy"] * 3]
    _, model = lm.train(docs_of(spark, texts).repartition(3), path)
    encoder = tokens.ChunkTokenizer(path)
    ids = np.concatenate([np.r_[np.frombuffer(encoder.encode((t or "").encode()), dtype="<u4"), lm.END_ID] for t in texts])
    weights, expected, symbol_of = lm.warm_start(ids[:50].astype(np.int32), np.array([50]), len(encoder.ends))
    trainer = lm.Trainer(weights, expected, lambda t: 0.01)
    trainer.learn(ids.astype(np.int32), np.array([len(ids)]), symbol_of)
    trainer.settle()
    assert np.allclose(trainer.expected.sum(axis=1), np.bincount(ids, minlength=len(encoder.ends)), atol=1e-2)
    assert np.allclose(model.shares.sum(axis=0, dtype=float), 1, atol=1e-4)


def test_equal_texts_score_equal_wherever_they_stand():
    rng = np.random.default_rng(8)
    model = random_model(rng)
    model = lm.Model({k: v.astype(np.float32) for k, v in model.weights.items()}, model.symbol_of, model.shares.astype(np.float32), 0.4)
    text = rng.integers(0, 700, 45).astype(np.int32)
    docs = [x for k in range(1, 40) for x in (text, rng.integers(0, 700, k * 7).astype(np.int32))]
    lengths = np.array([len(x) for x in docs])
    found = np.split(lm.log_probs(model, np.concatenate(docs), lengths), np.cumsum(lengths)[:-1])
    assert all(np.array_equal(found[0], x) for x in found[::2])


def test_scoring_looks_up_what_training_works_out():
    model = random_model(np.random.default_rng(9))
    seen, target = lm.lay_windows(np.arange(300, dtype=np.int32), np.array([1, 99, 200]), model.symbol_of)
    of = lm.by_symbol(model.weights)
    near = lm.nearness(model.weights, of)
    there = target.ravel() >= 0
    assert np.allclose(lm.heats(model.weights, seen, of, near)["g"][there], lm.heats(model.weights, seen, of)["g"][there])
    model.weights["distance"][0] = 50.0
    assert lm.nearness(model.weights, of) is None


def test_words_are_split_and_lowered_by_bytes():
    draw = random.Random(6)
    for _ in range(300):
        texts = ["".join(draw.choice("aBÉ \t\n\r\x0b\x0c\x1c\x85\xa0\u3000x,") for _ in range(draw.randint(0, 12))) for _ in range(3)] + [None]
        found = lm.words_of(pa.array(texts, pa.string()))
        want = [(t or "").encode().lower().split() for t in texts]
        listed = found.different.to_pylist()
        assert len(set(listed)) == len(listed) and found.n.tolist() == [len(w) for w in want]
        assert [listed[k] for k in found.which] == [w for words in want for w in words]


def test_ids_of_words_stay_from_pass_to_pass(path, monkeypatch):
    encoder, draw = tokens.ChunkTokenizer(path), random.Random(7)
    texts = [" ".join("".join(draw.choice("abcéß") for _ in range(draw.randint(1, 3))) + draw.choice(["", "", ",", "!?", "'s", "9"]) for _ in range(n)) for n in (0, 1, 70, 90)]
    lexicon = lm.Lexicon.of_worker("training", path)
    for some in (texts[:3], texts):  # words met before lend their ids to the same ones with signs behind them
        _, _, ids, lengths = lexicon.read(lm.words_of(pa.array(some)))
        want = [np.r_[np.frombuffer(encoder.encode(t.encode()), dtype="<u4"), lm.END_ID] for t in some]
        assert np.array_equal(ids, np.concatenate(want)) and lengths.tolist() == [len(x) for x in want]
    monkeypatch.setattr(tokens.ChunkTokenizer, "encode_flat", None)  # nothing is encoded a second time
    words = lm.words_of(pa.array(texts))
    head = {w: k for k, w in enumerate(words.different.to_pylist()[::2])}
    again = lm.Lexicon.of_worker("scoring", path, head)
    own, _, now, _ = again.read(words)
    assert np.array_equal(now, ids) and again.count[own].tolist() == [head.get(w, -1) for w in words.different.to_pylist()]


def test_a_step_adds_what_each_mixture_answers_for():
    rng = np.random.default_rng(5)
    model = random_model(rng)
    weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    ids = rng.integers(0, 700, 900).astype(np.int32)
    seen, target = lm.lay_windows(ids, np.array([1, 40, 859]), model.symbol_of)
    trainer = lm.Trainer(weights, model.shares.astype(np.float32) * 1000, lambda t: 0.0)
    _, blame, _ = lm.gradients(weights, trainer.shares, seen, target)
    trainer.step(seen, target)
    assert not trainer.expected.any()  # shares stand until they are looked at
    trainer.settle()
    want = np.zeros(model.shares.shape)
    np.add.at(want, target.ravel()[target.ravel() >= 0], blame[target.ravel() >= 0])
    assert np.allclose(trainer.expected, want, atol=1e-4) and np.allclose(trainer.shares.sum(axis=0, dtype=float), 1, atol=1e-4)


def test_lm_edges(spark, path, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 2)  # all but two words take the joined way
    docs = docs_of(spark, [None, "", "a b a", "a b a", "Ünï \U0001f389 a", "word " * 3000], [1, 2, 3, 3, None, 6])
    got = lm.score(docs, path).collect()
    assert len(got) == 6 and sum(r["n_tokens"] == 1 for r in got) == 2
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert same[0] == same[1]
    assert lm.score(docs.limit(0), path).count() == 0


# ---- 3 chat


def test_markers():
    for line, want in [("User: hi", ("user", "hi")), ("### Assistant: yo", ("assistant", "yo")), ("[system]: x", ("system", "x")), ("Q: why", ("user", "why")), ("a word", ("none", "a word")), ("Users: x", ("none", "Users: x")), ("ai > ok", ("assistant", "ok"))]:
        assert chat.marker(line) == want


def held_out(conv_id):
    return conv_id is not None and zlib.crc32(str(conv_id).encode()) % 7 == 2


def test_roles_recovered_of_conversations_not_fitted_to(spark, sf):
    got = chat.format_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    assert all(r["held_out"] == held_out(r["conv_id"]) for r in got)
    kept = [r for r in got if r["held_out"]]
    assert kept and sum(r["role"] == r["source_role"] for r in kept) / len(kept) > 0.9
    assert all(r["text"].startswith(f"<|{r['role']}|>\n") for r in got)


def random_chat_model(rng):
    n = len(chat.STATES)
    return chat.Model(rng.integers(0, 9, n).astype(float), rng.integers(0, 9, (n, n)).astype(float), rng.integers(0, 9, (n, chat.SYMBOLS)).astype(float))


def score_of(model, states, seen):
    total = model.start[states[0]] + model.show[states[0], seen[0]]
    return total + sum(model.move[a, b] + model.show[b, s] for a, b, s in zip(states, states[1:], seen[1:]))


def test_viterbi_against_every_path():
    rng = np.random.default_rng(5)
    for _ in range(8):
        model, seen = random_chat_model(rng), rng.integers(0, chat.SYMBOLS, 4)
        best = max(score_of(model, x, seen) for x in itertools.product(range(len(chat.STATES)), repeat=4))
        assert score_of(model, model.path(seen, None, None), seen) == pytest.approx(best)


def test_blocks_decode_like_one_piece():
    rng = np.random.default_rng(1)
    model, seen = random_chat_model(rng), rng.integers(0, chat.SYMBOLS, 40)
    cut = [seen[:13], seen[13:14], seen[14:30], seen[30:]]
    tables = [model.opening(cut[0]), *[model.through(c) for c in cut[1:]]]
    ends = chat.borders(tables)
    parts = [model.path(c, None if k == 0 else ends[k - 1], ends[k]) for k, c in enumerate(cut)]
    assert sum(parts, []) == model.path(seen, None, None)
    joints = chat.borders([chat.fold(tables[:2]), chat.fold(tables[2:])])
    assert ends == chat.borders(tables[:2], None, joints[0]) + chat.borders(tables[2:], joints[0], joints[1])


def plain_chat(rows):
    """Every conversation decoded in one piece, in plain Python, with the model counted over whole conversations' blocks of one."""
    found = []
    for conv in rows:
        leading, lines = chat.lines_of(conv)
        seen, blank = [], bool(leading)
        for line, tail, _, _ in lines:
            seen.append(chat.look(line, blank))
            blank = bool(tail)
        counts = {}
        for k, (_, form) in enumerate(seen):
            if form:
                times, at = counts.get(form, (0, k))
                counts[form] = (times + 1, at)
        usual = [max((f for f in counts if f[0] == kind), key=lambda f: (counts[f][0], -counts[f][1], f)) for kind in {f[0] for f in counts}]
        found.append((conv, chat.symbols([x for x, _ in seen], [f for _, f in seen], usual)))
    return found


def test_query_like_whole_conversations(spark, sf):
    """All turns of a fixture against decoding each conversation whole, without blocks, tables or borders."""
    df = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id is not null")
    pieces = chat.transcript_turns(df)
    cut = chat.blocks(pieces, 3).checkpoint()
    seen = chat.lookings(cut)
    model = chat.fit(seen)
    got = {}
    for r in sorted(chat.recover(cut, seen, model).collect(), key=lambda r: (r["conv_id"], r["block"], r["seq"])):
        words = r["text"].split("\n", 1)[1]
        if r["continues"]:
            got[r["conv_id"]][-1] = (got[r["conv_id"]][-1][0], got[r["conv_id"]][-1][1] + "\n" + words)
        else:
            got.setdefault(r["conv_id"], []).append((r["role"], words))
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["conv_id"], r["turn"], r["tie"])):
        whole.setdefault(r["conv_id"], []).append(r)
    want = {}
    for conv_id, (conv, shown) in zip(whole, plain_chat(whole.values()), strict=True):
        want[conv_id] = [(t[1], "\n".join(t[3])) for t in chat.said(conv, -1, model.path(shown, None, None))]
    assert got == want


def test_turns_keep_their_text(spark):
    said = {0: "def f():\n\n    return 1\n", 1: "    indented\u2028still one line\x0cand here\n\n\nlast", 2: "Answer: yes", 3: "Q: is it?\nA: it is"}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", said.get(t, f"turn {t} of many words in this one")) for c in range(40) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marked = {(r["conv_id"], r["turn"]) for r in chat.transcript_turns(df).where("marked").collect()}
    forms = {r["conv_id"]: r["text"][:2] for r in chat.transcript_turns(df).where("marked").collect()}
    got = chat.format_conversations(df, 3).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["block"], r["seq"])):
        text.setdefault(r["conv_id"], []).append(r["text"].split("\n", 1)[1])
    for conv_id, parts in text.items():
        if forms[conv_id] not in ("Q:", "A:") and all((conv_id, t) in marked for t in range(8)):  # nothing tells such words from markers
            assert "\n".join(parts) == "\n".join(said.get(t, f"turn {t} of many words in this one") for t in range(8))
    flat = "\n".join("\n".join(x) for x in text.values())
    assert "def f():\n\n    return 1\n" in flat and "    indented\u2028still one line\x0cand here\n\n\nlast" in flat and "Answer: yes" in flat


def test_chat_edges(spark):
    rows = [(1, 0, "user", "Hello\n\nthere"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, None, None, "x"), (None, 0, "user", "alone"), (None, None, None, None), (3, 0, "user", "a"), (3, 0, "user", "a")]
    rows += [(4, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(300)]
    rows += [(5, None, "user", "same")] * 200 + [(6, 0, "user", "word " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)).withColumn("block", F.lit("b")).withColumn("rows", F.lit(2))
    got = chat.format_conversations(df)
    assert {r["conv_id"] for r in got.collect()} == {None, 1, 2, 3, 4, 5, 6}
    assert "".join(r["text"] for r in got.where("conv_id = 4").orderBy("block", "seq").collect()).count("turn ") == 300
    assert "".join(r["text"] for r in got.where("conv_id = 5").collect()).count("same") == 200
    assert "word " * 300_000 in got.where("conv_id = 6").first()["text"]
    assert got.where("conv_id is null").count() == 2
    assert max(len(r["rows"]) for r in chat.blocks(chat.transcript_turns(df)).collect()) <= chat.BLOCK_TURNS
    assert chat.format_conversations(df.limit(0)).count() == 0
    named = df.select(F.concat(F.lit("c"), "conv_id").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    assert {r["conv_id"] for r in chat.format_conversations(named).collect()} == {None, *(f"c{i}" for i in range(1, 7))}


# ---- 4 licences

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in it.\n\nThe above copyright notice and this permission notice shall be included in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.'
APACHE = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n# Unless required by applicable law or agreed to in writing, software\n# is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'


def test_licences(spark):
    cases = [(MIT, "MIT"), (APACHE, "Apache-2.0"), ("Text.\nReleased under the MIT Licence.", "MIT"), ("a b. Licensed under CC BY-NC 4.0. c", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
             ("Released under the Foo License v7", "unknown"), ("the license was nice", ""), (None, ""), ("", ""), ("word " * 20000 + ". Released under the MIT License.", "MIT")]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs_of(spark, [c for c, _ in cases]).withColumn("licences", F.lit(1))).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


EXAMPLES = {
    "ApacheRef": "Licensed under the Apache License, Version 2.0 (the License)", "ApacheNoUse": "you may not use this file except in compliance with the License", "ApacheCopy": "You may obtain a copy of the License at http://x",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, it comes without warranties or conditions of any kind", "MITRef": "This software is released under the MIT licence", "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies", "AsIs": 'The software is provided "as is"', "NoLiability": "In no event shall the authors be liable",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSDSource": "Redistributions of source code must retain the above copyright notice",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice", "BSDEndorse": "Neither the name of it nor others may be used to endorse or promote products", "BSDRef": "This code is licensed under the 3-clause BSD license", "GPL3Ref": "Licensed under the GNU General Public License, version 3 or later",
    "GPL2Ref": "Licensed under the GNU General Public License version 2", "GPLRedistribute": "You can redistribute it and/or modify it under the terms of the GNU General Public License", "GPL3OrLater": "either version 3 of the License, or (at your option) any later version", "GPL2OrLater": "either version 2 of the License, or (at your option) any later version",
    "LGPL3Ref": "Licensed under the GNU Lesser General Public License, version 3", "AGPL3Ref": "Licensed under the GNU Affero General Public License, version 3", "MPLRef": "This file is subject to the terms of the Mozilla Public License, version 2.0", "CCBYNC": "Distributed under CC BY-NC 4.0", "CCBYSA": "Distributed under CC BY-SA 4.0", "CCBY": "Released under CC BY 4.0",
    "CC0": "Released under CC0 1.0", "Unlicense": "This is free and unencumbered software released into the public domain", "UnknownRef": "It is released under the Foo License",
}


ALONE = {
    "ApacheRef": "Licensed under the Apache License, Version 2.0.", "ApacheNoUse": "You may not use this file except in compliance with the License.", "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, it comes without warranties or conditions of any kind.", "MITRef": "Released under the MIT License.", "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies.", "AsIs": "This software is provided by the copyright holders and contributors as is.", "NoLiability": "In no event shall the authors be liable.",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSDSource": "Redistributions of source code must retain the above copyright notice.", "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice.", "BSDEndorse": "Neither the name of Foo may be used to endorse or promote products.",
    "BSD3Ref": "Licensed under the 3-Clause BSD License.", "BSD2Ref": "Licensed under the 2-clause BSD licence.", "BSDRef": "Distributed under the BSD license.", "GPL3Ref": "Released under the GNU General Public License, version 3.", "GPL3LaterRef": "Released under the GNU GPL, version 3 or later.",
    "GPL2Ref": "Licensed under the GNU General Public License, version 2.", "GPL2LaterRef": "Licensed under the GNU General Public License version 2 or later.", "GPLRedistribute": "You can redistribute it and/or modify it under the terms of the GNU General Public License.",
    "GPL3OrLater": "Either version 3 of the License, or (at your option) any later version.", "GPL2OrLater": "Either version 2 of the License, or (at your option) any later version.", "LGPL21Ref": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL21LaterRef": "Licensed under the GNU LGPL v2.1 or later.", "LGPL3Ref": "Licensed under the GNU LGPL, version 3.", "LGPL3LaterRef": "Licensed under the GNU Lesser General Public License, version 3 or later.", "AGPL3Ref": "Licensed under the GNU Affero General Public License, version 3.",
    "AGPL3LaterRef": "Licensed under the GNU AGPL v3 or later.", "MPLRef": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "CCBYNC": "This work is licensed under CC BY-NC 4.0.", "CCBYSA": "Released under CC BY-SA 4.0.", "CCBY": "Released under CC BY 4.0.",
    "CC0": "Released under CC0 1.0.", "Unlicense": "This is free and unencumbered software released into the public domain.", "UnknownRef": "Distributed under the Foo license of 1999 and so on.",
}


def test_sentences_wrapped_at_every_blank(spark):
    examples = {k: v for k, v in EXAMPLES.items() if k not in ALONE} | {k: v.rstrip(".") for k, v in ALONE.items()}
    assert set(examples) >= {n for n, _ in licences.SENTENCES}
    cases = []
    for name, text in examples.items():
        words = text.split(" ")
        cases += [(name, text + ".")] + [(name, lead + " ".join(words[:k]) + gap + " ".join(words[k:]) + ".") for k in range(1, len(words)) for lead, gap in (("", "\n"), ("// ", "\n// "), (" * ", "\n * "))]
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.scan(docs_of(spark, [t for _, t in cases])).collect()}
    assert [(name, text, got[k]) for k, (name, text) in enumerate(cases) if got[k] != name] == []


def test_each_sentence_alone(spark):
    assert set(ALONE) == {name for name, _ in licences.SENTENCES}
    names = list(ALONE)
    got = {r["doc_id"]: r for r in licences.scan(docs_of(spark, list(ALONE.values()))).collect()}
    assert [got[k]["sentence_ids"] for k in range(len(names))] == names
    named = {n: got[k]["licences"] for k, n in enumerate(names)}
    assert (named["GPL3LaterRef"], named["GPL3Ref"], named["BSD3Ref"], named["LGPL21LaterRef"]) == ("GPL-3.0-or-later", "GPL-3.0", "BSD-3-Clause", "LGPL-2.1-or-later")


def test_licences_as_the_sql_has_them(spark):
    import duckdb

    rows = list(enumerate([*ALONE.values(), "\n".join(ALONE.values()), *(v.replace(" ", "\n# ", 3) for v in ALONE.values()), MIT, APACHE, None, ""]))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(f"select doc_id, sentence_ids, licences from ({licences.oracle_sql()})").fetchall())
    assert sorted(tuple(r) for r in licences.scan(docs_of(spark, [t for _, t in rows])).select("doc_id", "sentence_ids", "licences").collect()) == want


BODY_TEXTS = [
    ("The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "GPL-3.0"), ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community.", "AGPL-3.0"),
    ("0. This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License.", "GPL-2.0"),
    ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "LGPL-3.0"),
    ("This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party.", "LGPL-2.1"), ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:", "MPL-2.0"),
    ('"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.', "Apache-2.0"),
    ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").", "CC-BY-4.0"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use it.", "BSL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it.", "Zlib"),
    ("  3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from it.", ""),
    ("This project is distributed under the terms of the BSD-3-Clause license.", "BSD-3-Clause"), ("the library is licensed under Apache License, version 2.0", "unknown"), ("You can redistribute it and/or modify it under the terms of the GNU General Public License as you like.", "GPL"),
    ("Permission is hereby granted, free of charge, to any person who asks.", ""),
]


def test_bodies_and_openings(spark):
    import duckdb

    texts = [t for t, _ in BODY_TEXTS] + [f"/* {t.upper()} */" for t, _ in BODY_TEXTS] + ["\n".join(t for t, _ in BODY_TEXTS)]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scan(docs_of(spark, texts)).collect()}
    assert [got[k][1] for k in range(len(BODY_TEXTS))] == [want for _, want in BODY_TEXTS]
    assert {name for name, _ in licences.BODIES} - set(" ".join(x for x, _ in got.values()).split()) == {"CCBYSABody"}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert got == {i: (x, y) for i, x, y in con.execute(f"select doc_id, sentence_ids, licences from ({licences.oracle_sql()})").fetchall()}


def test_known_sentences_are_in_normal_form(spark):
    """Each form is what normalising makes of it, so that the maps can be met at all, and has a word that isn't passed over."""
    forms = [form for _, form in licences.NOTICES + licences.BODIES + licences.SENTENCES]
    plain = [f.replace("*", "xyz") for f in forms]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(plain)), "k int, f string").orderBy("k").select(licences.normal(F.col("f"))).collect()]
    assert [(a, b) for a, b in zip(got, plain) if a != b] == []
    assert all(re.search(licences.LIKELY, f) for f in forms)
    assert {x for _, sequence in licences.NOTICE_RULES + licences.RULES + licences.LONE_RULES for x in sequence} <= {n for n, _ in licences.NOTICES + licences.BODIES + licences.SENTENCES}


def test_official_notices(spark):
    gpl = "{what} is free software{sign} you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation{then} either version {v} of the License, or\n(at your option) any later version.\n\n{what} is distributed in the hope that it will be useful."
    of = lambda what, kind, v, sign, then: gpl.format(what=what, kind=kind, v=v, sign=sign, then=then)
    cases = [
        (of("This program", "", 3, ":", ","), "GPL-3.0-or-later"), (of("Foo", "", 3, ":", ","), "GPL-3.0-or-later"), (of("This program", "", 2, ";", ";"), "GPL-2.0-or-later"), (of("This program", "Affero ", 3, ":", ","), "AGPL-3.0-or-later"),
        (of("This library", "Lesser ", "2.1", ";", ";"), "LGPL-2.1-or-later"), (of("This program", "Lesser ", 3, ":", ","), "LGPL-3.0-or-later"), (of("This library", "Library ", 2, ";", ";"), "LGPL-2.0-or-later"),
        ("You can redistribute it and/or modify it under the terms of the GNU General Public License.", "GPL"), ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "AGPL"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ]
    cases += [("".join(f"// {line}\n" for line in text.split("\n")), want) for text, want in cases]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs_of(spark, [t for t, _ in cases])).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


# ---- 5 packing


def test_tokens_equal_the_library(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)  # as the library comes: strings of special tokens are special
    draw = random.Random(0)
    odd = ["", "It's the dog's I'LL", "é é ﬁ ǅ İstanbul ΣΑΣ ς ẞ", "x y\x1cq\x85r", "12345 a1b2,c3.", "<|endoftext|>a", "a <|endoftext|> b", "x<|startoftext|>!", "<|EndOfText|> <|endoftext|>", "<|ENDOFTEXT|>.", "日本語 🎉👍🏽", "...,,, ,a .b a.b a,b. (a). a., a,.", "ͅa ́b", "\x00a b\x00", "the " * 3000]
    odd += ["".join(draw.choice("ab.,' é́ßÀ1 \x1c日🎉ſK") for _ in range(draw.randint(0, 40))) for _ in range(500)]
    encoder = tokens.ChunkTokenizer(path)
    for t in odd:
        assert np.frombuffer(encoder.encode(t.encode()), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert encoder.encode_many([t.encode() for t in odd]) == [encoder.encode(t.encode()) for t in odd]


def test_small_memo_gives_the_same(path, monkeypatch):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)).encode()
    want = tokens.ChunkTokenizer(path).encode(text)
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 2)
    tokens._memos().clear()
    assert tokens.ChunkTokenizer(path).encode(text) == want
    assert tokens.ChunkTokenizer(path).encode_many([text, None, text[:40]]) == [want, b"", tokens.ChunkTokenizer(path).encode(text[:40])]
    tokens._memos().clear()


def test_fullest_equals_brute_force():
    draw = random.Random(2)
    for _ in range(200):
        counts = {draw.randint(1, 20): draw.randint(1, 3) for _ in range(draw.randint(0, 4))}
        room = draw.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in found.items())


def fewest(lengths, capacity):
    """The least number of bins, by trying every way."""
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best and rest or len(bins) > best:
            return
        if not rest:
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                place(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_plan_against_every_packing():
    draw, more = random.Random(4), 0
    for _ in range(60):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 9))]
        found = packing.plan(dict(Counter(lengths)), 20)
        assert Counter(x for times, inside in found for k, n in inside.items() for x in [k] * (n * times)) == Counter(lengths)
        assert all(sum(k * n for k, n in inside.items()) <= 20 for _, inside in found)
        more += sum(times for times, _ in found) - fewest(lengths, 20)
    assert more <= 3


def test_packing(spark, path, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    texts = [None, "", "one two", "one two", *[" ".join(["word"] * n) for n in range(1, 90, 3)], "long " * 9000]
    docs = docs_of(spark, texts, [*range(len(texts) - 1), None])
    got = packing.pack_documents(docs, path).toPandas()
    assert got["length"].sum() == sum(len((t or "").split()) + 1 for t in texts) and got["length"].max() == 4096
    assert (got[got["doc_id"] <= 1]["length"] == 1).all()
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        stops = np.r_[0, np.cumsum(bin_["length"])]
        assert (bin_["offset"].to_numpy() == stops[:-1]).all() and stops[-1] <= 4096
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // 4096)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# ---- 6 URL rules


ODD_PAGES = [
    ("http://a.test/d/p", "<link href='/x' rel='nofollow canonical'>"), ("http://a.test/x", ""), ("http://b.test/1", '<meta http-equiv="refresh" content="0; url=\'http://c.net/2?a=1&amp;b=2\'">'),
    ("http://c.net/2?a=1&b=2", "<p>"), ("http://d.test/", "<!-- <link rel=canonical href=http://c.net/9> -->"), ("http://c.net/9", None), ("http://e.test/q/r", '<LINK REL="canonical"\n HREF="s">'),
    ("http://e.test/q/s", "<meta content='5;URL=//f.org/fr/' http-equiv=Refresh>"), ("http://f.org/fr/", ""), ("http://g.test/", '<link data-rel="x" rel="stylesheet" href="http://c.net/9">'), (None, "<link rel=canonical href=http://c.net/9>"),
    ("http://i.test/1", "<link rel=canonical href='http://c.net/it&apos;s&#x22;&lt;&#X3E;'>"), ("http://c.net/it's\"<>", None), ("nothing", None), ("http://h.test/a>b", '<link title="a > b" rel=canonical href="http://c.net/9#part">'), ("HTTP://H.TEST/a>b", ""),
]


def test_links_as_the_sql_has_them(spark):
    import duckdb

    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(ODD_PAGES)], "page_id long, url string, html string")
    columns = ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    got = sorted(tuple(r) for r in urlrules.judge(df).select(*columns).collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [(k, u, h) for k, (u, h) in enumerate(ODD_PAGES)])
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({registry.OP6_SQL})").fetchall())
    verdict = {r[0]: (r[4], r[5]) for r in got}
    assert verdict[2] == ("block", "b.test/1") and verdict[0][1] == verdict[1][1] == "a.test/d/p" and verdict[4] == ("allow", None)
    assert verdict[6] == verdict[7] == ("allow", "e.test/q/r") and verdict[9] == ("allow", None) and verdict[14][0] == verdict[15][0] == "block"
    assert verdict[11] == ("block", "c.net/it's\"<>")


def test_urls(spark):
    page = lambda i, url, html=None: (i, url, html)
    rows = [
        page(1, "https://a.example.net/en/1"), page(2, "http://A.example.NET/fr/1#x"), page(3, "https://x.org/fr/2"), page(4, None), page(5, "nothing"), page(6, "http://example.com/de/9?q"), page(7, "http://example.com/dex"),
        page(8, "https://alias.test/a", '<link rel="canonical" href="http://a.example.net/fr/1">'), page(9, "https://alias.test/b/c", '<META http-equiv="refresh" content="0; url=/a">'), page(10, "https://both.test/", '<link rel=canonical href="https://x.org/fr/2"><link href="https://alias.test/a" rel="canonical">'),
        page(11, "https://free.test/"), page(8, "https://alias.test/a", None), page(12, "http://net"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df.where("page_id <> 10")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("a.example.net", "/fr/1", "net/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow") and got[12] == ("net", "", None, "allow")
    assert got[8][3] == "block" and got[9][3] == "block" and got[11][3] == "allow"
    joined = {r["page_id"]: r["verdict"] for r in urlrules.judge(df).collect()}
    assert joined[8] == joined[9] == joined[10] == "allow" and joined[2] == "block"  # an explicit allow in the component wins, but not over an own rule
    more = spark.createDataFrame([("https://free.test/", "http://q.net/")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in urlrules.judge(df.union(spark.createDataFrame([(13, "http://q.net/", None, "x")], df.schema)), redirects=more).collect()}[11] == "block"
    assert urlrules.judge(df.limit(0)).count() == 0


def test_tags_over_several_lines(spark):
    rows = [(1, "https://a.net/x", None), (2, "https://one.test/", '<link\n rel="canonical"\n href="https://a.net/x">'), (3, "https://two.test/", '<meta\n http-equiv="refresh"\n content="0; url=https://a.net/x">')]
    got = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("block", "a.net/x") for k in (1, 2, 3)}


# ---- 7 exact top-k


def test_odd_components_as_the_sql_has_them(spark, tmp_path):
    import duckdb

    nan = float("nan")
    rows = [(k, [0.5 if (k >> b) & 1 else -0.5 for b in range(64)]) for k in range(60)] + [(100, [nan] * 64), (150, [None, nan, 0.5] + [-1.0] * 61), (200, [0.5] * 10), (250, [0.5] * 70), (300, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.op7_multi_index_hashing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select query_id, vec_id, distance, rank from ({registry.OP7_SQL})").fetchall())


@pytest.mark.parametrize("n,k", [(400, 10), (30, 5), (3, 10)])
def test_top_k_equals_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2, (5, 64))
    bits = centre[rng.integers(0, 5, n)] ^ (rng.random((n, 64)) < 0.08)
    bits[: n // 3] = bits[0]
    df = spark.createDataFrame([(i, [float(x) - 0.5 for x in b]) for i, b in enumerate(bits)] + [(n, None), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    coded = mih.codes(df)
    got, covered = {}, {}
    for r in mih.top_k(coded.withColumn("q", F.lit(1)), coded.where("id % 7 = 0").withColumn("bound", F.lit(0)), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
        covered.setdefault(r["query_id"], set()).add(r["covered"])
    ints = [int("".join(map(str, b.astype(int)[::-1])), 2) for b in bits]
    for q in range(0, n, 7):
        want = sorted(((ints[q] ^ x).bit_count(), i) for i, x in enumerate(ints))[:k]
        assert sorted(got[q]) == [(j + 1, d, i) for j, (d, i) in enumerate(want)]
        (radius,) = covered[q]  # closed by the covering bound, at the first step that proves it
        first = max(want[-1][0], (mih.TOGETHER + 1) * mih.SEGMENTS - 1 if want[-1][0] >= mih.SEGMENTS else mih.SEGMENTS - 1)
        assert radius == first or len(want) < k
    assert mih.top_k(coded.limit(0), coded.limit(0), k).count() == 0


# ---- 8 SimHash


def test_fingerprint_by_definition():
    import xxhash

    for text in ["a b c d a b c d", "One two", "", None, "x", "é ü a b  c\td"]:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tree_rows", [2048, 3])
def test_components_equal_brute_force(spark, sf, tree_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.collect()[:6]
    near = [(10_000 + i, " ".join(w for k, w in enumerate(base[i % 6]["text"].split()) if k != i), "en", "s", 0) for i in range(60)]
    docs = docs.union(spark.createDataFrame([*near, (None, base[0]["text"], "en", "s", 0), (20_000, None, "en", "s", 0), (20_001, " ", "en", "s", 0)], DOCS))
    got = simhash.simhash_components(docs, tree_rows=tree_rows).collect()
    rows = docs.collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = union_find(len(rows), links)
    least = {}
    for r, x in zip(rows, root):
        if r["doc_id"] is not None:
            least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(r["doc_id"]), least.get(x)) for r, x in zip(rows, root))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_shards_cover_every_close_pair():
    draw = random.Random(0)
    for radius, distinct in ((3, 10), (3, 10**9), (5, 10**6)):
        masks = simhash.shard_masks(radius, distinct)
        for _ in range(300):
            flips = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(not flips & w for _, w in masks) and all(m & w == m for m, w in masks)
        need = math.log2(distinct / simhash.SHARD_ROWS)
        assert all(need <= m.bit_count() < need + 1 for m, _ in masks) if need > 0 else masks == [(0, 0)]


def test_trees_prune(monkeypatch):
    """A tree of a shard's usual size compares a probe with a small part of its codes, and finds the same pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, simhash.SHARD_ROWS // 2, dtype=np.uint64) & ~np.uint64(0x7F)  # they agree on seven bits
    codes = np.unique(np.r_[base, base ^ (np.uint64(1) << rng.integers(7, 64, len(base)).astype(np.uint64))])
    shard, compared, plain = np.zeros(len(codes), dtype=np.int64), [0], bktree.Forest.apart
    forest = bktree.Forest(shard, codes)

    def counting(self, some, node):
        compared[0] += len(some)
        return plain(self, some, node)

    monkeypatch.setattr(bktree.Forest, "apart", counting)
    pairs = {(int(i), int(j)) for probe, node in forest.search(shard, codes, 3) for i, j in zip(probe, node)}
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 3))}
    assert compared[0] < 0.3 * len(codes) ** 2


def test_large_shards_take_all_bits_of_their_blocks(spark):
    """Codes that share the bits a shard is made by, and others that share a whole block."""
    rng = np.random.default_rng(6)
    codes = [int(x) & ~0xFF for x in rng.integers(0, 2**62, 300)] + [int(x) << 16 for x in rng.integers(0, 2**46, 200)]
    codes = sorted({*codes, *[c ^ 1 << int(b) for c, b in zip(codes, rng.integers(0, 62, 500))]})
    got = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), tree_rows=20, group_rows=300, shard_rows=30).collect()
    where = {c: k for k, c in enumerate(codes)}
    want = union_find(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    assert union_find(len(codes), [(where[r["a"]], where[r["b"]]) for r in got]) == want


def test_keep_one_leaves_columns_alone(spark):
    docs = docs_of(spark, ["a b c d", "a b c d", "e f g h"]).withColumn("text_key", F.lit("mine")).withColumn("_key", F.lit(7)).withColumn("kept_id", F.lit(8))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text_key"], r["_key"], r["kept_id"]) for r in kept.collect()) == [(0, "mine", 7, 8), (2, "mine", 7, 8)]


def test_near_copies_links_are_found():
    rng = np.random.default_rng(5)
    masks, missed, tried = nearcopies.tables(250_000), 0, 0
    for _ in range(400):
        found = rng.integers(0, 2**63, int(rng.integers(60, 900)), dtype=np.uint64)
        other = np.r_[found[: int(len(found) * 8 / 9) + 1], rng.integers(0, 2**63, len(found) // 9, dtype=np.uint64)]
        a, b = nearcopies.code(found), nearcopies.code(other)
        tried += 1
        near = int(np.bitwise_count(a ^ b).sum()) <= nearcopies.RADIUS
        missed += not (near and any(not (int(a[0] ^ b[0]) & x or int(a[1] ^ b[1]) & y) for x, y in masks))
    assert missed / tried < 0.04  # at a similarity of just 0.8


def test_simhash_of_a_set_by_definition():
    found = np.random.default_rng(1).integers(0, 2**63, 70_001, dtype=np.uint64)
    assert int(nearcopies.code(found)[0]) == sum(1 << k for k in range(64) if 2 * int(((found >> np.uint64(k)) & np.uint64(1)).sum()) > len(found))


def test_keep_one_of_unnamed_and_shared_ids(spark):
    texts = [f"{w} alone {w}{w} stands {w}{w}{w} here" for w in ("ash", "birch", "cedar", "elm", "fir", "gum")]
    docs = docs_of(spark, [*texts, texts[0]], [None, None, None, None, 7, 7, None])
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == sorted(texts)


# ---- 9 toxicity


def test_chain_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    chain = toxicity.fit(docs, train)
    got = [(r["toxic"], r["toxic_flag"]) for r in toxicity.score(docs, chain).drop("toxic").join(test, "doc_id").select("toxic", "toxic_flag").collect()]
    assert sum(y == 0 and p for y, p in got) / sum(y == 0 for y, _ in got) < 0.03
    assert sum(y == 1 and p for y, p in got) / sum(y == 1 for y, _ in got) > 0.5
    assert chain.models[1].earlier.shape == (1,) and chain.models[2].earlier.shape == (2,)


def plain_logistic(rows, y):
    """fit_linear on dense rows, feature by feature: rows are (set of features, earlier probabilities)."""
    n, positive = len(rows), sum(y)
    chi = {}
    for f in set().union(*[own for own, _ in rows]):
        seen, with_ = sum(f in own for own, _ in rows), sum(v for (own, _), v in zip(rows, y) if f in own)
        expected = seen * positive / n
        spread = expected * (1 - positive / n) * (1 - seen / n)
        if seen >= toxicity.MIN_ROWS and spread > 0 and (with_ - expected) ** 2 / spread >= toxicity.LEAST_CHI:
            chi[f] = (with_ - expected) ** 2 / spread
    kept = sorted(sorted(chi, key=lambda f: (-chi[f], f))[: toxicity.SELECTED])
    x = np.array([[f in own for f in kept] + list(earlier) + [True] for own, earlier in rows], dtype=float)
    theta = np.zeros(x.shape[1])
    theta[-1] = math.log((positive + 1) / (n - positive + 1))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, 251):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ theta, -35, 35))) - y) / n
        slope[:-1] += 3e-5 * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return lambda own, earlier: float(1 / (1 + np.exp(-np.clip(np.array([f in own for f in kept] + list(earlier) + [True], dtype=float) @ theta, -35, 35))))


def plain_features(text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    seen = Counter(zlib.crc32(p.encode()) % toxicity.BUCKETS for w in words for p in [f"={w}", *(w[:k] for k in (4, 5, 6, 7) if len(w) >= k)])
    found = {f for f in seen} | {(f * 40503 + k) % toxicity.BUCKETS for f, n in seen.items() for k in (2, 3) if n >= k}
    return found | {k * 40503 % toxicity.BUCKETS for k in range(1, len(words).bit_length() + 1)} if words else set()


def test_the_whole_query_in_plain_python(spark, tmp_path):
    """op9 over a small folder of tables against a chain fitted row by row, out of fold."""
    draw = random.Random(8)
    said = {"en": "the kind words of a good day and more".split(), "de": "der die das gute Wort vom Tag".split()}
    bad = {"en": ["idiot", "scum", "trashy"], "de": ["achlich", "achlicher"]}
    docs, labels = [], []
    for i in range(150):
        lang, toxic, low = draw.choice(["en", "en", "de"]), draw.random() < 0.3, draw.random() < 0.3
        words = draw.choices(said[lang], k=9) + [draw.choice(bad[lang])] * toxic + ["spam", "spam"] * low
        docs.append((i, " ".join(draw.sample(words, len(words))), lang))
        if i % 4:
            labels.append((i, int(not low), int(toxic)))
    docs += [(150, None, "en"), (151, "", None), (5, docs[5][1], docs[5][2]), (None, "idiot scum", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by_id = {i: (t, lang) for i, t, lang in docs}
    fitted = [(plain_features(by_id[i][0]), by_id[i][0], [int(by_id[i][1] != "en"), int(q == 0), x]) for i, q, x in labels]
    before, models = [()] * len(fitted), []
    for k in range(3):
        y = np.array([f[2][k] for f in fitted], dtype=float)
        rows = [(f[0], b) for f, b in zip(fitted, before)]
        models.append(plain_logistic(rows, y))
        fold = [zlib.crc32(f[1].encode()) % toxicity.FOLDS for f in fitted]
        told = [0.0] * len(rows)
        for out in range(toxicity.FOLDS):
            inside = [j for j in range(len(rows)) if fold[j] != out]
            model = plain_logistic([rows[j] for j in inside], y[inside])
            for j in range(len(rows)):
                if fold[j] == out:
                    told[j] = model(*rows[j])
        before = [(*b, p) for b, p in zip(before, told)]
    want = []
    for i, text, _ in docs:
        earlier = ()
        for model in models:
            earlier = (*earlier, model(plain_features(text), earlier))
        want.append((i, *earlier, earlier[-1] >= 0.5))
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in registry.op9_classifier_chain(spark, str(tmp_path)).collect()), key=key)
    want = sorted(want, key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1:4] for r in got], [r[1:4] for r in want], atol=1e-5)
    assert all(g[4] == w[4] for g, w in zip(got, want) if abs(w[3] - 0.5) > 1e-4)
    labelled = {i: x for i, _, x in labels}
    assert sum(r[4] == (labelled[r[0]] == 1) for r in got if r[0] in labelled) > 0.95 * len(labels)


def test_chain_edges(spark):
    texts = ["you idiot scum", "you stupid trash", *["kind words", "good day", "well met"] * 6] * 12
    chain = toxicity.fit_chain(texts, np.array([[0, 0, 1], [0, 1, 1], *[[0, 0, 0]] * 18] * 12, dtype=float), toxicity.CATEGORIES)
    docs = docs_of(spark, [None, "", "you idiot scum", "kind words " * 20000, "you idiot scum"], [1, 2, None, 4, 5]).withColumn("toxic", F.lit(True))
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 5 and {r["doc_id"] for r in got if r["toxic_flag"]} == {None, 5}
    assert sorted(r["doc_id"] for r in toxicity.clean(docs, chain).collect()) == [1, 2, 4]
    said = [(str(i), 1, int(i % 2)) for i in range(30)] * 2 + [(None, 1, 1), ("5", None, 1)]
    labels = spark.createDataFrame(said, "doc_id string, quality int, toxic int")
    named = spark.createDataFrame([(str(i % 30), "you idiot scum" if i % 2 else "kind words") for i in range(900)] + [("3", None)], "doc_id string, text string")
    assert toxicity.training_rows(named, labels, 7).count() == 7  # ids of any type, repeated ones once
    found = toxicity.score(named, toxicity.fit(named, labels)).collect()
    assert all(r["toxic_flag"] == (int(r["doc_id"]) % 2 == 1) for r in found if r["doc_id"] != "3") and len(found) == 901
    nothing = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.clean(docs, nothing).count() == 5 and toxicity.score(docs.limit(0), chain).count() == 0


# ---- 10 archives


def test_arc_headers_and_lengths():
    body = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(body) + body + b"\nhttp://a b/ 1.2.3.4 19970101000000 text/html 7\nab\n\ncd!\ndns:x.y 0.0.0.0 19970101000001 text/dns 3\nabc\nhttp://cut/ 1.1.1.1 19970101000002 image/png 99\n\xff\xfe"
    first, page, name, cut = arc.parse_arc(data)
    assert (page.fields["URL"], page.content, page.truncated) == ("http://a b/", b"ab\n\ncd!", False) and cut.truncated
    warc = [arc.to_warc(r, "x.arc").headers for r in (first, page, name, cut)]
    assert [h["WARC-Type"] for h in warc] == ["warcinfo", "resource", "response", "resource"]
    assert warc[1]["WARC-Date"] == "1997-01-01T00:00:00Z" and warc[1]["WARC-IP-Address"] == "1.2.3.4" and warc[3]["WARC-Truncated"] == "length"
    assert warc[1]["WARC-Payload-Digest"] == f"sha256:{hashlib.sha256(page.content).hexdigest()}" and len({h["WARC-Record-ID"] for h in warc}) == 4
    for broken in (b"http://a 1 2 3 4\n", body, data[: len(body) + 60] + b"\nbad line\nx"):
        with pytest.raises(ValueError):
            list(arc.parse_arc(broken))


def test_warc_round_trip_in_memory():
    records = [arc.to_warc(next(iter(list(arc.parse_arc(arc.version_block(v, "n") + b"\n" + arc.arc_record(v, 7, "http://x/", p)))[1:])), "n") for v in (1, 2) for p in (b"", b"a\r\n\r\nWARC/1.1\r\n", bytes(range(256)))]
    data = b"".join(arc.write_warc(r) + b"\r\n\r\n" for r in records)
    back = list(arc.parse_warc(data))
    assert [r.block for r in back] == [r.block for r in records] and back[0].headers["WARC-Type"] == "response"
    short = arc.revisit(records[2], records[0].headers["WARC-Record-ID"])
    assert arc.split_http(short.block)[2] == b"" and short.headers["WARC-Payload-Digest"] == records[2].headers["WARC-Payload-Digest"]
    with pytest.raises(ValueError):
        list(arc.parse_warc(data[:-3]))


def test_archives_are_members_that_gzip_reads(spark, tmp_path):
    import gzip

    rows = [(k, f"http://h/{k}", "same page " * 30 if k % 3 else f"page {k} " * 40) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    old, new = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    arc.write_arc(df, old, file_bytes=6000)
    arc.convert(df, old, new)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 2 and len(files) == len(list((tmp_path / "arc").glob("part-*")))
    kinds = Counter()
    for f in files:
        raw = f.read_bytes()
        records = list(arc.parse_warc(gzip.decompress(raw)))  # the padding behind the members is no fault to gzip
        assert records[0].headers["WARC-Type"] == "warcinfo" and len(list(arc._members(raw))) == len(records)
        kinds.update(r.headers["WARC-Type"] for r in records)
    assert kinds["response"] == 21 and kinds["revisit"] == 39
    versions = {next(arc.parse_arc(arc._members(f.read_bytes()))).fields["version"] for f in (tmp_path / "arc").glob("part-*")}
    assert versions == {"1", "2"}
    assert arc.read_warc(df, new).where("refers_to = 1").count() == 39


def test_both_versions_are_written_and_ids_of_any_type_come_back(spark, tmp_path):
    pages = [(f"p {k}/é:{k}\n", f"http://h/{k}", "the same page " * 20) for k in range(20)] + [(None, "u", "x")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").coalesce(1)
    arc.write_arc(df, f"file://{tmp_path}/arc")
    blocks = [next(arc.parse_arc(arc._members(f.read_bytes()))).fields for f in (tmp_path / "arc").glob("part-*")]
    assert {b["version"] for b in blocks} == {"1", "2"} and len({b["URL"] for b in blocks}) == len(blocks)
    got = arc.round_trip(df).collect()
    assert {r["page_id"] for r in got} == {p for p, _, _ in pages}
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {min(p for p, _, _ in pages if p)} and len(got) == 21


def test_records_in_pieces_are_read_alike():
    whole = arc.version_block(1, "n") + b"\n" + b"\n".join(arc.arc_record(1, k, f"http://x/{k}", b"p\r\n" * k) for k in range(9))
    for size in (1, 7, 64, 10_000):
        pieces = [whole[k : k + size] for k in range(0, len(whole), size)]
        assert list(arc.parse_arc(pieces)) == list(arc.parse_arc(whole))
    packed = arc._member(whole[:300]) + arc._member(whole[300:]) + b"\0"
    assert b"".join(arc._members(packed)) == whole and list(arc._members(whole + b"\0")) == [whole]


def test_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(arc, "FILE_BYTES", 2000)
    long_ = "é\r\n\r\nWARC/1.1\n" * 20
    rows = [(5, "http://a/", long_), (2, "http://b c/", long_), (9, None, long_), (3, "u", "short"), (4, "u", "short"), (6, "v", None), (None, "w", long_), (7, "x", ""), (2, "http://b c/", long_), (8, "y", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit(0)).repartition(3)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in arc.round_trip(df).collect()), key=repr)
    bytes_ = lambda t: (t or "").encode()
    want = []
    seen = Counter()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = bytes_(html)
        again = len(p) >= 100 and seen[p] > 0
        seen[p] += 1
        want.append((page_id is None, page_id or 0, "revisit" if again else "response", 2 if again else None, len(p), hashlib.sha256(p).hexdigest()))
    assert got == sorted(want, key=repr)
    assert arc.round_trip(df.limit(0)).count() == 0


# ---- SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    pick = lambda names, rows: sorted((tuple(r[list(names).index(c)] for c in order) for r in rows), key=repr)
    assert pick(df.columns, [tuple(r) for r in df.collect()]) == pick(found.columns, found.fetchall())


def test_no_local_checkpoint_or_driver_folder():
    from pathlib import Path

    for file in Path(registry.__file__).parent.glob("*.py"):
        assert not re.search(r"localCheckpoint|\.rdd\b|crossJoin", file.read_text()), file
