"""Operator 13 against the library's own ids, and its state maps against walking whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from attrisieve.llm import registry, tokencount, transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a" * 700, "\n\n x", "ab" * 400, "▁x ▁▁", "日本語テスト" * 40, "😀😀a", " " * 333, "<s>a</s> <unk> <0x0A>", "x" + " " * 33 + "y", "é", "\x00a", "aaaaaaaaab" * 60, "1234567890" * 50, "=-" * 300]


def noise(seed, n):
    draw, letters = random.Random(seed), "abcdeéthing  .,-=0123\n日▁ "
    return ["".join(draw.choice(letters) for _ in range(draw.choice((3, 30, 600)))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(PATH)


def test_counts_are_the_library_s(library, machine):
    texts = [t or "" for t in TEXTS] + noise(1, 200)
    assert machine.counts([t.encode() for t in texts]).tolist() == [len(x) for x in library.encode(texts)]


def test_merging_is_the_library_s(library, machine):
    for word in ("thinginginthe", "aaaaaaaaaaa", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁", "ressionsationally", "00010002000"):
        assert machine.merged("▁" + word) == library.encode(word, out_type=str)


def test_a_small_table_of_states_begins_anew(library, monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    for seed in range(3):
        texts = noise(seed, 30)
        assert transducer.Transducer.of_worker(PATH).counts([t.encode() for t in texts]).tolist() == [len(x) for x in library.encode(texts)]


def test_maps_compose_over_all_starts(machine):
    """Chunk maps with several starts, joined by the scan, against following each start by hand."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        nth = np.concatenate([np.arange(n) for n in rng.integers(1, 9, 4)])
        domain = np.tile(np.arange(3), (len(nth), 1))
        image, tokens = rng.integers(0, 3, (len(nth), 3)), rng.integers(-2, 5, (len(nth), 3))
        got_image, got_tokens = transducer.compose(domain, image, tokens, nth)
        for k in range(len(nth)):
            for start in range(3):
                state, n = start, 0
                for chunk in range(k - nth[k], k + 1):
                    n += tokens[chunk, state]
                    state = image[chunk, state]
                assert (got_image[k, start], got_tokens[k, start]) == (state, n)


def test_wrong_guesses_are_made_good(library, monkeypatch):
    """With nothing read in front of a chunk nearly every guess is wrong."""
    monkeypatch.setattr(transducer, "LOOK_BACK", 0)
    monkeypatch.setattr(transducer, "CHUNK", 3)
    machine = transducer.Transducer(PATH)
    texts = noise(7, 40) + ["the" * 50, "a" * 99]
    assert machine.counts([t.encode() for t in texts]).tolist() == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("block", [50, 700, tokencount.BLOCK])
def test_texts_cut_into_blocks(spark, library, block):
    texts = TEXTS + noise(3, 40)
    rows = [(k if k % 5 else None, t, "x") for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # repeated rows, null ids, a clashing column
    got = tokencount.count_tokens(df, PATH, block=block, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_rows(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        transducer.Transducer(str(tmp_path / "m"))


def test_query_over_all_documents(spark, sf, library):
    got = {r["doc_id"]: r["n_tokens"] for r in registry.op13_transducer_counts(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {k: len(library.encode(t)) for k, t in texts.items()}
