"""The boundaries to models, language detectors and encoders, run lists and batch arithmetic."""

import json

import pytest
from pyspark.sql import functions as F

from attrisieve.functions import text as T
from attrisieve.operators import batches, encoding, language, models, runs

PAIRS = "key long, query string, item string, a array<string>, b array<string>, vocabulary array<string>"


def pairs(spark):
    return spark.createDataFrame([(k, "red shirt", "shirt", ["red", "long"], ["blue", "long"], ["blue", "long", "red", "wide"]) for k in range(5)], PAIRS)


def failing(key_word):
    """A client that fails for prompts with a word."""

    def client(messages, model_id):
        if key_word in messages[-1]["content"]:
            raise RuntimeError("no answer")
        return models.stub_client(messages, model_id)

    return client


def test_process_examples(spark):
    df = pairs(spark).drop("item")
    got = models.process_examples(df, "stub", 7).collect()
    assert {r["key"] for r in got} == set(range(5))
    for r in got:
        assert r["original_query"] == "red shirt" and r["item"] == "shirt" and r["full_pos"] == ["red"] and r["full_neither"] == ["wide"]
        assert r["num_attributes"] == len(r["required"]) + len(r["forbidden"])
    assert models.process_examples(df, "stub", client=failing("Query:")).count() == 0
    assert models.process_examples(df, "stub", client=failing("Split")).count() == 0
    assert models.process_examples(df.limit(0), "stub").count() == 0
    with pytest.raises(ValueError):
        models.process_examples(df.withColumn("nl_query", F.lit("x")), "stub")


def test_visual_scores(spark):
    df = pairs(spark).drop("query")
    with pytest.raises(ValueError):
        models.score_visually(df, "gpt-5-mini")
    assert {r["hard_negative_distance_source"] for r in models.score_visually(df, "gemini-x").collect()} == {"gemini-x"}
    assert models.score_visually(df, "gemini-x", client=failing("Split")).count() == 0
    kept = models.score_visually(df, "gemini-x", client=failing("Split"), keep_failures=True).collect()
    assert len(kept) == 5 and all(r["nl_query"] is None and r["hard_negative_distance_source"] is None for r in kept)


def test_memo_is_written_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "Query: red shirt"), (2, "Query: red shirt"), (3, 'Query: "blue"/é\nhat')], "id long, prompt string")
    path = str(tmp_path / "memo")
    first = models.ask_remembered(df, "item", "m", path).collect()
    assert len(first) == 3 and all(r["calls"] == 1 for r in first)
    memo = spark.read.parquet(path).collect()
    assert len(memo) == 2
    want = {models.stable_json([{"role": "user", "content": p}]) for p in ("Query: red shirt", 'Query: "blue"/é\nhat')}
    keys = {r[0] for r in spark.createDataFrame([(x,) for x in want], "x string").select(models.memo_key(F.col("x"), F.lit("m"))).collect()}
    assert {r["key"] for r in memo} == keys
    again = models.ask_remembered(df, "item", "m", path, failing("Query")).collect()
    assert all(r["calls"] == 0 for r in again) and {(r["id"], r["reply"]) for r in again} == {(r["id"], r["reply"]) for r in first}
    assert models.ask_remembered(df, "item", "m", path, failing("Query"), use_memo=False).where("reply is not null").count() == 0
    assert models.ask_remembered(df, "item", "other", path, failing("Query")).where("reply is null").count() == 3
    assert spark.read.parquet(path).count() == 2
    assert models.stable_json([{"b": 1, "a": "é"}]) == '[{"a": "é", "b": 1}]'


def test_calls_in_order_and_never_more_than_the_window():
    import threading
    import time

    lock, under_way, most, drawn = threading.Lock(), [0], [0], []

    def job(k):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.03 if k % 4 == 0 else 0.001)
        with lock:
            under_way[0] -= 1
        return k

    def jobs():
        for k in range(40):
            drawn.append(k)
            yield lambda k=k: job(k)

    told = models.in_order(jobs(), 4)
    assert [next(told) for _ in range(3)] == [0, 1, 2] and len(drawn) <= 7  # nothing is drawn ahead of the window
    assert list(told) == list(range(3, 40)) and 1 < most[0] <= 4
    assert list(models.in_order(iter([]), 2)) == []
    with pytest.raises(ValueError):
        list(models.in_order(jobs(), 0))
    with pytest.raises(ZeroDivisionError):
        list(models.in_order((lambda k=k: 1 // k for k in (1, 0, 2)), 2))


def test_replies_come_whatever_the_window(spark):
    df = spark.createDataFrame([(k, f"Query: red shirt{k}") for k in range(600)], "key long, prompt string").repartition(2)
    want = {k: json.dumps({"item": f"shirt{k}", "features": ["red"]}) for k in range(600)}
    for window in (1, 7):
        got = models.ask(df, "item", "m", window=window).collect()
        assert {r["key"]: r["reply"] for r in got} == want and all(r["calls"] == 1 for r in got)
    assert models.ask(df.limit(0), "item", "m").count() == 0


def test_memo_is_compacted_and_read_in_part(spark, tmp_path):
    path = str(tmp_path / "memo")
    ask = lambda low, high: models.ask_remembered(spark.range(low, high).select("id", F.format_string("Query: shirt%d", "id").alias("prompt")), "item", "m", path)
    for low in (0, 100, 200):
        assert ask(low, low + 120).where("reply is not null").count() == 120
    files = lambda: [p for p in (tmp_path / "memo").rglob("*.parquet")]
    before, known = len(files()), {(r["key"], r["reply"]) for r in models.read_memo(spark, path).collect()}
    assert len(known) == 320
    assert models.compact_memo(spark, path, 1) > 0 and len(files()) < before
    assert {(r["key"], r["reply"]) for r in models.read_memo(spark, path).collect()} == known
    assert models.compact_memo(spark, path, 1) == 0 and models.compact_memo(spark, str(tmp_path / "none")) == 0
    one = spark.createDataFrame([(next(iter(known))[0],)], "key string")
    part = models.read_memo(spark, path, one)
    assert 0 < part.count() < 320 and "PartitionFilters: [shard" in part._jdf.queryExecution().toString().replace("isnotnull(shard", "shard")
    assert ask(0, 320).where("calls = 0").count() == 320


def test_paths_and_suffixes(spark):
    import posixpath

    cases = [("/a/b/c.jpg", "/a/b"), ("/a/b/c.jpg", "/a/d/e"), ("x/y", "x/y"), ("/a/./b//c", "/a"), ("img/c", "/"), ("a/b", "a/b/c/d")]
    df = spark.createDataFrame(cases, "path string, folder string")
    got = [r[0] for r in df.select(T.relative_path(F.col("path"), F.col("folder"))).collect()]
    assert got == [posixpath.relpath(p.lstrip("/") or ".", f.lstrip("/") or ".") for p, f in cases]
    names = spark.createDataFrame([("x.jsonl",), ("x.jsonl.gz",), (None,)], "n string")
    assert [r[0] for r in names.select(T.with_suffix(F.col("n"), ".jsonl", "_rephrased.jsonl")).collect()] == ["x_rephrased.jsonl", "x.jsonl.gz_rephrased.jsonl", None]


def test_language_boundary(spark):
    rows = [(1, "The cat is with the dog", "and of the"), (2, "der Hund und die Katze", "the"), (3, "1234", "the"), (4, None, "the"), (5, "the " * 50_000, "of")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    assert {r["id"]: r["lang"] for r in language.detect(df, "x").collect()} == {1: "en", 2: "de", 3: None, 4: None, 5: "en"}
    assert {r["id"] for r in language.only(df, ["x", "y"], "en").collect()} == {1, 5}
    assert language.only(df, ["x"], "en", lambda text: 1 / 0).count() == 0


def test_encoders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "id long, x string")
    got = {r["id"]: r["v"] for r in encoding.encode(df, "x", batch=2).collect()}
    assert got[2] is None and got[1] == got[4] == encoding.stand_in(["a b"])[0] and got[3] == [0.0] * encoding.DIM
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.bin").write_bytes(b"12345678abc")
    paths = spark.createDataFrame([("sub/one.bin",), ("gone.bin",)], "image string")
    seen = {r["image"]: r["v"] for r in encoding.encode_files(paths, "image", str(tmp_path)).collect()}
    assert seen == {"sub/one.bin": encoding.stand_in([b"12345678abc"])[0], "gone.bin": None}


def test_listed_runs_and_variants(spark):
    values = spark.createDataFrame([("r1", "acc", 1.0), ("r1", "acc_easy", 2.0), ("r1", "acc_hard", 3.0), ("r9", "acc", 4.0)], "run_id string, metric string, value double")
    listed = runs.run_list(spark, [("words", "ranked", "words", "r1"), ("words", "ranked", "pictures", "r1"), ("pictures", "ranked", "pictures", "r2")])
    got = {(r["run_id"], r["evaluated_on"]): (r["acc"], r["other"]) for r in runs.listed(listed, values, ["acc", "other"]).collect()}
    assert got == {("r1", "words"): (1.0, None), ("r1", "pictures"): (1.0, None), ("r2", "pictures"): (None, None)}
    assert {(r["run_id"], r["metric"], r["variant"]) for r in runs.easy_and_hard(values).collect()} == {("r1", "acc", "all"), ("r1", "acc", "easy"), ("r1", "acc", "hard"), ("r9", "acc", "all")}


def test_batch_plan():
    assert batches.batch_plan(1024, 64, 4) == (64, 4) and batches.batch_plan(8, 64, 0) == (8, 1)
    for wrong in ((100, 64, 1), (2, 8, 4)):
        with pytest.raises(ValueError):
            batches.batch_plan(*wrong)


def test_utc_now(spark):
    from datetime import UTC, datetime

    told = spark.range(1).select(T.utc_now().alias("t")).first()["t"]
    assert abs((datetime.now(UTC) - datetime.fromisoformat(told)).total_seconds()) < 120


def test_json_of_replies_is_checked():
    assert not models.valid_reply(json.dumps({"item": 3}), "item")
