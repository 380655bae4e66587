import json

import pytest
from pyspark.sql import functions as F

from attrisieve.functions import text as T
from attrisieve.operators import costs, models, profiling, runs
from attrisieve.sources import readers, writers
from attrisieve.streaming import metrics as streaming


def test_last_value_skips_null_and_nan(spark):
    df = spark.createDataFrame([(1, "m", 1.0, 1), (1, "m", None, 3), (1, "m", float("nan"), 2)], "run_id long, metric string, value double, step int")
    assert runs.last_values(df, F.col("step")).first()["value"] == 1.0
    summary = spark.createDataFrame([(1, "m", 9.0), (2, "m", 4.0)], "run_id long, metric string, value double")
    assert {r["run_id"]: r["value"] for r in runs.with_summary(runs.last_values(df, F.col("step")), summary).collect()} == {1: 9.0, 2: 4.0}


def test_names(spark):
    df = spark.createDataFrame([("a_synthetic_multiplier-0.5",), ("plain",), ("x_100000_y",)], "n string")
    got = [tuple(r) for r in df.select(T.token_after(F.col("n"), "synthetic_multiplier").try_cast("double"), T.first_number_token(F.col("n"))).collect()]
    assert got == [(0.5, None), (None, None), (None, 100000)]
    views = spark.createDataFrame([("MEN_Denim_id_00000080_01_1_front",)], "n string").select(T.product_of_view(F.col("n")), T.safe_filename(F.lit("/a b?c.jpg/"))).first()
    assert tuple(views) == ("MEN_Denim_id_00000080_01", "a_b_c.jpg")


def test_recall_fallback_and_merge(spark):
    df = spark.createDataFrame([({"recall@5": 0.1, "val/recall@5": None},), ({"accuracy@5": 0.3},), ({},)], "m map<string,double>")
    assert [r[0] for r in df.select(runs.recall_at(F.col("m"), 5)).collect()] == [None, 0.3, None]
    log = spark.createDataFrame([("x {'val/recall@5': 0.5, 'loss': 1} y {'z': 2} {'val/recall@5': 0.7}",)], "t string").select(F.explode(runs.log_dicts(F.col("t"))).alias("m"))
    assert [r["m"]["val/recall@5"] for r in log.collect()] == [0.5, 0.7]
    merged = spark.range(1).select(runs.merge_maps(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("b"), F.lit(3.0))).alias("m")).first()["m"]
    assert merged == {"a": 1.0, "b": 3.0}


def test_profile_lines(spark):
    lines = ["   3/1    0.100    0.100    0.200    0.200 utils/sat.py:29(generate)", " 7 0.0 0.0 0.0005 0.0 main.py:1(main)", " 1 0.1 0.1 0.1 0.1 /usr/lib/x.py:1(f)", "header"]
    p = profiling.parse(spark.createDataFrame([(x,) for x in lines], "value string"), only=("main.py", "utils/sat.py"))
    assert [(r["ncalls"], r["calls"], r["lineno"]) for r in profiling.by_cumulative_time(p).collect()] == [("3/1", 3, 29), ("7", 7, 1)]
    assert profiling.significant(p).count() == 1 and profiling.top(p, 1).where("measure = 'ncalls'").first()["amount"] == 7


def test_costs(spark):
    calls = spark.createDataFrame([("gemini-2.5-flash", 1_000_000, 1_000_000), ("gpt-none", 10, 10), ("local", 5, 5)], "model_id string, tokens_in long, tokens_out long")
    rows = costs.ledger(calls, costs.price_table(spark))
    assert costs.summary(rows).first().asDict() == {"total_tokens": 2_000_020, "total_calls": 2, "total_cost": 2.8, "tokens_per_call": 1_000_010.0, "cost_per_call": 1.4, "cost_per_million": pytest.approx(1.4, rel=1e-4)}
    none = costs.summary(rows.where("1 = 0")).first()
    assert (none["total_calls"], none["tokens_per_call"], none["cost_per_million"]) == (0, 0.0, None)
    assert "calls: 2" in costs.report(rows)


GOOD = {"common_features": ["x"], "unique_features_a": [], "unique_features_b": ["y"], "neither_features": []}
REPLIES = [
    (json.dumps(GOOD), True), (json.dumps(GOOD).replace('"', "'"), False), (json.dumps(GOOD | {"common_features": [1]}), False), (json.dumps(GOOD | {"more": []}), False),
    (json.dumps({k: v for k, v in GOOD.items() if k != "neither_features"}), False), (json.dumps(GOOD | {"common_features": ["No sleeves"]}), False), (None, False), ("[]", False), (json.dumps(GOOD | {"common_features": "x"}), False),
]


@pytest.mark.parametrize("text,valid", [*REPLIES, (json.dumps(GOOD) + " x", False), ('{"common_features": [1], ' + json.dumps(GOOD)[1:], True)])
def test_reply_validation(text, valid):
    assert models.valid_reply(text, "buckets") is valid


def test_native_reply_validation_agrees(spark):
    df = spark.createDataFrame([(t,) for t, _ in REPLIES], "t string")
    assert [r[0] for r in df.select(models.buckets_reply_valid(F.col("t"))).collect()] == [v for _, v in REPLIES]


def test_retry_marks_attempts_and_falls_back():
    seen = []

    def client(messages, model_id):
        seen.append(messages[0]["content"])
        if len(seen) == 1:
            raise RuntimeError
        return '{"rephrased_query": "ok"}' if len(seen) == 3 else "no"

    assert models.ask_with_retry(client, [{"role": "user", "content": "p"}], "m", "rephrase", 5) == ('{"rephrased_query": "ok"}', 3)
    assert len(set(seen)) == 3
    assert models.ask_with_retry(lambda m, i: "no", [{"role": "user", "content": "p"}], "m", "rephrase", 2) == (None, 2)
    assert [models.route(m) for m in ("gpt-5", "gemini-x", "llama")] == ["gpt", "gemini", "local"]


def test_rephrase_keeps_and_falls_back(spark):
    rows = spark.createDataFrame([(1, "blue shirt", None), (2, "x", "kept"), (3, None, None), (4, "", None)], "key long, nl_query string, rephrased_query string")
    assert {r["key"]: r["rephrased_query"] for r in models.rephrase(rows, "m").collect()} == {1: "Find blue shirt", 2: "kept", 3: None, 4: ""}
    assert {r["key"]: r["rephrased_query"] for r in models.rephrase(rows, "m", lambda m, i: "bad").collect()}[1] == "blue shirt"


def test_memo_saves_calls(spark):
    requests = spark.createDataFrame([(1, "Query: a b"), (2, "Query: c d"), (2, "Query: c d")], "key long, prompt string")
    memo = spark.createDataFrame([(1, "known")], "key long, reply string")
    got = {r["key"]: (r["reply"], r["calls"]) for r in models.ask(requests, "item", "m", memo=memo).collect()}
    assert got[1] == ("known", 0) and json.loads(got[2][0])["item"] == "d" and got[2][1] == 1


def test_failed_extractions_go_or_stay(spark):
    pairs = spark.createDataFrame([(1, ["a"], ["b"], ["a", "b", "c"])], "key long, a array<string>, b array<string>, vocabulary array<string>")
    bad = lambda m, i: "{}"
    assert models.extract_buckets(pairs, "m", bad).count() == 0 and models.extract_buckets(pairs, "m", bad, keep_failures=True).first()["full_pos"] is None
    assert models.extract_buckets(pairs, "m").first()["full_neither"] == ["c"]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, "b", 3)], "row_id long, t string, n int")
    for write, read in ((writers.jsonl, lambda p: readers.jsonl(spark, p, rows.schema)), (writers.parquet, lambda p: readers.parquet(spark, p))):
        path = f"{tmp_path}/{write.__name__}"
        write(rows, path)
        assert sorted(map(tuple, read(path).collect())) == sorted(map(tuple, rows.collect()))
    assert readers.jsonl(spark, f"{tmp_path}/none", rows.schema).count() == 0
    ledger = f"{tmp_path}/ledger"
    for _ in range(2):
        writers.append_ledger(rows.where("row_id = 2"), ledger)
    assert readers.csv(spark, ledger, "row_id long, t string, n int").count() == 2
    made = []
    for _ in range(2):
        writers.cached(spark, f"{tmp_path}/cached", lambda: made.append(1) or rows)
    assert len(made) == 1
    keyed = spark.createDataFrame([("a", 1), ("b", 2)], "model string, x int")
    writers.overwrite_partition(keyed, f"{tmp_path}/keyed", "model")
    writers.overwrite_partition(keyed.where("model = 'a'").withColumn("x", F.lit(5)), f"{tmp_path}/keyed", "model")
    assert {r["model"]: r["x"] for r in spark.read.parquet(f"{tmp_path}/keyed").collect()} == {"a": 5, "b": 2}
    writers.write_text(spark, f"{tmp_path}/report.md", "# é")
    assert (tmp_path / "report.md").read_text() == "# é"
    assert writers.metrics_json(spark.createDataFrame([(2.0, 1)], "b double, a int")) == '{"a": 1, "b": 2.0}'


def test_reports(spark):
    ex = spark.createDataFrame([(1, "o", "q", None, 2, "hard", "p", "h", ["a"])], "row_id long, original_query string, nl_query string, rephrased_query string, query_distance int, negative_example_source string, positive_text string, hard_text string, selected_pos array<string>")
    assert "- pos: a" in writers.text_report(ex)
    assert "![t](../img/x.jpg)" in writers.image_block("t", "out/img/x.jpg", {"color": "red", "text": ""}, "out/md/r.md")


def test_whitespace_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text("3\nimage item split\n\na.jpg i1 train\nshort\nb.jpg i2   test extra\n")
    part, boxes = readers.annotated_images(spark, f"{tmp_path}/p.txt", f"{tmp_path}/none.txt")
    assert [tuple(r)[1:] for r in part.orderBy("row_id").collect()] == [("a.jpg", "i1", "train"), ("b.jpg", "i2", "test")] and boxes.count() == 0
    with pytest.raises(FileNotFoundError):
        readers.whitespace_table(spark, f"{tmp_path}/none.txt", 3)


def test_catalogue_reader(spark):
    raw = spark.createDataFrame([(0, "MEN_x_1_front", None, "Red"), (1, None, "W_2_back", None), (2, " ", None, "x")], "row_id long, item_ID2 string, item_id string, color string").withColumnRenamed("item_ID2", "item_name")
    got = readers.catalogue(raw).collect()
    assert [(r["item_id"], r["product_id"], r["color"], r["text"]) for r in got] == [("W_2_back", "W", "", "")]


def test_run_files(spark, tmp_path):
    for name, body in (("run-1-abc", '{"a": 1, "b": "x"}'), ("run-2-abc", "broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(body)
        (tmp_path / name / "meta.yaml").write_text("args:\n  - --lr\n  - '2e-5'\nother: 1\n")
    got = {r["path"].split("/")[-2]: r["metrics"] for r in readers.summaries(spark, f"{tmp_path}/*/summary.json").collect()}
    assert got == {"run-1-abc": {"a": 1.0}, "run-2-abc": {}}
    args = readers.yaml_args(spark, f"{tmp_path}/*/meta.yaml").select(readers.arg_value(F.col("args"), "--lr").alias("v")).collect()
    assert {r["v"] for r in args} == {"2e-5"}
    listing = spark.createDataFrame([("w/run-1-abc",), ("w/run-2-abc",)], "path string")
    assert readers.run_dirs(listing).first()["path"] == "w/run-2-abc"
    assert readers.config("a: 1\nb: true # x\nc: 'q'\nd: 2e-5\n", {"a": 5, "c": None}, {"z": 0}) == {"z": 0, "a": 5, "b": True, "c": "q", "d": 2e-5}


def test_windowed_stream(spark, sf, tmp_path):
    got = streaming.run_available(spark, f"{sf}/events.parquet", streaming.windowed_metrics, "windowed", f"{tmp_path}/cp", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
