"""Operators in the form large tables need: tiles, ranges, splits, transforms; each against a plain version."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrisieve.functions.sampling import rank_in_groups
from attrisieve.operators import boolean, encoding, language, losses, ranking, runs, tiles
from attrisieve.sources import readers, writers


def test_top_k_over_many_tiles_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 20)
    monkeypatch.setattr(tiles, "MOST", 20)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ranking, "CORPUS_BLOCK", 6)
    rng = np.random.default_rng(1)
    base = rng.integers(-3, 4, (700, 3)).astype(float)  # many equal cosines
    asked = base[:25] * 2
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(base.tolist())], "corpus_id long, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(asked.tolist())] + [(3, asked[3].tolist()), (None, [1.0, 0.0, 0.0])], "query_id long, v array<double>")
    for k, exclude in ((5, False), (40, True)):
        got = {}
        for r in ranking.top_k(queries, rows, k, exclude).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["corpus_id"]))
        unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.full_like(m, np.nan), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
        scores = (unit(asked)[:, None, :] * unit(base)[None, :, :]).sum(axis=2).round(ranking.DECIMALS)
        for q in range(25):
            fit = sorted((-scores[q, c], c) for c in range(700) if not math.isnan(scores[q, c]) and not (exclude and c == q))[:k]
            assert [c for _, c in sorted(got.get(q, []))] == [c for _, c in fit]
    assert ranking.top_k(queries, rows.limit(0), 3).count() == 0 and ranking.top_k(queries.limit(0), rows, 3).count() == 0


def test_rounds_grow():
    assert list(tiles.rounds(30, 2)) == [(0, 2), (2, 10), (10, 30)] and list(tiles.rounds(0, 4)) == []


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ranks_with_an_outlier_and_a_large_group(spark, groups):
    keys = [*range(1, 4000), 1 << 60]
    df = spark.createDataFrame([(k, "hot" if k % 3 else f"g{k % 50}") for k in keys], "key long, g string").withColumn("base", F.lit(1))
    ranked = rank_in_groups(df, groups, "key", "place")
    assert sorted(ranked.columns) == sorted([*df.columns, "place"])
    got = {r["key"]: r["place"] for r in ranked.collect()}
    seen = {}
    for k in keys:
        g = ("hot" if k % 3 else f"g{k % 50}") if groups else ""
        assert got[k] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    sizes = [r["n"] for r in df.repartitionByRange(*groups, "key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < len(keys) / 2
    assert rank_in_groups(df.limit(0), groups, "key", "place").count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    draw = random.Random(2)
    texts = {}
    for name in ("b.txt", "a.txt", "c.txt"):
        texts[name] = [draw.choice(["", "  ", "\t", f"line {name} {k} é"]) for k in range(300)]
        (tmp_path / name).write_text("\n".join(texts[name]) + ("\n" if name == "a.txt" else ""), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.placed_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        lines = readers.numbered_lines(spark, str(tmp_path))
        got = {r["row_id"]: r["value"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [x for name in sorted(texts) for x in texts[name] if x.strip()]
    assert got == dict(enumerate(want))


def test_whitespace_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("3\n\nname item split\n a.jpg\tx  train \n\nshort\nb.jpg y test more\n")
    assert [(r["row_id"], r["parts"]) for r in readers.whitespace_table(spark, str(tmp_path / "t.txt"), 3).orderBy("row_id").collect()] == [(2, ["a.jpg", "x", "train"]), (4, ["b.jpg", "y", "test", "more"])]
    with pytest.raises(FileNotFoundError):
        readers.whitespace_table(spark, str(tmp_path / "none"), 3)
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.format_string("n%d x%d z", "id", "id").alias("value"))
    writers.whitespace_table(rows.repartition(3), str(tmp_path / "out"), "name item split")
    assert [r["parts"][0] for r in readers.whitespace_table(spark, str(tmp_path / "out"), 3).orderBy("row_id").collect()] == [f"n{k}" for k in range(500)]


def test_images_of_all_kinds(spark, tmp_path):
    samples = bytes(range(1, 49))
    for channels in (1, 3, 4):
        (tmp_path / f"{channels}.png").write_bytes(writers.png(2, 2, samples, channels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["rgb"] and bytes(r["rgb"])) for r in readers.images(spark, str(tmp_path)).collect()}
    grey = b"".join(samples[k : k + 1] * 3 for k in range(4))
    opaque = b"".join(samples[4 * k : 4 * k + 3] for k in range(4))
    assert got == {"1.png": (2, 2, grey), "3.png": (2, 2, samples[:12]), "4.png": (2, 2, opaque), "bad.png": (None, None, None)}


def test_files_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"one"), ("c.txt", b"two")], "name string, content binary")
    for content in (rows, rows.withColumn("content", F.lit(b"other"))):
        assert {r["name"] for r in writers.files(content, str(tmp_path)).collect()} == {"a/b.txt", "c.txt"}
    assert (tmp_path / "a" / "b.txt").read_bytes() == b"one" and sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.txt", "c.txt"]


def test_logged_entries_over_splits(spark, tmp_path):
    """The last of many values wins whatever task has read it; literals that can't be read are left out."""
    folder = tmp_path / "run-20250101_1-x" / "files"
    folder.mkdir(parents=True)
    lines = [f"{k} {{'val/recall@5': {k}.5, 'n': None, 'ok': True}} and {{'recall@5': {k}}} {{'loss': 3}}" for k in range(200)] + ["{'recall@5': nan}", "{broken recall@5 'x'", "{'accuracy@5': 'high'}"]
    (folder / "output.log").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        entries = readers.log_entries(spark, f"{tmp_path}/run-*/files/output.log")
        summaries = spark.createDataFrame([(readers_path, {"val/recall@5": -1.0, "val/recall@10": 7.0}) for readers_path in {r["path"] for r in entries.collect()}], "path string, metrics map<string,double>")
        merged = runs.merged_metrics(summaries, entries).first()["metrics"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert merged == {"val/recall@5": 199.5, "recall@5": 199.0, "n": None, "ok": None, "val/recall@10": 7.0, "accuracy@5": None}
    assert readers.log_entries(spark, f"{tmp_path}/none/*").count() == 0


def test_run_folders_that_lack_files(spark, tmp_path):
    for name in ("run-20250101_1-a", "run-20250301_1-a", "run-20250101_1-b"):
        (tmp_path / name / "files").mkdir(parents=True)
    (tmp_path / "run-20250101_1-a" / "files" / "x-summary.json").write_text('{"recall@5": 1}')
    (tmp_path / "run-20250301_1-a" / "files" / "output.log").write_text("{'recall@5': 2.0}")
    (tmp_path / "run-20250101_1-b" / "files" / "config.yaml").write_text("args:\n  - --x\n  - '3'\n")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    got = {r["run_id"]: (r["recall_at_5"], r["recall_at_10"], r["verified_args"]) for r in runs.read_recalls(spark, str(tmp_path), listed).collect()}
    assert got == {"a": (2.0, None, ""), "b": (None, None, "--x 3"), "c": (None, None, "")}


def test_run_folders_are_listed_by_tasks_and_once(spark, tmp_path):
    """No pattern of folders, which the driver would look up one by one; what lies elsewhere or in a run's own subfolders is left out."""
    base = tmp_path / "files" / "b + ase"
    for k in range(40):
        folder = base / f"run-20250101_1-{k}" / "files"
        (folder / "run-x" / "files").mkdir(parents=True)
        (folder / "output.log").write_text(f"{{'recall@5': {k}.0}}")
        (folder / "run-x" / "files" / "output.log").write_text("{'recall@5': -1.0}")
        (base / f"run-20250101_1-{k}" / "output.log").write_text("{'recall@5': -2.0}")
    (base / "run-20250201_1-0" / "files").mkdir(parents=True)
    (base / "run-20250201_1-0" / "files" / "output.log").write_text("")
    (base / "other-20250201_1-1" / "files").mkdir(parents=True)
    (base / "other-20250201_1-1" / "files" / "output.log").write_text("{'recall@5': -3.0}")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    files, logs = readers.run_files(spark, str(base)), readers.run_logs(spark, str(base))
    assert spark.conf.get(key) == before
    assert files.count() == 40 and {r["name"] for r in files.select("name").distinct().collect()} == {"output.log"}
    found = {r["path"].rsplit("-", 1)[1].split("/")[0]: r["value"] for r in readers.entries_in(logs).collect()}
    assert found == {str(k): float(k) for k in range(40)}
    listed = spark.createDataFrame([(str(k),) for k in range(41)], "run_id string")
    table = runs.read_recalls(spark, str(base), listed)
    assert {r["run_id"]: r["recall_at_5"] for r in table.collect()} == found | {"40": None}
    assert set(re.findall(r"InMemoryFileIndex\((\d+) path", table._jdf.queryExecution().executedPlan().toString())) == {"1"}  # a pattern gives 40
    assert readers.run_files(spark, f"{base}/none").count() == 0 == readers.run_logs(spark, f"{base}/none").count()


@pytest.mark.parametrize("n", [0, 1, 5, 13])
def test_distance_tables_against_all_assignments(spark, monkeypatch, n):
    monkeypatch.setattr(boolean, "LOW_BITS", 3)
    monkeypatch.setattr(boolean, "CHUNK", 4)
    tokens = boolean.random_tokens(n, 5) if n else ["true"]
    got = {r["assignment"]: r["distance"] for r in boolean.distance_table(spark, n, boolean.to_sql(tokens, "z")).collect()}
    accepts = eval(f"lambda args: {' '.join(tokens)}".replace("true", "True"))  # noqa: S307
    ok = np.array([a for a, z in enumerate(itertools.product((False, True), repeat=n)) if accepts(z[::-1])])
    every = np.arange(1 << n)
    want = np.array([np.bitwise_count(ok ^ a).min() for a in every])
    assert got == dict(zip(every.tolist(), want.tolist(), strict=True))
    assert boolean.distance_table(spark, n, "false").count() == 0


def test_distances_to_a_function_of_twenty_variables(spark):
    rows = spark.createDataFrame([(1, [True] * 20), (2, [False] * 20), (3, [k % 2 == 0 for k in range(20)])], "key long, z array<boolean>")
    apart = " and ".join(f"(z[{k}] or z[{k + 1}])" for k in range(0, 20, 2)) + " and not (z[0] and z[1])"
    assert {r["key"]: r["distance"] for r in boolean.edit_distances(rows, "key", "z", 20, apart).collect()} == {1: 1, 2: 10, 3: 0}


def test_language_model(spark):
    train = spark.createDataFrame([("the cat and the dog of the house", "en"), ("der Hund und die Katze im Haus", "de"), ("12 34", "xx"), ("the", None), (None, "de")], "text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    rows = [(1, "The House"), (2, "die Katze, der Hund"), (3, None), (4, ""), (5, "99 !?"), (6, "the " * 30_000), (6, "the " * 30_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, t string, key string")
    told = language.tell(df, "t", model)
    assert told.columns == ["id", "t", "key", "lang"]
    assert sorted((r["id"], r["lang"]) for r in told.collect()) == [(1, "en"), (2, "de"), (3, None), (4, None), (5, None), (6, "en"), (6, "en")]
    assert sorted(r["id"] for r in language.only(df, ["t"], "en", model).collect()) == [1, 6, 6]
    assert {r["lang"] for r in language.tell(df, "t", language.fit(train.limit(0))).collect()} == {None}
    small = language.fit(train, most=3)
    assert small.weights.count() == 3 and {r["lang"] for r in language.tell(df, "t", small).collect()} <= {"de", "en", None}


def test_language_model_on_documents_held_out(spark):
    from attrisieve.plans import registry

    rows = registry.queries()["language_by_triples"](spark, "/root/testdata/sf0.01").where("held").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["detected"] for r in rows) / len(rows) > 0.97


def test_distinct_texts_are_encoded_once(spark, tmp_path):
    def encoder(inputs):
        with open(tmp_path / "seen", "a") as f:
            f.write("".join(f"{x}\n" for x in inputs))
        return [[float(len(x)), 0.0] for x in inputs]

    rows = spark.createDataFrame([(k, "ab" if k % 2 else "abc") for k in range(50)] + [(99, None)], "id long, x string")
    got = encoding.encode_distinct(rows, "x", encoder)
    assert {(r["x"], r["v"] and tuple(r["v"])) for r in got.collect()} == {("ab", (2.0, 0.0)), ("abc", (3.0, 0.0)), (None, None)} and got.count() == 51
    assert sorted((tmp_path / "seen").read_text().split()) == ["ab", "abc"]


def test_only_named_files_are_encoded(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * (k + 1))

    def encoder(inputs):
        assert all(len(x) in (1, 3) for x in inputs)
        return [[float(len(x))] for x in inputs]

    paths = spark.createDataFrame([("0.bin",), ("2.bin",), ("2.bin",), ("gone",), (None,)], "image string")
    assert sorted((str(r["image"]), r["v"]) for r in encoding.encode_files(paths, "image", str(tmp_path), encoder).collect()) == [("0.bin", [1.0]), ("2.bin", [3.0]), ("2.bin", [3.0]), ("None", None), ("gone", None)]


def test_truncated_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 5.0],), ([2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(encoding.truncated(F.col("v"), 2)).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0], None]
    assert df.select(encoding.truncated(F.col("v"), None)).first()[0] == [3.0, 4.0, 12.0]
    with pytest.raises(ValueError):
        encoding.truncated(F.col("v"), 0)


def test_probes_with_intercept(spark):
    queries = spark.createDataFrame([(["a:1", "c:-1"], [1.0, -1.0, 9.0], 1), (["c:-1"], [0.0, -1.0, 9.0], 1), (["a:1"], [1.0, 0.0, 9.0], 2), (["a:1", "a:1"], None, 1)], "conditions array<string>, f array<double>, reference long")
    products = spark.createDataFrame([(1, ["a"], [2.0, 1.0, 1.0]), (2, ["c"], [1.0, 2.0, 1.0])], "key long, attributes array<string>, f array<double>")
    got = {(tuple(r["conditions"]), r["attribute"]): (r["b"], r["beta"]) for r in losses.probes_with_intercept(queries, products).collect()}
    # the second product doesn't fit the query that names it
    assert got == {(("a:1", "c:-1"), "a"): ([1.0, 0.0, 0.0], 1 - 2.0), (("a:1", "c:-1"), "c"): ([0.0, 1.0, 0.0], 0 - 1.0)}


def test_ledger_counts_a_run_once(spark, tmp_path):
    record = spark.createDataFrame([(5, "x")], "calls long, note string")
    for run in ("r1", "r2", "r2"):
        writers.append_ledger(record, str(tmp_path / "l"), run)
    assert sorted(r["run"] for r in readers.csv(spark, str(tmp_path / "l"), "calls long, note string, run string").collect()) == ["r1", "r2"]
