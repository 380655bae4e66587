import math

import pytest
from pyspark.sql import functions as F

from attrisieve.operators import losses, ranking, reshape, splits


def test_labels_and_sentinel(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,)], "d double").select(reshape.label(F.col("d"), 15, 25).alias("y"))
    assert [round(r["y"], 6) for r in df.collect()] == [0.6, 0.0, 0.2]
    for bad in ({"scale": 0}, {"scale": 1, "shape": "log"}):
        with pytest.raises(ValueError):
            reshape.label(F.lit(1.0), 1, **bad)


def test_easy_mask_branches(spark):
    by_source = spark.createDataFrame([("random", 1.0), ("hard", -1.0), (None, 1.0)], "negative_example_source string, query_distance double")
    assert [r[0] for r in by_source.select(reshape.is_easy(by_source)).collect()] == [True, False, False]
    by_value = by_source.drop("negative_example_source")
    assert [r[0] for r in by_value.select(reshape.is_easy(by_value)).collect()] == [False, True, False]
    by_label = spark.createDataFrame([(0.6,), (0.2,)], "label float")
    assert [r[0] for r in by_label.select(reshape.is_easy(by_label)).collect()] == [True, False]


def test_anchor_filters_and_swap(spark):
    rows = spark.createDataFrame([(1, "o", "q", "r", "a", "b"), (2, "o", " ", "r", "a", "b"), (3, "o", "q", "r", "a", "a")], "row_id int, original_query string, nl_query string, rephrased_query string, positive_example string, negative_example string")
    assert reshape.anchors(rows).count() == 2 and reshape.anchors(rows, drop_blank=True).count() == 1
    assert reshape.swap_sides(reshape.anchors(rows)).columns[:3] == ["anchor", "negative", "positive"]
    with pytest.raises(ValueError):
        reshape.anchors(rows, "nothing")
    with pytest.raises(ValueError):
        reshape.keep_for_style(rows, "other")
    with pytest.raises(ValueError):
        reshape.swap_sides(rows)


def test_splits(spark):
    rows = spark.createDataFrame([(i, f"q{i % 23}") for i in range(200)], "row_id int, anchor string")
    out = splits.split_by_query(rows)
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("anchor").alias("n")).collect()}
    assert sizes == {"train": 18, "validation": 2, "test": 3} and out.count() == 200
    assert {r["n_splits"] for r in splits.overlap(out, "anchor").collect()} == {1}
    part = splits.query_fraction(rows, 0.5)
    assert part.select("anchor").distinct().count() == round(23 * 0.5)
    assert splits.query_fraction(rows, 1).count() == 200
    with pytest.raises(ValueError):
        splits.query_fraction(rows, 0)
    with pytest.raises(ValueError):
        splits.split_by_query(rows.where("anchor in ('q1', 'q2')"))


def test_leakage_free(spark):
    rows = spark.createDataFrame([(i, f"q{i // 3}", f"p{i % 50}") for i in range(120)], "row_id int, q string, p string")
    out = splits.split_without_leakage(rows, ["q", "p"]).cache()
    assert out.count() == 120
    assert all({r["n_splits"] for r in splits.overlap(out, k).collect()} == {1} for k in ("q", "p"))


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 11, 1)], "query_id long, corpus_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 50)], "query_id long, corpus_id long")
    got = {(r["query_id"], r["k"]): r.asDict() for r in ranking.per_query_metrics(ranked, relevant, (1, 3, 10)).collect()}
    top = got[(1, 3)]
    assert (top["accuracy"], top["precision"], top["mrr"]) == (1.0, 2 / 3, 0.5) and math.isclose(top["recall"], 2 / 3)
    assert math.isclose(top["map"], (1 / 2 + 2 / 3) / 3)
    assert math.isclose(top["ndcg"], (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert got[(1, 10)]["precision"] == 0.2 and got[(1, 1)]["accuracy"] == 0.0
    assert all(got[(2, k)][m] == 0.0 for k in (1, 3, 10) for m in ("accuracy", "recall", "mrr", "ndcg", "map"))
    assert ranking.clamp_cutoffs((1, 5, 100, 1000), 50) == (1, 5, 50)


def test_top_k_breaks_ties_by_id_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CORPUS_BLOCK", 3)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    base = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)] + [(10, [0.0, 0.0]), (11, None)], "corpus_id long, v array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "query_id long, v array<double>")
    got = [(r["query_id"], r["corpus_id"]) for r in ranking.top_k(asked, base, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]


def test_reversed_margin_negates_gap(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], 0.2)], "q array<double>, p array<double>, n array<double>, label double")
    r = losses.losses(losses.with_cosines(rows)).first()
    assert math.isclose(r["margin_loss"], 0.64) and math.isclose(r["reversed_margin_loss"], 1.44) and math.isclose(r["attribute_hamming_loss"], 0.64) and r["triplet_loss"] == 0


def test_probe_recovery(spark):
    b = {"a": [1.0, 0.0, 2.0], "c": [0.0, 3.0, 1.0]}
    vec = lambda cond: [sum((1 if s == "1" else -1) * b[a][i] for a, s in (x.split(":") for x in cond)) for i in range(3)]
    queries = [["a:1", "c:-1"], ["a:1"], ["c:-1"], []]
    df = spark.createDataFrame([(q, [float(x) for x in vec(q)]) for q in queries], "conditions array<string>, f array<double>")
    for r in losses.probe_by_deletion(df).collect():
        assert r["b"] == b[r["attribute"]]


def test_last_metadata_positive_after_negative(spark):
    rows = spark.createDataFrame([(1, "q", "x", "y", "hard", 3.0), (2, "q", "y", "x", "random", -1.0)], "row_id long, anchor string, positive string, negative string, negative_example_source string, query_distance double")
    got = {r["text"]: (r["kind"], r["query_distance"]) for r in ranking.last_metadata(rows).collect()}
    assert got == {"x": ("Easy", -1.0), "y": ("Positive", -1.0)}
