import pytest
from pyspark.sql import functions as F

from attrisieve.operators import catalogue, mining

SCHEMA = "row_id long, query_id string, query string, product_id string, product_title string, product_text string, product_locale string, esci_label string, lang string"


def judged(spark, rows):
    return spark.createDataFrame([(i, q, q, f"p{i}", f"t{i}", f"x{i}", loc, label, "en") for i, q, loc, label in rows], SCHEMA)


def test_first_exact_row_wins_and_rest_drops(spark):
    df = judged(spark, [(5, "q", "us", "Exact"), (2, "q", "us", "Exact"), (3, "q", "us", "Substitute"), (4, "r", "us", "Substitute"), (6, "q", "us", "Complement"), (7, "q", "es", "Irrelevant")]).repartition(3)
    got = mining.hard_pairs(df).collect()
    assert [(r["positive"]["product_id"], r["hard"]["product_id"]) for r in got] == [("p2", "p3")]
    t = mining.triplets(df).collect()
    assert len(t) == 1 and t[0]["easy_neg_product"]["product_id"] in {"p2", "p3", "p4", "p5", "p6"}
    assert mining.reduction(df).first().asDict() == {"rows": 5, "kept": 1, "share": 0.2}


def test_prefix_limit_comes_first(spark):
    df = judged(spark, [(0, "q", "es", "Exact"), (1, "q", "us", "Exact"), (2, "q", "us", "Substitute")])
    assert mining.label_counts(mining.first_rows(df, 2)).collect()[0].asDict() == {"esci_label": "Exact", "n": 1}
    assert mining.first_rows(df, None).count() == 3


def records(spark, rows):
    return spark.createDataFrame(rows, "key long, product_id long, category string, color string")


def test_negatives(spark):
    df = records(spark, [(k, k, "ab"[k % 2], "rgb"[k % 3]) for k in range(60)])
    kind = {r["key"]: (r["category"], r["color"]) for r in df.collect()}
    for r in catalogue.triplets(df, match_color=True).collect():
        assert r["hard_key"] != r["key"] and kind[r["hard_key"]] == kind[r["key"]] and kind[r["easy_key"]][0] != kind[r["key"]][0]


def test_color_falls_back_to_category(spark):
    df = records(spark, [(1, 1, "a", "red"), (2, 2, "a", "blue"), (3, 3, "b", "red")])
    assert {r["key"]: r["hard_key"] for r in catalogue.hard_negatives(df, match_color=True).collect()} == {1: 2, 2: 1}


def test_one_category_raises(spark):
    with pytest.raises(ValueError):
        catalogue.triplets(records(spark, [(1, 1, "", "r"), (2, 2, None, "r")]))


def test_limit_takes_shuffled_prefix(spark):
    df = records(spark, [(k, k, "ab"[k % 2], "r") for k in range(20)])
    everything, some = catalogue.triplets(df), catalogue.triplets(df, max_examples=5)
    assert some.count() == 5 and some.exceptAll(everything).count() == 0


def test_boxes_keep_the_last(spark):
    part = spark.createDataFrame([("i1",), ("i2",)], "image_name string")
    boxes = spark.createDataFrame([(1, "i1", "1", "1", [0, 0, 1, 1]), (2, "i1", "2", "3", [5, 5, 6, 6])], "row_id int, image_name string, clothes_type string, pose_type string, bbox array<int>")
    got = {r["image_name"]: (r["clothes_type"], r["bbox"], r["t"]) for r in catalogue.with_boxes(part, boxes).withColumn("t", catalogue.clothes_type_name(F.col("clothes_type"))).collect()}
    assert got == {"i1": ("2", [5, 5, 6, 6], "lower_body"), "i2": ("", [], "unknown")}
