import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attrisieve.operators import attributes, boolean


def test_shirts(spark):
    df = spark.createDataFrame([("black", ["black"]), ("white", ["white"])], "name string, a array<string>")
    r, f = F.array(F.lit("black")), F.array(F.lit("logo"), F.lit("text"))
    got = {x["name"]: (x["d"], x["ok"]) for x in df.select("name", attributes.distance(F.col("a"), r, f).alias("d"), attributes.satisfies(F.col("a"), r, f).alias("ok")).collect()}
    assert got == {"black": (0, True), "white": (1, False)}


def test_violation_truth_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (-1, 1), (-1, 0)], "s int, z int")
    got = {(r["s"], r["z"]): r["v"] for r in df.select("s", "z", attributes.violation(F.col("s"), F.col("z")).alias("v")).collect()}
    assert got == {(1, 1): 0, (1, 0): 1, (-1, 1): 1, (-1, 0): 0}


def test_brute_force_equals_closed_form(spark):
    draw = random.Random(1)
    rows = []
    for k in range(40):
        n = draw.randint(1, 8)
        rows.append((k, [draw.random() < 0.5 for _ in range(n)], [draw.choice([1, -1]) for _ in range(n)]))
    df = spark.createDataFrame(rows, "key int, z array<boolean>, s array<int>")
    got = {r["key"]: r["distance"] for r in attributes.brute_force_distance(df, "key", "z", "s").collect()}
    assert got == {k: sum(z != (s > 0) for z, s in zip(zs, ss)) for k, zs, ss in rows}


def test_brute_force_takes_every_query(spark, sf, monkeypatch):
    from attrisieve.plans import fixtures, registry

    monkeypatch.setattr(attributes, "BLOCK", 1000)  # no power of two, so that blocks end unevenly
    want = {r["key"]: r["d"] for r in fixtures.generated(spark, sf).select("key", attributes.distance(F.col("b"), F.col("required"), F.col("forbidden")).alias("d")).collect()}
    got = registry.queries()["brute_force_distance"](spark, sf).collect()
    assert len(got) == len(want) and {r["key"]: r["distance"] for r in got} == want


def test_brute_force_works_features_out_once(spark, sf):
    """A test for nulls that Spark adds would repeat all that features come from in the condition of a join below."""
    from attrisieve.plans import registry

    plan = registry.queries()["brute_force_distance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join Inner" in x and "aggregate(" in x]
    rows = spark.createDataFrame([(1, [True], [-1]), (2, None, [1]), (3, [True], None), (4, [], [])], "key int, z array<boolean>, s array<int>")
    assert {r["key"]: r["distance"] for r in attributes.brute_force_distance(rows, "key", "z", "s").collect()} == {1: 1, 4: 0}


BUCKETS = "key long, item string, full_pos array<string>, full_neg array<string>, full_common array<string>, full_neither array<string>"


@pytest.mark.parametrize("sizes", [(0, 0, 3, 0), (0, 4, 0, 0), (5, 5, 5, 5), (0, 0, 0, 0), (1, 0, 0, 2)])
def test_generated_queries_respect_rules(spark, sizes):
    own = [[f"{b}{i}" for i in range(n)] for b, n in zip("pncx", sizes)]
    df = spark.createDataFrame([(k, "shirt", *own) for k in range(300)], BUCKETS)
    for r in attributes.generate_queries(df, "key").collect():
        chosen = [r[f"selected_{b}"] for b in ("pos", "neg", "common", "neither")]
        assert all(set(c) <= set(o) and len(set(c)) == len(c) for c, o in zip(chosen, own))
        assert r["query_distance"] == len(chosen[0]) + len(chosen[1]) <= r["target"] + 1
        assert bool(chosen[0] or chosen[2]) == bool(sizes[0] or sizes[2])
        assert bool(chosen[1] or chosen[3]) == bool(sizes[1] or sizes[3])


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, "i", ["a", "b", "c"], ["d", "e"], ["f"], ["g", "h"]) for k in range(50)], BUCKETS)
    one = {r["key"]: r["nl_query"] for r in attributes.generate_queries(df.repartition(1), "key").collect()}
    many = {r["key"]: r["nl_query"] for r in attributes.generate_queries(df.repartition(7), "key").collect()}
    assert one == many


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_random_expressions_are_well_formed(n, seed):
    tokens = boolean.random_tokens(n, seed)
    assert tokens.count("(") == tokens.count(")")
    text = " ".join(tokens)
    assert isinstance(eval(text, {"args": [True] * n}), bool)  # noqa: S307 - only names this test made
    assert [t for t in tokens if t.startswith("args")] == [f"args[{i}]" for i in range(n)]


def test_random_expression_distances(spark):
    tokens = boolean.random_tokens(3, 5)
    rows = [(i, [bool(i >> k & 1) for k in range(3)]) for i in range(8)]
    df = spark.createDataFrame(rows, "key int, z array<boolean>")
    got = {r["key"]: r["distance"] for r in boolean.edit_distances(df, "key", "z", 3, boolean.to_sql(tokens, "z")).collect()}
    ok = [i for i, z in rows if eval(" ".join(tokens), {"args": z})]  # noqa: S307
    assert got == {i: min((i ^ a).bit_count() for a in ok) for i, _ in rows if ok}
