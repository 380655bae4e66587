"""Operator 12 against every product, and its intervals, ties and edge cases."""

import math

import duckdb
import numpy as np
import pytest

from attrisieve.llm import negatives, registry
from attrisieve.operators import tiles

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute_force(rows):
    """rows: (id, label, vector), each a row of its own."""
    grid = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = lambda i: (i is None, i)
    out = []
    for at, (i, label, x) in enumerate(grid):
        if i is None or i % 50:
            continue
        score = [sum(a * b for a, b in zip(x, y)) for _, _, y in grid]
        alike = sorted((k for k in range(len(grid)) if k != at and grid[k][1] == label), key=lambda k: (-score[k], last(grid[k][0])))[:5]
        for p in alike:
            fits = [k for k in range(len(grid)) if grid[k][1] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            for rank, k in enumerate(sorted(fits, key=lambda k: (-score[k], last(grid[k][0])))[:3], 1):
                out.append((i, grid[p][0], rank, grid[k][0], score[p], score[k]))
    return sorted(out, key=repr)


def found(spark, rows, vector="array<float>"):
    df = spark.createDataFrame([(*r, 7.0) for r in rows], f"vec_id long, label int, embedding {vector}, x double")  # a clashing column
    got = negatives.mine(df)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


def unit_rows(rng, n, labels, dims=8):
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int(rng.integers(labels)), v[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("labels", [1, 3, 40])
def test_against_every_product(spark, monkeypatch, labels):
    monkeypatch.setattr(tiles, "LEAST", 40)
    monkeypatch.setattr(negatives, "ROWS", 16)
    rows = unit_rows(np.random.default_rng(labels), 300, labels)
    assert found(spark, rows) == brute_force(rows)


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    """A third of all rows share one vector; ids repeat or are missing; labels, vectors and components are null or infinite."""
    monkeypatch.setattr(negatives, "ROWS", 8)
    monkeypatch.setattr(tiles, "LEAST", 20)
    rows = unit_rows(np.random.default_rng(5), 120, 2, 3)
    rows += [(200 + i, i % 2, [0.5, 0.5, 0.5]) for i in range(60)] + [(None, i % 2, [0.4, 0.6, 0.5]) for i in range(4)] + [(50, 0, [0.5, 0.5, 0.4])] * 2
    rows += [(300, None, [1.0, 0.0, 0.0]), (350, 1, None), (400, 0, [1.0, None, 0.0]), (450, 0, [1.0, math.nan, 0.0]), (500, 0, [1.0, math.inf, 0.0]), (550, 1, []), (600, 1, [0.0, 0.0, 0.0])]
    assert found(spark, rows) == brute_force(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.integers(-(1 << 18), 1 << 18, 4) + 0.0).tolist()) for i in range(200)]
    assert found(spark, rows, "array<double>") == brute_force(rows)


def test_products_of_pairs_that_qualify():
    rng = np.random.default_rng(0)
    for sparse in (0, 0.1, 1):
        for _ in range(20):
            a, x = (rng.integers(-300, 300, (int(rng.integers(1, 60)), d)) for d in rng.integers(1, 9, 2))
            asked = []

            def qualify(i, j, low, high):
                wide = [np.broadcast_to(v, low.shape).ravel() for v in (i, j)]
                asked.append((*wide, low.ravel(), high.ravel()))
                return high >= 20_000

            old, negatives.SPARSE = negatives.SPARSE, sparse
            try:
                i, j, score = negatives.products(a, x, qualify)
            finally:
                negatives.SPARSE = old
            width = min(a.shape[1], x.shape[1])
            exact = a[:, :width] @ x[:, :width].T
            assert set(zip(i.tolist(), j.tolist(), score.tolist())) == {(p, q, exact[p, q]) for p, q in zip(*np.nonzero(exact >= 20_000))}
            for i, j, low, high in asked:  # every interval holds the product, and they end as points
                assert (low <= exact[i, j]).all() and (exact[i, j] <= high).all()
            spans = [(h - low).max() for _, _, low, h in asked if len(low)]
            assert all(q <= p for p, q in zip(spans, spans[1:])) and spans[-1] == 0 or not len(asked[-1][2])


def test_products_past_a_long_are_refused():
    with pytest.raises(ArithmeticError):
        negatives.products(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31), lambda *x: x[2] <= x[3])


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, 1, [1.0])]) == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, size):
    sf = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(registry.OP12_SQL)
    assert want.columns == COLUMNS
    got = registry.op12_bit_sliced_negatives(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got
