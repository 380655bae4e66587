"""Operator 11 against numpy over the same distinct vectors, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from attrisieve.llm import registry, whitening


def grid(vectors):
    return [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]


def expected(xs, k=16):
    """(n, exact deviations by x, unit eigenvectors, eigenvalues, trace) over the distinct vectors."""
    distinct = sorted(set(xs))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in distinct}
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in distinct])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return n, deviation, dict(zip(distinct, centred)), vectors[:, ::-1][:, :k], values[::-1][:k], np.trace(covariance)


def check(got, by_id, k=16):
    n, deviation, centred, vectors, values, trace = expected(list(by_id.values()), k)
    assert len(got) == len(by_id) * len(values)
    table = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for (i, c), r in table.items():
        want = centred[by_id[i]] @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        if abs(want) > 1e-3:
            signs.setdefault(c, np.sign(want * r["whitened"]))
        assert r["whitened"] == pytest.approx(signs.get(c, 1) * want, abs=1e-7)
        assert (r["n"], int(r["deviation"])) == (n, deviation[by_id[i]])
        assert r["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(80, 5)) * [3, 1, 0.5, 2, 0.1] + 7).tolist()
    rows = [(i, v, 1.5) for i, v in enumerate(vectors + vectors[:30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double")  # repeated vectors, a clashing column
    odd = spark.createDataFrame([(900, None, 0.0), (901, [1.0, None, 2.0, 3.0, 4.0], 0.0), (902, [1.0, math.nan, 2.0, 3.0, 4.0], 0.0), (903, [math.inf, 1.0, 2.0, 3.0, 4.0], 0.0)], df.schema)
    got = whitening.whiten(df.union(odd)).collect()
    check(got, {i: x for (i, _, _), x in zip(rows, grid([v for _, v, _ in rows]))}, 5)


def test_fewer_components_than_dimensions(spark):
    """Three distinct points span a plane; empty vectors count as zeros; null ids and repeated rows are rows."""
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 2.0]), (2, [0.0, 3.0, 0.0, 2.0]), (None, []), (None, [])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 8 and {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {3}
    assert sum(r["explained"] for r in got if r["vec_id"] == 1) == pytest.approx(1)


def test_deviations_past_a_long(spark):
    df = spark.createDataFrame([(0, [1e13, 0.0]), (1, [0.0, 5e12]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    n, deviation, *_ = expected(grid([[1e13, 0.0], [0.0, 5e12], [1.0, 1.0]]))
    xs = dict(enumerate(grid([[1e13, 0.0], [0.0, 5e12], [1.0, 1.0]])))
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, deviation[x]) for i, x in xs.items()}
    assert max(deviation.values()) > 2**63


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_varies(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_query_over_all_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(registry.op11_svd_whitening(spark, sf).collect(), dict(zip([r["vec_id"] for r in rows], grid([r["embedding"] for r in rows]))))
