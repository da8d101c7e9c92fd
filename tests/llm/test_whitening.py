"""Whitening: the kernels against numpy's decompositions, the query against a covariance formed in whole numbers."""

from fractions import Fraction

import numpy as np
import pytest

from junctura.llm import whitening
from junctura.llm.whitening import op13_whitening, principal, qd_values, triangle, whiten

SCHEMA = "vec_id long, embedding array<float>, component string"


def directions_hold(a, tolerance=1e-11):
    values, vectors = principal(triangle(a))
    seen = a @ vectors
    assert np.abs(vectors.T @ vectors - np.eye(a.shape[1])).max() < tolerance
    assert np.abs(seen.T @ seen - np.diag(values)).max() <= tolerance * max(values[0], 1e-300)
    assert (np.diff(values) <= 0).all()
    return values


def test_directions_of_many_kinds():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(500, 24))
    orthonormal = np.linalg.qr(a)[0]
    for m in (a, a * np.logspace(0, -6, 24), a * np.logspace(-6, 0, 24), orthonormal, orthonormal * np.repeat([3, 2, 1], 8), orthonormal * (1 + 1e-9 * np.arange(24)), np.ones((5, 3)), np.array([[2.0]]), rng.normal(size=(3, 10))):
        directions_hold(m)
    b = a.copy()
    b[:, 5], b[:, 9] = 0, b[:, 3]
    assert (directions_hold(b)[-2:] < 1e-24 * 500).all()
    for _ in range(100):
        directions_hold(rng.integers(-2, 3, size=(rng.integers(1, 30), rng.integers(1, 9))).astype(float))


def test_qd_values_are_relatively_accurate():
    diagonal, above = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1e-3, 1e-7, 1e-11])
    got = np.sqrt(qd_values(diagonal**2, above**2))
    # det(B) is the product of its diagonal, which only relatively accurate small values reproduce.
    assert np.prod(got) == pytest.approx(np.prod(diagonal), rel=1e-13)
    assert qd_values(np.array([4.0]), np.array([])).tolist() == [4.0]


def plainly(vectors, components=32):
    """n, deviations, eigenvalues and explained shares from sums in whole numbers."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    scaled = np.array([[n * r[k] - sums[k] for k in range(d)] for r in x], dtype=object)
    cov = np.array([[float(Fraction(int(sum(scaled[:, i] * scaled[:, j])), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (scaled.astype(float) / n) @ vectors[:, :components] / np.sqrt(values[:components])
    return n, [int(sum(r * r)) for r in scaled], white, values[:components] / values.sum()


def matches(rows, ids, vectors, components=32):
    n, deviations, white, explained = plainly(vectors, components)
    assert len(rows) == len(ids) * len(explained) and {r["n"] for r in rows} == {n}
    got = {(r["vec_id"], r["component"]): r for r in rows}
    matrix = np.array([[got[i, k + 1]["whitened"] for k in range(len(explained))] for i in ids])
    signs = np.sign((matrix * white).sum(0))
    assert np.abs(matrix * signs - white).max() < 1e-8
    for i, v in zip(ids, deviations, strict=True):
        assert got[i, 1]["deviation"] == v
    assert [got[ids[0], k + 1]["explained"] for k in range(len(explained))] == pytest.approx(explained.tolist(), rel=1e-10)
    assert np.abs(np.cov(matrix.T, bias=True) - np.eye(len(explained))).max() < 1e-9 and 0 <= rows[0]["identity_error"] < 1e-9


def test_edges_and_rounds_of_reduction(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=5).astype(float).tolist(), "x") for k in range(60)]
    good += [(60, good[0][1], "a repeated vector"), (61, [300.0, -300.0, 0.0, 3.0, 1.0], "large")]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 0.0, 0.0, 0.0], "x"), (103, [float("nan"), 0.0, 0.0, 0.0, 0.0], "x"), (104, [float("inf")] * 5, "x"), (105, [1.0] * 6, "longer"), (106, [1.0], "shorter")]
    table = spark.createDataFrame(good + odd, SCHEMA).repartition(9)
    matches(whiten(table).collect(), [r[0] for r in good], [r[1] for r in good])
    two = whiten(table, components=2).collect()
    assert {r["component"] for r in two} == {1, 2} and len(two) == 2 * len(good)
    twice = whiten(spark.createDataFrame([*good, (None, good[3][1], ""), (5, good[5][1], "")], SCHEMA)).collect()
    assert len(twice) == 5 * (len(good) + 2) and sum(r["vec_id"] is None for r in twice) == 5 and sum(r["vec_id"] == 5 for r in twice) == 10


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, "")], [(1, [1.0, 2.0], "")], [(k, [1.0, 2.0], "") for k in range(9)]):
        assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    constant = [(k, [float(k), 7.0, 2.0 * k], "") for k in range(9)]  # one direction in three dimensions
    assert {r["component"] for r in whiten(spark.createDataFrame(constant, SCHEMA)).collect()} == {1}


def test_what_64_bits_do_not_hold_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        whiten(spark.createDataFrame([(1, [1e30, 0.0], ""), (2, [0.0, 1.0], "")], SCHEMA)).collect()


def test_query_against_whole_numbers(spark):
    path = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    matches(op13_whitening(spark, path).collect(), [r["vec_id"] for r in given], [r["embedding"] for r in given])
