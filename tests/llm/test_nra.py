"""Exact top-k against plain products."""

import math
import random

import numpy as np
import pytest

from junctura.llm.nra import SortedLists, quantized, top_k_inner_product


def plain(ints, queries, k):
    """(query_id, rank, vec_id, score) by scoring every pair in Python's integers."""
    want = set()
    for i in queries:
        scores = sorted((-sum(a * b for a, b in zip(ints[i], v, strict=True)), j) for j, v in ints.items() if j != i)
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return want


def rows(df):
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_top_k(spark):
    rng = random.Random(1)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(300)}
    vectors |= {400 + i: vectors[7] for i in range(40)}  # ties
    bad = {900: None, 901: [float("nan")] * 6, 902: [None] * 6, 903: [float("inf")] + [0.0] * 5}
    df = spark.createDataFrame([(i, v, 0) for i, v in (vectors | bad).items()] + [(None, vectors[1], 0)], "vec_id long, embedding array<double>, score int")
    q = quantized(df, "vec_id", "embedding", 1024)
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    found = top_k_inner_product(q, q.where("vec_id % 50 = 0"), k=5, candidate_block=64, query_block=3, least_block=16)
    assert rows(found) == plain(ints, [i for i in ints if i % 50 == 0], 5)
    assert top_k_inner_product(q.limit(0), q.limit(0)).count() == 0
    assert top_k_inner_product(q.limit(3), q.limit(1), k=10).count() == 2


def test_large_components_and_overflow(spark):
    rng = random.Random(2)
    ints = {i: [rng.randrange(-(1 << 30), 1 << 30) for _ in range(5)] for i in range(60)}
    ints[61] = [*ints[3][:4], ints[3][4] + 1]  # apart from 3 beyond the 53rd bit
    df = spark.createDataFrame(list(ints.items()), "vec_id long, v array<long>")
    assert rows(top_k_inner_product(df, df.where("vec_id < 4"), k=4)) == plain(ints, range(4), 4)
    huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        top_k_inner_product(huge, huge).collect()
    with pytest.raises(Exception, match="64 bits"):
        quantized(spark.createDataFrame([(1, [1e300])], "vec_id long, e array<double>"), "vec_id", "e", 1024).collect()


def test_odd_rows(spark):
    data = [(1, [1, 2], 5), (1, [1, 2], 6), (1, [3, 0], 5), (2, [1, 2], 5), (3, [1, 2, 3], 5), (None, [1, 2], 5), (4, None, 5), (5, [], 5), (6, [], 5)]
    df = spark.createDataFrame(data, "vec_id long, v array<long>, rank int")
    got = rows(top_k_inner_product(df, df, k=2))
    assert got == {(1, 1, 2, 5), (1, 2, 2, 3), (2, 1, 1, 5), (2, 2, 1, 3), (5, 1, 6, 0), (6, 1, 5, 0)}  # 3 has no equal in length


def test_reading_stops_when_no_outsider_is_left():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (4_000, 4))
    vectors[:20] += np.array([200, -200, 200, -200])  # stand out for the first query
    block = SortedLists(np.arange(4_000), vectors)
    (at, scores), = block.top_k(np.array([[3, -3, 3, -3]]), 5, np.array([-1]))
    want = sorted((-(vectors @ [3, -3, 3, -3])).tolist())[:5]
    assert [-s for s in want] == scores.tolist() and (vectors[at] @ [3, -3, 3, -3] == scores).all()
    assert block.entries_read <= 2 * 2 * 4 * (4_000 // 8)  # the first two stops of 8
    flat = SortedLists(np.arange(40), np.ones((40, 3), int))
    (at, _), = flat.top_k(np.ones((1, 3), int), 5, np.array([0]))
    assert at.tolist() == [1, 2, 3, 4, 5] and flat.entries_read == 2 * 3 * 40
