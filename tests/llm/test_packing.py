"""Packing against a plain best-fit over all bins."""

import random

import pandas as pd

from junctura.llm.packing import best_fit_packing, pack_shard


def plain(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], {}
    for doc_id, length, source, cluster in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= length and source not in b["s"] and cluster not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= length
        bins[k]["s"] |= {source} - {None}
        bins[k]["c"] |= {cluster} - {None}
        out[doc_id] = k
    return out


def test_same_as_plain_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        n, capacity = rng.randint(1, 200), rng.choice([10, 50, 200])
        items = [(i, rng.randint(1, capacity - 1), rng.choice([None, "a", "b", "c", "d"] + ["hot"] * 3), rng.choice([None, "x"] * 2 + [str(k) for k in range(9)])) for i in range(n)]
        packed = pack_shard(pd.DataFrame(items, columns=["doc_id", "length", "source", "cluster"]), capacity)
        assert dict(zip(packed["doc_id"], packed["bin"], strict=True)) == plain(items, capacity)


def test_conflicts_and_edges(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, None, -3, 5, 90, 100, 101, 250, 1_000]), rng.choice(["hot", "hot", "a", None]), rng.choice(["copies", "copies", None, str(i)]), "extra") for i in range(700)]
    rows += [(7, 5, "a", "z", "extra"), (7, 5, "a", "z", "extra"), (None, 30, None, None, "extra")]
    df = spark.createDataFrame(rows, "doc_id long, length int, source string, cluster string, bin_id string")
    got = best_fit_packing(df, capacity=100, shard_rows=200).toPandas()
    lengths = sum(max(0, r[1] or 0) for r in rows)
    assert got["length"].sum() == lengths
    assert got["bin_id"].isna().sum() == sum((r[1] or 0) <= 0 for r in rows)
    placed = got.dropna(subset=["bin_id"]).sort_values(["bin_id", "bin_offset"])
    assert (placed.groupby("bin_id")["length"].sum() <= 100).all()
    ends = (placed["bin_offset"] + placed["length"]).groupby(placed["bin_id"]).shift(fill_value=0)
    assert (placed["bin_offset"] == ends).all()
    known = {r[0]: r for r in rows if r[0] is not None and r[0] != 7}
    once = placed[placed["doc_id"].isin(list(known))]
    for column in (2, 3):
        tag = once["doc_id"].map(lambda i, c=column: known[i][c])
        pairs = pd.DataFrame({"bin": once["bin_id"], "tag": tag}).dropna()
        assert not pairs.duplicated().any()
    assert best_fit_packing(df.limit(0)).count() == 0
