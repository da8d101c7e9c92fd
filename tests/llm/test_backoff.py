"""The backoff automaton against plain counts, and the exchange of counts that feeds it."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import backoff, counting
from junctura.llm.backoff import PRIOR, score_texts
from junctura.llm.counting import Routes, pack_keys, requests, sum_by_key, unpack_keys
from junctura.llm.labelled import remainder

DOCS = "doc_id long, text string, score string"


def grams(tokens, n):
    """Each token's context of n - 1 words and the token itself."""
    padded = [0] * (n - 1) + tokens
    return list(zip(*(padded[k:] for k in range(n)), strict=False))


def apart(spark, monkeypatch):
    """Partitions as they are dealt, so that both sides of a join must be dealt alike."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 500)
    monkeypatch.setattr(counting, "CHUNK_BYTES", 500)


@pytest.fixture(autouse=True)
def together(spark):
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("order", "direct"), [(1, 1024), (2, 1024), (3, 2)])
def test_scores_against_plain_counts(spark, monkeypatch, order, direct):
    monkeypatch.setattr(counting, "DIRECT", direct)  # 2: chunks write to groups of buckets
    monkeypatch.setattr(backoff, "PIECE", 7)
    apart(spark, monkeypatch)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "Ünseen W1", "w1\x0bW2", "w1 " * 5_000]
    rows = [(i, t, "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in score_texts(df, remainder(F.col("doc_id"), 5) != 1, order=order).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {n: Counter(g for i in train for g in grams(tokens[i], n)) for n in range(1, order + 1)}
    after = {n: Counter(g[:-1] for i in train for g in grams(tokens[i], n)) for n in range(1, order + 1)}
    one = {g[0]: c for g, c in seen[1].items()}
    n, v, n1, n2 = sum(one.values()), len(one), sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def probability(gram):
        if len(gram) == 1:
            return (one[gram[0]] - d) / n if gram[0] in one else d * v / n
        shorter, context = probability(gram[1:]), after[len(gram)][gram[:-1]]
        return (seen[len(gram)][gram] + PRIOR * shorter) / (context + PRIOR) if context else shorter

    for i, words in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in one for w in words), n, i not in train)
        assert r.base_score == pytest.approx(sum(math.log10((one.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r.score == pytest.approx(sum(math.log10(probability(g)) for g in grams(words, order)))
    # Probabilities of all words and the unknown one after a context sum to 1.
    context = (b"w1",) * (order - 1)
    assert sum(probability((*context, w)) for w in one) + probability((*context, b"new")) == pytest.approx(1)


def test_edges(spark):
    rows = [(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (2, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = score_texts(df, F.col("doc_id") > 0).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, True, 1, 1, 7), (0, True, 3, 3, 7), (1, False, 3, 3, 7), (1, False, 3, 3, 7), (2, False, 1, 1, 7)]
    assert score_texts(df.limit(0), F.lit(True)).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in score_texts(df, F.lit(False)).collect())


def test_key_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(pack_keys(keys[:0]))) == 0


@pytest.mark.parametrize("aligned", [True, False])
def test_relayed_sums_are_direct_sums(spark, monkeypatch, aligned):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    chunks = [np.unique(rng.choice(pool, 80)) for _ in range(11)]
    weights = [rng.integers(0, 4, len(c)) for c in chunks]

    def told(routes):
        rows = [r for k, (c, w) in enumerate(zip(chunks, weights, strict=True)) for r in requests(k, c, w, routes.group_width).to_pylist()]
        asked = spark.createDataFrame([(r["bucket"], r["chunk"], bytearray(r["keys"]), bytearray(r["weights"])) for r in rows], counting.REQUEST_SCHEMA)
        out = {}
        for r in sum_by_key(asked, routes, least=3, aligned=aligned).orderBy("chunk", "bucket").collect():
            out.setdefault(r.chunk, []).append((bytes(r["keys"]), bytes(r.sums)))
        sums = {k: np.concatenate([np.frombuffer(s, np.uint64) for _, s in v]) for k, v in out.items() if k >= 0}
        keys = {k: np.concatenate([unpack_keys(x) for x, _ in v]) for k, v in out.items() if k >= 0}
        facts = sum(np.frombuffer(s, np.uint64).astype(int) for _, s in out[-1])
        return len(rows), {k: v.tolist() for k, v in sums.items()}, {k: v.tolist() for k, v in keys.items()}, facts.tolist()

    n_direct, *direct = told(Routes.to(20))
    monkeypatch.setattr(counting, "DIRECT", 2)
    assert Routes.to(20) == Routes(25, 5)
    n_relayed, *relayed = told(Routes.to(20))
    assert relayed == direct
    assert n_direct > 11 * 15 and n_relayed == 11 * 5
    total = Counter()
    for c, w in zip(chunks, weights, strict=True):
        total.update(dict(zip(c.tolist(), w.tolist(), strict=True)))
    assert direct[2] == [sum(total.values()), *(sum(f(x) for x in total.values()) for f in (lambda x: x > 0, lambda x: x == 1, lambda x: x == 2))]
    if not aligned:
        assert direct[1] == {k: [x for x in c.tolist() if total[x] >= 3] for k, c in enumerate(chunks)}


def test_messages_grow_with_the_root_of_the_buckets():
    """Rows that a chunk sends at two sizes of a corpus, a hundred times apart."""
    small, large = Routes.to(100_000), Routes.to(10_000_000)
    assert 9 < large.groups / small.groups < 11 and large.buckets < 10_010_000
