"""Edge cases and plain versions of the operators that have no test module of their own."""

import random
from collections import Counter

import numpy as np

from junctura.llm.components import connected_components
from junctura.llm.neardup import keep_one_of_each, least_shared, list_entries, near_duplicates

DOCS = "doc_id long, text string, kept string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    import junctura.llm.neardup as module

    monkeypatch.setattr(module, "LONG_LIST", 8)
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(40)]
    base = [f"b{k}" for k in range(420)]
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for _ in range(40):  # copies of a long text, edited more and less
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 12, 30])):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        texts.append(" ".join(words))
    for _ in range(40):  # a passage that many texts share
        own = [f"o{rng.random()}" for _ in range(rng.choice([1, 2, 3, 30]))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    rng.shuffle(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, " ".join(base), "x")]
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # both sides of a join must be dealt alike
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=64).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got.pop(None) == (416, None, True)
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    assert near_duplicates(df.limit(0)).count() == 0
    kept = {r.doc_id for r in keep_one_of_each(df).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i} | {None}


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9_999)}" for _ in range(60_000)]
    edited = list(base)
    for _ in range(800):  # some 8,000 of 64,000 shingles of the union differ: above 0.85
        edited[rng.randrange(len(edited))] = f"e{rng.random()}"
    other = list(base)
    for _ in range(3_000):
        other[rng.randrange(len(other))] = f"o{rng.random()}"
    rows = [(1, " ".join(base), 7), (2, " ".join(edited), 7), (3, " ".join(other), 7), (4, "x" * 500_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    sets = {i: shingles(t) for i, t, _ in rows}
    assert [100 * len(sets[1] & sets[k]) >= 85 * len(sets[1] | sets[k]) for k in (2, 3)] == [True, False]
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert {r.doc_id: r.component_id for r in keep_one_of_each(df).collect()} == {1: 7, 3: 7, 4: 7}


def test_near_duplicates_of_repeated_ids(spark):
    rows = [(1, "a b c d e f", ""), (1, "u v w x y z", ""), (2, "A b c d e f", ""), (3, "u v w x y z", "")]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_least_shared_bounds():
    assert least_shared(100, k=256) == 85 and least_shared(217, k=256) == 185
    rng = np.random.default_rng(1)
    for n in (220, 256, 300, 800, 5_000):
        for _ in range(200):
            shared = rng.random(int(-(-85 * n // 100)))
            own_a, own_b = rng.random(int(n * 0.08)), rng.random(int(n * 0.08))
            a, b = np.sort(np.append(shared, own_a)), np.sort(np.append(shared, own_b))
            if len(shared) / (len(shared) + len(own_a) + len(own_b)) >= 0.85:
                assert len(np.intersect1d(a[:256], b[:256])) >= max(least_shared(len(a)), least_shared(len(b)))


def test_lists_of_a_chunk_that_asks_in_parts(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sketches = [np.unique(rng.choice(pool, 30)) for _ in range(12)]
    rows = [(0, rep, len(s), bytearray(s.tobytes())) for rep, s in enumerate(sketches)]
    df = spark.createDataFrame(rows, "chunk long, rep long, n long, sketch binary")

    def entries(classes):
        return sorted((r.value, r.rep, r.pos, r.size) for r in list_entries(classes, percent=50).where("sketch IS NULL").collect())

    whole, parts = df.coalesce(1), df.repartitionByRange(2, "rep")
    assert parts.rdd.getNumPartitions() == 2
    assert entries(parts) == entries(whole)
    # The rarest values that several sketches hold, up to the room that each has.
    held = Counter(int(v) for s in sketches for v in s)
    want = []
    for rep, s in enumerate(sketches):
        shared = sorted((held[int(v)], int(v)) for v in s if held[int(v)] > 1)
        alone = len(s) - len(shared)
        room = max(0, len(s) - least_shared(len(s), percent=50) + 1 - alone)
        want += [(v, rep, alone + k, len(s)) for k, (_, v) in enumerate(shared[:room])]
    assert entries(whole) == sorted(want)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low
