"""Exact deduplication and its index."""

import random

from pyspark.sql import functions as F

from junctura.llm.digests import DigestIndex, exact_dedup, keep_first_copies, text_digest

DOCS = "doc_id long, text string, kept string"


def test_exact_dedup(spark):
    rows = [(3, "a  b", "x"), (1, "a\n\tb", "x"), (2, "a b ", "x"), (4, None, "x"), (5, "", "x"), (None, "a b", "x"), (None, "only", "x"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()), key=str)
    want = sorted([(3, 1, 4, False), (1, 1, 4, True), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False), (0, 1, 4, False), (0, None, 1, True), (1, 1, 4, True)], key=str)
    assert got == want
    assert exact_dedup(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in keep_first_copies(df).collect()) == ["1", "1", "2", "4", "None"]


def test_digest_index_keeps_earlier_batches(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(5, "a", ""), (6, "b", "")], DOCS)
    second = spark.createDataFrame([(1, "a", ""), (2, "c", ""), (3, "c", "")], DOCS)
    exact_dedup(first, index)
    for _ in range(2):  # again, as after a failure
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(second, index).collect()}
        assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3
    index.drop()


def test_batches_go_through_the_anti_join(spark):
    rng = random.Random(3)
    texts = ["hot"] * 40 + [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 6) for _ in range(160)] + ["x" * 300_000] * 2
    rng.shuffle(texts)
    ids = rng.sample(range(-500, 500), len(texts))
    df = spark.createDataFrame([(i, t, "") for i, t in zip(ids, texts, strict=True)], DOCS)
    index = DigestIndex(spark)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, index).collect()}
    least = {t: min(i for i, u in zip(ids, texts, strict=True) if u == t) for t in texts}
    assert got == {i: (least[t], texts.count(t), least[t] == i) for i, t in zip(ids, texts, strict=True)}
    assert index.read().count() == index.read().select("digest").distinct().count() == len(least)
    assert {r.doc_id for r in keep_first_copies(df).collect()} == set(least.values())
    plan = index.lacking(df.select("doc_id", text_digest(F.col("text")).alias("text_sha256")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    files = index.read().inputFiles()
    assert len(files) > index.buckets  # several batches were appended
    index.drop()
    assert not index.exists() and not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 7, "q"), (2, "a", 8, "r"), (None, "a", 9, "s"), (None, "b", 9, "s")], "doc_id long, text string, keep_id int, text_sha256 string")
    assert exact_dedup(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = keep_first_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text, r.keep_id) for r in kept.collect()) == [(0, "b", 9), (1, "a", 7)]
    assert keep_first_copies(df.limit(0)).count() == 0
