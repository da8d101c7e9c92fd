"""The n-gram classifier against plain counts, on learnable texts, and on edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import toxicity
from junctura.llm.labelled import labelled_sample
from junctura.llm.toxicity import NgramModel, document_grams, drop_toxic, gram_ratios, score_toxicity, train_toxicity

DOCS = "doc_id long, text string, score string"
MARKS = "doc_id long, quality int, toxic int"


def plain_grams(text):
    return {f" {w} "[i : i + n] for w in text.lower().split() for n in (3, 4, 5, 6) for i in range(len(w) + 3 - n)}


def hash_of(gram):
    """By the definition: a sum of characters times powers, mixed."""
    total = sum(ord(c) * toxicity._POWERS[k] for k, c in enumerate(gram)) % (1 << 64)
    return int(toxicity.mix(np.array([(total + len(gram)) % (1 << 64)], dtype=np.uint64))[0])


def prose(rng, n):
    return " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dogs", "ran"]) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("places", [7, 1 << 19])
def test_grams_of_texts(monkeypatch, places):
    monkeypatch.setattr(toxicity, "PLACES", places)
    for text in ("", " ", "a", "A b", "Ünder \u00a0 Straße\n日本語 𝔘nicode", "x" * 50, "İ I", "ab\tabc  abcd abcdefg " * 9):
        assert set(document_grams(text).tolist()) == {hash_of(g) for g in plain_grams(text)}, text
    texts = ["the cat", "", "a dog sat", "cat cat", "\n"]
    grams = sorted({hash_of(g): g for t in texts[:3] for g in plain_grams(t)}.items())
    model = NgramModel(np.array([h for h, _ in grams], np.uint64), np.arange(1.0, len(grams) + 1), -0.5)
    rows, features = model.features(texts)
    assert {(r, grams[f][1]) for r, f in zip(rows.tolist(), features.tolist(), strict=True)} == {(r, g) for r, t in enumerate(texts) for g in plain_grams(t) if g in dict(grams).values()}
    weight = {g: k + 1.0 for k, (_, g) in enumerate(grams)}
    for score, text in zip(model.scores(texts), texts, strict=True):
        x = sum(weight.get(g, 0.0) for g in plain_grams(text)) - 0.5
        assert score == pytest.approx(1 / (1 + math.exp(-x)))


def test_ratios_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "GATHERED", 100)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 9)), int(i % 3 == 0)) for i in range(90)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    bad, good = Counter(), Counter()
    for _, text, label in rows:
        (bad if label else good).update(plain_grams(text))
    got = {r.key % (1 << 64): r for r in gram_ratios(sample, 30, 60).collect()}
    assert set(got) == {hash_of(g) for g in bad | good}
    for g in bad | good:
        r = got[hash_of(g)]
        assert (r.p, r.q) == (bad[g], good[g])
        assert r.ratio == pytest.approx(math.log((bad[g] + 0.5) / 31) - math.log((good[g] + 0.5) / 61))


def test_learns_words(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(20, 60)).split()
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["blorgish", "blorgly", "Snarfed!", "snarfing"]))
        docs.append((i, " ".join(words), ""))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000, None, ""), (1001, "", ""), (None, "blorgful", ""), (1002, "the cat " * 100_000 + "snarfing", ""), (1003, "blorgish", "x"), (1003, "a mat", "y")]
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, MARKS)
    model = train_toxicity(df, marks, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in score_toxicity(df, model).where("doc_id <> 1003 OR doc_id IS NULL").collect()}
    held = [i for i in range(600) if i % 2]
    assert all(got[i].predicted == (i % 5 == 0) for i in held)
    assert got[None].predicted == got[1002].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(600) if got[i].predicted == 0] + [1000, 1001, 1003])
    nothing = train_toxicity(df, marks.where("toxic = 0"), F.lit(True))
    assert all(r.predicted == 0 for r in score_toxicity(df, nothing).collect())
    assert score_toxicity(df.limit(0), model).count() == drop_toxic(df.limit(0), model).count() == 0


def test_sample_takes_equal_texts_once(spark):
    docs = spark.createDataFrame([(3, "t", ""), (1, "t", ""), (2, None, ""), (4, "u", ""), (4, "v", "")], DOCS)
    marks = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (2, 1, 1), (4, 1, 1), (5, 1, 1), (None, 1, 1), (6, 1, 0), (6, 1, 1)], MARKS)
    got = labelled_sample(docs, marks, "toxic", F.lit(True), 100)
    assert sorted((r.doc_id, r.text, r.label) for r in got.collect()) == [(1, "t", 0), (4, "u", 1), (4, "v", 1)]
    assert labelled_sample(docs, marks, "toxic", F.lit(True), 2).count() <= 3


def test_bytes_of_the_sample_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "kind ") * 20) for k in range(40)], "doc_id long, text string")
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(40)], "doc_id long, toxic int, quality int")
    full = toxicity.train_toxicity(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)  # nine or ten of the documents
    some = toxicity.train_toxicity(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10)
    none = toxicity.train_toxicity(docs, labels, F.lit(True))
    assert len(full.keys) and len(none.keys) == 0 and len(some.keys) <= len(full.keys)
