"""The line-chain classifier: marginals against enumeration, learnable lines, and edge cases."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.llm import quality
from junctura.llm.quality import Chains, QualityModel, keep_good, line_features, score_quality, train_quality

DOCS = "doc_id long, text string, score string"


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 2]
    first_of = np.cumsum([0, *sizes])
    emission, transition = rng.normal(size=first_of[-1]), rng.normal(size=(2, 2))
    good, pairs, log_z = Chains(first_of).marginals(emission, transition)
    want_pairs, want_z = np.zeros((2, 2)), 0.0
    for a, n in zip(first_of[:-1], sizes, strict=True):
        if not n:
            continue
        weights = {}
        for labels in itertools.product((0, 1), repeat=n):
            x = sum(emission[a + t] for t in range(n) if labels[t]) + sum(transition[labels[t], labels[t + 1]] for t in range(n - 1))
            weights[labels] = math.exp(x)
        z = sum(weights.values())
        want_z += math.log(z)
        for t in range(n):
            assert good[a + t] == pytest.approx(sum(w for labels, w in weights.items() if labels[t]) / z)
        for labels, w in weights.items():
            for t in range(n - 1):
                want_pairs[labels[t], labels[t + 1]] += w / z
    assert pairs == pytest.approx(want_pairs) and log_z == pytest.approx(want_z)


def test_length_weighted_shares():
    features, lengths, first_of = line_features(pa.array(["aaaa\nBB!!", None, "\n\n", "x"]))
    assert lengths.tolist() == [4, 4, 1] and first_of.tolist() == [0, 2, 2, 2, 3]
    weights = np.zeros(features.shape[1])
    weights[0] = 1.5  # the constant: every line alike
    share = QualityModel(weights, np.zeros((2, 2)), 1.0, 0.0, 0.5).shares(features, lengths, first_of)
    assert share[[0, 3]] == pytest.approx(1 / (1 + math.exp(-1.5))) and np.isnan(share[1:3]).all()


def prose(rng, n):
    return " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dogs", "ran"]) for _ in range(n)).capitalize() + "."


def test_quality_learns_lines(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        lines = [prose(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            junk = rng.choice([lambda: "BUY NOW!! " * 12, lambda: "word | " * 15, lambda: "same same " * 12])
            lines[rng.randrange(len(lines)) :] = [junk() for _ in range(rng.randint(2, 9))]
        docs.append((i, "\n".join(lines), ""))
        labels.append((i, int(i % 3 != 0), 0))
    docs += [(1000, None, ""), (1001, "", ""), (1002, "\n\n", ""), (None, prose(rng, 9), ""), (1003, "x" * 200_000, "")]
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_quality(df, marks, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in score_quality(df, model).collect()}
    held = [i for i in range(400) if i % 2]
    assert sum(got[i].predicted == (i % 3 != 0) for i in held) / len(held) > 0.95
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score == got[1002].score
    nothing = train_quality(df, marks.limit(0), F.lit(True))
    assert {r.score for r in score_quality(df, nothing).collect()} == {0.5}
    assert score_quality(df.limit(0), model).count() == 0
    repeated = spark.createDataFrame([(1, "\n".join(["BUY NOW!! " * 12] * 8), "a"), (1, prose(rng, 40), "b"), (2, None, "c")], DOCS)
    scores = {(r.doc_id, r.predicted) for r in score_quality(repeated, model).collect()}
    assert {(1, 0), (1, 1)} <= scores
    kept = keep_good(repeated, model)
    assert kept.columns == repeated.columns and {r.score for r in kept.collect()} >= {"b"} and "a" not in {r.score for r in kept.collect()}
    assert keep_good(repeated.limit(0), model).count() == 0


def test_training_lines_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 40)
    monkeypatch.setattr(quality, "DOC_LINES", 15)
    seen = []
    monkeypatch.setattr(quality, "fit_quality", lambda features, lengths, first_of, labels: seen.append((len(features), len(labels))))
    docs = [(i, "\n".join([f"line {i} {k}" for k in range(10 if i else 16)]), "") for i in range(20)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    train_quality(spark.createDataFrame(docs, DOCS), marks, F.lit(True))
    assert seen == [(40, 4)]
