"""Words tagged by language: marginals against enumeration, features against strings, held-out languages and edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.llm import langtags
from junctura.llm.kernels import text_bytes
from junctura.llm.langtags import BUCKETS, Chains, fit_languages, identify_languages, op11_language, tag_words, text_words, train_languages

DOCS = "doc_id long, text string, lang string, lang_pred string"
WORDS = {
    "aa": ["the", "house", "river", "walking", "stone", "over", "under", "garden"],
    "bb": ["und", "schloss", "straße", "gehen", "stein", "über", "unter", "garten"],
    "cc": ["y", "casa", "ríos", "andando", "piedra", "sobre", "debajo", "jardín"],
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_marginals_against_all_labellings(monkeypatch):
    rng = np.random.default_rng(2)
    sizes, k = [4, 0, 1, 6], 3
    first_of = np.cumsum([0, *sizes])
    emission, transition = 2 * rng.normal(size=(first_of[-1], k)), rng.normal(size=(k, k))
    want, want_pairs = np.zeros_like(emission), np.zeros((k, k))
    for a, n in zip(first_of[:-1], sizes, strict=True):
        if not n:
            continue
        weight = {x: np.exp(sum(emission[a + t, x[t]] for t in range(n)) + sum(transition[x[t], x[t + 1]] for t in range(n - 1))) for x in itertools.product(range(k), repeat=n)}
        z = sum(weight.values())
        for x, w in weight.items():
            for t in range(n):
                want[a + t, x[t]] += w / z
            for t in range(n - 1):
                want_pairs[x[t], x[t + 1]] += w / z
    for block in (1, 2, 32):
        monkeypatch.setattr(langtags, "BLOCK", block)
        got, pairs = Chains(first_of).marginals(emission, transition)
        assert got == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_long_chains_keep_their_messages():
    n = 5000
    emission = np.zeros((n, 2))
    emission[0, 1] = 3.0  # one word decides where words hold together
    got, _ = Chains(np.array([0, n])).marginals(emission, np.log(np.array([[1, 1e-9], [1e-9, 1]])))
    assert got[-1, 1] == pytest.approx(1 / (1 + np.exp(-3)), rel=1e-3)


def test_features_and_their_gradient():
    data, offsets = text_bytes(pa.array(["Ab ab", None, "12", "ab-xyzzy"]))
    words, which, starts, ends, first_of = text_words(data, offsets)
    assert first_of.tolist() == [0, 2, 2, 2, 4] and len(set(which[[0, 1, 2]])) == 1 and which[3] != which[0]
    sizes = {int(which[0]): 2, int(which[3]): 5}
    for word, size in sizes.items():
        mine = words.grams[words.starts[word] :][: size + 2]
        assert (mine != BUCKETS).sum() == sum(size + 2 - n + 1 for n in langtags.ORDERS if n <= size + 2)
        assert (words.rest[word] != BUCKETS).sum() == 1 + 2 * sum(n <= size for n in langtags.AFFIXES)
    rng = np.random.default_rng(0)
    weights, ahead = rng.normal(size=(BUCKETS + 1, 2)), rng.normal(size=(2, 2))
    weights[BUCKETS] = 0
    slope = rng.normal(size=(BUCKETS + 1, 2))
    slope[BUCKETS] = 0
    assert (words.scores(weights + slope) * ahead).sum() - (words.scores(weights) * ahead).sum() == pytest.approx((words.gradient(ahead) * slope).sum())


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    texts, labels = zip(*[(prose(rng, lang, rng.randint(5, 60)), lang) for _ in range(60) for lang in WORDS], strict=True)
    return fit_languages(list(texts), list(labels))


def test_code_switched_text(spark, model):
    docs = spark.createDataFrame([(1, "the stone house, über die straße gehen und walking over the river", "", ""), (2, None, "", ""), (3, "123", "", "")], DOCS)
    got = {r["doc_id"]: r["words"] for r in tag_words(docs, model).collect()}
    tags = {w["word"]: w["lang"] for w in got[1]}
    assert [tags[w] for w in ("the", "stone", "straße", "gehen", "walking", "river")] == ["aa", "aa", "bb", "bb", "aa", "aa"]
    assert all(0 <= w["p"] <= 1 for w in got[1]) and got[2] == got[3] == []


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 345 .,!"), (4, "– … €"), (5, "the garden"), (5, "jardín y casa"), (None, "schloss"), (6, "und " * 40_000), (7, "漢字"), (8, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "zz", "clash") for i, t in rows], DOCS).repartition(3)
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in identify_languages(docs, model).collect())
    assert [x[:2] for x in got if x[0] not in (7, 8)] == [(0, "bb"), (1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "aa"), (5, "cc"), (6, "bb")]
    assert all(lang in WORDS for i, lang, _ in got if i in (7, 8)) and all(0 <= s <= 1 for *_, s in got)
    none = train_languages(docs, F.col("doc_id") < 0)
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(docs, none).collect()} == {("und", 0.0)}
    one = train_languages(docs, F.col("doc_id") == 5)
    assert {r["lang_pred"] for r in identify_languages(docs, one).collect()} == {"zz", "und"}
    assert identify_languages(docs.limit(0), model).collect() == []
    many = spark.createDataFrame([(k, "a", f"l{k}", "") for k in range(100)], DOCS)
    with pytest.raises(ValueError, match="languages"):
        train_languages(many, F.lit(True))


def test_training_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, prose(rng, lang, 20), lang, "") for k, lang in enumerate(list(WORDS) * 10)] + [(900, None, "aa", ""), (None, "a", "aa", ""), (901, "casa", None, "")], DOCS)
    one, two = (train_languages(d, F.col("doc_id") != 7) for d in (docs.repartition(1), docs.repartition(5)))
    assert one.languages == two.languages == ["aa", "bb", "cc"] and (one.weights == two.weights).all() and (one.transition == two.transition).all()


def test_held_out_languages(spark):
    path = "/root/testdata/sf0.01"
    got = op11_language(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
