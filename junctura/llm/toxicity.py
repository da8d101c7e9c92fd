"""Operator 4: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of lower-cased words with a space at either end; a document has a feature or hasn't. Its value
is the feature's log-count ratio between the two classes, and logistic regression over those values gives the weights.
Only n-grams whose ratio stands out from chance are kept, so that long documents gather no noise; of these, all are.

An n-gram goes by a 64-bit hash of its characters, found for all places of many texts at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.kernels import mix, release_memory
from junctura.llm.labelled import labelled_sample, remainder
from junctura.llm.scratch import materialize

#: Labelled documents that training looks at, and bytes of their texts together, at most.
SAMPLE_DOCS, SAMPLE_BYTES = 20_000, 100_000_000
#: Lengths of n-grams, which all from the least to the greatest are.
NGRAMS = (3, 4, 5, 6)
#: Standard errors by which an n-gram's shares of the classes must differ, and in how many documents it must be.
MIN_Z, MIN_COUNT, MIN_SHARE = 5.0, 5, 0.0005
#: Characters whose n-grams are hashed at a time, texts taken together, and bits of the table that is looked at first.
PLACES, TOGETHER, TABLE_BITS = 1 << 19, 500, 20
#: Distinct n-grams of documents that a task gathers before it adds them up.
GATHERED = 1 << 22
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(NGRAMS[-1])]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of lower-cased texts, each word with one space beside it, and where each text starts."""
    plain = [f" {' '.join(t.lower().split())} " for t in texts]
    starts = np.cumsum([0, *map(len, plain)])
    return np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32), starts


def gram_keys(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of n-grams within words; two texts meet in two spaces, which no n-gram spans."""
    longest = NGRAMS[-1]
    for at in range(0, len(chars), PLACES):
        part = chars[at : at + PLACES + longest - 1].astype(np.uint64)
        spaces = np.cumsum(np.append(0, part == 32))
        value = part
        for n in range(2, longest + 1):
            value = value[:-1] + part[n - 1 :] * np.uint64(_POWERS[n - 1])
            if n >= NGRAMS[0]:
                places = np.flatnonzero(spaces[n - 1 : n - 1 + len(value)] == spaces[1 : 1 + len(value)])
                places = places[places < PLACES]
                yield places + at, mix(value[places] + np.uint64(n))


def document_grams(text: str) -> np.ndarray:
    """The hashes of a text's n-grams, ascending and each once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys for _, keys in gram_keys(characters([text])[0]))]))


class NgramModel:
    """A bias and the weights of n-grams, these by ascending hash."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's features: numbers of texts, ascending, and of features."""
        chars, starts = characters(texts)
        found = [np.zeros(0, np.int64)]
        if len(self.keys):
            for places, keys in gram_keys(chars):
                likely = np.flatnonzero(self.table[self._slot(keys)])
                places, keys = places[likely], keys[likely]
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                known = self.keys[at] == keys
                rows = np.searchsorted(starts, places[known], side="right") - 1
                found.append(rows * len(self.keys) + at[known])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.keys)))

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, features = self.features(texts)
        x = self.bias + np.bincount(rows, self.weights[features], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on a sparse matrix by Adam steps over all rows; deterministic."""
    w, bias, n = np.zeros(n_features), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), max(1, len(y))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(rows, values * w[cols], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y
        gradient = np.append(np.bincount(cols, values * error[rows], minlength=n_features) / n + l2 * w, error.sum() / n)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


class _Tally:
    """Documents of one class that have each n-gram, added up now and then."""

    def __init__(self) -> None:
        self.keys, self.counts, self.gathered = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.gathered.append(keys)
        if sum(map(len, self.gathered)) > GATHERED:
            self.settle()

    def settle(self) -> None:
        keys, at = np.unique(np.concatenate([self.keys, *self.gathered]), return_inverse=True)
        ones = np.ones(len(at) - len(self.keys), np.int64)
        self.keys, self.counts, self.gathered = keys, np.bincount(at, np.append(self.counts, ones), minlength=len(keys)).astype(np.int64), []


def gram_ratios(sample: DataFrame, bad: int, good: int) -> DataFrame:
    """``key, p, q, ratio, z``: of each n-gram the toxic and other documents that have it, the log-count ratio with half a
    document added, and the standard errors between its shares of both; ``bad`` and ``good`` are the classes' sizes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = _Tally(), _Tally()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                tallies[int(label == 1)].add(document_grams(text))
        for c, tally in enumerate(tallies):
            tally.settle()
            for k in range(0, len(tally.keys), 1 << 17):
                keys = tally.keys[k : k + (1 << 17)].view(np.int64)
                yield pd.DataFrame({"key": keys, "c": np.full(len(keys), c, np.int32), "n": tally.counts[k : k + len(keys)]})
        del tallies
        release_memory()

    def of(c: int) -> Column:
        return F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0))

    grams = sample.select("text", "label").mapInPandas(count, "key long, c int, n long").groupBy("key").agg(of(1).alias("p"), of(0).alias("q"))
    p, q = F.col("p") + 0.5, F.col("q") + 0.5
    ratio = F.log(p / (bad + 1)) - F.log(q / (good + 1))
    share = (F.col("p") + F.col("q")) / (bad + good)
    apart = F.abs(F.col("p") / bad - F.col("q") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    return grams.select("key", "p", "q", ratio.alias("ratio"), F.when(share < 1, apart).otherwise(0.0).alias("z"))


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> NgramModel:
    """Fit on at most ``sample_docs`` labelled documents of SAMPLE_BYTES together; n-grams are counted by Spark, the weights fitted on the driver.

    The driver gets the n-grams that stand out, each in a share of the sample's documents or more, and which of them each
    document has, never a text. Without labelled documents of both classes the model knows no n-gram and scores every
    text with the labels' share.
    """
    drawn = materialize(labelled_sample(docs, labels, "toxic", usable, sample_docs), "toxicity-sample")
    # At most sample_docs rows of three numbers each, so one task may order them.
    sized = drawn.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sized.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "h")
    sample = drawn.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"], "left_semi").drop("h")
    sizes = {r["c"]: r["n"] for r in sample.groupBy(F.when(F.col("label") == 1, 1).otherwise(0).alias("c")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return NgramModel(np.zeros(0, np.uint64), np.zeros(0), math.log((bad + 1) / (good + 1)))
    often = F.col("p") + F.col("q") >= max(MIN_COUNT, MIN_SHARE * (bad + good))
    kept = gram_ratios(sample, bad, good).where(often & (F.col("z") >= MIN_Z)).select("key", "ratio").toPandas()
    kept = kept.assign(key=kept["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    keys, scale = kept["key"].to_numpy(), kept["ratio"].to_numpy()

    def having(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = NgramModel(keys, scale, 0.0)
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.iloc[k : k + TOGETHER]
                rows, features = model.features(part["text"].to_list())
                cuts = np.searchsorted(rows, np.arange(1, len(part)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "have": [x.astype(np.int32).tobytes() for x in np.split(features, cuts)]})

    have = sorted(sample.mapInPandas(having, "doc_id long, label int, have binary").collect(), key=lambda r: (r["doc_id"], bytes(r["have"])))
    lists = [np.frombuffer(r["have"], dtype=np.int32) for r in have]
    rows, cols = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    w, bias = fit_logistic(rows, cols, scale[cols], np.array([float(r["label"] == 1) for r in have]), len(keys))
    return NgramModel(keys, w * scale, bias)


def score_toxicity(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, one row per input row.

    * null and empty texts get the score of a text without known n-grams;
    * null and repeated ids are passed on; only the two named columns are read;
    * rows are independent of each other, so nothing is shuffled.
    """
    shipped = _ship(docs, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = NgramModel(*shipped.value)
        for texts in batches:
            parts = [local.scores(texts.iloc[k : k + TOGETHER].to_list()) for k in range(0, len(texts), TOGETHER)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))
        del local
        release_memory()

    out = rows.select(F.col("doc_id").cast(id_type), scored("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _ship(docs: DataFrame, model: NgramModel) -> Broadcast:
    """The model's numbers, 16 bytes for each n-gram that stands out in the sample."""
    return docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))


def drop_toxic(docs: DataFrame, model: NgramModel, text_col: str = "text") -> DataFrame:
    """The input rows that the model doesn't find toxic, columns as given, whatever their names.

    Null texts count as empty; empty texts have no n-gram and stay unless most of the sample was toxic; rows that repeat
    each other share their fate; an empty table gives an empty result.
    """
    shipped = _ship(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = NgramModel(*shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                yield part.filter(pa.array(local.scores([t or "" for t in part.column(text_col).to_pylist()]) < 0.5))
        del local
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train_toxicity(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
