"""Operator 2: document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines beside it. Forward-backward gives each
line's probability to be good; their mean, weighted by line length, is the document's share of good text, which a
logistic curve turns into the probability that the document is labelled good.

Labels exist for documents only. For training, lines of good documents count as good; in bad documents a line-wise
classifier decides first which lines are the bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.kernels import hash_words, release_memory, slices, split_words, text_bytes
from junctura.llm.labelled import labelled_sample, remainder
from junctura.llm.scratch import materialize

#: Labelled documents that training looks at, at most; lines of all of them, which the driver holds the features of, and
#: lines of one (documents with more are not taken for training).
SAMPLE_DOCS, SAMPLE_LINES, DOC_LINES = 4_000, 400_000, 20_000

_CLASSES = ("upper", "letter", "digit", "bang", "mark", "bar", "punct")
N_OWN = 10
N_FEATURES = 1 + 3 * N_OWN


def _class_tables() -> dict[str, np.ndarray]:
    code = np.arange(256)
    upper, lower = (code >= 65) & (code <= 90), ((code >= 97) & (code <= 122)) | (code >= 128)
    digit, bang = (code >= 48) & (code <= 57), code == ord("!")
    mark, bar = np.isin(code, list(b"*$%&#@^~=<>")), np.isin(code, list(b"|\\/{}[]_"))
    printable = (code > 32) & (code < 127)
    return {"upper": upper, "letter": upper | lower, "digit": digit, "bang": bang, "mark": mark, "bar": bar, "punct": printable & ~(upper | lower | digit | bang | mark | bar)}


_TABLES = _class_tables()


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that has bytes, its length, and the first line of each row (one entry more than rows)."""
    data, offsets = text_bytes(column)
    features, lengths, first_of = [np.zeros((0, N_FEATURES))], [np.zeros(0)], [np.zeros(1, np.int64)]
    count = 0
    for first, last in slices(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        breaks = np.flatnonzero(part == 10)
        starts = np.union1d(at[:-1], breaks + 1)
        starts = starts[starts < len(part)]
        stops = np.append(starts[1:], len(part))[: len(starts)]
        stops = stops - (part[stops - 1] == 10)  # without the line feed
        filled = stops > starts
        starts, stops = starts[filled], stops[filled]
        of_row = np.searchsorted(starts, at)
        own = _own_features(part, at, starts, stops)
        row = np.repeat(np.arange(len(at) - 1), np.diff(of_row))
        above, below = np.zeros_like(own), np.zeros_like(own)
        same = row[1:] == row[:-1]
        above[1:][same], below[:-1][same] = own[:-1][same], own[1:][same]
        features.append(np.hstack([np.ones((len(own), 1)), own, above, below]))
        lengths.append((stops - starts).astype(float))
        first_of.append(of_row[1:] + count)
        count += len(starts)
    return np.concatenate(features), np.concatenate(lengths), np.concatenate(first_of)


def _own_features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = {}
    for name in _CLASSES:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_TABLES[name][data], out=total[1:])
        sums[name] = (total[stops] - total[starts]).astype(float)
    w_starts, w_ends, _ = split_words(data, offsets)
    hashes = hash_words(data, w_starts, w_ends)
    again = np.zeros(len(hashes) + 1)
    if len(hashes) > 1:
        np.cumsum(hashes[1:] == hashes[:-1], out=again[2:])
    lo, hi = np.searchsorted(w_starts, starts), np.searchsorted(w_starts, stops)
    words = (hi - lo).astype(float)
    repeats = np.where(hi > lo, again[hi] - again[np.minimum(lo + 1, hi)], 0.0)
    per_word, length = 1 / np.maximum(words, 1), (stops - starts).astype(float)
    return np.column_stack([
        sums["upper"] / np.maximum(sums["letter"], 1),
        np.minimum(sums["bang"] * per_word, 2),
        np.minimum(sums["mark"] * per_word, 3),
        np.minimum(sums["bar"] * per_word, 2),
        repeats * per_word,
        sums["digit"] / np.maximum(length, 1),
        np.minimum(sums["punct"] * per_word, 2),
        1 - sums["letter"] / np.maximum(length - words, 1),
        np.log1p(length) / 10,
        np.minimum(length * per_word, 30) / 10,
    ])


class Chains:
    """Rows' lines laid out step by step: all first lines, then all second lines, the longest rows first."""

    def __init__(self, first_of: np.ndarray):
        sizes = np.diff(first_of)
        order = np.argsort(-sizes, kind="stable")
        ordered, firsts = sizes[order], first_of[:-1][order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")  # rows with more than t lines
        self.steps = [firsts[:n] + t for t, n in enumerate(self.active)]

    def marginals(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transition counts, and the summed log partition. emission: log-odds of good."""
        n = len(emission)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        pairs, log_z = np.zeros((2, 2)), 0.0
        e = np.column_stack([np.zeros(n), emission])
        for t, at in enumerate(self.steps):
            forward[at] = e[at]
            if t:
                a = forward[self.steps[t - 1][: len(at)]]
                forward[at] += np.logaddexp(a[:, :1] + transition[0], a[:, 1:] + transition[1])
        for t in range(len(self.steps) - 1, 0, -1):
            at, before = self.steps[t], self.steps[t - 1][: len(self.steps[t])]
            b = e[at] + backward[at]
            backward[before] = np.logaddexp(transition[:, 0] + b[:, :1], transition[:, 1] + b[:, 1:])
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        for t in range(1, len(self.steps)):
            at, before = self.steps[t], self.steps[t - 1][: len(self.steps[t])]
            joint = forward[before][:, :, None] + transition[None] + (e[at] + backward[at])[:, None, :] - z[at][:, None, None]
            pairs += np.exp(joint).sum(0)
        if self.steps:
            log_z = float(z[self.steps[0]].sum())
        return np.exp(both[:, 1] - z), pairs, log_z


@dataclass
class QualityModel:
    """Weights of a line's log-odds, of the transitions (from, to; 0 bad, 1 good), and of the final logistic curve."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float
    empty: float

    def shares(self, features: np.ndarray, lengths: np.ndarray, first_of: np.ndarray) -> np.ndarray:
        """Each row's length-weighted mean probability of a good line; nan for rows without lines."""
        good, _, _ = Chains(first_of).marginals(features @ self.weights, self.transition)
        total = np.append(0, np.cumsum(lengths * good))[first_of]
        weight = np.append(0, np.cumsum(lengths))[first_of]
        with np.errstate(invalid="ignore"):
            return np.diff(total) / np.diff(weight)

    def scores(self, column: pa.Array) -> np.ndarray:
        share = self.shares(*line_features(column))
        x = self.slope * np.nan_to_num(share) + self.offset
        return np.where(np.isnan(share), self.empty, 1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * len(y) * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - l2 * len(y) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_quality(features: np.ndarray, lengths: np.ndarray, first_of: np.ndarray, labels: np.ndarray, steps: int = 150) -> QualityModel:
    """Fit the field and the final curve to labelled rows; deterministic."""
    mean = (labels.sum() + 1) / (len(labels) + 2)
    sizes = np.diff(first_of)
    if not len(features) or labels.min() == labels.max():
        return QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(mean / (1 - mean))), float(mean))
    row = np.repeat(np.arange(len(labels)), sizes)
    truth = labels[row].astype(float)
    balance = np.where(truth == 1, 0.5 / max(1, truth.sum()), 0.5 / max(1, len(truth) - truth.sum())) * len(truth)
    line_wise = _logistic(features, truth, balance)
    good = features @ line_wise > 0
    some_bad = np.bincount(row, ~good, minlength=len(labels)) > 0
    state = np.where(truth == 1, 1, np.where(some_bad[row], good, 0)).astype(int)
    # Conditional likelihood of these line labels, by Adam.
    chains = Chains(first_of)
    same = row[1:] == row[:-1]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (state[:-1][same], state[1:][same]), 1)
    theta = np.append(_logistic(features, state.astype(float)), np.zeros(4))
    target = np.append(features.T @ state, seen_pairs.ravel())
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(features)
    for k in range(1, steps + 1):
        p, pairs, _ = chains.marginals(features @ theta[:-4], theta[-4:].reshape(2, 2))
        gradient = (target - np.append(features.T @ p, pairs.ravel())) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    model = QualityModel(theta[:-4], theta[-4:].reshape(2, 2), 0.0, 0.0, float(mean))
    share = model.shares(features, lengths, first_of)
    usable = ~np.isnan(share)
    curve = _logistic(np.column_stack([share[usable], np.ones(usable.sum())]), labels[usable].astype(float), l2=1e-5)
    model.slope, model.offset = float(curve[0]), float(curve[1])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on at most ``sample_docs`` labelled documents of at most DOC_LINES lines each; the driver gets the features of at
    most SAMPLE_LINES of their lines, not their texts."""
    sample = labelled_sample(docs, labels, "quality", usable, sample_docs)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, lengths, first_of = line_features(batch.column(1))
            blobs = [features[a:b].astype(np.float32).tobytes() for a, b in zip(first_of[:-1], first_of[1:], strict=True)]
            sizes = [lengths[a:b].astype(np.float32).tobytes() for a, b in zip(first_of[:-1], first_of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "label", "x", "n"])

    lines = materialize(sample.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(extract, "doc_id long, label int, x binary, n binary"), "quality-sample")
    # At most sample_docs rows of three numbers each, so one task may order them; features are fetched for those chosen.
    sized = lines.withColumn("lines", F.length("n") / 4).withColumn("h", F.xxhash64("x")).where(F.col("lines") <= DOC_LINES)
    so_far = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sized.select("doc_id", "h", "lines").withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_LINES)
    got = sized.join(F.broadcast(chosen.select("doc_id", "h")), ["doc_id", "h"], "left_semi").select("doc_id", "label", "x", "n").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    n = [np.frombuffer(r["n"], dtype=np.float32) for r in got]
    first_of = np.cumsum([0, *map(len, x)])
    features = np.concatenate(x).astype(float) if x else np.zeros((0, N_FEATURES))
    lengths = np.concatenate(n).astype(float) if n else np.zeros(0)
    return fit_quality(features, lengths, first_of, np.array([int(r["label"] == 1) for r in got], dtype=int))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, one row per input row.

    * null texts, empty ones and those of line feeds alone get the share of good documents in training;
    * null and repeated ids are passed on; only the two named columns are read;
    * rows are independent of each other, so nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                score = model.scores(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The input rows that the model accepts, columns as given, whatever their names.

    Null texts, empty ones and those of line feeds alone are accepted if most of the training documents were good; rows that
    repeat each other share their fate; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                yield part.filter(pa.array(model.scores(part.column(text_col)) >= 0.5))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return score_quality(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
