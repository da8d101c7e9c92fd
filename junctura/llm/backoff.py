"""Operator 3: language-model scores by a weighted backoff automaton.

States are contexts. A state has an arc for each word that followed it in training, weighted with the word's smoothed
log-probability, and a failure arc to the state of the context without its oldest word, weighted with the log of what is
left to the shorter context. Smoothing interpolates, the shorter context counting as PRIOR words that followed:
``P(w | h) = (c(hw) + PRIOR * P(w | shorter h)) / (c(h) + PRIOR)``; an arc holds the whole sum and the failure arc
log(PRIOR / (c(h) + PRIOR)). Under the one-word contexts stands the root, the empty context: ``P(w) = (c(w) - D) / N``
for known words, and D * V / N for all unknown ones together.

The automaton of a corpus is as large as the corpus, so no task ever holds it: texts are dealt into chunks, each chunk
asks for the counts of the n-grams it can meet (see ``counting``), builds the part of the automaton that its texts can
pass through, and walks them through it from left to right, carrying each text's state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.counting import BUCKET_KEYS, CHUNK_BYTES, REQUEST_SCHEMA, Routes, chunk_count, requests, sum_by_key
from junctura.llm.kernels import combine, mix, release_memory, word_hashes
from junctura.llm.labelled import remainder
from junctura.llm.scratch import materialize, shuffle_partitions

#: Words in an n-gram.
ORDER = 2
#: Words that the shorter context's probabilities count for, against those that followed the context itself.
PRIOR = 5.0
#: Tokens of a text that are walked in one go; the next piece begins by reading the last words of the one before.
PIECE = 256
END, START = (mix(np.array([x], dtype=np.uint64))[0] for x in (0x1E4D, 0x57A7))


@dataclass(frozen=True)
class Corpus:
    """Training tokens, distinct ones, and those seen once and twice."""

    tokens: int
    words: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    @property
    def unknown(self) -> float:
        """The probability of all unknown words together."""
        return self.discount * self.words / self.tokens if self.tokens else 1.0


def token_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, last row, hashes of the tokens (words, then END), first token of each row."""
    for first, last, hashes, of_row in word_hashes(column):
        row = np.arange(last - first)
        tokens = np.empty(len(hashes) + len(row), dtype=np.uint64)
        tokens[np.arange(len(hashes)) + np.repeat(row, np.diff(of_row))] = hashes
        tokens[of_row[1:] + row] = END
        yield first, last, tokens, of_row + np.arange(last - first + 1)


def gram_keys(tokens: np.ndarray, first_of: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order the keys of the n-grams that end at each token; a text is preceded by STARTs."""
    keys, context = [tokens], tokens
    row = np.repeat(np.arange(len(first_of) - 1), np.diff(first_of))
    at = np.arange(len(tokens)) - first_of[:-1][row]  # place in its text
    for n in range(2, order + 1):
        before = np.full(len(tokens), START, dtype=np.uint64)
        ok = at >= n - 1
        before[ok] = tokens[np.flatnonzero(ok) - (n - 1)]
        context = combine(before, context + np.uint64(n))
        keys.append(context)
    return keys


def distinct_weights(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, how often each is counted, and where each of ``keys`` is among them."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counted, minlength=len(distinct)).astype(np.uint64), at


def base_scores(counts: np.ndarray, first_of: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Each text's known tokens and base score; counts: each token's in training."""
    base = np.log10((counts + 0.5) / (corpus.tokens + 0.5 * (corpus.words + 1)))
    return np.add.reduceat((counts > 0).astype(np.int64), first_of[:-1]), np.add.reduceat(base, first_of[:-1])


class Automaton:
    """The part of a corpus's backoff automaton that some texts can pass through.

    at, counts: for n = 1 to order, where the n-gram that ends at each token is among the distinct ones, and how often each
    of these was seen in training. State 0 is the root, state m the start of a text as a context of m words, and the
    n-grams shorter than ``order`` follow. Arcs are kept by ascending state and word.
    """

    def __init__(self, at: list[np.ndarray], counts: list[np.ndarray], first_of: np.ndarray, end: int, corpus: Corpus):
        self.order, self.words = len(at), len(counts[0])
        starts, texts = first_of[:-1], float(counts[0][end])  # as many starts as ends
        base = np.cumsum([0, self.order, *map(len, counts)])  # of the contexts of m words: base[m]
        self.fail, self.fail_weight = np.zeros(base[self.order], np.int64), np.zeros(base[self.order])
        self.unknown = float(np.log10(corpus.unknown))
        with np.errstate(divide="ignore"):
            own = np.log10((counts[0] - corpus.discount) / max(corpus.tokens, 1), where=counts[0] > 0, out=np.zeros(self.words))
        known = np.flatnonzero(counts[0])
        arcs = [(known, base[1] + known if self.order > 1 else np.zeros(len(known), np.int64), own[known])]
        p = np.where(counts[0] > 0, 10**own, corpus.unknown)[at[0]]
        for n in range(2, self.order + 1):
            m = n - 1  # words of the context
            state, seen = np.empty(len(at[0]), np.int64), np.empty(len(at[0]))
            state[1:], seen[1:] = base[m] + at[m - 1][:-1], counts[m - 1][at[m - 1][:-1]]
            state[starts], seen[starts] = m, texts
            self._fail_from(m, base, at, counts, texts)
            p = np.where(seen > 0, (counts[n - 1][at[n - 1]] + PRIOR * p) / (seen + PRIOR), p)
            grams = np.flatnonzero(counts[n - 1])
            where = _first_places(at[n - 1], len(counts[n - 1]))[grams]
            target = base[n] + grams if n < self.order else base[m] + at[m - 1][where]
            arcs.append((state[where] * self.words + at[0][where], target, np.log10(p[where])))
        keys, targets, weights = (np.concatenate(x) for x in zip(*arcs, strict=True))
        del arcs, p
        order = np.argsort(keys)
        self.arcs, self.targets, self.weights = keys[order], targets[order], weights[order]

    def _fail_from(self, m: int, base: np.ndarray, at: list[np.ndarray], counts: list[np.ndarray], texts: float) -> None:
        """Failure arcs from contexts of ``m`` words."""
        self.fail[m] = m - 1
        self.fail_weight[m] = np.log10(PRIOR / (texts + PRIOR)) if texts else 0.0
        here = slice(base[m], base[m] + len(counts[m - 1]))
        if m > 1:
            self.fail[here] = base[m - 1] + at[m - 2][_first_places(at[m - 1], len(counts[m - 1]))]
        self.fail_weight[here] = np.log10(PRIOR / (counts[m - 1] + PRIOR))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Move each state by a word, in place; the weights gathered on the way."""
        gathered, waiting = np.zeros(len(state)), np.arange(len(state))
        while len(waiting):
            key = state[waiting] * self.words + word[waiting]
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            moved, left = waiting[hit], waiting[~hit]
            gathered[moved] += self.weights[arc[hit]]
            state[moved] = self.targets[arc[hit]]
            stuck = state[left] == 0
            gathered[left[stuck]] += self.unknown
            waiting = left[~stuck]
            gathered[waiting] += self.fail_weight[state[waiting]]
            state[waiting] = self.fail[state[waiting]]
        return gathered

    def walk(self, words: np.ndarray, first_of: np.ndarray) -> np.ndarray:
        """Each text's log10 probability. Texts go side by side, a word of each in a step.

        A state depends on the last ``order - 1`` words alone, so a piece of a long text that starts at the root with
        these words is in the right state when its own words begin.
        """
        sizes = np.diff(first_of)
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first_of[:-1][text] + number * PIECE
        read = begin - np.where(number > 0, self.order - 1, 0)
        length = np.minimum(begin + PIECE, first_of[1:][text]) - read
        longest = np.argsort(-length, kind="stable")
        begin, read, length = begin[longest], read[longest], length[longest]
        state = np.where(number[longest] > 0, 0, self.order - 1)
        total = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            going = np.searchsorted(-length, -t, side="left")
            place = read[:going] + t
            weight = self.step(state[:going], words[place])
            total[:going] += np.where(place >= begin[:going], weight, 0.0)
        back = np.empty(len(text))
        back[longest] = total
        return np.bincount(text, back, minlength=len(sizes))


def _first_places(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` distinct values comes first."""
    places = np.zeros(n, np.int64)
    places[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    return places


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to be shuffled twice."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array([press(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        yield batch.set_column(2, "text", texts)


def _chunk_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a chunk's texts, and the first of each text (one entry more than texts)."""
    decompress = zstandard.ZstdDecompressor().decompress
    parts, first_of, count = [], [np.zeros(1, np.int64)], 0
    texts = pa.array([decompress(t.as_py()) for t in table.column("text")], pa.binary())
    for _, _, tokens, firsts in token_hashes(texts.cast(pa.string())):
        parts.append(tokens)
        first_of.append(firsts[1:] + count)
        count += len(tokens)
    return np.concatenate(parts), np.concatenate(first_of)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    ``train`` is a condition on ``id_col``: rows for which it holds are counted, the others are held out, and where it is
    null the row is held out. Both scores are log10 probabilities of the whole text with its end; the base score is that
    of single tokens with half a count added.

    * null and empty texts consist of their end;
    * null and repeated ids are passed on, and rows that repeat a text are counted as often as they come;
    * without training texts every token is unknown, with probability 1 in ``score``;
    * an empty table gives an empty result; only the two named columns are read.

    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    chunks = chunk_count(docs, text_col)
    routes = Routes.to(max(shuffle_partitions(spark), chunks * CHUNK_BYTES // (8 * BUCKET_KEYS)))
    held = ~F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    # A row's chunk depends on the row alone, so both passes, and tasks that are run again, make the same chunks.
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(chunks))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select(chunk.alias("chunk"), "doc_id", "text", "held_out").mapInArrow(_compressed, f"chunk long, doc_id {id_type}, text binary, held_out boolean")

    def counts_of(table: pa.Table, tokens: np.ndarray, first_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        counted = np.repeat(~np.asarray(table.column("held_out")), np.diff(first_of))
        for keys in gram_keys(tokens, first_of, order):
            yield distinct_weights(keys, counted)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        asked = [requests(key[0].as_py(), distinct, weights, routes.group_width, n * routes.groups) for n, (distinct, weights, _) in enumerate(counts_of(table, *_chunk_tokens(table)))]
        release_memory()
        return pa.Table.from_batches(asked)

    asked = dealt.groupBy("chunk").applyInArrow(ask, REQUEST_SCHEMA)
    answers = materialize(sum_by_key(asked, routes, aligned=True), "ngram-counts")
    corpus = _corpus(answers.where((F.col("chunk") < 0) & (F.col("bucket") < routes.buckets)))

    def score(key: tuple, table: pa.Table, news: pa.Table) -> pa.Table:
        tokens, first_of = _chunk_tokens(table)
        news = news.to_pandas()
        places, counts = [], []
        for n, (distinct, weights, at) in enumerate(counts_of(table, tokens, first_of)):
            own = news[news["bucket"] // routes.groups == n].sort_values("bucket")  # a bucket is a range of keys
            sums = np.frombuffer(b"".join(own["sums"]), dtype=np.uint64)
            if len(sums) != len(distinct):
                raise RuntimeError(f"chunk {key[0]}: {len(distinct)} n-grams, but {len(sums)} answers")
            places.append(at)
            counts.append(np.where(sums > 0, sums, weights).astype(np.int64))
        del news, own, sums, distinct, weights, at  # what follows needs as much again
        known, base = base_scores(counts[0][places[0]], first_of, corpus)
        end = places[0][first_of[1] - 1]  # a text's last token
        score = Automaton(places, counts, first_of, end, corpus).walk(places[0], first_of)
        del places, counts
        release_memory()  # a worker goes on to the next chunk
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": np.diff(first_of), "n_known": known,
            "train_tokens": np.full(len(known), corpus.tokens), "base_score": base, "score": score,
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = answers.where("chunk >= 0")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)


def _corpus(facts: DataFrame) -> Corpus:
    """The sums of the buckets' facts, added up by Spark."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch["sums"]), dtype=np.uint64).reshape(-1, 4).astype(np.int64)
            yield pd.DataFrame(numbers, columns=["tokens", "words", "once", "twice"])

    total = facts.select("sums").mapInPandas(unpacked, "tokens long, words long, once long, twice long").groupBy().sum().first()
    return Corpus(*(int(x or 0) for x in total))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, remainder(F.col("doc_id"), 5) != 1)
