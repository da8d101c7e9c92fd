"""Operator 11: language identification by a linear-chain conditional random field over words.

Every word is labelled with a language from its affixes, its character n-grams and itself (lexicon), and from the words beside
it by learned transitions, so that text which switches between languages is labelled stretch by stretch. Forward-backward
gives each word's probabilities; their mean, weighted by word length, is each language's share of a document.

Labels exist for documents only. Training takes all words of a document as its language first; words that are then found to
belong to another one with high probability, as quotations and licence lines are, take that label, and weights and
transitions are fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.kernels import LOWER, hash_words, release_memory, slices, split_words, text_bytes
from junctura.llm.labelled import remainder

#: Languages that a model may have. Bytes of text a language is learned from (passed by the last document at most), and the
#: longest document that takes part in training. The driver holds that much text of each language.
MAX_LANGUAGES, LANGUAGE_BYTES, DOCUMENT_BYTES = 64, 400_000, 1_000_000
#: Rows of weights that features are hashed into.
BUCKETS = 1 << 18
#: Orders of n-grams, a mark at both ends of a word included; bytes of longer affixes.
ORDERS, AFFIXES = (2, 3, 4), (4, 5)
#: Words of a chain that one lane takes.
BLOCK = 32
_NO_LETTER = ~((np.arange(256) >= 128) | ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122))
_MULTIPLIER, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Rows of weights for hashes of one kind of feature."""
    mixed = (hashes ^ np.uint64(kind * 0x51ED270B)) * _SPREAD
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Words:
    """Distinct words: rows of weights of their n-grams, byte by byte, and of their affixes and themselves."""

    grams: np.ndarray  # (bytes with marks, orders); BUCKETS where there is none
    starts: np.ndarray  # of each word in them
    rest: np.ndarray  # (words, affixes and lexicon)

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Words:
        sizes = ends - starts + 2
        stops = np.cumsum(sizes)
        begin = stops - sizes
        total = int(stops[-1]) if len(stops) else 0
        chars = np.zeros(total + max(ORDERS), dtype=np.uint64)
        inside = np.ones(total, dtype=bool)
        inside[begin] = inside[stops - 1] = False
        source = np.arange(total) - np.repeat(begin, sizes) + np.repeat(starts, sizes) - 1
        chars[:total][inside] = LOWER[data[source[inside]]]
        chars[begin], chars[stops - 1] = 1, 2
        left = np.repeat(stops, sizes) - np.arange(total)
        grams, h = np.empty((total, len(ORDERS)), dtype=np.int32), chars[:total].copy()
        for n in range(2, max(ORDERS) + 1):
            h = h * _MULTIPLIER + chars[n - 1 : total + n - 1]
            if n in ORDERS:
                grams[:, ORDERS.index(n)] = np.where(left >= n, _bucket(h, n), BUCKETS)
        rest = [_bucket(hashes, 11)]
        for n in AFFIXES:
            long = sizes - 2 >= n
            first, last = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            for k in range(n):
                first = first * _MULTIPLIER + chars[np.minimum(begin + 1 + k, stops - 1)]
                last = last * _MULTIPLIER + chars[np.maximum(stops - 1 - n + k, begin)]
            rest += [np.where(long, _bucket(first, 20 + n), BUCKETS), np.where(long, _bucket(last, 40 + n), BUCKETS)]
        return cls(grams, begin, np.column_stack(rest))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Summed weights of each word; the last row of weights is nothing."""
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]))
        grams = weights[self.grams[:, 0]]
        for k in range(1, self.grams.shape[1]):
            grams += weights[self.grams[:, k]]
        return np.add.reduceat(grams, self.starts, axis=0) + weights[self.rest].sum(1)

    def gradient(self, of_word: np.ndarray) -> np.ndarray:
        """What a gradient by the words' scores is by the weights."""
        sizes = np.diff(np.append(self.starts, len(self.grams)))
        out = np.empty((BUCKETS + 1, of_word.shape[1]))
        for k in range(of_word.shape[1]):
            each = np.repeat(of_word[:, k], sizes)
            out[:, k] = np.bincount(self.rest.ravel(), np.repeat(of_word[:, k], self.rest.shape[1]), BUCKETS + 1)
            for j in range(self.grams.shape[1]):
                out[:, k] += np.bincount(self.grams[:, j], each, BUCKETS + 1)
        out[BUCKETS] = 0
        return out


class Chains:
    """Rows' words cut into blocks, which are walked in step.

    The product of a block's step matrices carries a message over it, so messages first pass from block to block, then all
    blocks are filled at once: a row of a hundred thousand words takes a few thousand steps.
    """

    def __init__(self, first_of: np.ndarray):
        sizes = np.diff(first_of)
        many = -(-sizes // BLOCK)
        self.row = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = first_of[:-1][self.row] + nth * BLOCK
        self.stop = np.minimum(self.start + BLOCK, first_of[1:][self.row])
        self.opens = nth == 0
        order = np.argsort(nth, kind="stable")
        self.waves = np.split(order, np.cumsum(np.bincount(nth))[:-1]) if len(nth) else []
        self.first_of = first_of

    def marginals(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of each word, and expected counts of transitions (from, to)."""
        n, k = emission.shape
        e = np.exp(np.maximum(emission - emission.max(1, keepdims=True, initial=-np.inf), -80)) if n else emission
        t = np.exp(transition - transition.max())
        lanes = len(self.start)
        longest = int((self.stop - self.start).max(initial=0))
        product = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
        for step in range(longest):
            at = np.flatnonzero(self.start + step < self.stop)
            new = product[at]
            moved = (new.reshape(-1, k) @ t).reshape(-1, k, k)
            if step == 0:
                moved[self.opens[at]] = new[self.opens[at]]
            moved *= e[self.start[at] + step][:, None, :]
            product[at] = moved / moved.max((1, 2), keepdims=True)
        into, back = np.ones((lanes, k)), np.ones((lanes, k))
        for wave in self.waves[1:]:
            source = wave - 1  # blocks of a row follow each other
            got = np.einsum("lk,lkj->lj", into[source], product[source])
            into[wave] = got / got.sum(1, keepdims=True)
        for wave in self.waves[:0:-1]:
            got = np.einsum("lkj,lj->lk", product[wave], back[wave])
            back[wave - 1] = got / got.sum(1, keepdims=True)
        forward, backward = np.empty((n, k)), np.empty((n, k))
        current = into
        for step in range(longest):
            at = np.flatnonzero(self.start + step < self.stop)
            moved = current[at] @ t
            if step == 0:
                moved[self.opens[at]] = current[at][self.opens[at]]
            moved *= e[self.start[at] + step]
            current[at] = forward[self.start[at] + step] = moved / moved.sum(1, keepdims=True)
        current = back
        for step in range(longest):
            at = np.flatnonzero(self.stop - 1 - step >= self.start)
            place = self.stop[at] - 1 - step
            backward[place] = current[at]
            moved = (e[place] * current[at]) @ t.T
            current[at] = moved / moved.sum(1, keepdims=True)
        both = forward * backward
        pairs = np.zeros((k, k))
        later = np.ones(n, dtype=bool)
        later[self.first_of[:-1][np.diff(self.first_of) > 0]] = False
        later = np.flatnonzero(later)
        if len(later):
            ahead = e[later] * backward[later]
            z = ((forward[later - 1] @ t) * ahead).sum(1, keepdims=True)
            pairs = ((forward[later - 1] / z).T @ ahead) * t
        return both / both.sum(1, keepdims=True), pairs


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of rows of bytes; of each word there: which one it is, its start and its end; each row's first word.

    A word is a run of ASCII letters and bytes above 127.
    """
    starts, ends, first_of = split_words(data, offsets, _NO_LETTER)
    hashes, first, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    return Words.of(data, starts[first], ends[first], hashes), which, starts, ends, first_of


@dataclass
class LanguageModel:
    """Languages in order, a row of weights for each bucket (and one of zeros), and transitions from one to another."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def of_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each word's languages, its start and end, and each row's first word."""
        words, which, starts, ends, first_of = text_words(data, offsets)
        p, _ = Chains(first_of).marginals(words.scores(self.weights)[which].astype(float), self.transition)
        return p, starts, ends, first_of

    def shares(self, column: pa.Array) -> np.ndarray:
        """Each row's share of each language; nan for rows without words."""
        data, offsets = text_bytes(column)
        out = []
        for first, last in slices(offsets):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            p, starts, ends, first_of = self.of_words(part, at)
            size = (ends - starts).astype(float)
            total = np.vstack([np.zeros((1, p.shape[1])), np.cumsum(p * size[:, None], axis=0)])[first_of]
            weight = np.append(0, np.cumsum(size))[first_of]
            with np.errstate(invalid="ignore"):
                out.append(np.diff(total, axis=0) / np.diff(weight)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def fit_languages(texts: list[str], labels: list[str], rounds: tuple[int, int] = (15, 25)) -> LanguageModel:
    """Fit weights and transitions to texts of known language by the conditional likelihood; deterministic."""
    languages = sorted(set(labels))
    k = len(languages)
    weights, transition = np.zeros((BUCKETS + 1, k), dtype=np.float32), np.zeros((k, k))
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    words, which, _, _, first_of = text_words(data, offsets)
    if k < 2 or not len(which):
        return LanguageModel(languages, weights, transition)
    chains, row = Chains(first_of), np.repeat(np.arange(len(texts)), np.diff(first_of))
    given = np.array([languages.index(x) for x in labels])[row]
    balance = (len(given) / k / np.maximum(np.bincount(given, minlength=k), 1))[given]
    same_row = row[1:] == row[:-1]

    def climb(state: np.ndarray, steps: int, alone: bool) -> None:
        """Steps of Adam; ``alone``: words by themselves, without transitions."""
        truth = np.eye(k)[state]
        pairs = np.zeros((k, k))
        np.add.at(pairs, (state[:-1][same_row], state[1:][same_row]), 1)
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((k, k)), np.zeros((k, k))]
        for step in range(1, steps + 1):
            emission = words.scores(weights)[which].astype(float)
            if alone:
                p = np.exp(emission - emission.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                seen = pairs
            else:
                p, seen = chains.marginals(emission, transition)
            miss = (truth - p) * balance[:, None]
            by_word = np.column_stack([np.bincount(which, miss[:, j], len(words.starts)) for j in range(k)])
            gradients = (words.gradient(by_word) / len(given) - 1e-7 * weights, (pairs - seen) / len(given) - 1e-4 * transition)
            for value, slope, m, v, rate in ((weights, gradients[0], *moments[:2], 0.05), (transition, gradients[1], *moments[2:], 0.1)):
                m += 0.1 * (slope - m)
                v += 0.02 * (slope**2 - v)
                value += (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)).astype(value.dtype)

    climb(given, rounds[0], alone=True)
    sticky = np.log(np.where(np.eye(k) == 1, 0.9, 0.1 / max(1, k - 1)))
    p, _ = chains.marginals(words.scores(weights)[which].astype(float), sticky)
    state = np.where(p.max(1) > 0.95, p.argmax(1), given)
    climb(state, rounds[1], alone=False)
    return LanguageModel(languages, weights, transition)


def train_languages(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on documents for which ``usable`` (a condition on the id) holds, LANGUAGE_BYTES of each language or a little more.

    Which ones is settled by a hash of the id. Documents over DOCUMENT_BYTES, and those without a letter, are not learned
    from; more than MAX_LANGUAGES values are an error.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), dtype=np.float32), np.zeros((0, 0)))
    # Some thousands of documents of each language by their hash, so that no language's documents are sorted in one task.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4000 / n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    lettered = drawn.where(F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= DOCUMENT_BYTES))
    sizes = lettered.select("doc_id", "lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    chosen = sizes.withColumn("before", before).where(F.col("before") < LANGUAGE_BYTES).select("doc_id", "lang", "h").distinct()
    got = lettered.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "h"], "left_semi").select("text", "lang").distinct().collect()
    got = sorted((r["lang"], r["text"]) for r in got)
    return fit_languages([t for _, t in got], [lang for lang, _ in got])


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; null has none."""
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the greatest share of each whole text, and that share.

    * null texts and those without a letter are ``und`` with score 0, as is everything where no language was learned;
    * of languages with equal shares the first by name is taken;
    * null and repeated ids are passed on; only the two named columns are read; rows are independent, nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES columns of BUCKETS weights
    schema = f"doc_id {id_type}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                best, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                lettered = np.flatnonzero(has_letter(part.column(1)))
                if len(names) > 1 and len(lettered):
                    shares = model.shares(part.column(1).take(pa.array(lettered)))
                    best[lettered], score[lettered] = shares.argmax(1), np.clip(shares.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
        release_memory()

    return rows.mapInArrow(run, schema)


def tag_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, words``: every word of a text with its language and the probability of it, in order.

    Texts without words, and everything where no language was learned, have an empty list.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                if not model.languages or not data:
                    out.append([])
                    continue
                p, starts, ends, _ = model.of_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                cut = [data[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                out.append([{"word": w, "lang": model.languages[k], "p": float(x[k])} for w, k, x in zip(cut, p.argmax(1), p, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "words"])

    return rows.mapInArrow(run, f"doc_id {id_type}, words array<struct<word string, lang string, p double>>")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_languages(docs, remainder(F.col("doc_id"), 3) != 1)
    return identify_languages(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
