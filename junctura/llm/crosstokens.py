"""Operator 12: alignment of the tokens that two tokenizers cut the same text into.

Both tokenizers' tokens are laid over the bytes of the text. Where a token of A and one of B end together, the text is cut:
the stretch between two such cuts is a *group*, and the two tokens that end there are *linked*. Common ends are found by
galloping: the shorter list of ends drives, and each of its ends is sought in the longer one from where the last was found,
by steps that double and a binary search of the last step. Lanes of ``LANE`` ends gallop in step, so that numpy does the
work of a whole slice of texts at a time. Ranks of the common ends slice the groups; differences of ranks are the ranges of
tokens that overlap.

How often each pair of ids is linked in the corpus is counted chunk by chunk: a chunk of texts keeps its links, asks for the
totals of its distinct pairs, and is answered. So what is exchanged by pair has a row for each distinct pair of a chunk, not
for each link.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.bytepair import in_place, stands_alone, stretches
from junctura.llm.kernels import release_memory
from junctura.llm.remembered import Remembered, per_worker
from junctura.llm.scratch import materialize

#: Ends of the shorter list that one lane takes.
LANE = 64
#: Bytes of text aligned at a time, and of a chunk of texts that asks for counts together; a longer text is alone in both.
SLICE_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20


def gallop(driver: np.ndarray, other: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each driver position of the lanes ``starts`` to ``stops``: where ``other`` has the same value, or -1.

    Both lists ascend. Positions outside the lanes get -1. Each lane begins where a binary search puts its first value.
    """
    found = np.full(len(driver), -1, dtype=np.int64)
    n = len(other)
    if not n or not len(starts):
        return found
    cursor = np.searchsorted(other, driver[starts])
    padded = np.append(other, np.iinfo(np.int64).max)
    for t in range(int((stops - starts).max())):
        lane = np.flatnonzero(starts + t < stops)
        at, value = starts[lane] + t, driver[starts[lane] + t]
        low = cursor[lane]  # everything before it is less than the value
        high, step = low.copy(), 1
        less = np.flatnonzero(padded[high] < value)
        while len(less):
            low[less] = high[less] + 1
            high[less] = np.minimum(high[less] + step, n)
            less, step = less[padded[high[less]] < value[less]], 2 * step
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            behind = padded[middle] < value[open_]
            low[open_[behind]] = middle[behind] + 1
            high[open_[~behind]] = middle[~behind]
            open_ = open_[low[open_] < high[open_]]
        cursor[lane] = high
        same = padded[high] == value
        found[at[same]] = high[same]
    return found


def _lanes(firsts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``firsts`` to ``stops`` cut into lanes."""
    many = -(-(stops - firsts) // LANE)
    row = np.repeat(np.arange(len(firsts)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = firsts[row] + nth * LANE
    return begin, np.minimum(begin + LANE, stops[row])


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both lists of the values that both hold; text by text the shorter list drives.

    ``a_of`` and ``b_of``: where each text's ends begin (one entry more than texts); values ascend over all texts.
    """
    a_drives = np.diff(a_of) <= np.diff(b_of)
    in_b = gallop(a_ends, b_ends, *_lanes(a_of[:-1][a_drives], a_of[1:][a_drives]))
    in_a = gallop(b_ends, a_ends, *_lanes(b_of[:-1][~a_drives], b_of[1:][~a_drives]))
    a_at, b_at = np.flatnonzero(in_b >= 0), np.flatnonzero(in_a >= 0)
    a, b = np.concatenate([a_at, in_a[b_at]]), np.concatenate([in_b[a_at], b_at])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def overlap_ranges(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A of one text, the range (from, to) of B's tokens that share a byte with it."""
    starts = np.append(0, a_ends[:-1])
    return np.searchsorted(b_ends, starts, side="right"), np.searchsorted(b_ends, a_ends, side="left") + 1


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others
    are the letters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def id_bits(size: int) -> int:
    """The least number of bits that hold ids 0 to size - 1."""
    return max(1, int(size - 1).bit_length())


def pair_type(a_size: int, b_size: int) -> np.dtype:
    """What holds an id of A before an id of B."""
    return np.dtype(np.uint64 if id_bits(a_size) + id_bits(b_size) > 32 else np.uint32)


def vocabulary_sizes(a_json: str, b_model: bytes) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(a_json).get_vocab(with_added_tokens=True)
    return max(vocab.values()) + 1, sentencepiece.SentencePieceProcessor(model_proto=b_model).vocab_size()


class Pair:
    """A byte-level tokenizer A, a piece tokenizer B, the bytes of their tokens, and what is known of stretches."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))
        plain = [p for k, p in enumerate(pieces) if not self.b.is_byte(k)]
        self.space = self.b.piece_to_id("▁")
        #: Whether B's pieces hold spaces at their beginning alone, and no line feeds: else stretches depend on each other.
        self.by_stretch = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain) and not self.b.is_unknown(self.space)
        self.b_bits, self.key = id_bits(len(pieces)), pair_type(len(self.a_bytes), len(pieces))
        self.known = Remembered(lambda s: self._several([s])[0])
        self.names = {c: np.array([f"{k}{c}" for k in range(max(len(self.a_bytes), len(pieces)))], dtype=object) for c in ",|;"}

    def _checked(self, data: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        if b"".join([self.a_bytes[k] for k in a]) != data or b"".join([self.b_bytes[k] for k in b]) != data:
            return None
        return np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes()

    def _several(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both encodings of stretches, a space before each that doesn't begin with a line feed; None where they don't
        stand alone or don't spell it."""
        out: list = [None] * len(parts)
        alone = [k for k, s in enumerate(parts) if stands_alone(s)]
        placed = [in_place(parts[k]) for k in alone]
        for k, text, a, b in zip(alone, placed, self.a.encode_batch_fast(placed, add_special_tokens=False), self.b.encode([parts[k] for k in alone], num_threads=1), strict=True):
            if text[0] == "\n":  # without the space that B adds
                if not b or b[0] != self.space:
                    continue
                b = b[1:]
            out[k] = self._checked(text.encode(), a.ids, b)
        return out

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Both encodings of a whole text as the libraries give them; nothing if either doesn't spell it."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return self._checked(b" " + text.encode(), a, self.b.encode(text)) or (b"", b"")

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Both encodings of each text; nothing for null and empty ones and for those that either doesn't spell."""
        self.known.turn()
        cut = [stretches(t) if t and self.by_stretch else None for t in texts]
        new = [w for w in {w for parts in cut if parts for w in parts} if w not in self.known and w not in self.known.older]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for w, got in zip(part, self._several(part), strict=True):
                if len(w) <= 256:
                    self.known[w] = got
        out = []
        for text, parts in zip(texts, cut, strict=True):
            if not text:
                out.append((b"", b""))
                continue
            found = list(map(self.known.__getitem__, parts)) if parts else [None]
            if None in found:
                out.append(self.whole(text))
            else:
                a, b = zip(*found, strict=True)
                out.append((b"".join(a), b"".join(b)))
        return out


@dataclass
class Aligned:
    """A slice of texts: tokens of both, where each text's begin, and the positions of tokens that end together."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray

    @property
    def groups_of(self) -> np.ndarray:
        """The first group of each text (one entry more than texts)."""
        return np.searchsorted(self.a_at, self.a_of)

    def links(self, pair: Pair) -> np.ndarray:
        """The ids of linked tokens, as one number each."""
        return (self.a_ids[self.a_at].astype(pair.key) << pair.key.type(pair.b_bits)) | self.b_ids[self.b_at].astype(pair.key)

    def written(self, pair: Pair) -> list[str]:
        """Each text's groups: ids of A, a bar, ids of B; groups are parted by semicolons."""
        a_last, b_last = np.zeros(len(self.a_ids), bool), np.zeros(len(self.b_ids), bool)
        a_last[self.a_at], b_last[self.b_at] = True, True
        # A group's tokens of A stand behind all tokens of earlier groups, its tokens of B behind those of A as well.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_before = np.append(0, self.b_at + 1)[a_group]
        a_before = np.append(self.a_at + 1, 0)[b_group]
        words = np.empty(len(self.a_ids) + len(self.b_ids), dtype=object)
        words[np.arange(len(self.a_ids)) + b_before] = np.where(a_last, pair.names["|"][self.a_ids], pair.names[","][self.a_ids])
        words[np.arange(len(self.b_ids)) + a_before] = np.where(b_last, pair.names[";"][self.b_ids], pair.names[","][self.b_ids])
        flat, of = words.tolist(), (self.a_of + self.b_of).tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip(of[:-1], of[1:], strict=True)]


def align_texts(pair: Pair, texts: list[str | None]) -> Aligned:
    """Encode texts by both tokenizers and find where their tokens end together."""
    a, b = zip(*pair.encode(texts), strict=True) if texts else ((), ())
    a_of, b_of = (np.cumsum([0, *map(len, x)], dtype=np.int64) // 4 for x in (a, b))
    a_ids, b_ids = (np.frombuffer(b"".join(x), dtype=np.uint32) for x in (a, b))
    a_at, b_at = common_ends(np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids]), a_of, b_of)
    return Aligned(a_ids, b_ids, a_of, b_of, a_at, b_at)


def _pair_of(a_json: str, b_model: bytes) -> Pair:
    return per_worker("token-pair", (zlib.crc32(a_json.encode()), zlib.crc32(b_model)), lambda: Pair(a_json, b_model))


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list, int]]:
    """Parts of a batch of about SLICE_BYTES, with their texts and bytes."""
    texts = batch.column("text").to_pylist()
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += 4 * len(text or "") if text and not text.isascii() else len(text or "")
        if size >= SLICE_BYTES or k + 1 == len(texts):
            yield batch.slice(first, k + 1 - first), texts[first : k + 1], size
            first, size = k + 1, 0


def align_tokens(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, groups``: both tokenizers' ids of each text and its groups as ranges of token positions.

    A group is ``(a_from, a_to, b_from, b_to)``, ends excluded; its last tokens are linked.

    * null and empty texts, and texts that either tokenizer doesn't spell byte by byte, have no tokens and no groups;
    * null and repeated ids are passed on; only the two named columns are read, so others may have any name;
    * rows are independent, so nothing is shuffled; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((a_json, b_model))  # the vocabulary files, fixed in size
    group = pa.list_(pa.struct([(c, pa.int32()) for c in ("a_from", "a_to", "b_from", "b_to")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair_of(*shipped.value)
        for batch in batches:
            for part, texts, _ in _sliced(batch):
                got = align_texts(pair, texts)
                of, groups = got.groups_of, []
                for k in range(len(texts)):
                    a, b = got.a_at[of[k] : of[k + 1]] + 1 - got.a_of[k], got.b_at[of[k] : of[k + 1]] + 1 - got.b_of[k]
                    cuts = zip(np.append(0, a)[:-1].tolist(), a.tolist(), np.append(0, b)[:-1].tolist(), b.tolist(), strict=True)
                    groups.append([dict(zip(("a_from", "a_to", "b_from", "b_to"), cut, strict=True)) for cut in cuts])
                a_ids, b_ids = (pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(ids.astype(np.int32))) for o, ids in ((got.a_of, got.a_ids), (got.b_of, got.b_ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), a_ids, b_ids, pa.array(groups, group)], names=["doc_id", "a_ids", "b_ids", "groups"])
        release_memory()

    return rows.mapInArrow(run, f"doc_id {id_type}, a_ids array<int>, b_ids array<int>, groups array<struct<a_from int, a_to int, b_from int, b_to int>>")


def align_corpus(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's alignment in figures: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair of ids counts how many links of the corpus have it. ``n_best``: links whose count is the highest of all pairs with
    their id of B; ``count_sum``: the counts of the text's links, summed up. ``groups_sha256``: of ``a,a|b;a|b,b``, empty
    without tokens. Edge cases are those of ``align_tokens``; repeated rows count as often as they stand there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    shipped = spark.sparkContext.broadcast((a_json, b_model))
    figures = ("n_a", "n_b", "n_groups", "n_links")
    head = f"doc_id {id_type.simpleString()}, " + "".join(f"{c} long, " for c in figures) + "groups_sha256 string"
    fields = f"chunk long, {head}, links binary, pairs array<long>, counts array<long>"
    kinds = [pa.int64(), None, *[pa.int64()] * len(figures), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.strip().split(" ")[0] for x in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair_of(*shipped.value)
        chunk, held, counted, id_kind = TaskContext.get().partitionId() << 32, 0, [], pa.int64()

        def record(**given: pa.Array | list) -> pa.RecordBatch:
            n = len(given["chunk"])
            types = [id_kind if k is None else k for k in kinds]
            arrays = [x if isinstance(x := given.get(c), pa.Array) else pa.nulls(n, k) if x is None else pa.array(x, k) for c, k in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def totals() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*counted, strict=True))
            distinct, row = np.unique(keys, return_inverse=True)
            summed = np.bincount(row, weights=counts, minlength=len(distinct)).astype(np.int64)
            return record(chunk=[chunk], pairs=[distinct.astype(np.int64)], counts=[summed])

        for batch in batches:
            id_kind = batch.column("doc_id").type
            for part, texts, size in _sliced(batch):
                got = align_texts(pair, texts)
                links, of = got.links(pair), got.groups_of
                counted.append(np.unique(links, return_counts=True))
                blobs = [bytes(pa.compress(links[i:j].tobytes(), codec="zstd")) for i, j in zip(of[:-1], of[1:], strict=True)]
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in got.written(pair)]
                yield record(
                    chunk=np.full(len(texts), chunk), doc_id=part.column("doc_id"), n_a=np.diff(got.a_of), n_b=np.diff(got.b_of), n_groups=np.diff(of), n_links=np.diff(of),
                    groups_sha256=digests, links=blobs,
                )
                held += size
                if held >= CHUNK_BYTES:
                    yield totals()
                    chunk, held, counted = chunk + 1, 0, []
        if counted:
            yield totals()
        release_memory()

    sizes = vocabulary_sizes(a_json, b_model)
    kind, b_mask = pair_type(*sizes), (1 << id_bits(sizes[1])) - 1
    written = materialize(rows.mapInArrow(run, fields), "aligned-texts")
    of_chunk = written.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count"))
    counts = materialize(of_chunk.groupBy("pair").agg(F.sum("count").alias("count")), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(F.lit(b_mask)))
    # A row for each id of B, as many as its vocabulary has at most.
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = of_chunk.select(F.col("chunk").alias("asked"), "pair").join(known, "pair").select("asked", "pair", "count", "best")
    out_names = ["doc_id", *figures, "n_best", "count_sum", "groups_sha256"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("pair").to_numpy()
        order = np.argsort(keys)
        keys, count, is_best = keys[order], right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for blob, n in zip(left.column("links").to_pylist(), left.column("n_links").to_pylist(), strict=True):
            links = np.frombuffer(pa.decompress(blob, n * kind.itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.zeros(0, kind)
            at = np.searchsorted(keys, links.astype(np.int64))
            n_best.append(int(is_best[at].sum()))
            count_sum.append(int(count[at].sum()))
        columns = {c: left.column(c) for c in ("doc_id", *figures, "groups_sha256")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table({c: columns[c] for c in out_names})

    texts = written.where("pairs IS NULL").select("chunk", "doc_id", *figures, "groups_sha256", "links")
    out = f"doc_id {id_type.simpleString()}, " + "".join(f"{c} long, " for c in (*figures, "n_best", "count_sum")) + "groups_sha256 string"
    return texts.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(score, out)


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a_json = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        b_model = f.read()
    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), a_json, b_model)
