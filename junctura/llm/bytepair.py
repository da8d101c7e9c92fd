"""Operator 9: byte-level BPE by monoid tree reduction.

Encodings form a monoid: two encoded halves are joined by encoding again a window around their border. The window grows
until the tokens next to it stay as they are, and that is provable locally: a token sequence is the BPE encoding of its
bytes exactly when each pair of neighbours is the encoding of the pair's own bytes. A piece (one match of the
pre-tokenizer's pattern) is reduced as a balanced tree over its bytes, so a piece of any length costs n log n and not n^2;
pieces of a text are independent, so joining them, up a balanced tree, is concatenation. Decoding concatenates up the
same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.kernels import release_memory
from junctura.llm.remembered import Remembered, per_worker

#: Bytes up to which a window is merged by looking at all its neighbours again; longer ones use a queue.
SHORT_WINDOW = 48
#: The longest byte strings whose encodings are kept, and how many of these and of windows are.
KEPT_BYTES, MEMO = 8, 300_000
#: Tokens that are decoded, and stretches that are put together, at a leaf of a text's tree.
LEAF = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file that has a token in base64 and its rank on each line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class TreeBPE:
    """Encodes and decodes by a rank table.

    Encodings of short byte strings and of windows are kept: the halves of different words are often the same.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.reduced: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.joins = self.grown = 0  # joins of two encodings, and those that had to encode a window again

    # -- one piece ---------------------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Direct merging: again and again join the neighbours whose union has the lowest rank, leftmost first."""
        ranks = self.ranks
        if len(data) > SHORT_WINDOW:
            return self.merge_queue(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_queue(self, data: bytes) -> list[int]:
        """The same with a queue of candidate unions, for windows of many bytes."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is merged into its left neighbour
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(data[b:stop])) is not None:
                heapq.heappush(queue, (r, b, stop))
        return [ranks[data[i:e]] for i, e in enumerate(end) if e]

    def window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of neighbouring tokens; two tokens may stand side by side if it is themselves."""
        found = self.windows.get(tokens)
        if found is None:
            found = tuple(self.merge(b"".join([self.tokens[t] for t in tokens])))
            if len(self.windows) > MEMO:
                self.windows.clear()
            if len(tokens) <= KEPT_BYTES:
                self.windows[tokens] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``left`` and ``right`` together."""
        if not left or not right:
            return left or right
        self.joins += 1
        seam = (left[-1], right[0])
        middle = self.window(seam)
        if middle == seam:
            return left + right
        self.grown += 1
        first, stop, step_l, step_r = len(left) - 1, 1, 1, 1
        while True:
            ok_l = not first or self.window(pair := (left[first - 1], middle[0])) == pair
            ok_r = stop == len(right) or self.window(pair := (middle[-1], right[stop])) == pair
            if ok_l and ok_r:
                return left[:first] + middle + right[stop:]
            if not ok_l:
                first, step_l = max(0, first - step_l), 2 * step_l
            if not ok_r:
                stop, step_r = min(len(right), stop + step_r), 2 * step_r
            middle = self.window(left[first:] + right[:stop])

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one piece by halving, down to what is a token or a byte."""
        found = self.reduced.get(data)
        if found is None:
            rank = self.ranks.get(data)
            if rank is not None:
                return (rank,)
            half = len(data) // 2
            found = self.join(self.reduce(data[:half]), self.reduce(data[half:])) if data else ()
            if len(data) <= KEPT_BYTES:
                if len(self.reduced) > MEMO:
                    self.reduced.clear()
                self.reduced[data] = found
        return found

    # -- whole texts -------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """The ids of a text. Matches of the pattern are encoded apart, so joining them is concatenation."""
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self.reduce(p.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up a balanced tree."""
        if len(ids) <= LEAF:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def shared_model(ranks_data: bytes, pattern: str) -> TreeBPE:
    """The model that all tasks of a Python worker use, with what it remembers."""
    return per_worker("byte-pairs", (zlib.crc32(ranks_data), pattern), lambda: TreeBPE(parse_ranks(ranks_data), pattern))


def stretches(text: str) -> list[str] | None:
    """A text in stretches whose encodings don't depend on each other; None where it can't be cut so.

    The pattern's matches never cross from a character that isn't white space into one space or line feed behind it, if
    what follows isn't white space either. The first stretch is the start of the text; one that begins with a line feed
    stands as it is; every other stands with a space before it.
    """
    if "\n" in text:
        if " \n" in text or text[0] == "\n":
            return None
        if "\n\n" not in text:
            text = text.replace("\n", " \n")
    return text.split(" ")


def stands_alone(stretch: str) -> bool:
    """Whether a stretch has no white space at its ends, but for the line feed that it may begin with."""
    body = stretch.removeprefix("\n")
    return body != "" and not body[0].isspace() and not body[-1].isspace()


def in_place(stretch: str) -> str:
    return stretch if stretch[0] == "\n" else " " + stretch


class Rendered:
    """Texts' ids in decimal, joined by spaces, and the bytes that the ids decode to."""

    def __init__(self, model: TreeBPE):
        self.model = model
        self.known = Remembered(lambda s: self.render(in_place(s)) if stands_alone(s) else None)

    def render(self, text: str) -> tuple[str, bytes]:
        ids = self.model.encode(text)
        return " ".join(map(str, ids)), self.model.decode(ids)

    def combined(self, parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
        """Both of neighbouring stretches, put together up a balanced tree."""
        if len(parts) <= LEAF:
            ids, data = zip(*parts, strict=True)
            return " ".join(ids), b"".join(data)
        half = len(parts) // 2
        (ids_l, data_l), (ids_r, data_r) = self.combined(parts[:half]), self.combined(parts[half:])
        return f"{ids_l} {ids_r}", data_l + data_r

    def whole(self, text: str) -> tuple[str, bytes]:
        """Both of a whole text."""
        parts = stretches(text)
        if parts is None or len(parts) == 1 or parts[0] == "" or parts[0][-1].isspace():
            return self.render(text)
        self.known.turn()
        found = [self.render(parts[0]), *map(self.known.__getitem__, parts[1:])]
        return self.render(text) if None in found else self.combined(found)


def encode_column(df: DataFrame, ranks_data: bytes, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with an array column of ids; null texts count as empty and have no ids. Other columns pass through."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks_data)  # the vocabulary file, fixed in size

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared_model(shipped.value, pattern)
        for texts in batches:
            yield texts.fillna("").map(model.encode)

    return df.withColumn(out, ids_of(F.col(text_col)))


def decode_column(df: DataFrame, ranks_data: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of an id column; null ids give no bytes. An unknown id is an error."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks_data)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared_model(shipped.value, "")
        for ids in batches:
            yield ids.map(lambda x: b"" if x is None else model.decode(list(x)))

    return df.withColumn(out, bytes_of(F.col(ids_col)))


def roundtrip_digests(docs: DataFrame, ranks_data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    * null and empty texts have no tokens, and the digests of nothing;
    * null and repeated ids are passed on; only the two named columns are read;
    * rows are independent, so nothing is shuffled, and a lost task repeats its own rows only.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_data)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model(shipped.value, pattern)
        rendered = per_worker("rendered", model, lambda: Rendered(model))
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1):
                joined, decoded = rendered.whole(text.as_py())
                counts.append(joined.count(" ") + 1 if joined else 0)
                ids_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release_memory()

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks_data = f.read()
    return roundtrip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks_data, public_tokenizers.PATTERN)
