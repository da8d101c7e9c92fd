"""Operator 8: token counts that follow edits.

Each document keeps a segment tree whose leaves are runs of pre-tokens: how many characters and how many tokens they
have. An edit re-encodes the leaves it touches, with as much before it as the pre-tokenizer's pattern may look ahead
over, until the new pre-tokens meet a leaf's border again; from there on the text is as it was, so its pre-tokens are
too. The leaves' ancestors are then updated, and the root is the count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.bytepair import TreeBPE, in_place, shared_model, stands_alone, stretches
from junctura.llm.kernels import release_memory
from junctura.llm.remembered import GENERATION, Remembered, per_worker
from junctura.llm.scratch import materialize

#: Pre-tokens in a leaf when it is made, and from how many a tree is built anew.
LEAF_PIECES, FULL_LEAF = 32, 512
#: Characters that a match of the pattern may look at beyond its end.
LOOKAHEAD = 3
#: Edits of one document that are applied in one go.
EDITS_AT_ONCE = 5_000

EDITS = "array<struct<start: long, deleted: long, inserted: string>>"


def stretch_counts(model: TreeBPE) -> Remembered:
    """Stretch (see ``bytepair.stretches``) -> its tokens in its place, None for one that its neighbours may change."""
    return per_worker("stretch-counts", model, lambda: Remembered(lambda s: len(model.encode(in_place(s))) if stands_alone(s) else None, 2 * GENERATION))


class CountTree:
    """Characters and tokens of a text's leaves, and of every node above them."""

    def __init__(self, model: TreeBPE, text: str, leaves: tuple[list[int], list[int]] | None = None):
        self.model, self.text = model, text
        self.reencoded = 0
        chars, tokens = leaves if leaves is not None else self.measure_text(text)
        self._build(chars, tokens)

    def measure_text(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a whole text.

        Where all stretches between single spaces and line feeds are independent they serve as pre-tokens, as their
        borders are borders of pre-tokens.
        """
        parts = stretches(text)
        if parts is None or parts[0] == "" or parts[0][-1].isspace():
            return self.measure(self.pieces(text))
        known, rest = stretch_counts(self.model), parts[1:]
        known.turn()
        found = list(map(known.__getitem__, rest))
        if None in found:
            return self.measure(self.pieces(text))
        sizes = np.fromiter(map(len, rest), np.int64, len(rest)) + np.fromiter([s[0] != "\n" for s in rest], np.int64, len(rest))
        cuts = np.arange(0, len(parts), LEAF_PIECES)
        tokens = np.append(len(self.model.encode(parts[0])), np.array(found, dtype=np.int64)).astype(np.int64)
        return np.add.reduceat(np.append(len(parts[0]), sizes), cuts).tolist(), np.add.reduceat(tokens, cuts).tolist()

    def pieces(self, text: str) -> list[str]:
        return self.model.pattern.findall(text)

    def measure(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of leaves made of ``pieces``."""
        if not pieces:
            return [], []
        reduce = self.model.reduce
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter([len(reduce(p.encode())) for p in pieces], np.int64, len(pieces))
        cuts = np.arange(0, len(pieces), LEAF_PIECES)
        return np.add.reduceat(sizes, cuts).tolist(), np.add.reduceat(counts, cuts).tolist()

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        fill = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + fill, [0] * self.width + tokens + fill
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        """The leaves that hold text."""
        held = [k for k in range(self.width, 2 * self.width) if self.chars[k]]
        return [self.chars[k] for k in held], [self.tokens[k] for k in held]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node, start

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters from ``start`` on; places beyond the end mean the end."""
        old = self.text
        start = min(max(start, 0), len(old))
        stop = min(start + max(deleted, 0), len(old))
        self.text = old[:start] + inserted + old[stop:]
        if not old:
            self._build(*self.measure(self.pieces(self.text)))
            self.reencoded += len(self.text)
            return
        shift = len(self.text) - len(old)
        first, begin = self.leaf_at(max(0, start - LOOKAHEAD))
        last, border = first, begin + self.chars[first]  # old place of the border after the leaves that are replaced
        found: list[str] = []
        at = begin
        for match in self.model.pattern.finditer(self.text, begin):
            while border < stop or (border + shift < at and border < len(old)):
                last += 1
                border += self.chars[last]
            if at >= start + len(inserted) and at == border + shift:
                break
            found.append(match.group())
            at = match.end()
        else:
            last, border = 2 * self.width - 1, len(old)
        self.reencoded += at - begin
        self._replace(first, last, found)

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        chars, tokens = self.measure(pieces)
        room = last - first + 1
        if len(chars) > room:
            chars[room - 1 :], tokens[room - 1 :] = [sum(chars[room - 1 :])], [sum(tokens[room - 1 :])]
        for k in range(room):
            self.chars[first + k], self.tokens[first + k] = (chars[k], tokens[k]) if k < len(chars) else (0, 0)
        low, high = first // 2, last // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2
        if len(pieces) > FULL_LEAF * room:
            held = self.leaves()
            at = sum(1 for k in range(self.width, first + room - 1) if self.chars[k])
            text_at = sum(held[0][:at])
            more = self.measure(self.pieces(self.text[text_at : text_at + held[0][at]]))
            self._build(held[0][:at] + more[0] + held[0][at + 1 :], held[1][:at] + more[1] + held[1][at + 1 :])


STATE = "text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
EDITED = f"doc_id long, {STATE}, n_before long, n_reencoded long"


def _documents(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def _edited(doc_id: int | None, tree: CountTree, todo: list | None) -> tuple:
    """A row of EDITED: the tree's state after some edits."""
    before = tree.n_tokens
    for edit in todo if todo is not None else ():
        tree.edit(int(edit["start"] or 0), int(edit["deleted"] or 0), edit["inserted"] or "")
    return (doc_id, tree.text, *tree.leaves(), tree.n_tokens, before, tree.reencoded)


def _rows(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts that keep what is held at once small."""
    return (batch.iloc[k : k + 500] for k in range(0, len(batch), 500))


def count_tokens(docs: DataFrame, ranks_data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, leaf_chars, leaf_tokens, n_tokens``: the state that :func:`apply_edits` continues from.

    Null texts count as empty and have no leaf; null and repeated ids are passed on; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_data)  # the vocabulary file, fixed in size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared_model(shipped.value, pattern)
        for batch in batches:
            for part in _rows(batch):
                trees = [CountTree(model, t) for t in part["text"]]
                leaves = [t.leaves() for t in trees]
                yield part.assign(leaf_chars=[x[0] for x in leaves], leaf_tokens=[x[1] for x in leaves], n_tokens=[t.n_tokens for t in trees])

    return _documents(docs, id_col, text_col).mapInPandas(run, f"doc_id long, {STATE}")


def apply_edits(state: DataFrame, edits: Column, ranks_data: bytes, pattern: str) -> DataFrame:
    """The state after the edits of each row, with ``n_before`` and ``n_reencoded``, the characters encoded again.

    ``edits`` is an array column of the type EDITS, applied in order; null or empty changes nothing, and null parts of
    an edit count as 0 or the empty text.
    """
    shipped = state.sparkSession.sparkContext.broadcast(ranks_data)
    rows = state.select("doc_id", "text", "leaf_chars", "leaf_tokens", edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared_model(shipped.value, pattern)
        for batch in batches:
            for part in _rows(batch):
                out = [
                    _edited(doc_id, CountTree(model, text, ([int(x) for x in chars], [int(x) for x in tokens])), todo)
                    for doc_id, text, chars, tokens, todo in part.astype({"doc_id": "Int64"}).itertuples(index=False, name=None)
                ]
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, EDITED)


_COLUMNS = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_before", "n_reencoded"]


def count_edited(docs: DataFrame, edits: Column, ranks_data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`count_tokens` and :func:`apply_edits` in one pass; ``edits`` may refer to ``doc_id`` and ``text``."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_data)
    rows = _documents(docs, id_col, text_col).withColumn("edits", edits.cast(EDITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared_model(shipped.value, pattern)
        for batch in batches:
            for part in _rows(batch):
                out = [_edited(doc_id, CountTree(model, text), todo) for doc_id, text, todo in part.astype({"doc_id": "Int64"}).itertuples(index=False, name=None)]
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})
        release_memory()

    return rows.mapInPandas(run, EDITED)


def apply_edit_table(state: DataFrame, edits: DataFrame, ranks_data: bytes, pattern: str) -> DataFrame:
    """The state after a table of edits: ``doc_id, seq, start, deleted, inserted``, applied by ``seq``.

    A document's edits are applied EDITS_AT_ONCE at a time and the state is written in between, so neither a row nor the
    plan grows with the busiest document; edits with the same ``seq`` are applied in the order of their parts; edits of
    unknown or null ids are left out.
    """
    order = Window.partitionBy("doc_id").orderBy("seq", "start", "deleted", "inserted")
    numbered = materialize(edits.withColumn("turn", F.floor((F.row_number().over(order) - 1) / EDITS_AT_ONCE)), "edits")
    turns = numbered.agg(F.max("turn").alias("n")).first()["n"]
    for turn in range(0 if turns is None else int(turns) + 1):
        part = numbered.where(F.col("turn") == turn).groupBy("doc_id")
        one = F.struct("seq", "start", "deleted", "inserted")
        lists = part.agg(F.transform(F.sort_array(F.collect_list(one)), lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted"))).alias("todo"))
        state = materialize(apply_edits(state.join(lists, "doc_id", "left"), F.col("todo"), ranks_data, pattern), "edited")
    return state


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits of each: an insertion, a deletion and a replacement."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks_data = f.read()
    pattern = public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def place(salt: str) -> Column:
        return F.pmod(F.crc32(F.encode(F.concat(F.lit(salt), F.col("doc_id").cast("string")), "UTF-8")), F.length("text") + 1)

    def edit(start: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), inserted.alias("inserted"))

    edits = F.array(
        edit(place("a"), 0, F.concat(F.lit(" revision "), F.col("doc_id").cast("string"), F.lit(" "))), edit(place("b"), 40, F.lit("")), edit(place("c"), 12, F.lit("it's  new\n\n"))
    )
    after = count_edited(docs, edits, ranks_data, pattern)
    return after.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_reencoded", F.length("text").cast("long").alias("n_chars"))
