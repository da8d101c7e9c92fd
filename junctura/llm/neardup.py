"""Operator 7: near-duplicates by bottom-k sketches from one hash function.

A document's sketch is the K smallest hashes of its word shingles. Inverted lists of retained values bring documents
together, the sketch of the union estimates their similarity, and full shingle sets decide.

What keeps lists short without losing links:

* documents with equal shingle sets form one class, and one row stands for it;
* a document enters only the lists of its rarest retained values. Two documents that are similar enough share at least
  ``least_shared`` retained values, so, both ordered by the values' frequency, they meet within the first
  ``size - least_shared + 1``. For sets no larger than the sketch that is exact; for larger ones ``least_shared`` lies
  6.5 standard deviations below the mean, where fewer than one pair in ten thousand million is missed. A passage that a
  third of all documents carry is thus left out, unless it makes up nearly all of a document;
* in a list longer than LONG_LIST every member is first compared with one pivot, and after the links so found only
  members of different components with each other. Copies by the thousand meet their pivot and not each other;
* larger sets that meet in such lists without being joined are listed again by their whole sets, without a sample's
  margin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.components import connected_components
from junctura.llm.counting import BUCKET_KEYS, REQUEST_SCHEMA, Routes, by_chunk, find, lookup, requests, sum_by_key
from junctura.llm.kernels import combine, mix, release_memory, word_hashes
from junctura.llm.scratch import materialize, shuffle_partitions

#: Words in a shingle, and the similarity in hundredths from which documents are linked.
WORDS, PERCENT = 5, 85
#: Values in a sketch.
K = 256
#: As a sketch size: sets are kept whole.
NO_SKETCH = 1 << 30
#: Standard deviations that sampling may be off.
SIGMAS = 6.5
#: Members from which a list goes by a pivot.
LONG_LIST = 40


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct hashes of each row's shingles.

    A row with fewer words than a shingle has its whole sequence as one; a row without words (null included) has none.
    """
    out: list[np.ndarray] = []
    for first, last, hashes, of_row in word_hashes(column):
        if len(hashes) >= words:
            rolled = hashes[: len(hashes) - words + 1]
            for k in range(1, words):
                rolled = combine(rolled, hashes[k : len(hashes) - words + 1 + k])
        else:
            rolled = np.zeros(0, np.uint64)
        for row in range(last - first):
            a, b = int(of_row[row]), int(of_row[row + 1])
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                value = hashes[a : a + 1]
                for k in range(a + 1, b):
                    value = combine(value, hashes[k : k + 1])
                out.append(mix(value + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n: int, k: int = K, percent: int = PERCENT) -> int:
    """How many retained values a document of ``n`` shingles shares with any document that it is linked with."""
    j = percent / 100
    exact = -(-percent * n // 100)  # where the union is no larger than the sketch
    if n / j <= k:
        return exact
    spread = np.sqrt(k * j * (1 - j) * (1 - k / (n / j)))
    sampled = max(1, int(k * j - SIGMAS * spread - 1))
    return min(exact, sampled) if n < k else sampled


_SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles``, a 128-bit digest of the shingle set, and the sketch, one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sets = shingle_sets(part.column(1), words)
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([s[:k].tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )
        release_memory()

    return rows.mapInArrow(run, _SIGNATURE)


def list_entries(classes: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``value, rep, n, pos, size``: the lists that each class enters, its place ``pos`` in the class's order by rarity.

    For each class that enters any list there is one more row, with its ``sketch`` (else null), so that later joins carry
    the sketches of such classes alone.
    """
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.least(F.col("n"), F.lit(k))).alias("s")).first()["s"] or 0
    routes = Routes.to(max(shuffle_partitions(spark), -(-total // BUCKET_KEYS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in by_chunk(batches):
            values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64)
            keys, counts = np.unique(values, return_counts=True)
            yield requests(chunk, keys, counts, routes.group_width)
        release_memory()

    def rank(key: tuple, own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        keys, sums = lookup(replies)
        out: dict[str, list[np.ndarray]] = {"value": [], "rep": [], "n": [], "pos": [], "size": []}
        sketches: list[tuple] = []
        for rep, n, sketch in zip(own["rep"], own["n"], own["sketch"], strict=True):
            values = np.frombuffer(sketch, dtype=np.uint64)
            often = find(keys, sums, values)  # 0 stands for once
            shared = np.flatnonzero(often)
            alone = len(values) - len(shared)
            room = len(values) - least_shared(n, k, percent) + 1 - alone
            if room <= 0 or not len(shared):
                continue
            ordered = shared[np.lexsort((values[shared], often[shared]))][:room]
            for name, column in (("value", values[ordered].view(np.int64)), ("rep", np.full(len(ordered), rep)), ("n", np.full(len(ordered), n)), ("pos", np.arange(alone, alone + len(ordered))), ("size", np.full(len(ordered), len(values)))):
                out[name].append(column)
            sketches.append((0, rep, n, 0, len(values), sketch))
        entries = pd.DataFrame({name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in out.items()})
        entries["sketch"] = None
        return pd.concat([entries, pd.DataFrame(sketches, columns=entries.columns)]) if sketches else entries

    asked = classes.select("chunk", "sketch").mapInArrow(ask, REQUEST_SCHEMA)
    replies = sum_by_key(asked, routes, least=2).where("chunk >= 0")
    own = classes.select(F.col("chunk").cast("long").alias("chunk"), "rep", "n", "sketch")  # of the replies' type, as both are dealt by it
    return own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(rank, "value long, rep long, n long, pos long, size long, sketch binary")


def _may_link(x: str, y: str, k: int, percent: int) -> Column:
    """Whether the sizes and places in a list leave room for a link. x, y: aliases of list entries."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    small, large = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
    rest = F.least(c(x, "size") - c(x, "pos"), c(y, "size") - c(y, "pos"))
    return (small * 100 >= large * percent) & ((large > k) | (rest * (100 + percent) >= (small + large) * percent))


def _pairs(x: str, y: str) -> list[Column]:
    ids = F.col(f"{x}.rep"), F.col(f"{y}.rep")
    return [F.least(*ids).alias("a"), F.greatest(*ids).alias("b")]


def verified_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = K, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    j = percent / 100
    floor = j - SIGMAS * np.sqrt(j * (1 - j) / k)

    @F.pandas_udf("int")
    def judge(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        """0 no link, 1 the full sets must decide, 2 a link."""
        out = np.zeros(len(sa), dtype=np.int32)
        for i, (x, y, n, m) in enumerate(zip(sa, sb, na, nb, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            union = np.union1d(x, y)
            if n <= k and m <= k:
                out[i] = 2 * (100 * (n + m - len(union)) >= percent * len(union))
            else:
                union = union[:k]
                both = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
                out[i] = both.sum() >= floor * len(union)
        return pd.Series(out)

    side = classes.select("rep", "n", "sketch")
    with_a = pairs.join(side.toDF("a", "na", "sa"), "a")
    with_both = with_a.join(side.toDF("b", "nb", "sb"), "b")
    judged = materialize(with_both.select("a", "b", judge("sa", "sb", "na", "nb").alias("verdict")).where("verdict > 0"), "judged")
    sure, open_ = judged.where("verdict = 2").select("a", "b"), judged.where("verdict = 1").select("a", "b")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    @F.pandas_udf("boolean")
    def linked(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    wanted = open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    sets = materialize(texts.mapInArrow(full_sets, "id long, shingles binary"), "shingle-sets")
    full = open_.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    checked = full.where(linked("xa", "xb")).select("a", "b")
    return sure.union(checked)


def list_links(classes: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], k: int, percent: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` found through the lists of ``classes``, and the ``rep`` of classes for which the lists may be too wide.

    judge: of pairs, and the classes with their sketches, keeps the pairs that are links. whole: sets up to so many values are in their sketch as they are; in lists
    with a pivot, larger ones are compared with the pivot only and returned as open where that hasn't joined them all.
    """
    found = materialize(list_entries(classes, k, percent), "list-entries")
    entries, listed_classes = found.where("sketch IS NULL").drop("sketch"), found.where("sketch IS NOT NULL").select("rep", "n", "sketch")
    # A list's length, and as its pivot the member with the fewest values of its own.
    pivot = F.min(F.struct("pos", "rep", "n", "size")).alias("p")
    lists = materialize(entries.groupBy("value").agg(F.count("*").alias("members"), pivot).where("members > 1"), "lists")
    listed = entries.join(lists, "value").select("value", "rep", "n", "pos", "size", "members", "p")
    listed = materialize(listed, "listed-entries")
    short = listed.where(F.col("members") <= LONG_LIST)
    met = short.alias("x").join(short.alias("y"), (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep")) & _may_link("x", "y", k, percent)).select(*_pairs("x", "y"))
    long = listed.where(F.col("members") > LONG_LIST)
    stars = long.select(F.struct("rep", "n", "pos", "size").alias("x"), F.col("p").alias("y")).where(F.col("x.rep") != F.col("y.rep")).where(_may_link("x", "y", k, percent)).select(*_pairs("x", "y"))
    first = materialize(met.union(stars).distinct(), "pairs")
    links = materialize(judge(first, listed_classes), "links")
    labels = connected_components(links)
    # Members of long lists that no pivot has brought together.
    named = long.join(labels, long["rep"] == labels["node"], "left").select("value", "rep", "n", "pos", "size", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "long-lists")
    mixed = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    apart = materialize(named.join(mixed, "value", "left_semi"), "mixed-lists")
    exact = apart.where(F.col("n") <= whole)
    rest = exact.alias("x").join(exact.alias("y"), (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", k, percent))
    second = materialize(rest.select(*_pairs("x", "y")).distinct().join(first, ["a", "b"], "left_anti"), "more-pairs")
    more = materialize(judge(second, listed_classes), "more-links")
    return links.union(more), apart.where(F.col("n") * 100 > whole * percent).select("rep").distinct()


def whole_sets(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``chunk, rep, n, sketch`` with the whole shingle sets of the named documents in place of sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "sketch"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(reps, "rep", "left_semi")
    sets = texts.mapInArrow(run, "rep long, n long, sketch binary").where("n > 0")
    return materialize(sets.select(F.spark_partition_id().cast("long").alias("chunk"), "rep", "n", "sketch"), "whole-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    ``component_id`` is the smallest id that links lead to, the row's own included; ``kept`` marks the row of that id.

    * rows without words (null, empty and blank texts) are linked with nothing and kept;
    * rows that repeat an id count as one document, so links of any of their texts are links of all;
    * rows with a null id can't be named: they have a null component, take no part in links and are kept;
    * an empty table gives an empty result; only the two named columns are read.
    """
    signed = materialize(signatures(docs, id_col, text_col, k, words), "signatures")
    keys = ["n_shingles", "d1", "d2"]
    grouped = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min_by("sketch", "doc_id").alias("sketch"))
    numbered = grouped.select(F.spark_partition_id().cast("long").alias("chunk"), "rep", F.col("n_shingles").alias("n"), "d1", "d2", "sketch")
    classes = materialize(numbered, "classes")
    links, wide = list_links(classes, lambda pairs, listed: verified_links(pairs, listed, docs, id_col, text_col, k, percent, words), k, percent, k)
    if wide.limit(1).count():
        # A sample's margin lets documents into lists of values that are common to much less than PERCENT of them;
        # the lists of whole sets have no margin.
        sets = whole_sets(wide, docs, id_col, text_col, words)
        exact, _ = list_links(sets, lambda pairs, listed: verified_links(pairs, listed, docs, id_col, text_col, NO_SKETCH, percent, words), NO_SKETCH, percent, NO_SKETCH)
        links = links.union(exact)
    labels = connected_components(links)
    # Ids that stand for several classes (rows that repeat an id) are joined by being one node.
    component = classes.join(labels, classes["rep"] == labels["node"], "left").select(F.col("n").alias("n_"), F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), F.coalesce("component", "rep").alias("found"))
    component = materialize(component, "class-components")
    same = (F.col("n_shingles") == F.col("n_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_"))
    out = signed.select("doc_id", *keys).join(component, same, "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input rows without near-duplicates; columns as given. percent: as in ``near_duplicates``."""
    dropped = near_duplicates(docs, id_col, text_col, percent=percent).where("NOT kept").select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(dropped, F.col(id_col) == F.col("__dropped_id"), "left_anti")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
