"""Counts of 64-bit keys over a corpus, asked for and answered by chunk.

A *chunk* is the set of documents that one task holds. It sends its distinct keys, each with a weight, to the buckets
that the keys' hashes name, as one packed array a bucket; the bucket adds up the weights of equal keys and sends each
chunk the sums of the keys it asked about. A key costs a bucket one entry per chunk however common it is, a bucket
holds one hash range of the keys, and no table of all keys is ever in one place.

Chunks and buckets both grow with the corpus, so where there are many buckets, chunks don't write to each of them: they
write to groups of buckets, as many as the root of the buckets. A *relay* takes what some chunks send to one group, adds
it up, asks the group's buckets, and hands the sums back. Messages then grow as the power 1.5 of the corpus in place of 2,
and a relay holds about what a bucket does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import materialize, shuffle_partitions

REQUEST_SCHEMA = "bucket long, chunk long, keys binary, weights binary"
REPLY_SCHEMA = "chunk long, bucket long, keys binary, sums binary"
#: Bytes of text in a chunk, about; and distinct keys in a bucket, about.
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
#: Buckets up to which chunks write to each.
DIRECT = 1_024


@dataclass(frozen=True)
class Routes:
    """Buckets, which are equal ranges of keys, and the groups that chunks address; both numbered by range."""

    buckets: int
    groups: int

    @classmethod
    def to(cls, buckets: int) -> Routes:
        """Routes to so many buckets or some more."""
        if buckets <= DIRECT:
            return cls(buckets, buckets)
        root = math.isqrt(buckets - 1) + 1
        return cls(root * root, root)

    @property
    def bucket_width(self) -> int:
        return (1 << 64) // self.buckets + 1

    @property
    def group_width(self) -> int:
        return self.bucket_width * (self.buckets // self.groups)


def chunk_count(docs: DataFrame, text_col: str = "text") -> int:
    """Chunks for the texts of ``docs``: one for each CHUNK_BYTES, and enough to occupy the session's partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-total // CHUNK_BYTES))


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, byte by byte of all keys, which leaves the high bytes to compression."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def requests(chunk: int, keys: np.ndarray, weights: np.ndarray, width: int, first: int = 0) -> pa.RecordBatch:
    """A chunk's request rows; ``keys`` are distinct and in ascending order. Ranges of ``width`` are numbered from ``first``."""
    if width > np.iinfo(np.uint64).max:
        filled, cuts = [0] if len(keys) else [], [0, len(keys)] if len(keys) else [0]
    else:
        ranges = keys // np.uint64(width)
        starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(keys) else np.zeros(0, int)
        filled, cuts = ranges[starts].tolist(), [*starts.tolist(), len(keys)]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([first + b for b in filled], pa.int64()),
        "chunk": pa.array([chunk] * len(filled), pa.int64()),
        "keys": pa.array([pack_keys(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        "weights": pa.array([weights[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    })


def _merged(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of request rows the keys of each, all their weights, the distinct keys, where each key is among them, and sums."""
    keys = [unpack_keys(k) for k in rows["keys"]]
    weights = np.frombuffer(b"".join(rows["weights"]), dtype=np.uint32).astype(np.uint64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.uint64)
    np.add.at(sums, at, weights)
    return keys, weights, distinct, at, sums


def _answers(rows: pd.DataFrame, keys: list[np.ndarray], weights: np.ndarray, of_key: np.ndarray, bucket: int, least: int, aligned: bool) -> list[tuple]:
    """REPLY_SCHEMA rows to request rows; of_key: the sum of each of their keys."""
    out, start = [], 0
    for chunk, own in zip(rows["chunk"], keys, strict=True):
        found, given = of_key[start : start + len(own)], weights[start : start + len(own)]
        start += len(own)
        kept = found >= least
        if aligned:
            out.append((chunk, bucket, b"", np.where(found == given, np.uint64(0), found).tobytes()))
        elif kept.any():
            out.append((chunk, bucket, pack_keys(own[kept]), found[kept].tobytes()))
    return out


_REPLY = ["chunk", "bucket", "keys", "sums"]


def sum_by_key(asked: DataFrame, routes: Routes, least: int = 1, aligned: bool = False) -> DataFrame:
    """For each request row the keys whose sum over all chunks is at least ``least``, and those sums.

    ``asked`` are requests to the routes' groups; several kinds of keys may go by numbers of their own, kind ``n`` having
    the groups from ``n * routes.groups`` on.

    aligned: without the keys, but with the sums of all keys in the order they were asked in, 0 where the sum is what
    the chunk itself gave; for chunks that can make the same keys again.

    Rows with chunk -1 describe a bucket (of kind ``n``: from ``n * routes.buckets`` on): ``keys`` is empty and ``sums``
    holds, as four 64-bit numbers, the sum of all its weights, its distinct keys with any weight, and those of weight 1
    and 2.
    """
    if routes.groups == routes.buckets:
        return _bucket_sums(asked, least, aligned)
    relay = F.floor(F.col("chunk") / routes.groups).alias("relay")
    grouped = materialize(asked.select("bucket", relay, "chunk", "keys", "weights"), "asked")
    width, groups, buckets = routes.bucket_width, routes.groups, routes.buckets

    def ask_on(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, distinct, _, sums = _merged(rows)
        sent = requests(key[1], distinct, sums, width, key[0] // groups * buckets).to_pandas()
        return sent.assign(group=key[0])

    def hand_back(key: tuple, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=_REPLY)
        keys, weights, distinct, at, sums = _merged(rows)
        if aligned:
            told = np.frombuffer(b"".join(replies.sort_values("bucket")["sums"]), dtype=np.uint64)
            total = np.where(told > 0, told, sums)
        else:
            total = find(*lookup(replies), distinct)
        return pd.DataFrame(_answers(rows, keys, weights, total[at], key[0], least, aligned), columns=_REPLY)

    onward = materialize(grouped.groupBy("bucket", "relay").applyInPandas(ask_on, REQUEST_SCHEMA + ", group long"), "relayed")
    told = materialize(_bucket_sums(onward.select("bucket", "chunk", "keys", "weights"), least, aligned), "relay-sums")
    back = told.where("chunk >= 0").select(F.expr(f"bucket div {buckets} * {groups} + bucket % {buckets} div {buckets // groups}").alias("bucket"), F.col("chunk").alias("relay"), F.col("bucket").alias("of"), "keys", "sums")
    renamed = back.withColumnsRenamed({"bucket": "group", "of": "bucket"})
    answered = grouped.groupBy("bucket", "relay").cogroup(renamed.groupBy("group", "relay")).applyInPandas(hand_back, REPLY_SCHEMA)
    return answered.union(told.where("chunk < 0"))


def _bucket_sums(asked: DataFrame, least: int, aligned: bool) -> DataFrame:
    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, weights, _, at, sums = _merged(rows)
        facts = np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum()], dtype=np.uint64)
        return pd.DataFrame([(-1, key[0], b"", facts.tobytes()), *_answers(rows, keys, weights, sums[at], key[0], least, aligned)], columns=_REPLY)

    return asked.groupBy("bucket").applyInPandas(answer, REPLY_SCHEMA)


def lookup(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All keys that a chunk was answered, ascending and each once, and their sums.

    A chunk that is read by several tasks asks in parts: a bucket then gives it several replies, in which a key has the
    same sum over all chunks.
    """
    if not len(replies):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ordered = replies.sort_values("bucket")  # a bucket is a range of keys
    keys = np.concatenate([unpack_keys(k) for k in ordered["keys"]])
    sums = np.frombuffer(b"".join(ordered["sums"]), dtype=np.uint64)
    if (keys[1:] <= keys[:-1]).any():
        keys, first = np.unique(keys, return_index=True)
        sums = sums[first]
    return keys, sums


def find(keys: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The sum of each wanted key, 0 where it isn't known."""
    if not len(keys):
        return np.zeros(len(wanted), np.uint64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, sums[at], np.uint64(0))


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a partition that is sorted by its first column ``chunk``, one table for each chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        chunks = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != chunks[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
