"""Operator 10: best-fit packing of documents into fixed-size bins under conflicts.

A bin carries one bitmap of the sources and one of the duplicate clusters in it; a document fits a bin that has room for
it and neither its source nor its cluster. Documents come longest first. Bins are ordered by residual; the search starts
at the tightest residual that is large enough and goes on to the next until a bin is compatible; without one, a new bin
is opened.

Documents are dealt into shards of bounded size by a hash of the id, each packed on its own, so hot sources and clusters
are spread over all shards. A shard leaves some bins part-filled, which SHARD_ROWS makes few in proportion.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.digests import normalized

#: Units (here words) in a bin; documents in a shard, about.
CAPACITY, SHARD_ROWS = 2048, 20_000
#: Members in a shard from which a cluster's residuals are counted, as those of sources are.
COUNTED_CLUSTER = 32
WORD = r"[^\x20\x09-\x0D]+"


class Bins:
    """Bins of one shard, by residual and source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_residual: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.total = np.zeros(capacity + 1, np.int32)
        self.holding: dict[tuple[str, int], np.ndarray] = {}  # by tag: bins that have it, by residual

    def _shift(self, at: int, residual: int, by: int, tags: list[tuple[str, int]]) -> None:
        self.total[residual] += by
        for tag in tags:
            self.holding.setdefault(tag, np.zeros(self.capacity + 1, np.int32))[residual] += by
        lists = self.by_residual[residual]
        if by > 0:
            insort(lists.setdefault(self.sources[at], []), at)
        else:
            mine = lists[self.sources[at]]
            mine.remove(at)
            if not mine:
                del lists[self.sources[at]]

    def find(self, length: int, source: int, cluster: int, tags: list[tuple[str, int]]) -> int:
        """The tightest compatible bin, of equal ones the first opened; -1 if there is none."""
        free = self.total[length:].copy()
        for tag in tags:
            if tag in self.holding:
                np.minimum(free, self.total[length:] - self.holding[tag][length:], out=free)
        for residual in np.flatnonzero(free) + length:
            best = -1
            for bitmap, bins in self.by_residual[residual].items():
                if not bitmap & source:
                    found = next((b for b in bins if not self.clusters[b] & cluster), -1)
                    if found >= 0 and (best < 0 or found < best):
                        best = found
            if best >= 0:
                return best
        return -1

    def put(self, length: int, source: int, cluster: int, tags: list[tuple[str, int]], held: dict[int, list[tuple[str, int]]]) -> tuple[int, int]:
        """Place a document; its bin and its offset there. ``held`` has the counted tags of each bin."""
        at = self.find(length, source, cluster, tags)
        if at < 0:
            at = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            held[at] = []
        else:
            self._shift(at, self.residual[at], -1, held[at])
        offset = self.capacity - self.residual[at]
        self.residual[at] -= length
        self.sources[at] |= source
        self.clusters[at] |= cluster
        held[at] += tags
        self._shift(at, self.residual[at], 1, held[at])
        return at, offset


def pack_shard(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``doc_id, piece, bin, offset, length`` of items ``doc_id, length, source, cluster`` (null: no conflict)."""
    items = items.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable")
    source_bit = {s: 1 << k for k, s in enumerate(sorted(items["source"].dropna().unique()))}
    sizes = items["cluster"].value_counts()
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(sizes[sizes > 1].index))}
    counted = {c: k for k, c in enumerate(sorted(sizes[sizes >= COUNTED_CLUSTER].index))}
    bins, held, rests = Bins(capacity), {}, []
    out: list[tuple] = []
    for doc_id, length, source, cluster in items[["doc_id", "length", "source", "cluster"]].itertuples(index=False, name=None):
        whole, rest = divmod(int(length), capacity)
        source, cluster = (None if pd.isna(x) else x for x in (source, cluster))
        tags = [("s", source_bit[source])] if source is not None else []
        if cluster in counted:
            tags.append(("c", counted[cluster]))
        entry = (doc_id, whole, rest, source_bit.get(source, 0), cluster_bit.get(cluster, 0), tags)
        out += [(doc_id, piece, -1, 0, capacity) for piece in range(whole)]
        if rest:
            rests.append(entry)
        if not whole and not rest:
            out.append((doc_id, 0, None, 0, 0))
    # What is left of documents longer than a bin takes its place by its own length.
    for doc_id, piece, length, source, cluster, tags in sorted(rests, key=lambda e: -e[2]):
        out.append((doc_id, piece, *bins.put(length, source, cluster, tags, held), length))
    packed = pd.DataFrame(out, columns=["doc_id", "piece", "bin", "offset", "length"])
    full = packed["bin"] == -1  # a bin of its own for every full piece
    packed.loc[full, "bin"] = np.arange(len(bins.residual), len(bins.residual) + full.sum())
    return packed


def best_fit_packing(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, bin_id, bin_offset, length``: where each document lies.

    ``items``: ``doc_id long, length int, source, cluster``. A document longer than a bin is cut into pieces of full
    bins and a rest, which is packed like a document; pieces of one document conflict and never share a bin.

    * null, zero and negative lengths take no room: one row with a null bin;
    * a null source or cluster conflicts with nothing; a null id is an id like any other;
    * rows that repeat an id are packed each for itself (and conflict through their cluster);
    * an empty table gives an empty result; extra columns are ignored.
    """
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(0)).cast("long").alias("length"),
        F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"),
    )
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster"), F.lit(shards)).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = pack_shard(rows.astype({"doc_id": "Int64"}), capacity)
        local = packed["bin"].astype("Int64")
        return pd.DataFrame({"doc_id": packed["doc_id"].astype("Int64"), "piece": packed["piece"], "bin_id": local + (int(key[0]) << 32), "bin_offset": packed["offset"], "length": packed["length"]})

    return dealt.groupBy("shard").applyInPandas(pack, "doc_id long, piece int, bin_id long, bin_offset int, length int")


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as items: length in words, the source, and as cluster the texts that are equal but for white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).alias("length"), "source", F.xxhash64(normalized(text)).alias("cluster"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(document_items(spark.read.parquet(f"{sf_dir}/documents.parquet")))
