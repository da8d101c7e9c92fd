"""Read screening by masked seeds, and insert-size statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions.sequences import kmers, max_base_count, reverse_complement, seed_keys
from junctura.sources.shared import materialize

#: Seeds up to which an index is shipped to the tasks (about 24 bytes each), and places of a read that are hashed at a time.
SMALL_INDEX, PLACES = 4_000_000, 1 << 18
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def seed_index(references: DataFrame, cfg: JunctionConfig, seq: str = "seq", strands: bool = True, informative: bool = True) -> DataFrame:
    """Distinct ``(mask, seed)`` of the references' k-mers, on both strands, without seeds that are nearly one base."""
    text = F.upper(F.col(seq))
    both = F.array(text, reverse_complement(text)) if strands else F.array(F.col(seq))
    each = references.select(F.explode(both).alias("s"))
    keyed = each.select(F.explode(kmers(F.col("s"), cfg.seed_length)).alias("kmer"))
    keyed = keyed.select(F.explode(seed_keys(F.col("kmer"), cfg.seed_length, cfg.seed_block)).alias("x")).select("x.mask", "x.seed")
    if informative:
        keyed = keyed.where(max_base_count(F.col("seed")) < cfg.max_seed_base)
    return keyed.distinct()


def seed_hits(reads: DataFrame, index: DataFrame, cfg: JunctionConfig, keys: list[str], seq: str = "seq", small: int = SMALL_INDEX) -> DataFrame:
    """``keys, hits``: positions of each read at which one of the masked seeds is in the index; reads without any are absent.

    An index of up to ``small`` seeds is shipped to the tasks, sorted by a hash, and reads are looked up where they lie; the
    letters are compared wherever a hash is found. A larger one is joined: positions are first reduced to those of which one half at least, which no mask touches,
    is half of an indexed seed.
    """
    index = materialize(index, "seed-index")
    if index.limit(small + 1).count() <= small:
        return _hits_by_lookup(reads, index, cfg, keys, seq)
    return _hits_by_join(reads, index, cfg, keys, seq)


def _hits_by_join(reads: DataFrame, index: DataFrame, cfg: JunctionConfig, keys: list[str], seq: str) -> DataFrame:
    k, block = cfg.seed_length, cfg.seed_block
    half = k // block // 2 * block  # a mask lies in one half of the seed
    at = reads.select(*keys, F.posexplode(kmers(F.col(seq), k)).alias("pos", "kmer"))
    left, right = F.substring("seed", -(k - half), k - half), F.substring("seed", 1, half)
    halves = index.select(F.when(F.col("mask") < half // block, F.struct(F.lit(1).alias("part"), left.alias("text"))).otherwise(F.struct(F.lit(0).alias("part"), right.alias("text"))).alias("h")).select("h.part", "h.text").distinct()
    parts = F.array(F.struct(F.lit(0).alias("part"), F.substring("kmer", 1, half).alias("text")), F.struct(F.lit(1).alias("part"), F.substring("kmer", half + 1, k).alias("text")))
    likely = at.select(*keys, "pos", "kmer", F.inline(parts)).join(halves, ["part", "text"], "left_semi").select(*keys, "pos", "kmer").distinct()
    masked = likely.select(*keys, "pos", F.inline(seed_keys(F.col("kmer"), k, block)))
    return masked.join(index, ["mask", "seed"], "left_semi").groupBy(*keys).agg(F.count_distinct("pos").alias("hits"))


def _hits_by_lookup(reads: DataFrame, index: DataFrame, cfg: JunctionConfig, keys: list[str], seq: str) -> DataFrame:
    k, block = cfg.seed_length, cfg.seed_block
    masks = k // block

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            letters = np.frombuffer("".join(batch["seed"]).encode("utf-32-le"), np.uint32).reshape(len(batch), k - block).astype(np.uint64)
            mask, place = batch["mask"].to_numpy(), np.arange(k - block)
            power = _POWERS[:k][place[None, :] + np.where(place[None, :] >= (mask * block)[:, None], block, 0)]
            mask_and_letters = np.hstack([mask[:, None].astype("<u4"), letters.astype("<u4")])
            yield pd.DataFrame({"key": _spread((letters * power).sum(1), mask.astype(np.uint64)).view(np.int64), "seed": [x.tobytes() for x in mask_and_letters]})

    table = index.mapInPandas(hashed, "key long, seed binary").toArrow()
    hashes = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    seeds = np.frombuffer(b"".join(table.column("seed").to_pylist()), "<u4").reshape(len(hashes), k - block + 1)[order]
    if seeds.max(initial=0) < 256:
        seeds = seeds.astype(np.uint8)
    shipped = reads.sparkSession.sparkContext.broadcast((hashes[order], seeds))  # ``small`` seeds at most
    types = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_keys, seeds = shipped.value
        table = np.zeros(1 << 22, dtype=bool)
        table[(index_keys >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            hits = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(len(keys))):
                letters = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)
                for start in range(0, len(letters) - k + 1, PLACES):
                    hits[row] += _hit_places(letters[start : start + PLACES + k - 1].astype(np.uint64), index_keys, seeds, table, masks, block)
            kept = pa.array(hits > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits)], names=[*keys, "hits"]).filter(kept)

    return reads.select(*keys, seq).mapInArrow(count, ", ".join([*(f"{c} {types[c]}" for c in keys), "hits long"]))


def _spread(sums: np.ndarray, mask: np.ndarray | np.uint64) -> np.ndarray:
    """Mixes every bit of a sum, and the mask, into a hash."""
    x = sums + (mask + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _hit_places(letters: np.ndarray, known: np.ndarray, seeds: np.ndarray, table: np.ndarray, masks: int, block: int) -> int:
    """Places at which one of the masked seeds is known."""
    k = masks * block
    n = len(letters) - k + 1
    blocks = [sum(letters[m * block + i : m * block + i + n] * _POWERS[m * block + i] for i in range(block)) for m in range(masks)]
    total, hit = sum(blocks), np.zeros(n, dtype=bool)
    for m in range(masks):
        keys = _spread(total - blocks[m], np.uint64(m))
        likely = np.flatnonzero(table[(keys >> np.uint64(42)).astype(np.int64)])
        likely = likely[~hit[likely]]
        at = np.searchsorted(known, keys[likely])
        others = np.delete(np.arange(k), np.arange(m * block, (m + 1) * block))
        while True:  # seeds that share a hash follow each other
            same = np.flatnonzero(at < len(known))
            same = same[known[at[same]] == keys[likely[same]]]
            likely, at = likely[same], at[same]
            if not len(likely):
                break
            found = (seeds[at, 0] == m) & (letters[likely[:, None] + others] == seeds[at, 1:]).all(axis=1)
            hit[likely[found]] = True
            likely, at = likely[~found], at[~found] + 1
    return int(hit.sum())


def screen_reads(reads: DataFrame, references: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """The pairs (``read_id, seg, seq, ...``) of which one mate at least has ``min_seed_hits`` seed hits."""
    seen = reads.withColumn("__s", F.regexp_replace(F.upper("seq"), "[^ACGT]", "A"))
    hits = seed_hits(seen, seed_index(references, cfg), cfg, ["read_id", "seg"], "__s").where(F.col("hits") >= cfg.min_seed_hits)
    return reads.join(hits.select("read_id").distinct(), "read_id", "left_semi")


def insert_size_stats(sizes: DataFrame, size: str = "size", bound: int = 1000) -> DataFrame:
    """``mean_is, upper_sd, max_is, max_is_capped`` of positive insert sizes, one row; nulls for no input.

    The mean is cut to an integer; the deviation is that of the sizes above it, around it.
    """
    usable = sizes.select(F.col(size).cast("double").alias("s")).where("s > 0")
    mean = usable.agg(F.floor(F.avg("s")).alias("mean_is"))
    above = usable.join(F.broadcast(mean)).where("s > mean_is")  # one row
    spread = above.agg(F.sqrt(F.avg((F.col("s") - F.col("mean_is")) ** 2)).alias("upper_sd"))
    top = F.col("mean_is") + 5 * F.coalesce("upper_sd", F.lit(0.0))
    return mean.join(F.broadcast(spread)).select("mean_is", "upper_sd", F.floor(top).alias("max_is"), F.least(F.ceil(top), F.lit(bound)).cast("long").alias("max_is_capped"))
