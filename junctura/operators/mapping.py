"""Reads placed on references of any size: a minimizer index, chains of its hits, alignment within the chains' windows.

* The index holds each reference's minimizers, the k-mers of least hash among ``w`` neighbours, under the hash of the smaller
  of both strands. It is a table in buckets of that hash, so reads' minimizers are shuffled to it and it is never moved.
* Hits of a read on one contig and strand are cut into chains where neighbouring diagonals, or places along one, lie more
  than ``MAX_GAP`` apart. This is windows over a read's hits: nothing is gathered, and a seed that repeats in the reference is
  as many rows, which adaptive execution deals out if there are too many for a task.
* Only a chain's window is aligned. The best alignment is the read's place, the others its alternatives.

Nothing is capped: every hit takes part in a chain, and every chain that spells ``min_chain`` letters is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions.sequences import alternative_text, reverse_complement
from junctura.operators.align import RESULT, align_many, codes
from junctura.operators.windows import CHUNK, contig_chunks, region_sequences

#: Length of k-mers, and how many neighbours one is the least of; a stretch of K + W - 1 letters that read and reference
#: have in common holds a hit.
K, W = 15, 6
#: How far diagonals, and places along one, of neighbouring hits of a chain may lie apart.
MAX_GAP = 60
BUCKETS = 64
#: Minimizers of reads up to which they are shipped to the index (about 50 bytes each) and not both dealt by their hash.
SMALL_READS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def minimizers(letters: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, pos, rev`` of a sequence's minimizers (letters as numbers, 4 for unknown): every k-mer that has the least hash of
    some w neighbours, ties included; k-mers with unknown letters and those that equal their other strand have none."""
    n = len(letters) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    wide = letters.astype(np.uint64)
    for j in range(k):
        part = wide[j : j + n] & np.uint64(3)
        forward = (forward << np.uint64(2)) | part
        backward |= (np.uint64(3) - part) << np.uint64(2 * j)
    least = np.minimum(forward, backward)
    key = (least ^ (least >> np.uint64(17))) * _MIX
    key = (key ^ (key >> np.uint64(32))) >> np.uint64(1)  # a long of Spark
    unknown = np.cumsum(np.append(0, letters > 3))
    key[(unknown[k:] > unknown[:-k]) | (forward == backward)] = np.uint64(1 << 63)
    size = min(w, n)
    low = np.lib.stride_tricks.sliding_window_view(key, size).min(axis=1)
    around = np.concatenate([np.zeros(size - 1, np.uint64), low, np.zeros(size - 1, np.uint64)])
    chosen = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(around, size).max(axis=1) == key) & (key < np.uint64(1 << 63)))
    return key[chosen].astype(np.int64), chosen, forward[chosen] > backward[chosen]


def _with_minimizers(rows: DataFrame, keys: list[str], seq: str, k: int, w: int) -> DataFrame:
    """``keys, key, pos, rev``: the minimizers of each row's sequence, and its length as ``size``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimizers(codes(s.as_py() or ""), k, w) for s in batch.column(len(keys))]
            sizes = np.array([len(s.as_py() or "") for s in batch.column(len(keys))], np.int64)
            row = np.repeat(np.arange(batch.num_rows), [len(x[0]) for x in found])
            key, pos, rev = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, bool)))
            columns = [batch.column(c).take(pa.array(row)) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(key), pa.array(pos), pa.array(rev), pa.array(sizes[row])], names=[*keys, "key", "pos", "rev", "size"])

    return rows.select(*keys, seq).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "key long, pos long, rev boolean, size long"]))


def minimizer_index(chunks: DataFrame, width: int = CHUNK, k: int = K, w: int = W) -> DataFrame:
    """``key, chr, r_pos, r_rev`` of references in chunks (``chr, chunk, part``), each chunk with the letters of the next that its
    last windows reach into."""
    over = chunks.select("chr", (F.col("chunk") - 1).alias("chunk"), F.substring("part", 1, k + w - 2).alias("more"))
    whole = chunks.join(over, ["chr", "chunk"], "left").select("chr", "chunk", F.concat("part", F.coalesce("more", F.lit(""))).alias("seq"))
    found = _with_minimizers(whole, ["chr", "chunk"], "seq", k, w)
    at = found.select("key", "chr", (F.col("chunk") * width + F.col("pos")).alias("r_pos"), F.col("rev").alias("r_rev"))
    return at.distinct()  # what two chunks see of their border


def contig_minimizers(contigs: DataFrame, width: int = CHUNK, k: int = K, w: int = W) -> DataFrame:
    """:func:`minimizer_index` of contigs as rows (``chr, seq``), made where they lie: each stretch of ``width`` letters is seen with
    the letters around it that its k-mers' windows reach into and keeps the minimizers that begin in it, so nothing is moved.

    Chunks whose last one is shorter than a window may give some more, which are no minimizers of the contig.
    """
    last = F.greatest(F.ceil(F.length("seq") / width) - 1, F.lit(0))
    each = contigs.select("chr", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    lead = F.when(F.col("chunk") > 0, w - 1).otherwise(0)
    begin = F.col("chunk") * width - lead
    around = each.select("chr", "chunk", F.substring("seq", (begin + 1).cast("int"), (lead + width + k + w - 2).cast("int")).alias("seq"))
    found = _with_minimizers(around, ["chr", "chunk"], "seq", k, w).withColumn("at", F.col("pos") - lead)
    return found.where((F.col("at") >= 0) & (F.col("at") < width)).select("key", "chr", (F.col("chunk") * width + F.col("at")).alias("r_pos"), F.col("rev").alias("r_rev"))


def write_index(index: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """The index as a table of the session's catalogue, in sorted buckets of its key, for any number of later jobs."""
    index.write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(table)
    return index.sparkSession.table(table)


def chains(reads: DataFrame, index: DataFrame, keys: list[str], seq: str = "seq", k: int = K, w: int = W, max_gap: int = MAX_GAP, ship: int = 0) -> DataFrame:
    """``keys, chr, rev, start, end, letters, size``: places of the reference that a read may come from.

    Of a read as it would lie on the reference, ``start`` and ``end`` are where its first and last letter would be if the
    chain's outermost diagonals went on; ``letters``: how many of its letters the chain's hits spell at least. Up to ``ship``
    minimizers of reads are shipped to an index that isn't written.
    """
    mine = _with_minimizers(reads, keys, seq, k, w)
    if ship and mine.limit(ship + 1).count() <= ship:
        mine = F.broadcast(mine)  # the index stays where it is
    met = mine.join(index, "key")
    rev = F.col("rev") != F.col("r_rev")
    # On the other strand the read is turned round, so that diagonals of both kinds are reference less read.
    q_pos = F.when(rev, F.col("size") - F.col("pos") - k).otherwise(F.col("pos"))
    hits = met.select(*keys, "chr", rev.alias("rev"), q_pos.alias("q"), "r_pos", (F.col("r_pos") - q_pos).alias("diagonal"), "size")
    group = [*keys, "chr", "rev"]

    def cut(by: list[str], order: list[str], value: str, name: str) -> Column:
        ordered = Window.partitionBy(*by).orderBy(*order)
        step = F.col(value) - F.lag(value).over(ordered)
        return F.when(step.isNull() | (step > max_gap), 1).otherwise(0).alias(name), ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    opens, so_far = cut(group, ["diagonal", "r_pos"], "diagonal", "__o")
    banded = hits.select("*", opens).withColumn("band", F.sum("__o").over(so_far)).drop("__o")
    opens, so_far = cut([*group, "band"], ["r_pos", "q"], "r_pos", "__o")
    linked = banded.select("*", opens).withColumn("chain", F.sum("__o").over(so_far)).drop("__o")
    # Letters that a hit adds to those of the hits before it along the read.
    along = Window.partitionBy(*group, "band", "chain").orderBy("q")
    past = F.col("q") - F.lag("q").over(along)
    added = F.when(past.isNull(), k).otherwise(F.least(past, F.lit(k)))
    facts = [F.min("diagonal").alias("start"), (F.max("diagonal") + F.max("size")).alias("end"), F.sum("added").alias("letters"), F.max("size").alias("size")]
    return linked.withColumn("added", added).groupBy(*group, "band", "chain").agg(*facts).drop("band", "chain")


def chain_windows(found: DataFrame, lengths: DataFrame, slack: int = MAX_GAP) -> DataFrame:
    """Chains (as of :func:`chains`) with ``w_start, w_end``, their windows on the contig, each window of a read once."""
    inside = found.join(lengths.select("chr", "len"), "chr")
    start, end = F.greatest(F.col("start") - slack, F.lit(0)), F.least(F.col("end") + slack, F.col("len"))
    return inside.withColumns({"w_start": start, "w_end": end}).where("w_start < w_end").drop("start", "end", "len")


def aligned_chains(windows: DataFrame, reads: DataFrame, chunks: DataFrame, keys: list[str], cfg: JunctionConfig, seq: str = "seq", width: int = CHUNK) -> DataFrame:
    """``keys, chr, rev, pos, end, score, q_begin, q_end, cigar``: reads aligned to their windows, equal places once.

    Windows that reach over chunks are put together once, however many reads share them; of equal places the one with the best
    score stays.
    """
    text = F.when(F.col("rev"), reverse_complement(F.upper(F.col(seq)))).otherwise(F.upper(F.col(seq)))
    own = windows.join(reads.select(*keys, F.col(seq)), keys).withColumn("__q", text).drop(seq)
    first, last = F.floor(F.col("w_start") / width), F.floor((F.col("w_end") - 1) / width)
    # A window within a chunk is cut out where it meets the chunk, and aligned there.
    cut = F.substring("part", (F.col("w_start") - F.col("chunk") * width + 1).cast("int"), (F.col("w_end") - F.col("w_start")).cast("int"))
    within = own.where(first == last).withColumn("chunk", first).join(chunks, ["chr", "chunk"]).withColumn("__ref", cut).drop("chunk", "part")
    across = own.where(first != last)
    spots = across.select("chr", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.lit("+").alias("strand")).distinct()
    texts = region_sequences(spots, chunks, width).select("chr", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.col("seq").alias("__ref"))
    both = within.unionByName(across.join(texts, ["chr", "w_start", "w_end"]))
    row = both.select(*keys, "chr", "rev", "w_start", _aligned(F.col("__q"), F.col("__ref"), cfg).alias("a")).where("a IS NOT NULL AND a.score IS NOT NULL")
    at = row.select(*keys, "chr", "rev", (F.col("w_start") + F.col("a.ref_begin")).alias("pos"), (F.col("w_start") + F.col("a.ref_end") + 1).alias("end"), "a.score", "a.q_begin", "a.q_end", "a.cigar")
    facts = F.max(F.struct("score", "end", "q_begin", "q_end", "cigar")).alias("m")
    return at.groupBy(*keys, "chr", "rev", "pos").agg(facts).select(*keys, "chr", "rev", "pos", "m.*")


def _aligned(query: Column, ref: Column, cfg: JunctionConfig) -> Column:
    def run(queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        found = align_many(list(zip(queries, refs, strict=True)), cfg)
        out = pd.DataFrame([x or (None,) * 6 for x in found], columns=["score", "ref_begin", "ref_end", "q_begin", "q_end", "cigar"])
        return out.astype({c: "Int32" for c in out.columns[:5]})

    return F.pandas_udf(run, RESULT)(query, ref)


def best_and_alternatives(alignments: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Each read's best alignment, ``n_alternatives`` and ``xa``: the others whose score is at least ``share`` of the best.

    Of equal scores the first by contig, place and strand is the best; alternatives are written in that order after score.
    """
    order = [F.desc("score"), "chr", "pos", "rev"]
    own = Window.partitionBy(*keys)
    ranked = alignments.withColumn("__n", F.row_number().over(own.orderBy(*order))).withColumn("__top", F.max("score").over(own))
    near = ranked.where(F.col("score") >= F.lit(share) * F.col("__top"))
    mismatches = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[XID]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    text = F.struct("__n", alternative_text(F.col("chr"), F.col("rev"), F.col("pos"), F.col("cigar"), mismatches).alias("t"))
    others = near.groupBy(*keys).agg(F.sum(F.when(F.col("__n") > 1, 1).otherwise(0)).alias("n_alternatives"), F.sort_array(F.collect_list(F.when(F.col("__n") > 1, text))).alias("__xa"))
    listed = others.select(*keys, "n_alternatives", F.array_join(F.transform("__xa", lambda x: x["t"]), "").alias("xa"))
    return near.where("__n = 1").drop("__n", "__top").join(listed, keys)


def map_reads(
    reads: DataFrame, contigs: DataFrame, keys: list[str], cfg: JunctionConfig | None = None, seq: str = "seq", index: DataFrame | None = None, width: int = CHUNK, min_chain: int = K
) -> DataFrame:
    """Where reads (``keys, seq``) lie on contigs (``chr, seq``), both strands searched.

    ``keys, chr, rev, pos, end, score, q_begin, q_end, cigar, n_alternatives, xa``; ``rev``: the read's other strand lies there.
    Positions are 0-based, ``end`` exclusive; alignments are those that ``align`` finds within a chain's window, of at least
    ``min_score``. Reads without a place are left out, as are null and empty ones. ``keys`` have to tell reads apart.

    * a read that shares no stretch of K + W - 1 letters with its place may be missed; ``index`` reuses a written one;
    * places that overlap a better one of the same read and strand (chains of one repeat) are alternatives like others.
    """
    cfg = cfg or JunctionConfig()
    upper = contigs.select("chr", F.upper("seq").alias("seq"))
    chunks = contig_chunks(upper, width)
    lengths = contigs.select("chr", F.length("seq").cast("long").alias("len"))
    met = {"index": index} if index is not None else {"index": contig_minimizers(upper, width), "ship": SMALL_READS}
    found = chains(reads, keys=keys, seq=seq, **met).where(F.col("letters") >= min_chain)
    placed = aligned_chains(chain_windows(found, lengths), reads, chunks, keys, cfg, seq, width).where(F.col("score") >= cfg.min_score)
    return best_and_alternatives(placed, keys, cfg.relative_score)


def open_index(spark: SparkSession, table: str) -> DataFrame:
    """An index that :func:`write_index` wrote."""
    return spark.table(table)
