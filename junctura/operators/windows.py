"""Windows on contigs: around regions and calls, their sequences, and the reads that cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import NOT_IN_DEPTH, lacks_bits, reverse_complement, slop, strand_slop
from junctura.operators.ranges import covered_share

#: Bases of a contig in a row of :func:`contig_chunks`.
CHUNK = 1 << 16


def contig_chunks(contigs: DataFrame, width: int = CHUNK) -> DataFrame:
    """``chr, chunk, part``: contigs (``chr, seq``) cut into rows of ``width`` bases, so that no join carries a whole one."""
    last = F.greatest(F.ceil(F.length("seq") / width) - 1, F.lit(0))
    each = contigs.select("chr", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return each.select("chr", "chunk", F.substring("seq", (F.col("chunk") * width + 1).cast("int"), F.lit(width)).alias("part"))


def region_windows(edges: DataFrame, lengths: DataFrame, by: int) -> DataFrame:
    """``chr, start, end, strand, left, right``: both regions of each edge widened by ``by`` within their contigs, once each.

    ``edges``: for the sides h and v ``_chr, _strand, _left, _right``; ``lengths``: ``chr, len``. Regions on contigs that the
    catalogue lacks are left out.
    """
    names = ("chr", "strand", "left", "right")
    both = edges.select(F.inline(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in names]) for s in "hv"]))).distinct()
    start, end = slop(F.col("left"), F.col("right"), F.lit(by), F.col("len"))
    return both.join(lengths, "chr").select("chr", start.alias("start"), end.alias("end"), "strand", "left", "right")


def region_sequences(windows: DataFrame, chunks: DataFrame, width: int = CHUNK) -> DataFrame:
    """``windows`` (``chr, start, end, strand, ...``) with ``seq``, the other strand's where ``strand`` is ``-``.

    A window is joined with the chunks it touches and put together from their parts; windows that lie outside their contig,
    or are empty, have an empty sequence. ``chunks`` must have been made with the same width.
    """
    keys = windows.columns
    touched = F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))
    at = windows.distinct().withColumn("chunk", F.explode(touched))
    first = F.greatest(F.col("start") - F.col("chunk") * width, F.lit(0))
    last = F.least(F.col("end") - F.col("chunk") * width, F.lit(width))
    piece = F.substring("part", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
    pieces = at.join(chunks, ["chr", "chunk"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", F.coalesce(piece, F.lit("")).alias("p")))).alias("ps"))
    seq = F.array_join(F.transform("ps", lambda p: p["p"]), "")
    return pieces.select(*keys, F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))


def coverage_windows(calls: DataFrame, lengths: DataFrame, max_is: int) -> DataFrame:
    """``call_id, is_virus, chr, w_start, w_end``: where the reads of a call should lie on either side of its junction.

    ``calls``: ``call_id`` and for the sides host and virus ``_chr, _rev, _start, _end``. On the host that is ``max_is`` upstream
    of the breakpoint along its strand, on the virus as much downstream.
    """
    out = []
    for side, up, down in (("host", max_is, 0), ("virus", 0, max_is)):
        own = calls.select("call_id", F.lit(side == "virus").alias("is_virus"), F.col(f"{side}_chr").alias("chr"), F.when(F.col(f"{side}_rev"), "-").otherwise("+").alias("strand"), F.col(f"{side}_start").alias("s"), F.col(f"{side}_end").alias("e"))
        start, end = strand_slop(F.col("s"), F.col("e"), F.col("strand"), F.lit(up), F.lit(down), F.col("len"))
        out.append(own.join(lengths, "chr").select("call_id", "is_virus", "chr", start.alias("w_start"), end.alias("w_end")))
    return out[0].unionByName(out[1])


def depth_share(windows: DataFrame, aln: DataFrame) -> DataFrame:
    """``call_id, is_virus, covered, share``: how much of each window is under a read that counts.

    ``aln``: ``chr, pos, rlen, flag``; unmapped, secondary, failed and duplicate rows don't count.
    """
    spans = aln.where(lacks_bits(F.col("flag"), NOT_IN_DEPTH)).select("chr", F.col("pos").alias("s"), (F.col("pos") + F.col("rlen")).alias("e"))
    named = windows.withColumn("id", F.struct("call_id", "is_virus"))
    return covered_share(named, spans).select("id.call_id", "id.is_virus", "covered", "share")


def measured_coverage(shares: DataFrame) -> DataFrame:
    """``call_id, m_host, m_virus``: both sides' shares in one row, as ``calls.adjust_coverage`` takes them."""
    def of(is_virus: bool):
        return F.max(F.when(F.col("is_virus") == F.lit(is_virus), F.col("share")))

    return shares.groupBy("call_id").agg(of(False).alias("m_host"), of(True).alias("m_virus"))
