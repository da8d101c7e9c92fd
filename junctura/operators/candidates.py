"""Junction candidates from chimeric pairs and from clipped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.sequences import end_position, is_full_length, is_homopolymer, left_clip, pair_strands, right_clip, split_strands


def extract_clips(aln: DataFrame, min_clip: int = 20) -> DataFrame:
    """``read_id, seg, side, anchor_is_virus, clip_len``: clips of reads that are clipped at one end only.

    ``aln``: ``read_id, seg, is_virus, left_clip, right_clip`` and, if it has them, ``alts`` whose full-length members
    rule a read out.
    """
    usable = aln
    if "alts" in aln.columns:
        usable = aln.where(~F.coalesce(F.exists("alts", lambda a: is_full_length(a["cigar"])), F.lit(False)))
    left, right = F.col("left_clip"), F.col("right_clip")
    side = F.when((left >= min_clip) & (right < min_clip), "L").when((right >= min_clip) & (left < min_clip), "R")
    return usable.withColumn("side", side).where("side IS NOT NULL").withColumn("clip_len", F.greatest(left, right)).withColumnRenamed("is_virus", "anchor_is_virus")


def with_clips(aln: DataFrame) -> DataFrame:
    """``left_clip`` and ``right_clip`` read from the CIGAR."""
    return aln.withColumn("left_clip", left_clip(F.col("cigar"))).withColumn("right_clip", right_clip(F.col("cigar")))


def chimeric_pairs(best: DataFrame) -> DataFrame:
    """Pairs with one mate on each organism: ``read_id, h_*, v_*``, by one pass over the mates of a read.

    ``best``: one row for each ``(read_id, seg)`` with ``chr, pos, rev, rlen, is_virus``.
    """
    mate = F.struct("chr", "pos", "rev", "rlen")
    sides = best.groupBy("read_id").agg(
        F.max(F.when(~F.col("is_virus"), mate)).alias("h"), F.max(F.when(F.col("is_virus"), mate)).alias("v"), F.count("*").alias("n")
    )
    both = sides.where("n = 2 AND h IS NOT NULL AND v IS NOT NULL")
    return both.select("read_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "hv" for c in ("chr", "pos", "rev", "rlen")])


def pair_candidates(pairs: DataFrame) -> DataFrame:
    """``chr, pos, strand, frag_id, is_virus``: both sides of each chimeric pair, host at its end, virus at its start."""
    host, virus = pair_strands(F.col("h_rev"), F.col("v_rev"))
    sides = F.array(
        F.struct(F.col("h_chr").alias("chr"), (F.col("h_pos") + F.col("h_rlen")).alias("pos"), host.alias("strand"), F.lit(False).alias("is_virus")),
        F.struct(F.col("v_chr").alias("chr"), F.col("v_pos").cast(pairs.schema["v_pos"].dataType).alias("pos"), virus.alias("strand"), F.lit(True).alias("is_virus")),
    )
    return pairs.select("read_id", F.explode(sides).alias("s")).select("s.chr", "s.pos", "s.strand", F.col("read_id").alias("frag_id"), "s.is_virus").distinct()


def split_candidates(anchors: DataFrame, clips: DataFrame) -> DataFrame:
    """Candidates of reads whose clip was aligned to the other organism.

    anchors: ``read_id, seg, side, anchor_is_virus, chr, pos, end``; clips: ``read_id, seg, side, c_chr, c_pos, c_end, c_rev``.
    A left clip puts the junction at the anchor's start and the clip's end, a right clip the other way round.
    """
    both = anchors.join(clips, ["read_id", "seg", "side"])
    host, virus = split_strands(F.col("anchor_is_virus"), F.col("side"), F.col("c_rev"))
    anchor_pos = F.when(F.col("side") == "L", F.col("pos")).otherwise(F.col("end"))
    clip_pos = F.when(F.col("side") == "L", F.col("c_end")).otherwise(F.col("c_pos"))
    own = F.when(F.col("anchor_is_virus"), virus).otherwise(host)
    other = F.when(F.col("anchor_is_virus"), host).otherwise(virus)
    sides = F.array(
        F.struct(F.col("chr").alias("chr"), anchor_pos.alias("pos"), own.alias("strand"), F.col("anchor_is_virus").alias("is_virus")),
        F.struct(F.col("c_chr").alias("chr"), clip_pos.alias("pos"), other.alias("strand"), (~F.col("anchor_is_virus")).alias("is_virus")),
    )
    out = both.select("read_id", "seg", F.explode(sides).alias("s"))
    return out.select("s.chr", "s.pos", "s.strand", F.col("read_id").alias("frag_id"), "s.is_virus", "seg").distinct()


def all_places(rows: DataFrame, contigs: DataFrame, keys: list[str], distinct: bool = True) -> DataFrame:
    """``keys, own_is_virus, chr, pos, end, rev, is_virus``: each row's own alignment and its alternatives, once each if ``distinct``.

    ``rows``: ``keys, is_virus, chr, pos, rev, cigar, alts`` (array of ``chr, rev, pos, cigar, nm``); ``contigs``: ``chr,
    is_virus``. Alternatives on contigs that the catalogue lacks are left out.
    """
    own = F.array(F.struct("chr", "rev", F.col("pos").cast("long").alias("pos"), "cigar"))
    others = F.transform(F.coalesce("alts", F.array().cast(rows.schema["alts"].dataType)), lambda a: F.struct(a["chr"].alias("chr"), a["rev"].alias("rev"), a["pos"].cast("long").alias("pos"), a["cigar"].alias("cigar")))
    each = rows.select(*keys, F.col("is_virus").alias("own_is_virus"), F.inline(F.concat(own, others)))
    placed = each.select(*keys, "own_is_virus", "chr", "pos", end_position(F.col("pos"), F.col("cigar")).alias("end"), "rev")
    placed = placed.distinct() if distinct else placed
    return placed.join(contigs.select("chr", "is_virus"), "chr")


def alternative_pair_candidates(segments: DataFrame, contigs: DataFrame) -> DataFrame:
    """``chr, pos, strand, frag_id, is_virus`` of pairs, every place of one mate with every place of the other.

    ``segments``: one row for each ``read_id, seg`` as for :func:`all_places`. A junction's side depends on its own mate's
    place alone, so all combinations give just the places of each: nothing is multiplied. Pairs whose mates aren't on
    different organisms, or one of whose places isn't on its mate's organism, give none.
    """
    places = all_places(segments, contigs, ["read_id", "seg"], distinct=False)
    of = Window.partitionBy("read_id")
    seg, own = F.col("seg"), F.col("own_is_virus")
    told = {
        "__segs": F.min(seg).over(of) < F.max(seg).over(of), "__organisms": F.min(own).over(of) < F.max(own).over(of), "__pure": F.bool_and(own == F.col("is_virus")).over(of),
    }
    kept = places.withColumns(told).where("__segs AND __organisms AND __pure")
    host, virus = pair_strands(F.col("rev"), F.col("rev"))
    at, strand = F.when(F.col("is_virus"), F.col("pos")).otherwise(F.col("end")), F.when(F.col("is_virus"), virus).otherwise(host)
    return kept.select("chr", at.alias("pos"), strand.alias("strand"), F.col("read_id").alias("frag_id"), "is_virus").distinct()


def alternative_split_candidates(anchors: DataFrame, clips: DataFrame, contigs: DataFrame) -> DataFrame:
    """The same of clipped reads: every place of the anchor with every place of the clip on the other organism.

    ``anchors, clips``: ``read_id, seg, side`` and what :func:`all_places` needs. Anchor places on the other organism are
    ignored; reads whose clip has no place give none.
    """
    keys = ["read_id", "seg", "side"]
    a = all_places(anchors, contigs, keys).where("own_is_virus = is_virus")
    anchor_of = anchors.select(*keys, F.col("is_virus").alias("anchor_is_virus"))
    c = all_places(clips, contigs, keys).join(anchor_of, keys).where("is_virus <> anchor_is_virus")
    a = a.withColumn("anchor_is_virus", F.col("own_is_virus")).join(c.select(*keys).distinct(), keys, "left_semi")
    c = c.join(a.select(*keys).distinct(), keys, "left_semi")
    left = F.col("side") == "L"

    def sides(places: DataFrame, is_anchor: bool) -> DataFrame:
        host, virus = split_strands(F.col("anchor_is_virus"), F.col("side"), F.col("rev"))
        at = F.when(left == F.lit(is_anchor), F.col("pos")).otherwise(F.col("end"))
        return places.select("chr", at.alias("pos"), F.when(F.col("is_virus"), virus).otherwise(host).alias("strand"), F.col("read_id").alias("frag_id"), "is_virus", "seg")

    return sides(a, True).unionByName(sides(c, False)).distinct()


def usable_pairs(pairs: DataFrame, split_reads: DataFrame, alts: DataFrame | None = None, seqs: DataFrame | None = None) -> DataFrame:
    """Pairs whose read has no good clip, no alternative on the other organism and no sequence that is nearly one base."""
    kept = pairs.join(split_reads.select("read_id").distinct(), "read_id", "left_anti")
    if alts is not None:  # read_id, is_virus (of the segment), alt_is_virus
        kept = kept.join(alts.where("is_virus <> alt_is_virus").select("read_id").distinct(), "read_id", "left_anti")
    if seqs is not None:  # read_id, seq
        kept = kept.join(seqs.where(is_homopolymer(F.col("seq"))).select("read_id").distinct(), "read_id", "left_anti")
    return kept


def candidate_support(candidates: DataFrame) -> DataFrame:
    """``chr, strand, pos, n_frags``: the labels of clustering."""
    return candidates.groupBy("chr", "strand", "pos").agg(F.count_distinct("frag_id").alias("n_frags"))
