"""The whole job: from reads and references to reports, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.config import JunctionConfig
from junctura.functions import sequences as S
from junctura.operators import align, calls, candidates, cluster, dust, edgeproc, edges, mapping, screen, windows
from junctura.operators.ranges import union_all
from junctura.sources.shared import materialize
from junctura.sources.stages import Stages

REGION = ["chr", "strand", "left", "right"]
EDGE = [f"{s}_{c}" for s in "hv" for c in REGION]
FACTS = ["score", "ref_begin", "ref_end", "q_begin", "q_end", "cigar", "q_strand"]
SIDES = (("h", "host", False), ("v", "virus", True))


#: Settings that only the last stage looks at.
JUDGING = ("min_pairs", "min_host_pbs", "min_coverage", "max_masked", "pair_band", "duplicate_span", "read_len")


@dataclass
class Report:
    """What a run found. ``called``: every call with all its figures; ``accepted``, ``rejected``: their report lines, duplicates
    left out; ``remapped``: a line for each call before it was judged; ``edge_reads``: the fragments of each call."""

    called: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    remapped: DataFrame
    edge_reads: DataFrame
    made: list[str]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 0 on in a total order; rows are sorted in ranges, and only the ranges' sizes in one place."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    past = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__past"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__at", at).join(past, "__range").withColumn(name, F.col("__past") + F.col("__at")).drop("__range", "__past", "__at")


def run(
    spark: SparkSession, reads: DataFrame, host: DataFrame, virus: DataFrame, folder: str, cfg: JunctionConfig | None = None, version: str | None = None, width: int = windows.CHUNK
) -> Report:
    """Junctions between host and virus that read pairs span.

    ``reads``: ``read_id, seg (1 or 2), seq``; ``host, virus``: ``chr, seq``, with names of their own. Every stage is written
    to ``folder``; a later run with the same inputs and settings takes up where this one ended. ``version`` names the inputs'
    state; without it they are read once more for a fingerprint. ``width``: bases of a contig in a row.

    Reads without a viral seed, pairs with a missing mate, null and empty sequences come to nothing; so do empty inputs.
    """
    cfg = cfg or JunctionConfig()
    finding = replace(cfg, **{name: getattr(JunctionConfig(), name) for name in JUDGING})
    s = Stages(spark, folder)
    reads, host, virus = (s.given(df, version and f"{version}/{k}") for k, df in enumerate((reads, host, virus)))
    contigs = host.select("chr", F.upper("seq").alias("seq"), F.lit(False).alias("is_virus")).unionByName(virus.select("chr", F.upper("seq").alias("seq"), F.lit(True).alias("is_virus")))
    catalogue = contigs.select("chr", F.length("seq").cast("long").alias("len"), "is_virus")
    chunks = s.stage("chunks", lambda: windows.contig_chunks(contigs, width), host, virus, settings=width)
    screened = s.stage("screened", lambda: screen.screen_reads(reads.select("read_id", "seg", "seq"), virus, cfg), reads, virus, settings=finding)
    aligned = s.stage("aligned", lambda: _aligned(screened, contigs, cfg, width), screened, chunks, settings=finding)
    clips = s.stage("clips", lambda: _clips(aligned, contigs, cfg, width), aligned, chunks, settings=finding)
    cand = s.stage("candidates", lambda: _candidates(aligned, clips, catalogue), aligned, clips)
    edge_reads = s.stage("edges", lambda: _edges(cand, cfg), cand, settings=finding)
    regions = s.stage("regions", lambda: _regions(edge_reads, catalogue, chunks, cfg, width), edge_reads, chunks, settings=finding)
    segments = s.stage("segments", lambda: _segments(aligned, cand), aligned, cand)
    realigned = s.stage("realigned", lambda: _realigned(edge_reads, regions, segments, cfg), edge_reads, regions, segments, settings=finding)
    final = s.stage("packed", lambda: _packed(realigned, regions, segments, cand, cfg), realigned, regions, segments, cand, settings=finding)
    drafts = s.stage("drafts", lambda: _drafts(final, cfg), final, settings=finding)
    called = s.stage("called", lambda: _judged(drafts, aligned, catalogue, cfg), drafts, aligned, chunks, settings=cfg)
    line = calls.report_line().alias("line")
    return Report(
        called, calls.reported(called).select("call_id", line), calls.reported(called, rejected=True).select("call_id", line),
        drafts.withColumn("paired_with", F.lit(None).cast("long")).select("call_id", line), final.select("call_id", "frag_id", "is_split", *EDGE), s.made,
    )


def _aligned(screened: DataFrame, contigs: DataFrame, cfg: JunctionConfig, width: int) -> DataFrame:
    """Each segment's best place on either organism, as ``candidates`` takes it."""
    found = mapping.map_reads(screened, contigs, ["read_id", "seg"], cfg, width=width)
    placed = found.join(contigs.select("chr", "is_virus"), "chr").withColumn("rlen", F.col("end") - F.col("pos"))
    return candidates.with_clips(placed).join(screened.select("read_id", "seg", "seq"), ["read_id", "seg"])


def _clips(aligned: DataFrame, contigs: DataFrame, cfg: JunctionConfig, width: int) -> DataFrame:
    """Clips of reads that end on one organism and go on on the other: the anchor, and the clip's place there."""
    cut = candidates.extract_clips(aligned, cfg.min_clip_size)
    own = S.clip_sequence(S.oriented(F.upper("seq"), F.col("rev")), F.col("cigar"), F.col("side"))
    anchors = materialize(cut.select("read_id", "seg", "side", "anchor_is_virus", "chr", "pos", "end", own.alias("clip")), "anchors")
    keys, short = ["read_id", "seg", "side"], replace(cfg, min_score=cfg.min_clip_size)
    found = []
    for on_virus in (False, True):
        mine = anchors.where(F.col("anchor_is_virus") == F.lit(on_virus)).select(*keys, F.col("clip").alias("seq"))
        found.append(mapping.map_reads(mine, contigs.where(F.col("is_virus") != F.lit(on_virus)), keys, short, width=width))
    at = union_all(*found).select(*keys, F.col("chr").alias("c_chr"), F.col("pos").alias("c_pos"), F.col("end").alias("c_end"), F.col("rev").alias("c_rev"))
    return anchors.drop("clip").join(at, keys)


def _candidates(aligned: DataFrame, clips: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``chr, pos, strand, frag_id, is_virus, is_split``: both sides of every pair and split read."""
    anchors = clips.select("read_id", "seg", "side", "anchor_is_virus", "chr", "pos", "end")
    split = candidates.split_candidates(anchors, clips.select("read_id", "seg", "side", "c_chr", "c_pos", "c_end", "c_rev"))
    name = F.concat_ws(":", F.col("frag_id").cast("string"), F.col("seg").cast("string"))
    split = split.select("chr", "pos", "strand", name.alias("frag_id"), "is_virus", F.lit(True).alias("is_split"))
    others = aligned.select("read_id", "is_virus", F.explode(S.parse_alternatives(F.col("xa"))).alias("a")).select("read_id", "is_virus", F.col("a.chr").alias("chr"))
    alts = others.join(catalogue.select("chr", F.col("is_virus").alias("alt_is_virus")), "chr")
    pairs = candidates.usable_pairs(candidates.chimeric_pairs(aligned), clips, alts, aligned.select("read_id", "seq"))
    whole = candidates.pair_candidates(pairs).select("chr", "pos", "strand", F.concat(F.col("frag_id").cast("string"), F.lit(":p")).alias("frag_id"), "is_virus", F.lit(False).alias("is_split"))
    return whole.unionByName(split)


def _edges(cand: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """Supported edges' fragments, contained edges merged into their containers."""
    labels = candidates.candidate_support(cand).withColumnRenamed("n_frags", "n")
    assigned = materialize(cluster.assign_labels(labels, cfg.max_is), "assigned")
    keys = ["chr", "strand", "label_pos"]
    members = cluster.filter_fixpoint(cluster.region_members(cand, assigned), keys, cfg.region_support)
    spans = members.join(cluster.region_bounds(cand, assigned), keys).select(*REGION, "is_virus", "frag_id").distinct()
    found = materialize(edges.enumerate_edges(spans, REGION), "edge-reads")
    return edges.subsume(found.join(edges.supported_edges(found, EDGE, cfg.edge_support).select(*EDGE), EDGE, "left_semi"))


def _region_id(prefix: str = "") -> Column:
    return F.concat_ws(",", *[F.col(f"{prefix}{c}").cast("string") for c in REGION])


def _regions(edge_reads: DataFrame, catalogue: DataFrame, chunks: DataFrame, cfg: JunctionConfig, width: int) -> DataFrame:
    """``region_id, is_virus, start, end, strand, seq``: the surroundings of both regions of each edge."""
    around = windows.region_windows(edge_reads.select(*EDGE).distinct(), catalogue.select("chr", "len"), cfg.max_is)
    found = windows.region_sequences(around, chunks, width).withColumn("region_id", _region_id())
    return found.join(catalogue.select("chr", "is_virus"), "chr").select("region_id", "chr", "is_virus", "start", "end", "strand", "seq")


def _segments(aligned: DataFrame, cand: DataFrame) -> DataFrame:
    """``frag_id, is_virus, seq``: a pair's mate on each organism; of a split read the same segment twice."""
    mates = aligned.select(F.concat(F.col("read_id").cast("string"), F.lit(":p")).alias("frag_id"), "is_virus", "seq")
    split = aligned.select(F.concat_ws(":", F.col("read_id").cast("string"), F.col("seg").cast("string")).alias("frag_id"), F.explode(F.array(F.lit(False), F.lit(True))).alias("is_virus"), "seq")
    return mates.unionByName(split).join(cand.select("frag_id").distinct(), "frag_id", "left_semi")


def _realigned(edge_reads: DataFrame, regions: DataFrame, segments: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """Fragments of each edge that align to both of its regions, with the facts of both alignments."""
    named = edge_reads.withColumns({f"{s}_region": _region_id(f"{s}_") for s in "hv"})
    members = named.select(F.col("h_region").alias("region_id"), "frag_id").union(named.select("v_region", "frag_id")).distinct()
    found = align.align_segments(members, regions.select("region_id", "is_virus", "seq"), segments, cfg)
    return align.on_both_sides(named, materialize(found, "segments-aligned"), FACTS)


def _packed(realigned: DataFrame, regions: DataFrame, segments: DataFrame, cand: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """The fragments of each call: without duplicates, far and suspicious ones, each on the best of its edges."""
    ends = realigned.withColumns({f"{s}_distal": S.distal(F.lit(v), F.col(f"{s}_ref_begin"), F.col(f"{s}_ref_end")) for s, _, v in SIDES})
    single = ends.join(edgeproc.remove_duplicates(ends, EDGE, cfg.exploratory).select(*EDGE, "frag_id"), [*EDGE, "frag_id"], "left_semi")
    facts = single.withColumns({f"{s}_{a}": F.col(f"{s}_ref_{a}") for s in "hv" for a in ("begin", "end")} | {f"{s}_len": F.col(f"{s}_q_end") - F.col(f"{s}_q_begin") + 1 for s in "hv"})
    facts = materialize(facts, "single")
    near = edgeproc.within_insert_size(facts.join(calls.call_statistics(facts, EDGE, cfg).select(*EDGE, "h_bp", "v_bp"), EDGE), cfg.max_is)
    for s, _, on_virus in SIDES:
        own = segments.where(F.col("is_virus") == F.lit(on_virus)).select("frag_id", F.upper("seq").alias("__read"))
        near = near.join(own, "frag_id").withColumn(f"{s}_seq", S.oriented(F.col("__read"), F.col(f"{s}_q_strand") == "-")).drop("__read")
        near = near.join(regions.select(F.col("region_id").alias(f"{s}_region"), F.col("seq").alias(f"{s}_ref"), F.col("start").alias(f"{s}_from"), F.col("end").alias(f"{s}_to")), f"{s}_region")
    split = cand.select("frag_id", "is_split").distinct()
    named = near.join(split, "frag_id").withColumn("read_id", F.regexp_replace("frag_id", ":[^:]*$", ""))
    trusted = materialize(edgeproc.without_suspicious(named, cfg), "trusted")
    packed = edgeproc.pack_edges(trusted.select(*EDGE, "frag_id", (F.col("h_score") + F.col("v_score")).alias("score"), "read_id", "is_split"), EDGE, cfg)
    final = materialize(trusted.join(packed, [*EDGE, "frag_id"], "left_semi"), "final")
    return final.join(numbered(final.select(*EDGE).distinct(), EDGE, "call_id"), EDGE)


def _drafts(final: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """A row for each call: places on both contigs, support, consensus sequences and what of them is masked."""
    stats = calls.call_statistics(final, ["call_id"], cfg)
    facts = {f"{s}_{c}": F.first(f"{s}_{c}") for s in "hv" for c in ("chr", "strand", "from", "to")}
    each = final.groupBy("call_id").agg(*[c.alias(n) for n, c in facts.items()], F.sum(F.col("is_split").cast("int")).alias("split_reads"))
    both = stats.join(each, "call_id")

    def place(s: str) -> Column:
        """The breakpoint on the contig: regions of the other strand are counted from their window's end."""
        bp = F.col(f"{s}_bp")
        return F.when(F.col(f"{s}_strand") == "-", F.col(f"{s}_to") - bp - 1).otherwise(F.col(f"{s}_from") + bp).cast("long")

    sequences = []
    for s, side, _ in SIDES:
        laid = S.gapped_sequence(F.col(f"{s}_seq"), F.col(f"{s}_begin"), F.length(f"{s}_ref"), F.col(f"{s}_cigar"))
        rows = edgeproc.consensus(final.withColumn("row", F.xxhash64("frag_id")).withColumn("laid", laid), ["call_id"], "row", "laid")
        sequences.append(rows.select("call_id", F.lit(side).alias("side"), S.trim_unknown(F.col("consensus")).alias("seq")))
    texts = materialize(union_all(*sequences), "consensus")
    columns = {
        f"{side}_{n}": c for s, side, _ in SIDES
        for n, c in (("chr", F.col(f"{s}_chr")), ("rev", F.col(f"{s}_strand") == "-"), ("start", place(s)), ("end", place(s) + 1), ("pos", place(s)))
    }
    drafts = both.withColumns(columns | {"good_pairs": F.col("reads")}).drop(*facts, "h_bp", "v_bp", "reads")
    sided = calls.with_sequences_and_masks(drafts, texts, dust.dust_mask(texts, ["call_id", "side"]))
    wide = texts.groupBy("call_id").agg(*[F.max(F.when(F.col("side") == side, F.col("seq"))).alias(f"{side}_seq") for _, side, _ in SIDES])
    return sided.join(wide, "call_id")


def _judged(drafts: DataFrame, aligned: DataFrame, catalogue: DataFrame, cfg: JunctionConfig) -> DataFrame:
    """Calls with measured coverage, accepted or not, their partners, and whether an earlier call is the same."""
    around = windows.coverage_windows(drafts, catalogue.select("chr", "len"), cfg.max_is)
    depth = windows.depth_share(around, aligned.select("chr", "pos", "rlen", F.lit(0).alias("flag")))
    covered = calls.adjust_coverage(drafts, windows.measured_coverage(depth))
    judged = materialize(calls.accept_calls(covered, cfg, cfg.exploratory), "judged")
    pairs = calls.pair_calls(judged, cfg)
    same = calls.duplicate_calls(judged.select("call_id", *[f"{s}_{c}" for _, s, _ in SIDES for c in ("chr", "rev", "seq")]), cfg)
    return judged.join(pairs, "call_id", "left").join(same.withColumn("removed", F.lit(True)), "call_id", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
