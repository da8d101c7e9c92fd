"""Alignment records: flags, mates, screening of given alignments, extraction of edges' reads, entries of new alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.sequences import NOT_PRIMARY, has_flag, is_discordant, lacks_bits, with_flag
from junctura.sources.shared import materialize


def with_mate_fields(rows: DataFrame) -> DataFrame:
    """Two chosen rows of each read, told about each other; reads without one of both segments are left out.

    ``rows``: ``read_id, seg, flag, chr, pos, rev, cigar, mate_chr, mate_pos, tlen``, one for each segment. A row whose
    mate fields or mate strand don't fit gets the mate's place and strand and an insert size of 0; secondary and
    supplementary bits are cleared; ``mate_cigar`` is the mate's CIGAR. The segments of a read meet in one aggregation.
    """
    own = F.struct("flag", "chr", "pos", "rev", "cigar", "mate_chr", "mate_pos", "tlen")
    both = rows.groupBy("read_id").agg(F.max(F.when(F.col("seg") == 1, own)).alias("a"), F.max(F.when(F.col("seg") == 2, own)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")

    def told(seg: int, x: str, y: str) -> Column:
        me, mate = F.col(x), F.col(y)
        fits = me["mate_chr"].eqNullSafe(mate["chr"]) & me["mate_pos"].eqNullSafe(mate["pos"]) & (has_flag(me["flag"], "mate_reverse") == mate["rev"])
        flag = with_flag(me["flag"], "mate_reverse", mate["rev"]).bitwiseAND(F.lit(~NOT_PRIMARY))
        return F.struct(
            F.lit(seg).alias("seg"), flag.alias("flag"), me["chr"].alias("chr"), me["pos"].alias("pos"), me["rev"].alias("rev"), me["cigar"].alias("cigar"), mate["chr"].alias("mate_chr"),
            mate["pos"].alias("mate_pos"), F.when(fits, me["tlen"]).otherwise(0).alias("tlen"), mate["cigar"].alias("mate_cigar"),
        )

    return both.select("read_id", F.inline(F.array(told(1, "a", "b"), told(2, "b", "a"))))


def primary_rows(aln: DataFrame, duplicates: bool = True) -> DataFrame:
    """Rows that are a read's first alignment; without those marked as duplicates unless ``duplicates``."""
    kept = aln.where(lacks_bits(F.col("flag"), NOT_PRIMARY))
    return kept if duplicates else kept.where(~has_flag(F.col("flag"), "duplicate"))


def worth_screening(aln: DataFrame) -> DataFrame:
    """Rows of given alignments that seeds are looked for in: no duplicates, no host reads that match from end to end."""
    plain = ~F.col("is_virus") & F.col("cigar").rlike(r"^\d+M$")
    return aln.where(~plain & ~has_flag(F.col("flag"), "duplicate"))


def discordant_rows(aln: DataFrame, span: int) -> DataFrame:
    """Mapped rows whose mate lies on another contig or further away than ``span``."""
    return aln.where(~has_flag(F.col("flag"), "unmapped") & is_discordant(F.col("chr"), F.col("mate_chr"), F.col("tlen"), span))


def edge_segments(edge_reads: DataFrame, aln: DataFrame) -> DataFrame:
    """``aln`` rows of the segments that edges rest on, with ``suffix``: H or V by organism for pairs, else the segment.

    ``edge_reads``: ``read_id, seg``, the segment null for a pair, which brings both. A read that an edge has as a pair
    is a pair. Rows are read once, by one join on read and segment.
    """
    wanted = edge_reads.groupBy("read_id").agg(F.bool_or(F.col("seg").isNull()).alias("paired"), F.collect_set("seg").alias("segs"))
    segments = wanted.select("read_id", "paired", F.explode(F.when(F.col("paired"), F.array(F.lit(1), F.lit(2))).otherwise(F.col("segs"))).alias("seg"))
    suffix = F.when(F.col("paired"), F.when(F.col("is_virus"), "V").otherwise("H")).otherwise(F.col("seg").cast("string"))
    return aln.join(segments, ["read_id", "seg"]).withColumn("suffix", suffix).drop("paired")


def sampling_regions(reads: DataFrame, least: int = 10) -> DataFrame:
    """``chr, start, end, n``: runs of reads (``chr, start, tlen``) in which each begins before the one before it ends.

    Runs of fewer than ``least`` reads are left out. Reads are cut into bins by place; only the last read before each bin
    is carried into it.
    """
    from junctura.operators.ranges import islands

    spans = reads.where("tlen > 0").select("chr", "start", (F.col("start") + F.col("tlen")).alias("end"))
    runs = islands(spans, ["chr"], "start", "end").groupBy("chr", "island")
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def random_positions(contigs: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` places ``chr, pos``, each base of the contigs (``chr, len``) being as likely as any other.

    All bases are numbered, contig after contig by name: contigs are dealt into ranges of names, and only the ranges'
    totals are summed up in one place. The numbers are cut into as many equal slices as there are contigs; a draw, a hash
    of its number and the seed, finds its contig among those of its slice. So the same seed gives the same places
    whatever the partitions are, and no draw meets all contigs.
    """
    spark = contigs.sparkSession
    dealt = contigs.where("len > 0").select("chr", F.col("len").cast("long").alias("len")).repartitionByRange("chr").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "contig-ranges")
    sums = dealt.groupBy("range").agg(F.sum("len").alias("bases"), F.count("*").alias("contigs"), F.min("chr").alias("lowest"))
    before = sums.select("range", (F.sum("bases").over(Window.orderBy("lowest")) - F.col("bases")).alias("before"))
    total, many = sums.agg(F.sum("bases"), F.sum("contigs")).first()
    if not total:
        return contigs.select("chr", F.lit(0).cast("long").alias("pos")).limit(0)
    within = F.sum("len").over(Window.partitionBy("range").orderBy("chr", "len").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = dealt.withColumn("within", within).join(before, "range").select("chr", (F.col("before") + F.col("within")).alias("stop"), "len")
    width = -(-total // many)
    first = F.col("stop") - F.col("len")
    slices = ends.select("chr", first.alias("first"), "stop", F.explode(F.sequence(F.floor(first / width), F.floor((F.col("stop") - 1) / width))).alias("slice"))
    drawn = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed).cast("long")), F.lit(total)).alias("at"))
    met = drawn.withColumn("slice", F.floor(F.col("at") / width)).join(slices, "slice")
    return met.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("stop"))).select("chr", (F.col("at") - F.col("first")).alias("pos"))


def alignment_entries(pairs: DataFrame) -> DataFrame:
    """Records of fragments aligned to both regions of an edge, one for each side.

    ``pairs``: ``frag_id``, and for the sides h and v ``_chr, _strand, _left, _len`` of the region (its window's start and
    length on the contig) and ``_begin, _end, _cigar, _q_strand, _seq`` of the alignment (of the segment as it was read). On
    a region of the ``-`` strand the place is counted from the window's end and the CIGAR turned.
    """

    def entry(me: str, mate: str, is_virus: bool) -> Column:
        def c(side: str, name: str) -> Column:
            return F.col(f"{side}_{name}")

        def reverse(side: str) -> Column:
            """On the contig's forward strand: a read turned to fit its region, or a region on the other strand, not both."""
            return (c(side, "q_strand") == "-") != (c(side, "strand") == "-")

        def place(side: str) -> Column:
            return F.when(c(side, "strand") == "-", c(side, "left") + c(side, "len") - c(side, "end") - 1).otherwise(c(side, "left") + c(side, "begin"))

        from junctura.functions.sequences import operations, oriented

        flag = with_flag(with_flag(F.lit(1 + (128 if is_virus else 64)), "reverse", reverse(me)), "mate_reverse", reverse(mate))
        cigar = F.when(c(me, "strand") == "-", F.array_join(F.reverse(operations(c(me, "cigar"))), "")).otherwise(c(me, "cigar"))
        return F.struct(
            F.lit(is_virus).alias("is_virus"), flag.alias("flag"), c(me, "chr").alias("chr"), place(me).cast("long").alias("pos"), cigar.alias("cigar"),
            c(mate, "chr").alias("mate_chr"), place(mate).cast("long").alias("mate_pos"), oriented(c(me, "seq"), reverse(me)).alias("seq"),
        )

    return pairs.select("frag_id", F.inline(F.array(entry("h", "v", False), entry("v", "h", True))))
