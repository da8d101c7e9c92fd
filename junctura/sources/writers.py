"""Sinks for the domain's text formats; all are written by Spark's tasks, one part file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, line: Column, path: str, compression: str = "none") -> None:
    df.select(line.alias("value")).write.text(path, compression=compression)


def write_fastq(reads: DataFrame, path: str, seg: int, compression: str = "none", in_order: bool = False) -> None:
    """One mate's records in the order of ``ord``; ``in_order``: rows come in it, as out of a sort, and are not sorted again."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), F.col("seq"), F.lit("+"), F.col("qual"))
    mine = reads.where(F.col("seg") == seg)
    write_lines(mine if in_order else mine.orderBy("ord"), record, path, compression)


def write_fasta(df: DataFrame, name: str, seq: str, path: str, line: int | None = None) -> None:
    """Each sequence in one line, or in lines of ``line`` letters."""
    letters = F.col(seq) if line is None else F.rtrim(F.regexp_replace(seq, f"(.{{{line}}})", "$1\n"), F.lit("\n"))
    write_lines(df, F.concat(F.lit(">"), F.col(name), F.lit("\n"), letters), path)


def write_tsv(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated without a header, in a total order if one is named."""
    (df.orderBy(*order) if order else df).write.csv(path, sep="\t")


def write_bed(df: DataFrame, path: str) -> None:
    """Six columns; ``chr, start, end, name, strand``."""
    write_tsv(df.select("chr", "start", "end", "name", F.lit(".").alias("dot"), "strand"), path, "chr", "start", "end", "name")


def write_edges(edge_reads: DataFrame, path: str) -> None:
    """A line for each edge: both regions as ``chr,left,right,strand``, its fragments, and how many these are; best first."""
    region = [F.concat_ws(",", *[F.col(f"{s}_{c}").cast("string") for c in ("chr", "left", "right", "strand")]) for s in "hv"]
    lines = edge_reads.select(F.concat_ws(":", *region).alias("regions"), F.col("frag_id").cast("string").alias("frag_id")).groupBy("regions")
    each = lines.agg(F.array_sort(F.collect_set("frag_id")).alias("f")).select("regions", F.array_join("f", ",").alias("frags"), F.size("f").alias("n"))
    each.orderBy(F.desc("n"), "regions").write.csv(path, sep="\t")


def write_sam(aln: DataFrame, path: str, *order: str) -> None:
    """Records as SAM lines without a header: places from 1 on, ``*`` for what is null, tags as given in ``tags``."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("*"))

    def place(c: str) -> Column:
        return (F.coalesce(c, F.lit(-1)) + 1).cast("string")

    fields = [text("read_id"), text("flag"), text("chr"), place("pos"), text("mapq"), text("cigar"), text("mate_chr"), place("mate_pos"), F.coalesce(F.col("tlen").cast("string"), F.lit("0")), text("seq"), text("qual"), F.nullif(F.col("tags"), F.lit(""))]
    write_lines(aln.orderBy(*order) if order else aln, F.concat_ws("\t", *fields), path)


def write_by_contig(aln: DataFrame, path: str) -> None:
    """Alignments in a folder for each contig, by place, so that a scan of one contig reads nothing else.

    Tasks get ranges of contig and place, and where many rows share a place parts of these, so that a large contig is many
    files and no task's share grows with a contig or a place.
    """
    dealt = aln.repartitionByRange("chr", "pos", F.xxhash64("read_id"))
    dealt.sortWithinPartitions("chr", "pos").write.partitionBy("chr").parquet(path)


def write_names(reads: DataFrame, path: str) -> None:
    write_lines(reads.select("read_id").distinct(), F.col("read_id").cast("string"), path)


def write_call_reads(reads: DataFrame, path: str) -> None:
    """The alignments of each call in a folder of its own, by place."""
    reads.repartition("call_id").sortWithinPartitions("call_id", "chr", "pos").write.partitionBy("call_id").parquet(path)
