"""Cleaning of alignments: one row for each segment of a read, with its alternatives counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions.sequences import clip_side


def best_rows(aln: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    ranked = aln.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def best_alignment(aln: DataFrame) -> DataFrame:
    """A read's best row: primary before other, mapped before unmapped, higher score (missing last), read 1, contig, place."""
    return best_rows(aln, ["read_id"], [F.col("nonprimary"), F.col("unmapped"), F.desc_nulls_last("score"), F.col("seg"), F.col("chr"), F.col("pos"), F.col("rev")])


def best_mate(aln: DataFrame, best: DataFrame) -> DataFrame:
    """For each best row the opposite segment's row that it points to, or else the best of the opposite segment.

    best: ``read_id, b_seg, b_mate_chr, b_mate_pos``.
    """
    other = aln.join(best, "read_id").where(F.col("seg") != F.col("b_seg"))
    pointed = (F.col("chr") == F.col("b_mate_chr")) & (F.col("pos") == F.col("b_mate_pos"))
    order = [F.desc(F.coalesce(pointed, F.lit(False))), F.col("nonprimary"), F.col("unmapped"), F.desc_nulls_last("score"), F.col("chr"), F.col("pos"), F.col("rev")]
    return best_rows(other, ["read_id"], order)


def alternative_counts(aln: DataFrame, place: list[str]) -> DataFrame:
    """``read_id, seg, x2, y2``: distinct places of a segment, and those of the other (0 if it has no row)."""
    own = aln.groupBy("read_id", "seg").agg(F.count_distinct(*place).alias("x2"))
    # Both segments of a read in one row: no second shuffle to look at the mate.
    both = own.groupBy("read_id").agg(F.max(F.when(F.col("seg") == 1, F.col("x2"))).alias("n1"), F.max(F.when(F.col("seg") == 2, F.col("x2"))).alias("n2"))
    pair = F.array(F.struct(F.lit(1).alias("seg"), F.col("n1").alias("x2"), F.coalesce("n2", F.lit(0)).alias("y2")), F.struct(F.lit(2).alias("seg"), F.col("n2").alias("x2"), F.coalesce("n1", F.lit(0)).alias("y2")))
    return both.select("read_id", F.explode(pair).alias("p")).select("read_id", "p.seg", "p.x2", "p.y2").where("x2 IS NOT NULL")


def merged_alternatives(aln: DataFrame) -> DataFrame:
    """``read_id, seg, alts``: the distinct alternatives of all rows of a segment (column ``alts`` an array)."""
    return aln.groupBy("read_id", "seg").agg(F.array_distinct(F.flatten(F.collect_list("alts"))).alias("alts"))


def without_template_switches(reads: DataFrame) -> DataFrame:
    """Without rows that look like a strand switch of the template.

    ``reads``: ``cigar, rev, is_virus, alts`` (array of ``chr, rev, pos, cigar, nm, is_virus``). Rows clipped at both
    ends go; alternatives clipped at both ends are ignored; a clipped row goes if an alternative on the same organism is
    clipped at the opposite side on its strand, or at the same side on the other strand.
    """
    side = clip_side(F.col("cigar"))

    def switched(a: Column) -> Column:
        other = clip_side(a["cigar"])
        opposite = F.when(a["rev"] == F.col("rev"), F.lit(3) - side).otherwise(side)
        return (a["is_virus"] == F.col("is_virus")) & (other == opposite)  # 1 or 2, as ``side`` is where this is asked

    return reads.where((side != 3) & ~((side > 0) & F.exists(F.coalesce("alts", F.array().cast(reads.schema["alts"].dataType)), switched)))
