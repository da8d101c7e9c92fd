"""Queries that place reads on references, with the SQL that states what each must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators import mapping
from junctura.operators.windows import contig_chunks
from junctura.plans import views as V
from junctura.plans.queries import CFG, query
from junctura.plans.views import table
from junctura.sources.shared import materialize


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", V.dna(F.col("text")).alias("seq"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), V.dna(F.col("text")).alias("seq"))
    return materialize(docs.where("seq <> ''"), "contigs")


@query()
def mapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as reads, documents as contigs: each read's best place and how many others it has."""
    found = mapping.map_reads(_items(spark, sf_dir), _documents(spark, sf_dir), ["item_id"], CFG)
    return found.select("item_id", "chr", "rev", "pos", "end", "score", "cigar", "n_alternatives")


@query(f"""WITH i AS (SELECT item_id, {V.DNA.format("text")} AS s FROM benchmark), r AS (SELECT item_id, s, false AS rev FROM i UNION ALL SELECT item_id, translate(reverse(s), 'ACGT', 'TGCA'), true FROM i),
d AS (SELECT 'd' || doc_id AS chr, {V.DNA.format("text")} AS t FROM documents)
SELECT item_id, chr, rev, strpos(t, s) - 1 AS pos FROM r JOIN d ON length(s) >= 30 AND contains(t, s)""")
def exact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items stand letter by letter: the first place of each strand on each document among all chains' alignments."""
    items, contigs = _items(spark, sf_dir), _documents(spark, sf_dir)
    chunks = contig_chunks(contigs)
    found = mapping.chains(items, mapping.contig_minimizers(contigs), ["item_id"], ship=mapping.SMALL_READS)
    windows = mapping.chain_windows(found, contigs.select("chr", F.length("seq").cast("long").alias("len")))
    placed = mapping.aligned_chains(windows, items, chunks, ["item_id"], CFG)
    whole = placed.join(items, "item_id").where((F.col("score") == F.length("seq") * CFG.match) & (F.col("score") >= CFG.min_score))
    return whole.groupBy("item_id", "chr", "rev").agg(F.min("pos").alias("pos"))
