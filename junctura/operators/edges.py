"""Edges between host and virus regions that share fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators.containment import containers
from junctura.operators.ranges import islands
from junctura.sources.shared import materialize


def enumerate_edges(members: DataFrame, region: list[str]) -> DataFrame:
    """``h_*, v_*, frag_id``: every host region with every virus region of a fragment, once."""
    host = members.where(~F.col("is_virus")).select("frag_id", *[F.col(c).alias(f"h_{c}") for c in region])
    virus = members.where("is_virus").select("frag_id", *[F.col(c).alias(f"v_{c}") for c in region])
    return host.join(virus, "frag_id").distinct()


def supported_edges(edge_reads: DataFrame, edge: list[str], support: int = 3) -> DataFrame:
    """``edge, n_reads`` of edges with ``support`` distinct fragments."""
    return edge_reads.groupBy(*edge).agg(F.count_distinct("frag_id").alias("n_reads")).where(F.col("n_reads") >= support)


def edge_blocks(edges: DataFrame) -> DataFrame:
    """``edges`` with ``block``: runs, by host and virus contigs and strands, whose host spans overlap."""
    keys = ["h_chr", "h_strand", "v_chr", "v_strand"]
    return islands(edges, keys, "h_left", "h_right", "block", ("v_left", "v_right"))


def subsume(edge_reads: DataFrame) -> DataFrame:
    """Edge reads with contained edges' reads moved to their containers, once each.

    The reads are written first, as they are needed for the edges and again to be moved.
    """
    edge_reads = materialize(edge_reads, "edge-reads")
    keys = ["h_chr", "h_strand", "v_chr", "v_strand"]
    spans = ["h_left", "h_right", "v_left", "v_right"]
    to = containers(edge_reads.select(*keys, *spans))
    moved = edge_reads.join(to, [*keys, *spans])
    return moved.select(*keys, *[F.col(f"to_{c}").alias(c) for c in spans], "frag_id").distinct()


def effective_reads(edge_reads: DataFrame, edge: list[str]) -> DataFrame:
    """``edge, effective``: a read counts 1, or a half if its mate is on the edge too, and a split read adds 1 once.

    ``edge_reads``: ``edge, read_id, seg`` (null for a pair, 1 or 2 for a split mate).
    """
    mates = F.count("*").over(Window.partitionBy(*edge, "read_id"))
    weighed = edge_reads.select(*edge, "read_id", "seg").distinct().withColumn("w", F.when(F.col("seg").isNotNull() & (mates > 1), 0.5).otherwise(1.0))
    return weighed.groupBy(*edge).agg((F.sum("w") + F.max(F.when(F.col("seg").isNotNull(), 1.0).otherwise(0.0))).alias("effective"))


def unique_reads(edge_reads: DataFrame, edge: list[str]) -> DataFrame:
    """``edge, n_reads, n_unique``: reads of an edge, and those on no other edge."""
    alone = F.when(F.count("*").over(Window.partitionBy("frag_id")) == 1, 1).otherwise(0)
    return edge_reads.select(*edge, "frag_id").distinct().withColumn("a", alone).groupBy(*edge).agg(F.count("*").alias("n_reads"), F.sum("a").alias("n_unique"))
