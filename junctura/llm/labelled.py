"""Labelled documents for training classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents for which ``usable`` (a condition on doc_id) holds.

    Which ones is settled by a hash of the id, so it depends on neither partitions nor order. Ids with contradictory
    labels are left out. The ids are a broadcast of at most ``bound`` rows, so only texts of the sample are shuffled;
    equal texts count once, with the label of the smallest id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & usable)
    one = known.groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other")
    chosen = one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    first = rows.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("first"))
    return first.select("first.doc_id", "text", "first.label")
