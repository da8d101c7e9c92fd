"""A corpus from raw documents to packed training bins, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.digests import keep_first_copies
from junctura.llm.labelled import remainder
from junctura.llm.neardup import keep_one_of_each
from junctura.llm.packing import best_fit_packing, document_items
from junctura.llm.quality import keep_good, train_quality
from junctura.llm.scratch import materialize
from junctura.llm.toxicity import drop_toxic, train_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity in hundredths from which the near-dedup stage links documents; the query op7 has its own.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the line-chain classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train_quality(docs, labels, remainder(F.col("doc_id"), 3) != 1))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the n-gram classifier finds toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels, remainder(F.col("doc_id"), 5) != 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return keep_one_of_each(docs, percent=NEAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins and offsets of what is left."""
    return best_fit_packing(document_items(docs))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("best-fit packing", packing),
]

#: Classifiers and sketches are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage applied to what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir).select(*COLUMNS), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
