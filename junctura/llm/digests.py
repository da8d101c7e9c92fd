"""Operator 5: exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to one row per digest before anything is
shuffled by digest, sort-merge anti-joined with the index, and the digests it lacks are appended, so a text that fills
a third of the input still contributes one row per map task.

A table is taken in batches of ascending ids, as a corpus that grows would be: what an earlier batch has brought in is
found by the anti-join, and of equal texts the row with the smallest id is the one that stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.scratch import materialize, shuffle_partitions

#: Batches that a table is taken in, and digests in a bucket of its index, about.
BATCHES, BUCKET_ROWS = 4, 1_000_000
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(normalized(text), "UTF-8"), 256)


class DigestIndex:
    """A persistent set of digests with the row that represents each; it lies in the session's warehouse.

    ``buckets`` fixes how the table is laid out: with as many buckets as a join has partitions, or more, the index side
    of the anti-join is not shuffled. An index is sized for what it will hold when it is made; ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or shuffle_partitions(spark)

    @classmethod
    def for_rows(cls, spark: SparkSession, rows: int) -> DigestIndex:
        """A new index for about so many digests."""
        return cls(spark, buckets=max(shuffle_partitions(spark), -(-rows // BUCKET_ROWS)))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        """Columns ``digest`` and ``keep_id`` (null where every row of that text had a null id)."""
        return self.spark.table(self.table)

    def lacking(self, digested: DataFrame, id_col: str = "doc_id", digest_col: str = "text_sha256") -> DataFrame:
        """``digest, keep_id`` of the digests that the index lacks, each with its smallest id among the new rows."""
        fresh = digested.groupBy(F.col(digest_col).alias("digest")).agg(F.min(id_col).alias("keep_id"))
        if self.exists():
            fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        return fresh

    def append(self, digested: DataFrame, id_col: str = "doc_id", digest_col: str = "text_sha256") -> None:
        """Add the digests that the index lacks.

        A digest that is present keeps its row, so texts seen in an earlier batch win over later ones. Appending the
        same batch again adds nothing, so a job that died after its append can be run again.
        """
        fresh = self.lacking(digested, id_col, digest_col).repartition(self.buckets, "digest")
        fresh.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)

    def append_all(self, digested: DataFrame, batches: int = BATCHES) -> None:
        """Add ``doc_id, text_sha256`` in batches of ascending ids, rows without an id with the last."""
        bounds = digested.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)
        cuts = [None, *sorted({int(b) for b in bounds}), None]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            batch = digested if low is None else digested.where((F.col("doc_id") > low) | F.col("doc_id").isNull())
            self.append(batch if high is None else batch.where(F.col("doc_id") <= high))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _indexed(docs: DataFrame, index: DigestIndex | None, id_col: str, text_col: str) -> tuple[DataFrame, DigestIndex]:
    """``doc_id, text_sha256`` of all rows, written, and an index that knows them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"))
    digested = materialize(rows, "digests")
    index = index or DigestIndex.for_rows(docs.sparkSession, digested.count())
    index.append_all(digested)
    return digested, index


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``index`` may hold earlier tables; then a text that it knows is dropped here (``kept`` false), and ``keep_id`` is
    the earlier row's id. ``group_size`` counts the rows of this input with the text. Without one, an index is made and
    dropped again.

    * null text counts as the empty text; empty texts are one group;
    * rows with a null id join their text's group, but an id that exists is preferred as ``keep_id``; in a group where
      every id is null, ``keep_id`` is null and the rows stay (nothing names the one to keep);
    * rows that repeat an id share its fate: all rows of the smallest id are kept;
    * extra columns are ignored, so their names may clash with the results'.
    """
    digested, used = _indexed(docs, index, id_col, text_col)
    sizes = digested.groupBy(F.col("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("group_size"))
    # Written so that both sides of the next join are plain exchanges, which adaptive execution splits where a text is hot.
    groups = materialize(sizes.join(used.read(), "digest"), "digest-groups")
    if index is None:
        used.drop()
    joined = digested.join(groups, digested["text_sha256"] == groups["digest"])
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows whose text is the first of its kind; columns as given, whatever their names.

    Null texts, null ids and repeated ids as in :func:`exact_dedup`. Rows are dropped by id, so a text that many rows
    share is spread like any other, and only texts of dropped ids are hashed again, as an id may have several.
    """
    digested, used = _indexed(docs, index, id_col, text_col)
    first = (F.col("x.text_sha256") == F.col("i.digest")) & F.col("x.doc_id").eqNullSafe(F.col("i.keep_id"))
    dropped = materialize(digested.alias("x").join(used.read().alias("i"), first, "left_anti"), "dropped-copies")
    if index is None:
        used.drop()
    own_id, digest = F.col(f"d.{id_col}").cast("long"), text_digest(F.col(f"d.{text_col}"))
    nameless = F.when(own_id.isNull(), digest).otherwise("") == F.when(F.col("x.doc_id").isNull(), F.col("x.text_sha256")).otherwise("")
    same_text = F.array_contains(F.array("x.text_sha256"), digest)  # not a join key, so looked at where ids agree
    return docs.alias("d").join(dropped.alias("x"), own_id.eqNullSafe(F.col("x.doc_id")) & nameless & same_text, "left_anti")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
