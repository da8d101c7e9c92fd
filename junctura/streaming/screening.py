"""Read screening on a stream. A pair is judged by itself, so the batch operator's plan serves as it is, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from junctura.config import JunctionConfig
from junctura.operators.screen import screen_reads

READS = "read_id string, seg int, seq string, qual string, ord long"


def screen_stream(spark: SparkSession, source: str, references: DataFrame, target: str, checkpoint: str, cfg: JunctionConfig | None = None) -> StreamingQuery:
    """Screens the Parquet files that arrive in ``source`` (both mates of a pair in one file) and appends to ``target``.

    Each micro-batch is written in a folder by its number, so one that is run again replaces what it wrote.
    """
    cfg = cfg or JunctionConfig()

    def keep(batch: DataFrame, number: int) -> None:
        screen_reads(batch, references, cfg).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(READS).parquet(source).where(F.col("seq").isNotNull())
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
