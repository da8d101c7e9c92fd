"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

from junctura.sources.shared import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
