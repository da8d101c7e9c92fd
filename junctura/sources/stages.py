"""Stages of a job as written tables that a later run finds again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Tables in a folder under the fingerprint of all that they were made of.

    A stage's fingerprint is that of its name, the settings it was given and the stages and inputs before it. So a run
    that broke off goes on behind its last whole stage, and changed inputs or settings make anew what depends on them and
    nothing else. A stage counts as whole once a table of one row beside it says so.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.marks: dict[int, str] = {}
        self.made: list[str] = []

    def given(self, df: DataFrame, version: str | None = None) -> DataFrame:
        """An input under a fingerprint: the given version, or else one of its rows, whatever their order."""
        if version is None:
            cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
            h = F.xxhash64(*cells) if cells else F.lit(0)
            row = df.select(h.alias("a"), F.xxhash64(h, F.lit(1)).alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
            version = repr((df.dtypes, *row))
        self.marks[id(df)] = self._digest("input", version)
        self._keep(df)
        return df

    def stage(self, name: str, make: Callable[[], DataFrame], *before: DataFrame, settings: object = None) -> DataFrame:
        """The table of a stage, made of ``before`` (inputs and stages) and ``settings`` unless it is there already."""
        mark = self._digest(name, repr(settings), *[self.marks[id(x)] for x in before])
        path = f"{self.folder}/{name}-{mark[:20]}"
        if not self._whole(f"{path}-whole"):
            make().write.mode("overwrite").parquet(path)
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}-whole")
            self.made.append(name)
        out = self.spark.read.parquet(path)
        self.marks[id(out)] = mark
        self._keep(out)
        return out

    def _whole(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(path).count() == 1
        except AnalysisException:  # no such path, or nothing in it
            return False

    def _keep(self, df: DataFrame) -> None:
        """Holds on to a frame, so that no other gets its number."""
        self.__dict__.setdefault("_kept", []).append(df)

    @staticmethod
    def _digest(*parts: str) -> str:
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()
