"""Intermediate tables in the folder that executors and driver share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from skyloom.session import shared_folder


class Scratch:
    """Writes intermediate results as Parquet below ``spark.checkpoint.dir``.

    A written table cuts lineage: a lost executor costs at most the tasks that were running,
    and Python code upstream runs once however often its output is read.  ``drop`` removes
    the tables that a later one has replaced.  Only a session without the setting (a local
    test) gets a folder of its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = shared_folder(spark)
        self.base = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back from its files."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        self.paths.append(path)
        # The shuffles behind a written table are done with; Spark removes their files as soon
        # as nothing refers to them, which otherwise waits for the driver's next collection.
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 1) -> None:
        """Delete all written tables but the last ``keep``."""
        self._delete(self.paths[:len(self.paths) - keep])

    def forget(self, back: int) -> None:
        """Delete the table written ``back`` tables before the last."""
        self._delete([self.paths[-1 - back]])

    def _delete(self, paths: list[str]) -> None:
        self.paths = [p for p in self.paths if p not in paths]
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
