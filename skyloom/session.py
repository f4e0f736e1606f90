"""Session defaults and fault-tolerant lineage cutting."""

from __future__ import annotations

import os
import re
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even if that costs one more exchange later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of long texts or arrays travel to Python a few megabytes at a time, not ten thousand rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Undefined arithmetic (x / 0, bad text) is a missing value here, not a failed job.
    "spark.sql.ansi.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes (UTC, AQE, skew handling)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Grouped pandas functions travel by value, so executors need no copy of the package.
    cloudpickle.register_pickle_by_value(sys.modules["skyloom"])
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A small local session for tests and for the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SKYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    A cluster must set it; only a session whose executors are threads of the driver gets a
    folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
