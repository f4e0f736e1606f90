"""Tables on storage: readers, writers, provenance and screening."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import shared_folder

PARTITION = ["sector", "cam", "ccd", "cut"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked from the file system that owns it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers become NULL once, at ingest."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def load_table(spark: SparkSession, base: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``base``.parquet, else the legacy ``base``.csv (with a header)."""
    if exists(spark, f"{base}.parquet"):
        return nan_to_null(spark.read.parquet(f"{base}.parquet"))
    reader = spark.read.option("header", True).option("nanValue", "nan")
    return nan_to_null(reader.schema(schema).csv(f"{base}.csv") if schema is not None else reader.option("inferSchema", True).csv(f"{base}.csv"))


def save_table(df: DataFrame, path: str, partition: Sequence[str] = PARTITION, files_per_unit: int = 4) -> None:
    """Parquet partitioned by observing unit, as far as the columns exist."""
    parts = [c for c in partition if c in df.columns]
    if not parts:
        df.write.mode("overwrite").parquet(path)
        return
    # One exchange by unit and a spread: few files, yet a large unit is written by several tasks.
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in parts] or parts), F.lit(files_per_unit))
    df.repartition(*parts, spread).write.mode("overwrite").partitionBy(*parts).parquet(path)


def load_all_units(spark: SparkSession, root: str, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S3: all per-unit files below ``root``; unreadable ones are skipped and none at all is an error."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        out = reader.parquet(root)
    except AnalysisException as e:
        raise FileNotFoundError(f"no readable {pattern} below {root}") from e
    if _listing(spark, root, pattern).isEmpty():
        raise FileNotFoundError(f"no {pattern} below {root}")
    return out


def _listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


def skipped_units(spark: SparkSession, root: str, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S3: (path, length) of the files that ``load_all_units`` gets no row from: unreadable or empty ones."""
    read = load_all_units(spark, root, pattern, schema).select(F.col("_metadata.file_path").alias("path")).distinct()
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    return _listing(spark, root, pattern).withColumn("_p", plain).join(read.select(plain.alias("_p")), "_p", "left_anti").select("path", "length")


def with_provenance(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Sector, cam, ccd, cut and n read from a path such as Sector32/Cam1/Ccd2/Cut7of16."""
    p = path if path is not None else F.col("_metadata.file_path")
    got = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).cast("int")
    return df.select("*", got(r"(?i)Sector(\d+)").alias("sector"), got(r"(?i)Cam(\d+)").alias("cam"), got(r"(?i)Ccd(\d+)").alias("ccd"), got(r"(?i)Cut(\d+)of\d+").alias("cut"),
                     F.sqrt(got(r"(?i)Cut\d+of(\d+)").cast("double")).cast("int").alias("n"))


def export_light_curves(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Light curves (mjd, flux, flux_err), one folder per identity, method and units."""
    df.select(*by, "mjd", "flux", "flux_err").write.mode("overwrite").partitionBy(*by).parquet(path)


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose comment lines start with ``#``."""
    return spark.read.option("comment", "#").option("header", True).schema(schema).csv(path)


def screen_files(spark: SparkSession, path: str, min_bytes: int, pattern: str = "*") -> DataFrame:
    """Files of at least ``min_bytes``, from the listing alone (contents are not read)."""
    return _listing(spark, path, pattern).filter(F.col("length") >= min_bytes)
