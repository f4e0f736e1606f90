"""Views of the given tables in the engine's data model, in Spark and in SQL.

Each ``*_SQL`` text computes the same rows as the function of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH0 = 1704067200  # 2024-01-01 in Unix seconds


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)


def r6(col: Column | str, n: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, n)


def R(expr: str, n: int = 6) -> str:
    """SQL twin of ``r6``; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {n}) + 0e0)"


def sources(spark, sf) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("objid"),
        F.floor((seconds("ts") - EPOCH0) / 1800).cast("long").alias("frame"),
        v.alias("flux"),
        F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long").alias("flux_sign"),
        (v / 10).alias("snr"),
        (((F.col("event_id") * 37) % 2048) / F.lit(8.0) + (v - F.floor(v)) * 0.4).alias("x"),
        (((F.col("event_id") * 101) % 2048) / F.lit(8.0) + (v * 10 - F.floor(v * 10)) * 0.4).alias("y"),
        (seconds("ts") / 86400 + 40587).alias("mjd"),
        F.when(F.col("event_id") % 3 == 0, 4).otherwise(1).cast("long").alias("frame_bin"),
        (F.col("event_id") % 8).alias("source_mask"),
    )


SOURCES_SQL = f"""SELECT event_id, user_id AS objid,
  CAST(floor((epoch(ts) - {EPOCH0}) / 1800) AS BIGINT) AS frame, value AS flux,
  CAST(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS BIGINT) AS flux_sign, value / 10e0 AS snr,
  ((event_id * 37) % 2048) / 8e0 + (value - floor(value)) * 4e-1 AS x,
  ((event_id * 101) % 2048) / 8e0 + (value * 10e0 - floor(value * 10e0)) * 4e-1 AS y,
  epoch(ts) / 86400e0 + 40587e0 AS mjd,
  CAST(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS BIGINT) AS frame_bin, event_id % 8 AS source_mask
  FROM events"""


def stars(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    gmag = 8 + (F.col("c_acctbal") + 1000) / 1000
    return table(spark, sf, "customer").select(
        k.alias("source"), (((k * 137) % 36000) / F.lit(100.0)).alias("ra"),
        (((k * 59) % 12000) / F.lit(100.0) - 60).alias("dec"), gmag.alias("gmag"),
        F.when(k % 29 != 0, gmag - 0.5).alias("rpmag"), F.col("c_mktsegment").alias("var_type"),
        F.col("c_nationkey").cast("long").alias("nation"),
    )


STARS_SQL = """SELECT c_custkey AS source, ((c_custkey * 137) % 36000) / 100e0 AS ra,
  ((c_custkey * 59) % 12000) / 100e0 - 60e0 AS dec, 8e0 + (c_acctbal + 1000e0) / 1000e0 AS gmag,
  CASE WHEN c_custkey % 29 <> 0 THEN 8e0 + (c_acctbal + 1000e0) / 1000e0 - 5e-1 END AS rpmag,
  c_mktsegment AS var_type, CAST(c_nationkey AS BIGINT) AS nation FROM customer"""


def detections(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    start = seconds("o_orderdate") / 86400 + 40587
    return table(spark, sf, "orders").select(
        k.alias("eventkey"), F.col("o_custkey").alias("objid"),
        (((k * 137) % 36000) / F.lit(100.0) + F.lit(0.001) * (k % 7)).alias("ra"),
        (((k * 59) % 12000) / F.lit(100.0) - 60 + F.lit(0.001) * (k % 5)).alias("dec"),
        (F.lit(0.002) + F.lit(0.001) * (k % 3)).alias("ra_err"), F.lit(0.002).alias("dec_err"),
        start.alias("mjd_start"), (start + F.col("o_totalprice") / 50000).alias("mjd_end"),
        F.col("o_totalprice").alias("snr"),
        F.when(k % 4 == 0, -1).otherwise(1).cast("long").alias("flux_sign"),
        F.element_at(F.array(*[F.lit(b).cast("long") for b in (1, 2, 4)]), (k % 3 + 1).cast("int")).alias("frame_bin"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


DETECTIONS_SQL = """SELECT o_orderkey AS eventkey, o_custkey AS objid,
  ((o_orderkey * 137) % 36000) / 100e0 + 1e-3 * (o_orderkey % 7) AS ra,
  ((o_orderkey * 59) % 12000) / 100e0 - 60e0 + 1e-3 * (o_orderkey % 5) AS dec,
  2e-3 + 1e-3 * (o_orderkey % 3) AS ra_err, 2e-3 AS dec_err,
  epoch(o_orderdate) / 86400e0 + 40587e0 AS mjd_start,
  epoch(o_orderdate) / 86400e0 + 40587e0 + o_totalprice / 50000e0 AS mjd_end, o_totalprice AS snr,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END AS BIGINT) AS flux_sign,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS BIGINT) AS frame_bin,
  o_orderstatus AS status, o_orderpriority AS priority FROM orders"""


def series(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pt"),
        (seconds("l_shipdate") / 86400).alias("t"), (F.col("l_extendedprice") / 1000).alias("flux"),
        (F.lit(0.5) + F.col("l_discount") * 10).alias("err"), F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"),
    )


SERIES_SQL = """SELECT l_suppkey AS series, l_orderkey * 8 + l_linenumber AS pt, epoch(l_shipdate) / 86400e0 AS t,
  l_extendedprice / 1000e0 AS flux, 5e-1 + l_discount * 10e0 AS err, l_returnflag AS flag, l_quantity AS qty,
  l_partkey AS part FROM lineitem"""


def pixels(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", "label", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"),
        F.floor(F.col("i") / 8).cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"))


PIXELS_SQL = """SELECT vec_id, label, i, v, i // 8 AS y, i % 8 AS x FROM (
  SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def zeropoints(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        (F.col("n_regionkey") + 1).cast("long").alias("sector"), (1 + k % 4).alias("cam"),
        (1 + F.floor(k / 4) % 4).cast("long").alias("ccd"), (1 + k % 16).alias("cut"), k.alias("star"),
        (20 + F.col("s_acctbal") / 10000).alias("zp_ab"), (11 + (k % 90) / F.lit(20.0)).alias("rp"),
        (F.lit(0.01) + (k % 13) / F.lit(100.0)).alias("e_zp"))


ZEROPOINTS_SQL = """SELECT CAST(n_regionkey + 1 AS BIGINT) AS sector, 1 + s_suppkey % 4 AS cam, 1 + (s_suppkey // 4) % 4 AS ccd,
  1 + s_suppkey % 16 AS cut, s_suppkey AS star, 20e0 + s_acctbal / 10000e0 AS zp_ab, 11e0 + (s_suppkey % 90) / 20e0 AS rp,
  1e-2 + (s_suppkey % 13) / 100e0 AS e_zp FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def frame_grid(spark, sf) -> DataFrame:
    """Reduced frames: the occupied ten-minute slots; gaps are those of the events."""
    slot = F.floor(seconds("ts") / 600).cast("long")
    return (table(spark, sf, "events").select(slot.alias("slot")).distinct()
            .select("slot", (F.col("slot") * 600 / F.lit(86400.0) + 40587).alias("mjd")))


FRAME_GRID_SQL = """SELECT slot, slot * 600 / 86400e0 + 40587e0 AS mjd FROM (
  SELECT DISTINCT CAST(floor(epoch(ts) / 600e0) AS BIGINT) AS slot FROM events)"""


def tracks(spark, sf) -> DataFrame:
    u = F.col("user_id")
    t = (seconds("ts") - EPOCH0) / 86400
    return table(spark, sf, "events").select(
        "event_id", u.alias("designation"), t.alias("t"),
        (0.3 * (u % 50) + 0.5 * t + F.col("value") / 1000).alias("x"), (0.2 * (u % 30) + 0.3 * t).alias("y"),
        F.col("value").alias("flux"), (1 + F.col("value") / 50).alias("e_flux"),
        F.floor(t * 48).cast("long").alias("frame"))


TRACKS_SQL = f"""SELECT event_id, user_id AS designation, (epoch(ts) - {EPOCH0}) / 86400e0 AS t,
  3e-1 * (user_id % 50) + 5e-1 * ((epoch(ts) - {EPOCH0}) / 86400e0) + value / 1000e0 AS x,
  2e-1 * (user_id % 30) + 3e-1 * ((epoch(ts) - {EPOCH0}) / 86400e0) AS y, value AS flux, 1e0 + value / 50e0 AS e_flux,
  CAST(floor((epoch(ts) - {EPOCH0}) / 86400e0 * 48e0) AS BIGINT) AS frame FROM events"""


def injections(spark, sf) -> DataFrame:
    return detections(spark, sf).select(
        F.col("eventkey").alias("injid"), (F.col("ra") + 0.0005).alias("x0"), F.col("dec").alias("y0"),
        (F.col("mjd_start") + 0.2).alias("i_start"), (F.col("mjd_end") + 0.2).alias("i_end"),
        F.col("flux_sign").alias("i_sign"), (F.col("snr") / 2).alias("i_snr"),
        F.when(F.col("flux_sign") == 1, "flare").otherwise("dip").alias("event_type"))


INJECTIONS_SQL = f"""SELECT eventkey AS injid, ra + 5e-4 AS x0, dec AS y0, mjd_start + 2e-1 AS i_start, mjd_end + 2e-1 AS i_end,
  flux_sign AS i_sign, snr / 2e0 AS i_snr, CASE WHEN flux_sign = 1 THEN 'flare' ELSE 'dip' END AS event_type
  FROM ({DETECTIONS_SQL}) d"""
