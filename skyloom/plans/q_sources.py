"""Queries: readers, writers, text formats and streams over the given tables."""

from pyspark.sql import functions as F

from skyloom.functions.timecode import filename_mjd
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.registry import query
from skyloom.sources import tables as Tb
from skyloom.sources import text as Tx
from skyloom.streaming import operators as St


@query("S1_load_table", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def s1(spark, sf):
    return Tb.load_table(spark, f"{sf}/supplier").select("s_suppkey", "s_nationkey", "s_acctbal")


@query("S2_save_partitioned", f"SELECT sector, cam, ccd, cut, star, zp_ab FROM ({D.ZEROPOINTS_SQL})")
def s2(spark, sf):
    path = Tb.scratch(spark)
    Tb.save_table(D.zeropoints(spark, sf).select("sector", "cam", "ccd", "cut", "star", "zp_ab"), path)
    out = spark.read.parquet(path)
    return out.select("star", "zp_ab", *[F.col(c).cast("long").alias(c) for c in Tb.PARTITION])


@query("S3_aggregate_units", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def s3(spark, sf):
    path = Tb.scratch(spark)
    Tb.save_table(D.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 4).alias("unit")), path, ["unit"])
    return Tb.load_all_units(spark, path, "*.parquet").select("c_custkey", "c_nationkey", "c_acctbal")


@query("S4_provenance", f"SELECT star, CAST(sector AS INTEGER) AS sector, CAST(cam AS INTEGER) AS cam, CAST(ccd AS INTEGER) AS ccd, CAST(cut AS INTEGER) AS cut, 4 AS n FROM ({D.ZEROPOINTS_SQL})")
def s4(spark, sf):
    z = D.zeropoints(spark, sf)
    path = F.concat(F.lit("/data/Sector"), F.col("sector"), F.lit("/Cam"), F.col("cam"), F.lit("/Ccd"), F.col("ccd"), F.lit("/Cut"), F.col("cut"), F.lit("of16/zp.csv"))
    return Tb.with_provenance(z.select("star", path.alias("p")), F.col("p")).drop("p")


@query("S4_file_provenance", "SELECT n_nationkey, 'nation.parquet' AS file FROM nation")
def s4b(spark, sf):
    return D.table(spark, sf, "nation").select("n_nationkey", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"))


@query("S5_export_light_curves", f"SELECT series % 8 AS objid, {R('t')} AS mjd, {R('flux')} AS flux, {R('err')} AS flux_err FROM ({D.SERIES_SQL})")
def s5(spark, sf):
    path = Tb.scratch(spark)
    s = D.series(spark, sf).select((F.col("series") % 8).alias("objid"), F.lit("psf").alias("method"), F.lit("counts").alias("units"), F.col("t").alias("mjd"), "flux", F.col("err").alias("flux_err"))
    Tb.export_light_curves(s, path, ["objid", "method", "units"])
    return spark.read.parquet(path).select(F.col("objid").cast("long").alias("objid"), r6("mjd").alias("mjd"), r6("flux").alias("flux"), r6("flux_err").alias("flux_err"))


@query("S6_whitespace_table", "SELECT p_partkey, p_size, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice, 1) + 0e0 END AS price FROM part")
def s6(spark, sf):
    p = D.table(spark, sf, "part")
    line = F.concat_ws("   ", F.lit(""), F.lower(F.conv("p_partkey", 10, 16)), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, F.lit("nan")).otherwise(F.col("p_retailprice").cast("string")))
    lines = p.select(line.alias("value")).unionByName(p.select(F.lit("# key size price").alias("value")))
    return Tx.whitespace_table(lines, ["p_partkey", "p_size", "price"], {"p_size": "int", "price": "double"}, hex_columns=["p_partkey"], rounding={"price": 1})


@query("S7_formatted_lines", "SELECT printf('%06d %.2f %s', s_suppkey, s_acctbal, s_name) AS value FROM supplier WHERE s_acctbal > 0")
def s7(spark, sf):
    s = D.table(spark, sf, "supplier").filter("s_acctbal > 0")
    return Tx.formatted_lines(s, ["s_suppkey", "s_acctbal", "s_name"], {"s_suppkey": "%06d", "s_acctbal": "%.2f"})


@query("S8_header_table", "SELECT 'f' || s_suppkey AS path, s_name AS OBJECT, CAST(s_nationkey AS VARCHAR) AS CAMERA FROM supplier")
def s8(spark, sf):
    card = lambda key, body: F.rpad(F.concat(F.rpad(F.lit(key), 8, " "), F.lit("= "), body), 80, " ")
    quoted = F.concat(F.lit("'"), F.col("s_name"), F.lit("'"))
    text = F.concat(card("SIMPLE", F.lit("T / standard")), card("OBJECT", quoted), card("CAMERA", F.concat(F.col("s_nationkey").cast("string"), F.lit(" / number"))), F.rpad(F.lit("END"), 80, " "))
    files = D.table(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey")).alias("path"), F.rpad(text, Tx.BLOCK, " ").cast("binary").alias("content"))
    return Tx.header_table(Tx.header_cards(files), ["OBJECT", "CAMERA"])


@query("S9_manifest_frames", f"SELECT event_id, {R('floor(epoch(ts)) / 86400e0 + 40587e0', 8)} AS mjd FROM events WHERE user_id % 4 = 1 AND user_id % 3 = 1 AND floor(epoch(ts)) / 86400e0 + 40587e0 BETWEEN 60315e0 AND 60325e0")
def s9(spark, sf):
    ts = F.col("ts").cast("timestamp")
    name = F.concat(F.lit("img"), F.date_format(ts, "yyyyDDDHHmmss"), F.lit("-s0001-"), F.col("user_id") % 4, F.lit("-"), F.col("user_id") % 3, F.lit("-0120-s_ffic.fits"))
    lines = D.table(spark, sf, "events").select("event_id", name.alias("value"))
    return Tx.manifest_frames(lines, 1, 1, 60315.0, 60325.0).select("event_id", r6(filename_mjd("value"), 8).alias("mjd"))


@query("S11_variability_class", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'VST' WHEN p_partkey % 3 = 0 THEN 'VEB' WHEN p_partkey % 2 = 0 THEN 'VCR' ELSE 'None' END AS \"Type\", CASE WHEN p_partkey % 7 = 0 THEN 5e-1 WHEN p_partkey % 3 = 0 THEN 25e-2 WHEN p_partkey % 2 = 0 THEN 75e-2 ELSE 0e0 END AS Prob FROM part")
def s11(spark, sf):
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, 0.75).alias("VCR"), F.when(k % 3 == 0, 0.25).otherwise(0.0).alias("VEB"), F.when(k % 7 == 0, 0.5).alias("VST"))
    return Tx.variability_class(p, ["VCR", "VEB", "VST"]).select("p_partkey", "Type", "Prob")


@query("S12_variable_catalogues", f"""SELECT ra, dec, CASE WHEN nation % 2 = 0 THEN 'ROT' ELSE var_type END AS "Type", 1e0 AS Prob, CAST(source AS VARCHAR) AS ID, 'first' AS Catalog FROM ({D.STARS_SQL})
UNION ALL SELECT ra, dec, var_type, 5e-1, CAST(source AS VARCHAR), 'second' FROM ({D.STARS_SQL})""")
def s12(spark, sf):
    s = D.stars(spark, sf)
    a = Tx.variable_catalogue(s, "first", "ra", "dec", "source", F.when(F.col("nation") % 2 == 0, "ROT:").otherwise(F.col("var_type")))
    return a.unionByName(Tx.variable_catalogue(s, "second", "ra", "dec", "source", F.col("var_type"), F.lit(0.5)))


@query("S13_star_flags", f"""SELECT source, CASE WHEN nation / 200e0 < 5e-2 THEN 1 WHEN nation / 200e0 < 1e-1 THEN 2 ELSE 0 END AS kron, CASE WHEN nation / 24e0 >= 9e-1 THEN 1 WHEN nation / 24e0 > 7e-1 THEN 2 ELSE 0 END AS cls,
CASE WHEN source % 4 = 3 OR source % 5 = 3 THEN 0 WHEN source % 4 = 1 OR source % 5 = 1 THEN 1 ELSE 2 END AS comb, CASE WHEN nation <> 7 THEN gmag END AS mag FROM ({D.STARS_SQL})""")
def s13(spark, sf):
    s = D.stars(spark, sf)
    filled = F.when(F.col("nation") == 7, 99.0).otherwise(F.col("gmag"))
    return s.select("source", Tx.psf_kron_flag(F.col("nation") / 200, F.lit(0.0)).alias("kron"), Tx.class_star_flag(F.col("nation") / 24).alias("cls"),
                    Tx.combined_class_flag(F.col("source") % 4, F.col("source") % 5).alias("comb"), Tx.clean_magnitude(filled).alias("mag"))


@query("S15_orbit_catalogue", "SELECT printf('%07d', c_custkey) AS designation, CASE WHEN c_custkey % 17 <> 0 THEN round(5 + (c_custkey % 200) / 1e1, 2) END AS magnitude_H, round(15e-1 + (c_custkey % 200) / 1e2, 4) AS semimajor_axis_au FROM customer WHERE c_custkey % 10 <> 0")
def s15(spark, sf):
    k = F.col("c_custkey")
    num = lambda fmt, x: F.format_string(fmt, x)
    h = F.when(k % 17 == 0, F.lit("     ")).otherwise(num("%5.2f", 5 + (k % 200) / 10))
    line = F.concat(num("%07d", k), F.lit(" "), h, F.lit(" "), F.lit(" 0.15"), F.lit(" "), F.lit("K239D"), F.lit(" "), num("%9.5f", (k % 360) * F.lit(1.0)), F.lit("  "), num("%9.5f", (k * 7 % 360) * F.lit(1.0)), F.lit("  "),
                    num("%9.5f", (k * 11 % 360) * F.lit(1.0)), F.lit("  "), num("%9.5f", (k % 40) * F.lit(1.0)), F.lit("  "), F.when(k % 10 == 0, F.lit("   bad   ")).otherwise(num("%9.7f", (k % 30) / 100)), F.lit(" "),
                    num("%11.8f", 0.1 + (k % 20) / 100), F.lit(" "), num("%11.7f", 1.5 + (k % 200) / 100))
    return Tx.orbit_catalogue(D.table(spark, sf, "customer").select(line.alias("value"))).select("designation", "magnitude_H", "semimajor_axis_au")


@query("S16_commented_csv", "SELECT CAST(n_nationkey AS DOUBLE) AS MidTime, n_regionkey AS Segment FROM nation")
def s16(spark, sf):
    path = Tb.scratch(spark)
    n = D.table(spark, sf, "nation")
    body = n.select(F.lit(1).alias("o"), F.col("n_nationkey").alias("k"), F.concat_ws(",", F.col("n_nationkey").cast("double").cast("string"), F.col("n_regionkey").cast("string")).alias("value"))
    notes = n.select(F.lit(0).alias("o"), F.col("n_nationkey").alias("k"), F.concat(F.lit("# "), F.col("n_name")).alias("value"))
    notes.unionByName(body).select("value").write.mode("overwrite").text(path)
    return spark.read.option("comment", "#").schema("MidTime double, Segment int").csv(path)


@query("S18_file_screen")
def s18(spark, sf):
    return Tb.screen_files(spark, sf, 10_000, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


@query("S19_tables_from_lines", "SELECT s_suppkey AS k, CASE WHEN s_suppkey = 7 THEN 'seven' ELSE s_name END AS name, s_acctbal AS v FROM supplier UNION ALL SELECT -1, 'extra', NULL")
def s19(spark, sf):
    lines = D.table(spark, sf, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")).alias("value"))
    t = Tx.table_from_lines(lines, "k long, name string, v double")
    return Tx.append_row(Tx.update_row(t, F.col("k") == 7, {"name": "seven"}), {"k": -1, "name": "extra"})


def _stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    return St.incoming(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark, stream):
    path, ck = Tb.scratch(spark), Tb.scratch(spark)
    schema = stream.schema
    St.run_available(stream, path, ck)
    return spark.read.schema(schema).parquet(path)


@query("ST1_incremental_ingest", "SELECT event_id, user_id, value FROM events")
def st1(spark, sf):
    return _drain(spark, _stream(spark, sf).select("event_id", "user_id", "value"))


@query("ST2_streaming_events", f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 43200 THEN 1 ELSE 0 END AS b FROM events),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e), g AS (SELECT user_id, min(ts) AS f, max(ts) AS l, count(*) AS n, max(value) AS mx FROM r GROUP BY user_id, run)
SELECT user_id, {R('epoch(f) / 86400e0 + 40587e0')} AS first_mjd, {R('epoch(l) / 86400e0 + 40587e0')} AS last_mjd, n AS n_detections, mx AS flux_max FROM g WHERE epoch(l) + 43200 <= (SELECT epoch(max(ts)) - 3600 FROM events)""")
def st2(spark, sf):
    out = _drain(spark, St.stream_events(_stream(spark, sf), "ts", ["user_id"], "12 hours", "1 hour"))
    m = lambda c: r6(D.seconds(c) / 86400 + 40587)
    return out.select("user_id", m("first_time").alias("first_mjd"), m("last_time").alias("last_mjd"), "n_detections", "flux_max")


@query("ST3_streaming_bins", f"""WITH b AS (SELECT floor(epoch(ts) / 21600) * 21600 AS s, avg(value) AS flux, count(*) AS n FROM events GROUP BY 1) SELECT {R('s / 86400e0 + 40587e0')} AS bin_mjd, {R('flux')} AS flux, n AS n_frames FROM b
WHERE s + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM events)""")
def st3(spark, sf):
    out = _drain(spark, St.stream_bins(_stream(spark, sf), "ts", [], "6 hours", "1 hour"))
    return out.select(r6(D.seconds("bin_start") / 86400 + 40587).alias("bin_mjd"), r6("flux").alias("flux"), "n_frames")


ST4_SQL = f"""WITH RECURSIVE r0 AS (SELECT user_id AS objid, CAST(floor((epoch(ts) - {D.EPOCH0}) / 14400) AS BIGINT) AS frame, max(value / 10e0) AS sig FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
wm AS (SELECT CAST(floor((epoch(max(ts)) - 3600 - {D.EPOCH0}) / 14400) AS BIGINT) - 1 AS f FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY objid ORDER BY frame) AS rn FROM r0 WHERE frame <= (SELECT f FROM wm)),
st AS (
 SELECT DISTINCT objid, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS e, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS miss, CAST(0 AS BIGINT) AS hits,
  CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce, CAST(NULL AS BIGINT) AS ch FROM r
 UNION ALL
 SELECT objid, rn, CASE WHEN opens THEN frame WHEN live AND NOT closes THEN s ELSE -1 END, CASE WHEN opens OR (live AND NOT closes AND sig >= 3) THEN frame ELSE e END, frame,
  CASE WHEN opens THEN 0 ELSE m END, CASE WHEN opens THEN 1 WHEN live AND NOT closes AND sig >= 3 THEN hits + 1 ELSE hits END,
  CASE WHEN closes THEN s END, CASE WHEN closes THEN e END, CASE WHEN closes THEN hits END
 FROM (SELECT *, (NOT live OR closes) AND sig >= 5 AS opens FROM (SELECT *, live AND m >= 5 AS closes FROM (
  SELECT st.objid, r.rn, s, e, hits, r.frame, r.sig, s >= 0 AS live, miss + r.frame - last - 1 + CASE WHEN r.sig >= 3 THEN 0 ELSE 1 END AS m
  FROM st JOIN r ON r.objid = st.objid AND r.rn = st.rn + 1)))),
fin AS (SELECT objid, s, e, hits FROM st WHERE rn = (SELECT max(rn) FROM r WHERE r.objid = st.objid) AND s >= 0 AND miss + (SELECT f FROM wm) - last >= 5)
SELECT objid, cs AS frame_start, ce AS frame_end, ch AS n_detections FROM st WHERE cs IS NOT NULL UNION ALL SELECT objid, s, e, hits FROM fin"""


@query("ST4_streaming_extension", ST4_SQL)
def st4(spark, sf):
    s = _stream(spark, sf).select(F.col("user_id").alias("objid"), F.floor((D.seconds("ts") - D.EPOCH0) / 14400).alias("frame"), (F.col("value") / 10).alias("sig"), "ts")
    return _drain(spark, St.stream_extend(s, "ts", 14400, D.EPOCH0))
