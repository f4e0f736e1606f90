"""Queries: catalogue, interval and cross joins."""

from pyspark.sql import functions as F

from skyloom.functions import orbits as O
from skyloom.operators import catalog as C
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_functions import orbit_table, sep_sql
from skyloom.plans.registry import query


@query("J1_cone_search", f"""SELECT source, {R(sep_sql('ra', 'dec', '359e0', '10e0'), 4)} AS sep_arcsec FROM ({D.STARS_SQL})
WHERE gmag < 165e-1 AND {sep_sql('ra', 'dec', '359e0', '10e0')} < 54000e0""")
def j1(spark, sf):
    return C.cone_search(D.stars(spark, sf), 359.0, 10.0, 15.0, 16.5).select("source", r6("sep_arcsec", 4).alias("sep_arcsec"))


@query("J2_cross_match", f"""WITH d AS ({D.DETECTIONS_SQL}), s AS ({D.STARS_SQL}),
p AS (SELECT eventkey, source, var_type, sqrt((d.ra - s.ra) * (d.ra - s.ra) + (d.dec - s.dec) * (d.dec - s.dec)) AS dist FROM d, s
 WHERE abs(d.ra - s.ra) < 2e-1 AND abs(d.dec - s.dec) < 2e-1),
b AS (SELECT * FROM p WHERE dist < 2e-1 QUALIFY row_number() OVER (PARTITION BY eventkey ORDER BY dist, source) = 1)
SELECT eventkey, source, coalesce(var_type, 'none') AS var_type, {R('dist')} AS match_dist FROM d LEFT JOIN b USING (eventkey)""")
def j2(spark, sf):
    out = C.cross_match(D.detections(spark, sf), D.stars(spark, sf), "source", 720.0, ["var_type"], {"var_type": "none"})
    return out.select("eventkey", "source", "var_type", r6(F.when(F.col("source").isNotNull(), F.col("match_dist"))).alias("match_dist"))


@query("J3_append_unmatched", f"""WITH a AS (SELECT source, ra, dec FROM ({D.STARS_SQL})), b AS (SELECT 100000 + eventkey AS source, ra, dec FROM ({D.DETECTIONS_SQL}))
SELECT source, {R('ra')} AS ra, {R('dec')} AS dec FROM a UNION ALL SELECT source, {R('ra')}, {R('dec')} FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE abs(a.dec - b.dec) < 3e-1 AND {sep_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= 900e0)""")
def j3(spark, sf):
    a = D.stars(spark, sf).select("source", "ra", "dec")
    b = D.detections(spark, sf).select((F.col("eventkey") + 100000).alias("source"), "ra", "dec")
    return C.append_unmatched(a, b, 900.0).select("source", r6("ra").alias("ra"), r6("dec").alias("dec"))


@query("J4_density_match")
def j4(spark, sf):
    return C.density_match(D.detections(spark, sf).select("eventkey", "ra", "dec"), D.stars(spark, sf).select("source", "ra", "dec"), "eventkey", "source", 360.0).withColumn("match_dist", r6("match_dist"))


@query("J5_closest_pair", f"""WITH d AS (SELECT eventkey, ra, dec FROM ({D.DETECTIONS_SQL})), s AS (SELECT source, ra + 5e-4 AS ra, dec FROM ({D.STARS_SQL}))
SELECT eventkey, source, {R('sqrt((d.ra - s.ra) * (d.ra - s.ra) + (d.dec - s.dec) * (d.dec - s.dec))')} AS pair_dist FROM d, s
WHERE abs(d.ra - s.ra) < 5e-2 AND abs(d.dec - s.dec) < 5e-2 ORDER BY sqrt((d.ra - s.ra) * (d.ra - s.ra) + (d.dec - s.dec) * (d.dec - s.dec)), source, eventkey LIMIT 1""")
def j5(spark, sf):
    s = D.stars(spark, sf).select("source", (F.col("ra") + 0.0005).alias("ra"), "dec")
    return C.closest_pair(D.detections(spark, sf), s, "eventkey", "source", ["ra", "dec"], 0.05).withColumn("pair_dist", r6("pair_dist"))


def _small_sky(spark, sf):
    d = D.detections(spark, sf)
    return d.select(F.col("eventkey").alias("row"), "objid", (F.col("objid") % 360 + F.col("ra_err")).alias("ra"), (F.col("objid") % 90 + F.lit(0.0)).alias("dec"), F.floor("mjd_start").alias("frame"))


@query("J6_attach_catalogue")
def j6(spark, sf):
    return C.attach_catalogue(_small_sky(spark, sf), D.stars(spark, sf).select("source", F.floor("ra").cast("double").alias("ra"), F.floor("dec").cast("double").alias("dec"), "var_type"), "source", ["var_type"], 180.0).select("row", "objid", "var_type")


@query("J7_merge_methods")
def j7(spark, sf):
    first = _small_sky(spark, sf).filter("row % 3 <> 0")
    second = _small_sky(spark, sf).filter("row % 3 = 0").withColumn("objid", F.col("objid") + 7)
    return C.merge_methods(first, second).select("row", "objid", "frame")


@query("J8_brightest_star", f"""WITH d AS ({D.DETECTIONS_SQL}), s AS ({D.STARS_SQL}),
p AS (SELECT eventkey, source, rpmag, gmag, ((s.ra - d.ra + 180e0) % 360e0 + 360e0) % 360e0 - 180e0 AS dra, s.dec - d.dec AS ddec, cos(radians(d.dec)) AS c, ra_err * 20e0 AS ex, dec_err * 20e0 AS ey
 FROM d JOIN s ON abs(s.dec - d.dec) <= 3 * d.dec_err * 20e0),
m AS (SELECT * FROM p WHERE abs(dra * c) <= 3 * ex AND sqrt(pow(dra * c / ex, 2) + pow(ddec / ey, 2)) <= 3
 QUALIFY row_number() OVER (PARTITION BY eventkey ORDER BY rpmag NULLS LAST, gmag NULLS LAST, source) = 1)
SELECT eventkey, coalesce(CAST(source AS VARCHAR), '-') AS gaia_id FROM d LEFT JOIN m USING (eventkey)""")
def j8(spark, sf):
    d = D.detections(spark, sf).withColumns({"ra_err": F.col("ra_err") * 20, "dec_err": F.col("dec_err") * 20})
    return C.brightest_star(d, D.stars(spark, sf), cell=0.25).select("eventkey", "gaia_id")


@query("J9_variable_class", f"""WITH d AS ({D.DETECTIONS_SQL}), s AS ({D.STARS_SQL}),
m AS (SELECT eventkey, var_type FROM d JOIN s ON abs(s.ra - d.ra) < 3 * ra_err AND abs(s.dec - d.dec) < 3 * dec_err
 QUALIFY row_number() OVER (PARTITION BY eventkey ORDER BY source) = 1)
SELECT eventkey, coalesce(var_type, status) AS classification FROM d LEFT JOIN m USING (eventkey)""")
def j9(spark, sf):
    d = D.detections(spark, sf).withColumn("classification", F.col("status"))
    return C.variable_class(d, D.stars(spark, sf).withColumn("cat_idx", F.col("source"))).select("eventkey", "classification")


def _predicted(spark, sf):
    """Predicted positions: one per designation and frame, slightly off the detections."""
    return D.tracks(spark, sf).groupBy("designation", "frame").agg((F.avg("x") + 0.25).alias("x"), (F.avg("y") - 0.125).alias("y"))


DET_SQL = f"SELECT event_id, designation % 40 AS objid, frame, x AS xcentroid, y AS ycentroid FROM ({D.TRACKS_SQL})"
PRED_SQL = f"SELECT designation, frame, avg(x) + 25e-2 AS x, avg(y) - 125e-3 AS y FROM ({D.TRACKS_SQL}) GROUP BY designation, frame"
PAIR_SQL = f"det AS ({DET_SQL}), pred AS ({PRED_SQL}), pr AS (SELECT xcentroid - x AS dx, ycentroid - y AS dy FROM det JOIN pred USING (frame) WHERE sqrt((xcentroid - x) * (xcentroid - x) + (ycentroid - y) * (ycentroid - y)) <= 5e0)"


def _det(spark, sf):
    return D.tracks(spark, sf).select("event_id", (F.col("designation") % 40).alias("objid"), "frame", F.col("x").alias("xcentroid"), F.col("y").alias("ycentroid"))


@query("J12_identify_moving", f"""WITH {PAIR_SQL}, m AS (SELECT objid, designation, frame, sqrt(pow(xcentroid - (x + 25e-2), 2) + pow(ycentroid - (y - 5e-1), 2)) AS d FROM det JOIN pred USING (frame)),
b AS (SELECT * FROM m WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY objid ORDER BY d, designation, frame) = 1)
SELECT o.objid, {R('d')} AS dist_px FROM (SELECT DISTINCT objid FROM det) o LEFT JOIN b USING (objid)""")
def j12(spark, sf):
    off = spark.range(1).select(F.lit(0.25).alias("offset_x"), F.lit(-0.5).alias("offset_y"))
    return C.identify_moving(_det(spark, sf), _predicted(spark, sf), off).select("objid", r6("dist_px").alias("dist_px"))


@query("J13_pooled_offset", f"WITH {PAIR_SQL} SELECT count(*) AS n_pairs, {R('median(dx)')} AS offset_x, {R('median(dy)')} AS offset_y FROM pr")
def j13(spark, sf):
    out = C.pooled_offset(_det(spark, sf), _predicted(spark, sf))
    return out.select("n_pairs", r6("offset_x").alias("offset_x"), r6("offset_y").alias("offset_y"))


@query("J14_upgrade_class", f"""WITH m AS (SELECT s_suppkey AS objid, s_name AS designation FROM supplier)
SELECT eventkey, CASE WHEN designation IS NOT NULL THEN 'Asteroid' ELSE status END AS classification, designation AS known_asteroid_designation
FROM ({D.DETECTIONS_SQL}) d LEFT JOIN m USING (objid)""")
def j14(spark, sf):
    m = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("objid"), F.col("s_name").alias("designation"), F.col("s_acctbal").alias("dist_px"), F.col("s_suppkey").alias("match_frame"))
    d = D.detections(spark, sf).withColumn("classification", F.col("status"))
    return C.upgrade_class(d, m).select("eventkey", "classification", "known_asteroid_designation")


@query("J15_contaminating_star", f"""WITH p AS (SELECT event_id, x, y FROM ({D.SOURCES_SQL})), s AS (SELECT source, (source * 37) % 2560 / 1e1 AS sx, (source * 91) % 2560 / 1e1 AS sy, gmag FROM ({D.STARS_SQL})),
r AS (SELECT event_id, source, gmag, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d, greatest(2e0, least(20e0, 4e0 * pow(1e1, -2e-1 * (gmag - 1e1)))) AS rad FROM p JOIN s ON abs(x - sx) <= 20 AND abs(y - sy) <= 20),
b AS (SELECT * FROM r WHERE d <= 20 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d - rad, source) = 1)
SELECT event_id, coalesce(d - rad < 0, false) AS near_star_proximity, {R('d')} AS contaminating_star_dist_px, coalesce(source, -1) AS contaminating_star_idx FROM p LEFT JOIN b USING (event_id)""")
def j15(spark, sf):
    st = D.stars(spark, sf).select(F.col("source").alias("star_idx"), ((F.col("source") * 37) % 2560 / F.lit(10.0)).alias("x"), ((F.col("source") * 91) % 2560 / F.lit(10.0)).alias("y"), F.col("gmag").alias("mag"))
    out = C.contaminating_star(D.sources(spark, sf).select("event_id", "x", "y"), st, "event_id")
    return out.select("event_id", "near_star_proximity", r6("contaminating_star_dist_px").alias("contaminating_star_dist_px"), "contaminating_star_idx")


MATCH_SQL = f"""i AS ({D.INJECTIONS_SQL}), e AS ({D.DETECTIONS_SQL}),
n AS (SELECT injid, eventkey, frame_bin, sqrt((x0 - ra) * (x0 - ra) + (y0 - dec) * (y0 - dec)) AS sep, least(mjd_end, i_end) - greatest(mjd_start, i_start) AS inter,
 greatest(mjd_end, i_end) - least(mjd_start, i_start) AS uni, mjd_end - mjd_start AS de, i_end - i_start AS di, abs((mjd_start + mjd_end) / 2 - (i_start + i_end) / 2) * 1440 AS pk, e.snr / i_snr AS snr_ratio
 FROM i JOIN e ON i_sign = flux_sign AND abs(x0 - ra) <= 2e-3 AND abs(y0 - dec) <= 2e-3),
q AS (SELECT *, inter / uni AS iou, greatest(de, di) / least(de, di) AS dr, sep + (1 - inter / uni) + abs(ln(greatest(de, di) / least(de, di))) + pk / greatest(di * 1440, 1e0) AS score FROM n WHERE sep <= 2e-3 AND inter > 0 AND inter / uni >= 1e-1),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY injid ORDER BY frame_bin, score, eventkey) = 1),
mt AS (SELECT i.*, b.eventkey, b.iou, b.score, b.snr_ratio, CASE WHEN b.frame_bin = 1 THEN 'y' WHEN b.frame_bin IS NOT NULL THEN CAST(b.frame_bin AS VARCHAR)
 WHEN EXISTS (SELECT 1 FROM e x WHERE abs(x.ra - i.x0) <= 2e-3 AND sqrt((x0 - x.ra) * (x0 - x.ra) + (y0 - x.dec) * (y0 - x.dec)) <= 2e-3 AND x.mjd_start BETWEEN i_start AND i_end) THEN 'iso' ELSE 'n' END AS detected FROM i LEFT JOIN b USING (injid))"""


def _matched(spark, sf):
    mid = (F.col("mjd_start") + F.col("mjd_end")) / 2
    ev = D.detections(spark, sf).select("eventkey", "flux_sign", "frame_bin", F.col("ra").alias("x"), F.col("dec").alias("y"), "mjd_start", "mjd_end", mid.alias("mjd_max"), "snr")
    inj = D.injections(spark, sf).withColumn("i_max", (F.col("i_start") + F.col("i_end")) / 2)
    iso = ev.select("x", "y", F.col("mjd_start").alias("mjd"))
    return C.recovery_match(inj, ev, iso, radius=0.002, min_iou=0.1)


@query("J17_recovery_match", f"WITH {MATCH_SQL} SELECT injid, detected, eventkey, {R('iou')} AS temporal_iou, {R('score', 5)} AS match_score, {R('snr_ratio')} AS snr_ratio FROM mt")
def j17(spark, sf):
    return _matched(spark, sf).select("injid", "detected", "eventkey", r6("temporal_iou").alias("temporal_iou"), r6("match_score", 5).alias("match_score"), r6("snr_ratio").alias("snr_ratio"))


@query("A25_recovery_summary", f"""WITH {MATCH_SQL} SELECT event_type, CAST(CASE WHEN i_snr < 0 THEN 0 WHEN i_snr >= 3e5 THEN 11 ELSE floor(i_snr / 3e4) + 1 END AS BIGINT) AS snr_bin, count(*) AS n,
count(*) FILTER (detected NOT IN ('n', 'iso')) AS n_recovered, count(*) FILTER (detected = 'iso') AS n_isolated FROM mt GROUP BY 1, 2""")
def a25(spark, sf):
    return C.recovery_summary(_matched(spark, sf), edges=(0.0, 300000.0, 10))


@query("J18_sources_in_stamp", f"""WITH c AS (SELECT s_suppkey AS star, (s_suppkey * 53) % 256 * 1e0 AS cx, (s_suppkey * 29) % 256 * 1e0 AS cy FROM supplier), s AS (SELECT event_id, x AS sx, y AS sy FROM ({D.SOURCES_SQL}))
SELECT star, event_id FROM c JOIN s ON abs(sx - cx) <= 5 AND abs(sy - cy) <= 5""")
def j18(spark, sf):
    k = F.col("s_suppkey")
    c = D.table(spark, sf, "supplier").select(k.alias("star"), ((k * 53) % 256 * F.lit(1.0)).alias("cx"), ((k * 29) % 256 * F.lit(1.0)).alias("cy"))
    s = D.sources(spark, sf).select("event_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return C.sources_in_stamp(c, s, 5).select("star", "event_id")


TILES_SQL = "SELECT n_nationkey AS tile, (n_nationkey % 5) * 5e1 AS x_lo, (n_nationkey % 5) * 5e1 + 6e1 AS x_hi, (n_nationkey // 5) * 5e1 AS y_lo, (n_nationkey // 5) * 5e1 + 6e1 AS y_hi FROM nation"


@query("J19_points_in_tiles", f"SELECT event_id, tile FROM ({D.SOURCES_SQL}) s JOIN ({TILES_SQL}) t ON x >= x_lo AND x < x_hi AND y >= y_lo AND y < y_hi")
def j19(spark, sf):
    n = F.col("n_nationkey")
    t = D.table(spark, sf, "nation").select(n.alias("tile"), ((n % 5) * F.lit(50.0)).alias("x_lo"), ((n % 5) * F.lit(50.0) + 60).alias("x_hi"),
                                            (F.floor(n / 5) * F.lit(50.0)).alias("y_lo"), (F.floor(n / 5) * F.lit(50.0) + 60).alias("y_hi"))
    return C.points_in_tiles(D.sources(spark, sf).select("event_id", "x", "y"), t, 32.0).select("event_id", "tile")


@query("J19_polygon_and_ellipse", f"""SELECT event_id, pow((x - 120e0) / 70e0, 2) + pow((y - 100e0) / 30e0, 2) <= 1 AS in_ell, x + y < 200e0 AND x > 20e0 AND y > 30e0 AS in_poly FROM ({D.SOURCES_SQL})""")
def j19b(spark, sf):
    return D.sources(spark, sf).select("event_id", C.in_ellipse("x", "y", 120.0, 100.0, 70.0, 30.0).alias("in_ell"), C.in_polygon("x", "y", [(20, 30), (170, 30), (20, 180)]).alias("in_poly"))


@query("J20_busy_objects", f"""WITH d AS ({D.DETECTIONS_SQL}) SELECT eventkey, objid FROM d WHERE objid IN (SELECT objid FROM d GROUP BY objid HAVING count(*) <= 10) AND flux_sign = 1""")
def j20(spark, sf):
    d = D.detections(spark, sf).select("eventkey", "objid", "flux_sign")
    quiet = d.groupBy("objid").agg(F.count(F.lit(1)).alias("n")).filter("n <= 10").select("objid")
    return d.filter("flux_sign = 1").join(quiet, "objid", "left_semi").select("eventkey", "objid")


@query("J21_flag_pairs", f"""WITH d AS ({D.DETECTIONS_SQL}), s AS ({D.STARS_SQL}),
b AS (SELECT eventkey, source, var_type, sqrt((d.ra - s.ra) * (d.ra - s.ra) + (d.dec - s.dec) * (d.dec - s.dec)) AS dist FROM d JOIN s ON abs(d.ra - s.ra) <= 1e-2 AND abs(d.dec - s.dec) <= 1e-2
 WHERE sqrt((d.ra - s.ra) * (d.ra - s.ra) + (d.dec - s.dec) * (d.dec - s.dec)) <= 1e-2 QUALIFY row_number() OVER (PARTITION BY eventkey ORDER BY dist, source) = 1)
SELECT eventkey, source, var_type, {R('dist * 3600', 4)} AS dist_arcsec FROM d LEFT JOIN b USING (eventkey)""")
def j21(spark, sf):
    out = C.flag_pairs(D.detections(spark, sf), D.stars(spark, sf), "eventkey", "source", 36.0, ["var_type"])
    return out.select("eventkey", "source", "var_type", r6("dist_arcsec", 4).alias("dist_arcsec"))


@query("J22_any_epoch_hit")
def j22(spark, sf):
    epochs = D.table(spark, sf, "region").select((F.lit(60000.0) + F.col("r_regionkey") * 7).alias("mjd")).withColumns({"ox": F.cos(F.col("mjd") / 58.13), "oy": F.sin(F.col("mjd") / 58.13), "oz": F.lit(0.0)})
    # A handful of sample epochs per search, fixed by the sampling step.
    both = orbit_table(spark, sf).crossJoin(F.broadcast(epochs))
    v = O.ecliptic_directions(both, "mjd", "epoch", ("ox", "oy", "oz"), "a", "e", "inc", "node", "peri", "anomaly", "motion")
    return v.filter("ux > 0.9").select("orbit").distinct()


@query("J23_concat_results", f"SELECT eventkey AS k, snr, NULL AS ra FROM ({D.DETECTIONS_SQL}) UNION ALL SELECT source, NULL, ra FROM ({D.STARS_SQL})".replace("NULL AS ra", "CAST(NULL AS DOUBLE) AS ra"))
def j23(spark, sf):
    a = D.detections(spark, sf).select(F.col("eventkey").alias("k"), "snr")
    return a.unionByName(D.stars(spark, sf).select(F.col("source").alias("k"), "ra"), allowMissingColumns=True)


@query("S17_survey_route", f"SELECT source, CASE WHEN source % 11 = 0 THEN 'deep' WHEN dec > -28 THEN 'north' ELSE 'south' END AS survey FROM ({D.STARS_SQL})")
def s17(spark, sf):
    s = D.stars(spark, sf).withColumn("avail", F.when(F.col("source") % 11 == 0, "deep"))
    return C.survey_route(s, "dec", "avail").select("source", "survey")
