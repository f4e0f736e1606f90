"""Queries: clustering, moving objects and profile fits."""

from pyspark.sql import functions as F

from skyloom.operators import fits as Ft
from skyloom.operators import tracks as Tr
from skyloom.operators.components import density_groups, number_labels
from skyloom.operators.dedupe import dedupe_close, group_space_time
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_robust import rounded
from skyloom.plans.q_series import lc_events, light_curves
from skyloom.plans.registry import query


@query("G1_spatial_groups", f"""WITH RECURSIVE s AS (SELECT event_id, x, y FROM ({D.SOURCES_SQL})), e AS (SELECT a.event_id AS u, b.event_id AS v FROM s a JOIN s b ON abs(a.x - b.x) <= 5e-1 AND abs(a.y - b.y) <= 5e-1
 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5e-1), r AS (SELECT event_id AS node, event_id AS seen FROM s UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
l AS (SELECT node, min(seen) AS low, count(*) AS n FROM r GROUP BY node) SELECT node AS event_id, CASE WHEN n >= 2 THEN low END AS label FROM l""")
def g1(spark, sf):
    return density_groups(D.sources(spark, sf).select("event_id", "x", "y"), "event_id", ["x", "y"], 0.5, 2).select("event_id", "label")


@query("G2_dedupe_close")
def g2(spark, sf):
    s = D.sources(spark, sf).select("event_id", (F.col("frame") % 8).alias("frame"), "x", "y", "flux")
    return dedupe_close(s, "event_id", ["x", "y"], "flux", 3.0, ["frame"]).select("event_id", "frame")


@query("G3_space_time_groups")
def g3(spark, sf):
    s = D.sources(spark, sf).select("event_id", "x", "y", "frame")
    return number_labels(group_space_time(s, "event_id", ["x", "y"], "frame", 0.5, 48), "group", "objid").select("event_id", "objid")


def _points(spark, sf):
    return D.tracks(spark, sf).select("event_id", "designation", "t", "x", "y")


@query("G4_track_seeds")
def g4(spark, sf):
    p = _points(spark, sf).withColumn("x", F.col("x") * 20)
    return Tr.seed_tracks(p, "event_id", eps_space=3.0, eps_time=1.0).select("event_id", "track")


@query("G6_track_fits", f"""WITH p AS (SELECT designation AS track, t, x, y FROM ({D.TRACKS_SQL})), r AS (SELECT track, regr_slope(x, t) AS vx, regr_intercept(x, t) AS bx, regr_slope(y, t) AS vy, regr_intercept(y, t) AS "by", avg(t) AS t_ref,
 min(t) AS t_min, max(t) AS t_max, count(*) AS n_points FROM p GROUP BY track), q AS (SELECT track, sqrt(avg(pow(x - vx * t - bx, 2) + pow(y - vy * t - "by", 2))) AS residual_px FROM p JOIN r USING (track) GROUP BY track)
SELECT track, {R('t_ref')} AS t_ref, {R('bx + vx * t_ref')} AS x0, {R('vx')} AS vx, {R('"by" + vy * t_ref')} AS y0, {R('vy')} AS vy, {R('t_min')} AS t_min, {R('t_max')} AS t_max, n_points, {R('residual_px')} AS residual_px FROM r JOIN q USING (track)""")
def g6(spark, sf):
    fit = Tr.fit_tracks(_points(spark, sf).withColumnRenamed("designation", "track"), quadratic=False)
    return rounded(fit.drop("ax", "ay"), "t_ref", "x0", "vx", "y0", "vy", "t_min", "t_max", "residual_px")


@query("G6_track_fits_quadratic")
def g6q(spark, sf):
    return rounded(Tr.fit_tracks(_points(spark, sf).withColumnRenamed("designation", "track")), "t_ref", "x0", "vx", "ax", "y0", "vy", "ay", "residual_px")


def _partial(spark, sf):
    # Unclustered points: every fourth detection of each object.
    return _points(spark, sf).withColumn("track", F.when(F.col("event_id") % 4 != 0, F.col("designation"))).drop("designation")


@query("G7_grow_tracks")
def g7(spark, sf):
    return Tr.grow_tracks(_partial(spark, sf), "event_id", eps=0.05, rounds=2, quadratic=False).select("event_id", "track")


@query("G8_merge_tracks")
def g8(spark, sf):
    p = _points(spark, sf).withColumn("track", F.col("designation") * 2 + F.col("event_id") % 2).drop("designation")
    return Tr.merge_tracks(p, "event_id", eps=0.1, rounds=2, quadratic=False).select("event_id", "track")


@query("G9_cross_tracks")
def g9(spark, sf):
    p = _points(spark, sf).withColumnRenamed("designation", "track")
    return Tr.cross_tracks(p, "event_id", max_dist=0.02, step=0.5, quadratic=False).select("event_id", "track")


@query("G10_link_detections", f"""WITH p AS (SELECT event_id, designation AS track, t, x, y FROM ({D.TRACKS_SQL})), m AS (SELECT track, regr_slope(x, t) AS vx, regr_intercept(x, t) AS bx, regr_slope(y, t) AS vy, regr_intercept(y, t) AS "by", min(t) AS t_min, max(t) AS t_max
 FROM p WHERE event_id % 4 <> 0 GROUP BY track), d AS (SELECT event_id, m.track, sqrt(pow(x - vx * t - bx, 2) + pow(y - vy * t - "by", 2)) AS dist FROM p JOIN m ON t BETWEEN t_min AND t_max AND vx * t + bx BETWEEN 0 AND 256 AND vy * t + "by" BETWEEN 0 AND 256 WHERE event_id % 4 = 0),
b AS (SELECT * FROM d WHERE dist < 3e-2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, track) = 1) SELECT p.event_id, {R('dist')} AS link_dist FROM p LEFT JOIN b USING (event_id) WHERE p.event_id % 4 = 0""")
def g10(spark, sf):
    p = _partial(spark, sf)
    model = Tr.fit_tracks(p, quadratic=False)
    out = Tr.link_detections(p.filter("track IS NULL"), model, "event_id", radius=0.03)
    return out.select("event_id", r6("link_dist").alias("link_dist"))


@query("G10_tag_moving")
def g10t(spark, sf):
    ev = D.tracks(spark, sf).select("event_id", "t", (F.col("x") * 8).alias("x"), (F.col("y") * 8).alias("y"), F.when(F.col("event_id") % 3 == 0, "Asteroid").otherwise("-").alias("classification"),
                                    F.when(F.col("event_id") % 7 == 0, -1).otherwise(1).cast("long").alias("flux_sign"))
    return Tr.tag_moving(ev, "event_id", eps_space=2.0, grow_eps=1.0, merge_eps=1.0, crossing=0.02, radius=0.5, rounds=1).select("event_id", "classification", "asteroid_id")


STAMP_SQL = f"st AS (SELECT label AS ev, vec_id AS frame, y - 3 AS dy, x - 3 AS dx, v FROM ({D.PIXELS_SQL}) WHERE y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4)"


@query("P13_centroid_motion", f"""WITH {STAMP_SQL}, f AS (SELECT ev, frame, sum(v) AS flux, sum(greatest(v, 0e0) * dx) / sum(greatest(v, 0e0)) AS cx, sum(greatest(v, 0e0) * dy) / sum(greatest(v, 0e0)) AS cy FROM st GROUP BY ev, frame),
g AS (SELECT *, max(flux) OVER (PARTITION BY ev) AS top FROM f), k AS (SELECT ev, arg_min(cx, frame) AS ax, arg_min(cy, frame) AS ay, arg_max(cx, frame) AS bx, arg_max(cy, frame) AS "by" FROM g WHERE flux >= top / 2 GROUP BY ev)
SELECT ev, {R('sqrt(pow(ax - bx, 2) + pow(ay - "by", 2))')} AS com_motion FROM k""")
def p13(spark, sf):
    st = D.pixels(spark, sf).filter("y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4").select(F.col("label").alias("ev"), F.col("vec_id").alias("frame"), (F.col("y") - 3).alias("dy"), (F.col("x") - 3).alias("dx"), "v")
    return rounded(Tr.com_motion(st, "ev"), "com_motion")


@query("P14_gaussian_score")
def p14(spark, sf):
    # Windows of ten frames on both sides of every event.
    ev = lc_events(spark, sf).select("objid", F.struct("objid", "eventid").alias("k"), "frame_start", "frame_end")
    rows = ev.withColumn("frame", F.explode(F.sequence(F.col("frame_start") - 10, F.col("frame_end") + 10))).join(light_curves(spark, sf), ["objid", "frame"])
    flat = rows.select(F.concat_ws("_", "k.objid", "k.eventid").alias("event"), "frame", "flux")
    return rounded(Tr.gaussian_score(flat, "event"), "gaussian_score", n=3)


@query("P15_moving_thresholds", """WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 13) / 1e1 AS m, (s_suppkey % 11) / 1e1 AS g FROM supplier) SELECT k, (m >= 1 AND g >= 0) OR (m >= 75e-2 AND g >= 7e-1) OR (m >= 5e-1 AND g >= 9e-1) AS moving FROM s""")
def p15(spark, sf):
    k = F.col("s_suppkey")
    s = D.table(spark, sf, "supplier").select(k.alias("k"), ((k % 13) / F.lit(10.0)).alias("com_motion"), ((k % 11) / F.lit(10.0)).alias("gaussian_score"))
    return s.select("k", Tr.is_moving().alias("moving"))


@query("P16_straight_lines")
def p16(spark, sf):
    px = D.pixels(spark, sf)
    top = px.groupBy("label", "y", "x").agg(F.max("v").alias("v")).select(F.col("label").alias("ev"), (F.col("y") - 4).alias("dy"), (F.col("x") - 4).alias("dx"), "v")
    return Tr.straight_lines(top, "ev", F.col("v") > 0.3, min_votes=6)


@query("P17_profile_fits")
def p17(spark, sf):
    ev = lc_events(spark, sf).withColumns({"t_start": F.lit(60000.0) + F.col("frame_start") / 12, "t_end": F.lit(60000.0) + F.col("frame_end") / 12}).filter("frame_duration > 1")
    lc = light_curves(spark, sf).select("objid", F.col("mjd").alias("t"), "flux", F.lit(0.6).alias("err"))
    win = Ft.event_windows(ev, lc, ["objid"], "eventid", 1 / 12, n_durations=5.0)
    fit = Ft.fit_events(win, ["objid", "eventid"], exposure=1 / 12)
    return rounded(fit.select("objid", "eventid", "fit_ok", "delta_chi2", "n_region"), "delta_chi2", n=2)


FEATURES = ["l_quantity", "l_extendedprice", "f3"]


def _feature_rows(spark, sf):
    return D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("l_extendedprice"), (1 + F.col("o_custkey") % 50).alias("l_quantity"), (1 + F.col("o_orderkey") % 9 + F.col("o_totalprice") / 90000).alias("f3"))


@query("G11_event_clusters")
def g11(spark, sf):
    return Ft.cluster_events(_feature_rows(spark, sf), "row", FEATURES, eps=0.2, min_samples=10).select("row", "cluster")


@query("G12_cluster_stability")
def g12(spark, sf):
    return rounded(Ft.cluster_stability(_feature_rows(spark, sf), "row", FEATURES, 1, sizes=(10, 20), eps=0.2).select("row", "stability"), "stability")


@query("G13_template_members")
def g13(spark, sf):
    return Ft.template_members(g11(spark, sf), "row", 1)
