"""Queries: ordered series."""

from pyspark.sql import functions as F

from skyloom.operators import series as S
from skyloom.operators.components import density_groups
from skyloom.operators.skew import island_ids
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.registry import query

# A gap-free light curve per object on a two-hour grid: summed values, else a small ripple.
LC_SQL = f"""a AS (SELECT objid, frame // 4 AS frame, sum(flux) AS v FROM ({D.SOURCES_SQL}) GROUP BY 1, 2),
mm AS (SELECT min(frame) AS lo, max(frame) AS hi FROM a), o AS (SELECT DISTINCT objid FROM a),
g AS (SELECT objid, unnest(generate_series((SELECT lo FROM mm), (SELECT hi FROM mm))) AS frame FROM o),
lc AS (SELECT g.objid, g.frame, 60000e0 + g.frame / 12e0 AS mjd, coalesce(v, 0e0) / 10e0 + ((g.objid * 31 + g.frame * 17) % 100) / 50e0 - 1e0 AS flux FROM g LEFT JOIN a USING (objid, frame))"""
HIT_SQL = f"""{LC_SQL}, h AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY objid ORDER BY frame) > 3 THEN 1 ELSE 0 END AS b FROM lc WHERE flux >= 6e0),
hr AS (SELECT *, 1 + sum(b) OVER (PARTITION BY objid ORDER BY frame) AS run FROM h),
ev AS (SELECT objid, CAST(run AS BIGINT) AS eventid, min(frame) AS frame_start, max(frame) AS frame_end, CAST(1 AS BIGINT) AS flux_sign, max(frame) - min(frame) + 1 AS frame_duration,
 count(*) AS n_detections, CAST(1 AS BIGINT) AS frame_bin FROM hr GROUP BY objid, run)"""


def light_curves(spark, sf):
    a = D.sources(spark, sf).groupBy("objid", F.floor(F.col("frame") / 4).alias("frame")).agg(F.sum("flux").alias("v"))
    mm = a.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    g = a.select("objid").distinct().crossJoin(F.broadcast(mm)).select("objid", F.explode(F.sequence("lo", "hi")).alias("frame"))
    ripple = ((F.col("objid") * 31 + F.col("frame") * 17) % 100) / F.lit(50.0)
    # Added from left to right, as the SQL does: another order rounds to the other side of a limit.
    return g.join(a, ["objid", "frame"], "left").select(
        "objid", "frame", (F.lit(60000.0) + F.col("frame") / 12).alias("mjd"), (F.coalesce("v", F.lit(0.0)) / 10 + ripple - 1).alias("flux"))


def lc_events(spark, sf):
    hits = light_curves(spark, sf).filter("flux >= 6.0")
    runs = island_ids(hits, ["objid"], ["frame"], F.col("frame") - F.col("_p") > 3, {"_p": "frame"}, "eventid")
    return runs.groupBy("objid", "eventid").agg(
        F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"), F.lit(1).cast("long").alias("flux_sign"),
        (F.max("frame") - F.min("frame") + 1).alias("frame_duration"), F.count(F.lit(1)).alias("n_detections"), F.lit(1).cast("long").alias("frame_bin"))


@query("W3_extend_events", f"""WITH {HIT_SQL}, x AS (SELECT objid, frame FROM lc WHERE flux / 2e0 >= 3e-1),
f AS (SELECT e.objid, e.eventid, x.frame, (x.frame - frame_end) - row_number() OVER (PARTITION BY e.objid, e.eventid ORDER BY x.frame) AS miss FROM ev e JOIN x ON x.objid = e.objid AND x.frame > frame_end),
b AS (SELECT e.objid, e.eventid, x.frame, (frame_start - x.frame) - row_number() OVER (PARTITION BY e.objid, e.eventid ORDER BY x.frame DESC) AS miss FROM ev e JOIN x ON x.objid = e.objid AND x.frame < frame_start)
SELECT objid, eventid, coalesce((SELECT min(frame) FROM b WHERE b.objid = ev.objid AND b.eventid = ev.eventid AND miss < 5), frame_start) AS new_start,
coalesce((SELECT max(frame) FROM f WHERE f.objid = ev.objid AND f.eventid = ev.eventid AND miss < 5), frame_end) AS new_end FROM ev""")
def w3(spark, sf):
    lc = light_curves(spark, sf).select("objid", "frame", (F.col("flux") / 2).alias("sig"))
    return S.extend_events(lc_events(spark, sf), lc, ["objid"], sig_limit=0.3).select("objid", "eventid", "new_start", "new_end")


SIG_SQL = f"""{HIT_SQL}, en AS (SELECT e.*, a.mjd AS t0, b.mjd AS t1 FROM ev e JOIN lc a ON a.objid = e.objid AND a.frame = frame_start JOIN lc b ON b.objid = e.objid AND b.frame = frame_end),
bd AS (SELECT en.*, (SELECT arg_min(frame, (abs(mjd - (t0 - 2e-1)), frame)) FROM lc WHERE lc.objid = en.objid) AS b0, (SELECT arg_min(frame, (abs(mjd - (t1 + 2e-1)), frame)) FROM lc WHERE lc.objid = en.objid) AS b1,
 (SELECT arg_min(frame, (abs(mjd - (t0 - 2e-1 - 1e0)), frame)) FROM lc WHERE lc.objid = en.objid) AS w0, (SELECT arg_min(frame, (abs(mjd - (t1 + 2e-1 + 1e0)), frame)) FROM lc WHERE lc.objid = en.objid) AS w1 FROM en),
bs AS (SELECT bd.objid, bd.eventid, median(flux) AS med, stddev_pop(flux) AS sd, count(*) AS n, regr_slope(flux, mjd) AS slope FROM bd JOIN lc ON lc.objid = bd.objid AND ((frame > w0 AND frame < b0) OR (frame < w1 AND frame > b1))
 WHERE NOT EXISTS (SELECT 1 FROM ev s WHERE s.objid = lc.objid AND lc.frame BETWEEN s.frame_start AND s.frame_end) GROUP BY bd.objid, bd.eventid),
ins AS (SELECT ev.objid, ev.eventid, max(flux) AS mx, avg(flux) AS mean, arg_min(frame, (-flux, frame)) AS fm FROM ev JOIN lc ON lc.objid = ev.objid AND frame BETWEEN frame_start AND frame_end GROUP BY ev.objid, ev.eventid),
sg AS (SELECT i.*, CASE WHEN n >= 2 AND sd > 0 THEN (mx - med) / sd END AS lc_sig_max, CASE WHEN n >= 2 AND sd > 0 THEN (mean - med) / sd END AS lc_sig_med, med, sd,
 coalesce(n >= 2 AND sd > 0 AND abs(slope) / sd < 2 AND abs(med) < sd AND sd < 5, false) AS flat FROM ins i LEFT JOIN bs USING (objid, eventid))"""


@query("W4_event_significance", f"WITH {SIG_SQL} SELECT objid, eventid, {R('mx')} AS flux_max, fm AS frame_max, {R('lc_sig_max')} AS lc_sig_max, {R('lc_sig_med')} AS lc_sig_med, CAST(flat AS BIGINT) AS lc_flat FROM sg")
def w4(spark, sf):
    out = S.event_significance(lc_events(spark, sf), light_curves(spark, sf), ["objid"])
    return out.select("objid", "eventid", "frame_max", "lc_flat", *[r6(c).alias(c) for c in ("flux_max", "lc_sig_max", "lc_sig_med")])


@query("W5_short_event_classes", f"""WITH {SIG_SQL}, zz AS (SELECT e.objid, e.eventid, lc.frame, (flux - med) / sd AS z, row_number() OVER (PARTITION BY e.objid, e.eventid ORDER BY (flux - med) / sd DESC, lc.frame) AS rn
 FROM ev e JOIN sg USING (objid, eventid) JOIN lc ON lc.objid = e.objid AND lc.frame BETWEEN frame_start AND frame_end),
c AS (SELECT objid, eventid, count(*) FILTER (z >= 5) AS n5, count(*) FILTER (z >= 3) AS n3, abs(max(frame) FILTER (rn = 2) - max(frame) FILTER (rn = 1)) AS gap FROM zz GROUP BY objid, eventid)
SELECT objid, eventid, CASE WHEN frame_duration = 1 THEN CASE WHEN n5 = 1 THEN 'CosmicRay' ELSE 'Junk' END WHEN n_detections = 2 THEN CASE WHEN n5 = 1 AND n3 = 1 THEN 'CosmicRay'
 WHEN frame_duration > 2 AND gap > 1 THEN CASE WHEN n5 > 0 THEN 'CosmicRay' ELSE 'Junk' END ELSE '-' END ELSE '-' END AS classification FROM ev JOIN c USING (objid, eventid)""")
def w5(spark, sf):
    ev, lc = lc_events(spark, sf), light_curves(spark, sf)
    return S.classify_short(ev, lc, S.event_significance(ev, lc, ["objid"]), ["objid"]).select("objid", "eventid", "classification")


@query("W6_recheck_moving")
def w6(spark, sf):
    ev, lc = lc_events(spark, sf), light_curves(spark, sf)
    ev = ev.withColumns({"classification": F.when(F.col("eventid") % 5 == 0, "Asteroid").otherwise("-"), "mjd_start": F.lit(60000.0) + F.col("frame_start") / 12, "mjd_end": F.lit(60000.0) + F.col("frame_end") / 12})
    out = S.recheck_moving(ev, lc, ["objid"])
    return out.select("objid", "eventid", "classification", "frame_start", "frame_end", "frame_duration", "n_detections", r6("mjd_start").alias("mjd_start"), r6("mjd_end").alias("mjd_end"))


GRID_SEG_SQL = f"fg AS (SELECT *, CASE WHEN mjd < 60325e0 THEN 1 ELSE 2 END AS segment, CASE WHEN slot % 5 <> 0 THEN (slot % 97) * 1e0 END AS flux FROM ({D.FRAME_GRID_SQL}))"


def _grid_seg(spark, sf):
    return D.frame_grid(spark, sf).withColumns({"segment": F.when(F.col("mjd") < 60325, 1).otherwise(2), "flux": F.when(F.col("slot") % 5 != 0, (F.col("slot") % 97) * F.lit(1.0))})


@query("W7_frame_bins", f"""WITH {GRID_SEG_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY segment ORDER BY mjd) - 1) // 6 AS bl FROM fg),
b AS (SELECT segment, bl, avg(mjd) AS mjd, avg(flux) AS flux, count(*) AS n_frames FROM n GROUP BY segment, bl)
SELECT segment, row_number() OVER (ORDER BY segment, bl) - 1 AS bin_index, {R('mjd')} AS mjd, {R('flux')} AS flux, n_frames FROM b""")
def w7(spark, sf):
    out = S.frame_bins(_grid_seg(spark, sf), [], "mjd", 6, ["flux"])
    return out.select("segment", "bin_index", r6("mjd").alias("mjd"), r6("flux").alias("flux"), "n_frames")


@query("W8_block_means", f"""WITH s AS ({D.SERIES_SQL}), n AS (SELECT *, CAST((row_number() OVER (PARTITION BY series ORDER BY t, pt) - 1) // 7 AS BIGINT) AS block FROM s)
SELECT series, block, {R('avg(flux)')} AS flux FROM n GROUP BY series, block HAVING count(*) = 7""")
def w8(spark, sf):
    return S.block_means(D.series(spark, sf), ["series"], ["t", "pt"], 7, ["flux"]).withColumn("flux", r6("flux"))


@query("W9_local_excess")
def w9(spark, sf):
    return S.local_excess(D.series(spark, sf).select("series", "pt", "t", "flux"), ["series"], ["t", "pt"], "flux", window=51, sigma=2.0).select("series", "pt", "local_flux_excess")


FLAG_SQL = f"s AS (SELECT series, pt, t, flux > 30e0 AS bright, flag = 'R' AS ret, part % 3 AS star FROM ({D.SERIES_SQL}))"


def _flags(spark, sf):
    return D.series(spark, sf).select("series", "pt", "t", (F.col("flux") > 30).alias("bright"), (F.col("flag") == "R").alias("ret"), (F.col("part") % 3).alias("star"))


@query("W10_spread_over_runs", f"""WITH {FLAG_SQL}, c AS (SELECT *, CASE WHEN bright <> lag(bright) OVER w THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY series ORDER BY t, pt)),
r AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY t, pt) AS run FROM c) SELECT series, pt, bright AND bool_or(ret) OVER (PARTITION BY series, run) AS flagged FROM r""")
def w10(spark, sf):
    return S.spread_over_runs(_flags(spark, sf), ["series"], ["t", "pt"], "bright", "ret", "flagged").select("series", "pt", "flagged")


@query("W11_long_same_runs", f"""WITH {FLAG_SQL}, c AS (SELECT *, CASE WHEN lag(bright) OVER w IS NOT NULL AND (bright <> lag(bright) OVER w OR star <> lag(star) OVER w) THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY series ORDER BY t, pt)),
r AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY t, pt) AS run FROM c) SELECT series, pt, bright AND count(*) OVER (PARTITION BY series, run) >= 3 AS flagged FROM r""")
def w11(spark, sf):
    return S.long_same_runs(_flags(spark, sf), ["series"], ["t", "pt"], "bright", "star", 3, "flagged").select("series", "pt", "flagged")


@query("W12_contamination_flags")
def w12(spark, sf):
    s = D.series(spark, sf).select("series", "pt", "t", "flux", (F.col("part") % 3 == 0).alias("near_star_proximity"), (F.col("part") % 2).alias("contaminating_star_idx"))
    return S.contamination_flags(s, ["series"], ["t", "pt"], "flux", min_run=4).select("series", "pt", "local_flux_excess", "near_bright_star")


@query("W13_gap_limited_window", f"""WITH t AS (SELECT row_number() OVER (ORDER BY mjd) - 1 AS frame, mjd FROM ({D.FRAME_GRID_SQL})), g AS (SELECT *, CASE WHEN mjd - lag(mjd) OVER (ORDER BY mjd) > 25e-1 * 10e0 / 1440e0 THEN 1 ELSE 0 END AS b FROM t),
r AS (SELECT *, sum(b) OVER (ORDER BY mjd) AS run FROM g), e AS (SELECT run, max(frame) AS last FROM r GROUP BY run)
SELECT frame AS frame_start, least(last, (SELECT max(frame) FROM t x WHERE x.mjd <= r.mjd + 5e-2)) + 1 AS frame_end FROM r JOIN e USING (run)""")
def w13(spark, sf):
    from skyloom.operators.skew import OrderedScan

    t = OrderedScan(D.frame_grid(spark, sf), [], ["mjd"]).row_number("rn").done().select((F.col("rn") - 1).alias("frame"), "mjd", F.lit(1).alias("unit"))
    starts = t.select("unit", F.col("frame").alias("frame_start"), F.lit(0.05).alias("days"))
    return S.gap_limited_window(starts, t, ["unit"], 10.0, "days", gap_factor=2.5).select("frame_start", "frame_end")


@query("W19_nearest_index", f"""WITH t AS (SELECT slot, mjd FROM ({D.FRAME_GRID_SQL})), e AS (SELECT event_id, mjd + 2e-1 AS q FROM ({D.SOURCES_SQL})),
a AS (SELECT e.*, t.slot AS s0, t.mjd AS t0 FROM e ASOF LEFT JOIN t ON e.q >= t.mjd), b AS (SELECT a.*, t.slot AS s1, t.mjd AS t1 FROM a ASOF LEFT JOIN t ON a.q <= t.mjd)
SELECT event_id, CASE WHEN s0 IS NOT NULL AND (s1 IS NULL OR q - t0 <= t1 - q) THEN s0 ELSE s1 END AS slot FROM b""")
def w19(spark, sf):
    e = D.sources(spark, sf).select("event_id", (F.col("mjd") + 0.2).alias("at"))
    return S.asof_nearest(e, D.frame_grid(spark, sf), [], "at", "mjd", ["slot"]).select("event_id", "slot")


@query("J10_asof_nearest", f"""WITH t AS (SELECT slot, mjd FROM ({D.FRAME_GRID_SQL})), e AS (SELECT event_id, mjd AS q FROM ({D.SOURCES_SQL})),
a AS (SELECT e.*, t.slot AS s0, t.mjd AS t0 FROM e ASOF LEFT JOIN t ON e.q >= t.mjd), b AS (SELECT a.*, t.slot AS s1, t.mjd AS t1 FROM a ASOF LEFT JOIN t ON a.q <= t.mjd),
p AS (SELECT event_id, q, CASE WHEN s0 IS NOT NULL AND (s1 IS NULL OR q - t0 <= t1 - q) THEN s0 ELSE s1 END AS slot, CASE WHEN s0 IS NOT NULL AND (s1 IS NULL OR q - t0 <= t1 - q) THEN t0 ELSE t1 END AS tt FROM b)
SELECT event_id, slot FROM p WHERE abs(q - tt) <= 3e-3""")
def j10(spark, sf):
    e = D.sources(spark, sf).select("event_id", F.col("mjd").alias("at"))
    return S.asof_nearest(e, D.frame_grid(spark, sf), [], "at", "mjd", ["slot"], tolerance=0.003, inner=True).select("event_id", "slot")


@query("J11_interpolate", f"""WITH t AS (SELECT mjd AS tm, (slot % 50) * 1e0 AS v FROM ({D.FRAME_GRID_SQL})), e AS (SELECT event_id, mjd AS q FROM ({D.SOURCES_SQL})),
a AS (SELECT e.*, t.v AS v0, t.tm AS t0 FROM e ASOF LEFT JOIN t ON e.q >= t.tm), b AS (SELECT a.*, t.v AS v1, t.tm AS t1 FROM a ASOF LEFT JOIN t ON a.q <= t.tm)
SELECT event_id, {R('CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = q THEN v0 ELSE v0 + (v1 - v0) * (q - t0) / (t1 - t0) END', 4)} AS seg FROM b""")
def j11(spark, sf):
    e = D.sources(spark, sf).select("event_id", F.col("mjd").alias("at"))
    t = D.frame_grid(spark, sf).select("mjd", ((F.col("slot") % 50) * F.lit(1.0)).alias("v"))
    return S.interpolate(e, t, [], "at", "mjd", "v", "seg").select("event_id", r6("seg", 4).alias("seg"))


@query("S10_largest_gap_split", f"""WITH s AS (SELECT DISTINCT objid, frame FROM ({D.SOURCES_SQL})), g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY objid ORDER BY frame) AS gap FROM s),
b AS (SELECT objid, arg_min(frame, (-gap, frame)) AS brk FROM g WHERE gap IS NOT NULL GROUP BY objid) SELECT objid, frame, CAST(CASE WHEN frame >= brk THEN 2 ELSE 1 END AS BIGINT) AS part FROM s JOIN b USING (objid)""")
def s10(spark, sf):
    return S.split_largest_gap(D.sources(spark, sf).select("objid", "frame").distinct(), ["objid"], "frame")


@query("W20_orbit_correction", f"""WITH s AS (SELECT series, pt, flux, flag FROM ({D.SERIES_SQL})), r AS (SELECT series, flag, sum(qty) AS f, stddev_pop(qty) AS sd FROM ({D.SERIES_SQL}) GROUP BY series, flag),
p AS (SELECT series, arg_min(f, (sd, flag)) AS f0 FROM r GROUP BY series) SELECT s.series, pt, {R('flux + f0 - f')} AS flux_corrected FROM s JOIN r ON s.series = r.series AND s.flag = r.flag JOIN p ON p.series = s.series""")
def w20(spark, sf):
    s = D.series(spark, sf)
    refs = s.groupBy("series", "flag").agg(F.sum("qty").alias("ref_flux"), F.stddev_pop("qty").alias("ref_std"))
    return S.orbit_correction(s.select("series", "pt", "flux", "flag"), refs, ["series"], "flag").select("series", "pt", r6("flux_corrected").alias("flux_corrected"))


@query("W21_event_frames", f"""WITH {HIT_SQL}, l AS (SELECT objid, eventid, list_sort(list_distinct(list_concat(generate_series(frame_start - 2, frame_end + 2, 3), [frame_start + 1]))) AS fr FROM ev),
m AS (SELECT objid, eventid, list_concat(fr, [fr[-1] + 3 * i FOR i IN generate_series(1, greatest(0, 5 - len(fr)))]) AS fr FROM l)
SELECT objid, eventid, array_to_string(list_sort(list_distinct([greatest(0, least(f, 300)) FOR f IN fr])), ',') AS frames FROM m""")
def w21(spark, sf):
    fr = S.event_frame_list("frame_start", "frame_end", F.col("frame_start") + 1, F.lit(301), 2, 3)
    return lc_events(spark, sf).select("objid", "eventid", F.array_join(fr.cast("array<string>"), ",").alias("frames"))


def binned_events(spark, sf):
    """Events of three time bins on a small field, with groups at 1 px and 2 px."""
    k = F.col("o_orderkey")
    start = (k * 13) % 400
    ev = D.table(spark, sf, "orders").select(
        k.alias("eventkey"), ((k * 37) % 997 / F.lit(2.0)).alias("x"), ((k * 53) % 991 / F.lit(2.0)).alias("y"),
        F.element_at(F.array(*[F.lit(b).cast("long") for b in (1, 2, 6)]), (k % 3 + 1).cast("int")).alias("frame_bin"), start.alias("_s"),
        F.when(k % 10 == 0, "Asteroid").otherwise("-").alias("classification"))
    ev = ev.withColumns({"frame_start": F.floor(F.col("_s") / F.col("frame_bin")), "frame_end": F.floor((F.col("_s") + 8) / F.col("frame_bin"))}).drop("_s")
    one = density_groups(ev, "eventkey", ["x", "y"], 1.0, 1, label="g1")
    return density_groups(one, "eventkey", ["x", "y"], 2.0, 1, label="g2")


@query("G5_crossbin_ids")
def g5(spark, sf):
    out = S.crossbin_ids(binned_events(spark, sf), "g1", "g2")
    return out.select("eventkey", "frame_bin", F.array_join(F.col("crossbin_ids").cast("array<string>"), ",").alias("crossbin_ids"))


@query("J16_interval_overlap", f"""WITH e AS ({D.DETECTIONS_SQL}) SELECT a.eventkey AS fine, b.eventkey AS coarse FROM e a JOIN e b ON a.objid = b.objid AND b.frame_bin > a.frame_bin
AND a.mjd_start <= b.mjd_end AND a.mjd_end >= b.mjd_start""")
def j16(spark, sf):
    d = D.detections(spark, sf)
    block = lambda: F.explode(F.sequence(F.floor(F.col("mjd_start") / 16), F.floor(F.col("mjd_end") / 16))).alias("_b")
    a = d.select(F.col("eventkey").alias("fine"), "objid", F.col("frame_bin").alias("fb"), F.col("mjd_start").alias("s0"), F.col("mjd_end").alias("e0"), block())
    b = d.select(F.col("eventkey").alias("coarse"), "objid", F.col("frame_bin").alias("cb"), F.col("mjd_start").alias("s1"), F.col("mjd_end").alias("e1"), block())
    # A pair is reported in the first block both intervals share.
    first = F.greatest(F.floor(F.col("s0") / 16), F.floor(F.col("s1") / 16))
    return a.join(b, ["objid", "_b"]).filter((F.col("cb") > F.col("fb")) & (F.col("s0") <= F.col("e1")) & (F.col("e0") >= F.col("s1")) & (F.col("_b") == first)).select("fine", "coarse")
