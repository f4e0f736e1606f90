"""Queries: events and objects from detections."""

from pyspark.sql import functions as F

from skyloom.operators import events as E
from skyloom.operators import filters as Fl
from skyloom.operators.skew import best_per_key, group_stats
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.registry import query

GAP = 24

# Labelled detections, events with an event number per object, and the filterable event table.
LABELLED_SQL = f"""src AS ({D.SOURCES_SQL}),
fr AS (SELECT DISTINCT objid, flux_sign, frame FROM src),
br AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY objid, flux_sign ORDER BY frame) > {GAP} THEN 1 ELSE 0 END AS b FROM fr),
rn AS (SELECT *, 1 + sum(b) OVER (PARTITION BY objid, flux_sign ORDER BY frame) AS run FROM br),
sh AS (SELECT objid, coalesce(max(CASE WHEN flux_sign > 0 THEN run END), 0) AS shift FROM rn GROUP BY objid),
lab AS (SELECT src.*, CAST(rn.run + CASE WHEN src.flux_sign > 0 THEN 0 ELSE shift END AS BIGINT) AS eventid
        FROM src JOIN rn USING (objid, flux_sign, frame) JOIN sh USING (objid))"""
EVENTS_SQL = f"""{LABELLED_SQL},
ev AS (SELECT objid, eventid, min(frame_bin) AS frame_bin, min(frame) AS frame_start, max(frame) AS frame_end,
  max(frame) - min(frame) + 1 AS frame_duration, min(mjd) AS mjd_start, max(mjd) AS mjd_end, max(mjd) - min(mjd) AS mjd_duration,
  max(snr) AS image_sig_max, max(flux_sign) AS flux_sign, arg_min(source_mask, (frame, event_id)) AS source_mask,
  count(*) AS n_detections FROM lab GROUP BY objid, eventid)"""
TABLE_SQL = f"""{EVENTS_SQL},
et AS (SELECT *, CAST(objid * 100000 + eventid AS BIGINT) AS eventkey,
  CASE (objid + eventid) % 6 WHEN 0 THEN 'Asteroid' WHEN 1 THEN 'CosmicRay' WHEN 2 THEN 'Junk' WHEN 3 THEN 'VRRLyr' WHEN 4 THEN 'RRLyrae' ELSE '-' END AS classification,
  CASE WHEN (objid * 7 + eventid) % 5 = 0 THEN CAST(objid AS VARCHAR) ELSE '-' END AS gaia_id,
  (objid % 18) * 1e1 - 9e1 AS gal_b, CAST((eventid * 7) % 11 = 0 AS BIGINT) AS bad_frame_flag, n_detections / 2e1 AS psf_like,
  (eventid % 7) / 1e1 AS xcentroid_err, (objid % 5) / 1e1 AS ycentroid_err, CAST(eventid % 2 AS BIGINT) AS lc_flat,
  count(*) OVER (PARTITION BY objid) AS total_events FROM ev)"""


def labelled(spark, sf):
    return E.temporal_events(D.sources(spark, sf), GAP)


def events(spark, sf):
    # One time bin per event here: the smallest among its detections.
    lab = labelled(spark, sf).withColumnRenamed("frame_bin", "_bin")
    order = F.struct("frame", "event_id")
    return lab.groupBy("objid", "eventid").agg(
        F.min("_bin").alias("frame_bin"), F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"),
        (F.max("frame") - F.min("frame") + 1).alias("frame_duration"), F.min("mjd").alias("mjd_start"),
        F.max("mjd").alias("mjd_end"), (F.max("mjd") - F.min("mjd")).alias("mjd_duration"), F.max("snr").alias("image_sig_max"),
        F.max("flux_sign").alias("flux_sign"), F.min_by("source_mask", order).alias("source_mask"), F.count(F.lit(1)).alias("n_detections"))


def event_table(spark, sf):
    o, e = F.col("objid"), F.col("eventid")
    names = F.array(*[F.lit(x) for x in ("Asteroid", "CosmicRay", "Junk", "VRRLyr", "RRLyrae", "-")])
    ev = events(spark, sf).withColumns({
        "eventkey": o * 100000 + e,
        "classification": F.element_at(names, ((o + e) % 6 + 1).cast("int")),
        "gaia_id": F.when((o * 7 + e) % 5 == 0, o.cast("string")).otherwise(F.lit("-")),
        "gal_b": (o % 18) * F.lit(10.0) - 90, "bad_frame_flag": ((e * 7) % 11 == 0).cast("long"), "psf_like": F.col("n_detections") / F.lit(20.0),
        "xcentroid_err": (e % 7) / F.lit(10.0), "ycentroid_err": (o % 5) / F.lit(10.0), "lc_flat": e % 2,
    })
    return group_stats(ev, ["objid"], F.count(F.lit(1)).alias("total_events"))


@query("flagship_top_objects", f"""WITH {TABLE_SQL},
ob AS (SELECT objid, count(*) AS n_events, max(image_sig_max) AS image_sig_max, min(frame_duration) AS min_eventlength_frame,
  max(frame_duration) AS max_eventlength_frame, CAST(sum(DISTINCT flux_sign) AS BIGINT) AS flux_sign,
  arg_min(eventid, (-image_sig_max, eventid)) AS best_event FROM et WHERE classification <> 'Junk' GROUP BY objid)
SELECT objid, n_events, {R('image_sig_max')} AS image_sig_max, min_eventlength_frame, max_eventlength_frame, flux_sign, best_event
FROM ob WHERE n_events >= 2 ORDER BY image_sig_max DESC, objid LIMIT 100""")
def flagship(spark, sf):
    ev = Fl.filter_events(event_table(spark, sf))
    ob = ev.groupBy("objid").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("image_sig_max").alias("image_sig_max"),
        F.min("frame_duration").alias("min_eventlength_frame"), F.max("frame_duration").alias("max_eventlength_frame"),
        F.sum_distinct("flux_sign").alias("flux_sign"),
        F.min_by("eventid", F.struct(-F.col("image_sig_max"), F.col("eventid"))).alias("best_event"))
    top = ob.filter("n_events >= 2").orderBy(F.col("image_sig_max").desc(), "objid").limit(100)
    return top.withColumn("image_sig_max", r6("image_sig_max"))


@query("W1_temporal_events", f"WITH {LABELLED_SQL} SELECT event_id, objid, flux_sign, frame, eventid FROM lab")
def w1(spark, sf):
    return labelled(spark, sf).select("event_id", "objid", "flux_sign", "frame", "eventid")


@query("W2_consecutive_runs", f"""WITH src AS ({D.SOURCES_SQL}), fr AS (SELECT DISTINCT objid, frame FROM src),
br AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY objid ORDER BY frame) > 2 THEN 1 ELSE 0 END AS b FROM fr)
SELECT objid, frame, CAST(1 + sum(b) OVER (PARTITION BY objid ORDER BY frame) AS BIGINT) AS run FROM br""")
def w2(spark, sf):
    return E.consecutive_runs(D.sources(spark, sf).select("objid", "frame").distinct(), ["objid"], "frame")


@query("A1_detections_per_object", f"WITH src AS ({D.SOURCES_SQL}) SELECT event_id, objid, count(*) OVER (PARTITION BY objid) AS n_detections FROM src")
def a1(spark, sf):
    return E.count_per_object(D.sources(spark, sf).select("event_id", "objid"))


@query("A2_event_numbers", f"""WITH {EVENTS_SQL} SELECT objid, frame_start, flux_sign, count(*) OVER (PARTITION BY objid) AS total_events,
row_number() OVER (PARTITION BY objid ORDER BY frame_bin, frame_start, eventid) AS eventid FROM ev""")
def a2(spark, sf):
    return E.number_events(events(spark, sf)).select("objid", "frame_start", "flux_sign", "total_events", "eventid")


@query("A3_objects_rollup", f"""WITH {TABLE_SQL},
top AS (SELECT * FROM et QUALIFY row_number() OVER (PARTITION BY objid ORDER BY image_sig_max DESC, eventid) = 1),
md AS (SELECT objid, classification AS mode_class FROM (SELECT objid, classification, count(*) AS c FROM et GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY objid ORDER BY c DESC, classification) = 1),
ob AS (SELECT objid, count(*) AS n_events, CAST(sum(DISTINCT flux_sign) AS BIGINT) AS flux_sign, min(frame_duration) AS min_eventlength_frame,
  max(frame_duration) AS max_eventlength_frame, min(mjd_duration) AS min_eventlength_mjd, max(mjd_duration) AS max_eventlength_mjd FROM et GROUP BY objid),
k AS (SELECT ob.*, top.gaia_id, top.frame_bin, top.image_sig_max, top.xcentroid_err, top.ycentroid_err,
  CASE WHEN top.classification = 'Asteroid' AND n_events < 2 THEN 'Asteroid' ELSE mode_class END AS kind
  FROM ob JOIN top USING (objid) JOIN md USING (objid))
SELECT objid, n_events, flux_sign, min_eventlength_frame, max_eventlength_frame, {R('min_eventlength_mjd')} AS min_eventlength_mjd,
  {R('max_eventlength_mjd')} AS max_eventlength_mjd, CASE WHEN kind = 'RRLyrae' THEN 'VRRLyr' ELSE kind END AS classification,
  gaia_id, frame_bin, {R('image_sig_max')} AS image_sig_max, xcentroid_err, ycentroid_err FROM k""")
def a3(spark, sf):
    out = E.objects_rollup(event_table(spark, sf).drop("gal_b"))
    return out.drop("psf_maxsig").withColumns({c: r6(c) for c in ("min_eventlength_mjd", "max_eventlength_mjd", "image_sig_max")})


@query("A4_event_rollup", f"""WITH {LABELLED_SQL} SELECT frame_bin, objid, eventid, min(frame) AS frame_start, max(frame) AS frame_end,
max(frame) - min(frame) + 1 AS frame_duration, {R('min(mjd)')} AS mjd_start, {R('max(mjd)')} AS mjd_end, {R('max(mjd) - min(mjd)')} AS mjd_duration,
{R('max(snr)')} AS image_sig_max, max(flux_sign) AS flux_sign, arg_min(source_mask, (frame, event_id)) AS source_mask, count(*) AS n_detections
FROM lab GROUP BY frame_bin, objid, eventid""")
def a4(spark, sf):
    return E.event_rollup(labelled(spark, sf)).withColumns({c: r6(c) for c in ("mjd_start", "mjd_end", "mjd_duration", "image_sig_max")})


@query("W16_keep_first_event", f"""WITH s AS (SELECT *, CAST(floor(x) AS BIGINT) AS xint, CAST(floor(y) AS BIGINT) AS yint FROM ({D.SOURCES_SQL}))
SELECT frame_bin, xint, yint, min(event_id) AS event_id FROM s GROUP BY frame_bin, xint, yint""")
def w16(spark, sf):
    s = D.sources(spark, sf).select("frame_bin", F.floor("x").alias("xint"), F.floor("y").alias("yint"), "event_id", "flux")
    return E.keep_first(s, ["frame_bin", "xint", "yint"], ["event_id"]).drop("flux")


@query("W17_relabel_objects", f"""WITH s AS (SELECT event_id, CASE WHEN objid % 10 = 0 THEN 0 ELSE objid END AS objid, frame_bin FROM ({D.SOURCES_SQL})),
r AS (SELECT *, dense_rank() OVER (ORDER BY objid, frame_bin) AS newid FROM s WHERE objid <> 0)
SELECT * FROM r UNION ALL SELECT *, (SELECT max(newid) FROM r) + row_number() OVER (ORDER BY event_id) FROM s WHERE objid = 0""")
def w17(spark, sf):
    s = D.sources(spark, sf).select("event_id", F.when(F.col("objid") % 10 == 0, 0).otherwise(F.col("objid")).cast("long").alias("objid"), "frame_bin")
    return E.relabel(s, "event_id")


@query("W18_renumber_survivors", f"""WITH s AS (SELECT event_id, objid FROM ({D.SOURCES_SQL})), c AS (SELECT objid, count(*) AS n FROM s GROUP BY objid),
k AS (SELECT objid, row_number() OVER (ORDER BY objid) AS new_label FROM c WHERE n >= 67)
SELECT event_id, s.objid, coalesce(new_label, -1) AS new_label FROM s LEFT JOIN k USING (objid)""")
def w18(spark, sf):
    return E.renumber_survivors(D.sources(spark, sf).select("event_id", "objid"), "objid", 67)


@query("T1_sort_fits", """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS delta_bic FROM supplier
ORDER BY delta_bic ASC NULLS LAST, s_suppkey""")
def t1(spark, sf):
    s = D.table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("delta_bic"))
    return s.orderBy(F.col("delta_bic").asc_nulls_last(), "s_suppkey")


@query("T2_top_members", """SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50""")
def t2(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(50)


@query("T3_best_per_object", f"""SELECT objid, eventkey, snr FROM ({D.DETECTIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY objid ORDER BY snr DESC, eventkey) = 1""")
def t3(spark, sf):
    d = D.detections(spark, sf).select("objid", "eventkey", "snr")
    return best_per_key(d, ["objid"], [-F.col("snr"), F.col("eventkey")])


@query("T4_top_candidates", f"""SELECT objid, eventkey, snr FROM (SELECT objid, eventkey, snr FROM ({D.DETECTIONS_SQL})
QUALIFY row_number() OVER (PARTITION BY objid ORDER BY snr DESC, eventkey) = 1) ORDER BY snr DESC, objid LIMIT 20""")
def t4(spark, sf):
    return t3(spark, sf).orderBy(F.col("snr").desc(), "objid").limit(20)


@query("T5_concat_distinct", """SELECT DISTINCT * FROM (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER' FROM supplier)""")
def t5(spark, sf):
    a = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    b = D.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("SUPPLIER").alias("v"))
    return a.unionByName(b).distinct()


@query("T7_selection_list", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN
(SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT')""")
def t7(spark, sf):
    picks = D.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(picks, ["l_orderkey", "l_linenumber"], "left_semi")
