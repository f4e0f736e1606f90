"""Queries: predicates and selections."""

from pyspark.sql import functions as F

from skyloom.operators import filters as Fl
from skyloom.operators.events import ordered_columns
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_events import TABLE_SQL, event_table
from skyloom.plans.registry import query

KEY = ["objid", "eventid"]


@query("F1_filter_events", f"""WITH {TABLE_SQL} SELECT objid, eventid FROM et WHERE classification <> 'Junk' AND classification <> 'CosmicRay'
AND source_mask < 4 AND bad_frame_flag = 0 AND flux_sign = 1 AND image_sig_max >= 2e0 AND psf_like >= 5e-2 AND lc_flat = 1
AND total_events >= 20 AND total_events <= 60 AND frame_bin = 1 AND gaia_id = '-'""")
def f1(spark, sf):
    return Fl.filter_events(
        event_table(spark, sf), star=True, no_cosmic_rays=True, no_straps=True, exclude_bad_frames=True, flux_sign=1, image_sig_max=2.0,
        psf_like=0.05, lc_flat=True, min_events=20, max_events=60, frame_bin=1).select(*KEY)


@query("F2_star_filter_hard", f"""WITH {TABLE_SQL}, clean AS (SELECT c_custkey AS objid FROM customer WHERE c_nationkey % 2 = 0)
SELECT objid, eventid FROM et WHERE gaia_id = '-' AND objid IN (SELECT objid FROM clean)""")
def f2(spark, sf):
    objects = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("objid"), F.when(F.col("c_nationkey") % 2 == 0, "-").otherwise("star").alias("gaia_id"))
    return Fl.star_filter(event_table(spark, sf), "hard", objects).select(*KEY)


@query("F3_classification", f"""WITH {TABLE_SQL} SELECT objid, eventid, classification FROM et
WHERE lower(classification) NOT IN ('vcr','vrrlyr','veb','vlpv','vst','vagn','vrm','vmso','rrlyrae')""")
def f3(spark, sf):
    return event_table(spark, sf).filter(Fl.classification_is("classification", "!var")).select(*KEY, "classification")


@query("F3_classification_objects", """SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building')""")
def f3o(spark, sf):
    return D.table(spark, sf, "customer").filter(Fl.classification_is("c_mktsegment", "Building", for_objects=True)).select("c_custkey", "c_mktsegment")


@query("F4_duration_limits", f"""WITH {TABLE_SQL} SELECT objid, eventid, frame_duration, frame_bin FROM et
WHERE frame_duration <= 120e0 / frame_bin AND frame_duration >= 12e0 / frame_bin""")
def f4(spark, sf):
    return Fl.filter_events(event_table(spark, sf), no_junk=False, min_duration=12, max_duration=120).select(*KEY, "frame_duration", "frame_bin")


@query("F5_centroid_error", f"""WITH {TABLE_SQL} SELECT objid, eventid FROM et WHERE xcentroid_err * xcentroid_err + ycentroid_err * ycentroid_err <= 2e0 * 9e-2""")
def f5(spark, sf):
    return event_table(spark, sf).filter(Fl.centroid_error_within("xcentroid_err", "ycentroid_err", 0.3)).select(*KEY)


@query("F6_galactic_latitude", f"""WITH {TABLE_SQL} SELECT objid, eventid FROM et WHERE abs(gal_b) BETWEEN 30 AND 90""")
def f6(spark, sf):
    return event_table(spark, sf).filter(Fl.latitude_within("gal_b", 30)).select(*KEY)


CROSSBIN = """SELECT o_orderkey AS eventkey, o_custkey, o_orderkey % 50 AS grp, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [o_custkey % 40, 40 + o_orderkey % 7] END AS ids FROM orders"""


def _crossbins(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c % 40, 40 + k % 7))
    return D.table(spark, sf, "orders").select(k.alias("eventkey"), ids.alias("crossbin_ids"))


@query("F7_no_crossbins", f"SELECT eventkey FROM ({CROSSBIN}) WHERE len(ids) = 0")
def f7(spark, sf):
    return _crossbins(spark, sf).filter(Fl.no_crossbins("crossbin_ids")).select("eventkey")


@query("F8_boundary_buffer", f"""WITH {TABLE_SQL}, bo AS (SELECT frame_bin, max(frame_end) AS last, CAST(max(frame_end) // 2 AS BIGINT) AS brk FROM et GROUP BY frame_bin),
w AS (SELECT frame_bin, last, unnest([0, brk, brk + 1, last]) AS b, CAST(floor(30 / frame_bin) AS BIGINT) AS reach FROM bo),
iv AS (SELECT frame_bin, greatest(b - reach, 0) AS lo, least(b + reach, last) AS hi FROM w)
SELECT objid, eventid FROM et WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.frame_bin = et.frame_bin AND lo <= frame_end AND hi >= frame_start)""")
def f8(spark, sf):
    ev = event_table(spark, sf)
    bounds = ev.groupBy("frame_bin").agg(F.max("frame_end").alias("last"), F.floor(F.max("frame_end") / 2).alias("brk"))
    return Fl.outside_boundaries(ev, bounds, 30).select(*KEY)


@query("F9_object_cone", f"""WITH s AS ({D.STARS_SQL}) SELECT source, {R('2 * degrees(asin(least(1e0, sqrt(pow(sin(radians(10e0 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(10e0)) * pow(sin(radians(359e0 - ra) / 2), 2)))))', 6)} AS sep
FROM s WHERE 2 * degrees(asin(least(1e0, sqrt(pow(sin(radians(10e0 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(10e0)) * pow(sin(radians(359e0 - ra) / 2), 2))))) * 3600 < 54000e0""")
def f9(spark, sf):
    from skyloom.functions.angles import separation_arcsec

    return Fl.filter_objects(D.stars(spark, sf), ra=359.0, dec=10.0, distance=54000.0).select(
        "source", r6(separation_arcsec("ra", "dec", 359.0, 10.0) / 3600).alias("sep"))


@query("F10_crossbin_ids", f"SELECT eventkey FROM ({CROSSBIN}) WHERE list_has_any(ids, [CAST(3 AS BIGINT), 44])")
def f10(spark, sf):
    return Fl.crossbin_events(_crossbins(spark, sf), [3, 44]).select("eventkey")


@query("F11_filter_injections", f"""SELECT injid FROM ({D.INJECTIONS_SQL}) WHERE event_type = 'flare' AND i_snr >= 50000e0 AND (injid % 20) / 1e1 - 1e0 >= 5e-1""")
def f11(spark, sf):
    inj = D.injections(spark, sf).withColumnRenamed("i_snr", "snr").withColumn("K", (F.col("injid") % 20) / F.lit(10.0) - 1)
    return Fl.filter_injections(inj, event_type="flare", min_snr=50000.0, min_k=0.5).select("injid")


FITS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE -20e0 * l_discount * 10e0 END AS delta_bic,
l_tax * 50e0 AS redchi2_region, l_quantity / 2e0 AS A_snr, l_returnflag <> 'R' AS fit_ok FROM lineitem"""


def _fits(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 9 != 0, F.lit(-20.0) * F.col("l_discount") * 10).alias("delta_bic"),
        (F.col("l_tax") * 50).alias("redchi2_region"), (F.col("l_quantity") / 2).alias("A_snr"), (F.col("l_returnflag") != "R").alias("fit_ok"))


@query("F12_fit_pass_flag", f"""SELECT l_orderkey, l_linenumber, coalesce(fit_ok AND delta_bic <= -6 AND redchi2_region <= 3 AND A_snr >= 5, false) AS pass FROM ({FITS})""")
def f12(spark, sf):
    df = _fits(spark, sf)
    return df.select("l_orderkey", "l_linenumber", Fl.fit_passes(df).alias("pass"))


@query("F13_quality_mask", f"""SELECT l_orderkey, l_linenumber FROM ({FITS}) WHERE coalesce(delta_bic <= -6 AND A_snr >= 5, false)""")
def f13(spark, sf):
    df = _fits(spark, sf).drop("redchi2_region", "fit_ok")
    return df.filter(Fl.fit_passes(df)).select("l_orderkey", "l_linenumber")


@query("F14_index_predicates", f"""SELECT source, rpmag IS NULL AS no_rp, coalesce(gmag > 9e0 AND gmag <= 12e0, false) AS mid, coalesce(rpmag < 9e0 OR rpmag > 15e0, false) AS outer_rp,
(nation & 5) <> 0 AS bits, regexp_matches(var_type, '^(A|B)') AS ab, nation = 3 AS is3 FROM ({D.STARS_SQL})""")
def f14(spark, sf):
    return D.stars(spark, sf).select(
        "source", Fl.equals("rpmag", None).alias("no_rp"), Fl.in_range("gmag", 9.0, 12.0, exclude_low=True).alias("mid"),
        Fl.in_range("rpmag", 9.0, 15.0, outside=True).alias("outer_rp"), Fl.masked("nation", 5).alias("bits"),
        F.col("var_type").rlike("^(A|B)").alias("ab"), Fl.equals("nation", 3).alias("is3"))


A_SQL, B_SQL = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000"


def _sets(spark, sf):
    o = D.table(spark, sf, "orders")
    return (o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("k")))


@query("F15_set_algebra", f"""SELECT 'union' AS op, k FROM (({A_SQL}) UNION ({B_SQL})) UNION ALL SELECT 'and', k FROM (({A_SQL}) INTERSECT ({B_SQL}))
UNION ALL SELECT 'minus', k FROM (({A_SQL}) EXCEPT ({B_SQL}))""")
def f15(spark, sf):
    a, b = _sets(spark, sf)
    return (Fl.union_of(a, b).select(F.lit("union").alias("op"), "k").unionByName(Fl.intersection_of(a, b).select(F.lit("and").alias("op"), "k"))
            .unionByName(Fl.difference_of(a, b).select(F.lit("minus").alias("op"), "k")))


@query("T6_symmetric_difference", f"(({A_SQL}) EXCEPT ({B_SQL})) UNION (({B_SQL}) EXCEPT ({A_SQL}))")
def t6(spark, sf):
    return Fl.symmetric_difference(*_sets(spark, sf))


@query("F16_error_mask", f"""WITH z AS ({D.SERIES_SQL}), m AS (SELECT series, median(err) AS med FROM z WHERE err > 0 GROUP BY series)
SELECT series, pt, err FROM z JOIN m USING (series) WHERE err > 0 AND err <= 12e-1 * med AND err <= 11e-1 * 1e0""")
def f16(spark, sf):
    return Fl.keep_good_errors(D.series(spark, sf).select("series", "pt", "err"), "err", ["series"], factor=1.2, cap=1.1)


@query("F17_isolated_stars", f"""WITH s AS ({D.STARS_SQL}) SELECT source FROM s a WHERE a.rpmag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE
sqrt(pow((b.ra - a.ra) * cos(radians(a.dec)), 2) + pow(b.dec - a.dec, 2)) * 3600 > 5e-1 AND sqrt(pow((b.ra - a.ra) * cos(radians(a.dec)), 2) + pow(b.dec - a.dec, 2)) * 3600 < 7200e0
AND b.rpmag < a.rpmag + 2e0)""")
def f17(spark, sf):
    s = D.stars(spark, sf)
    return Fl.isolated_stars(s.filter("rpmag IS NOT NULL"), s, 2.0).select("source")


@query("F18_candidate_window", f"""SELECT objid, eventkey, snr FROM ({D.DETECTIONS_SQL}) WHERE mjd_start > 49500e0 - 30e0 AND mjd_start < 49500e0 + 400e0
AND mjd_end - mjd_start < 7e0 AND snr > 20000e0 QUALIFY row_number() OVER (PARTITION BY objid ORDER BY snr DESC, eventkey) = 1""")
def f18(spark, sf):
    return Fl.candidate_window(D.detections(spark, sf), 49500.0, 30.0, 400.0, 7.0, 20000.0).select("objid", "eventkey", "snr")


@query("F19_schema_order", f"WITH {TABLE_SQL} SELECT objid, eventid, classification, frame_start, frame_end, flux_sign, gaia_id, frame_bin FROM et")
def f19(spark, sf):
    return ordered_columns(event_table(spark, sf), ["objid", "eventid", "classification", "sector", "frame_start", "frame_end", "flux_sign", "gaia_id", "frame_bin"])


@query("F20_tile_calibrators", f"""WITH s AS (SELECT p_partkey AS star, p_size % 7 AS tile, CAST(p_retailprice % 100 AS DOUBLE) / 100e0 AS quality FROM part),
l AS (SELECT *, greatest(0, CAST(ceil((9e-1 - quality) / 5e-2 - 1e-9) AS BIGINT)) AS level FROM s),
c AS (SELECT tile, level, sum(count(*)) OVER (PARTITION BY tile ORDER BY level) AS cum FROM l GROUP BY tile, level),
k AS (SELECT tile, coalesce(min(CASE WHEN cum >= 40 THEN level END), max(level)) AS cut FROM c GROUP BY tile)
SELECT star, CAST(tile AS INTEGER) AS tile, {R('9e-1 - cut * 5e-2')} AS threshold FROM l JOIN k USING (tile) WHERE level <= cut""")
def f20(spark, sf):
    s = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("star"), (F.col("p_size") % 7).alias("tile"), ((F.col("p_retailprice") % 100) / 100).alias("quality"))
    return Fl.calibrators_per_tile(s, ["tile"], "quality", 40, 0.9).select("star", "tile", r6("threshold").alias("threshold"))
