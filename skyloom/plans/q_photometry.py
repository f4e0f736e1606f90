"""Queries: pixel tables.  The 8x8 stamps are the given vectors, one frame per vector."""

from pyspark.sql import functions as F

from skyloom.operators import lightcurves as L
from skyloom.operators import photometry as P
from skyloom.operators import starfits as S
from skyloom.operators.detection import background_free, detect_sources, segments
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_robust import clip_sql, rounded
from skyloom.plans.registry import query


def _px(spark, sf):
    return D.pixels(spark, sf)


def _pos(spark, sf):
    """One position per stamp, off the border for most."""
    return D.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 8).alias("y"), (F.col("vec_id") * 3 % 8).alias("x"))


POS_SQL = "pos AS (SELECT vec_id, vec_id % 8 AS py, vec_id * 3 % 8 AS px FROM embeddings)"
PX_SQL = f"p AS ({D.PIXELS_SQL})"
_PCLIP, _PLAST = clip_sql(5, "p", "vec_id", "v", "3e0", library=True)


@query("P1_detect_sources")
def p1(spark, sf):
    out = detect_sources(_px(spark, sf), ["vec_id"], mesh=8, tile=8)
    return rounded(out.select("vec_id", "flux_sign", "xint", "yint", "xcentroid", "ycentroid", "flux", "snr", "ellipticity", "neg_extent"), "xcentroid", "ycentroid", "flux", "snr", "ellipticity", "neg_extent")


@query("P1_segments")
def p1s(spark, sf):
    """All connected pixels of every width and sign, before thinning; ``test_p1`` holds them against a flood fill."""
    out = segments(background_free(_px(spark, sf), ["vec_id"], mesh=8), ["vec_id"], tile=8)
    return rounded(out.select("vec_id", "flux_sign", r6("detection_fwhm", 3).alias("detection_fwhm"), "n_pixels", "xcentroid", "ycentroid", "flux", "a", "b"), "xcentroid", "ycentroid", "flux", "a", "b", n=4)


@query("P2_negative_extent", f"""WITH {PX_SQL}, {POS_SQL}, {_PCLIP}, sd AS (SELECT vec_id, stddev_pop(v) AS sd FROM p JOIN {_PLAST} USING (vec_id) WHERE v > lo AND v < hi GROUP BY vec_id),
n AS (SELECT vec_id, CASE WHEN count(*) < 13 THEN least(min(v), 0e0) ELSE min(v) END AS m FROM p JOIN pos USING (vec_id) WHERE pow(y - py, 2) + pow(x - px, 2) <= 4 GROUP BY vec_id)
SELECT vec_id, {R('greatest(0e0, -m) / sd')} AS neg_extent FROM n JOIN sd USING (vec_id)""")
def p2(spark, sf):
    return rounded(P.negative_extent(_pos(spark, sf).withColumn("row", F.col("vec_id")), _px(spark, sf), ["vec_id"], "row").drop("row"), "neg_extent")


@query("P3_brightest_pixel", f"""WITH {PX_SQL}, {POS_SQL} SELECT vec_id, y AS yint_brightest, x AS xint_brightest FROM p JOIN pos USING (vec_id) WHERE abs(y - py) <= 1 AND abs(x - px) <= 1
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, y, x) = 1""")
def p3(spark, sf):
    return P.brightest_pixel(_pos(spark, sf).withColumn("row", F.col("vec_id")), _px(spark, sf), ["vec_id"], "row").drop("row")


@query("P4_mask_lookup", f"""WITH {POS_SQL} SELECT vec_id, py AS y, px AS x, CAST(CASE WHEN (py * 8 + px) % 3 = 0 THEN (py + px) % 8 ELSE 0 END AS BIGINT) AS source_mask FROM pos WHERE px > 1 AND px < 7 AND py > 1 AND py < 7""")
def p4(spark, sf):
    # The mask is a small image derived from the stamps' pixel grid.
    grid = _px(spark, sf).select("y", "x").distinct().filter((F.col("y") * 8 + F.col("x")) % 3 == 0).withColumn("source_mask", (F.col("y") + F.col("x")) % 8)
    return P.mask_lookup(_pos(spark, sf), grid, [], 1, (8, 8)).select("vec_id", "y", "x", "source_mask")


LAB_POS = "lp AS (SELECT DISTINCT CAST(label AS BIGINT) AS label, CAST(2 + label % 4 AS BIGINT) AS py, CAST(2 + label % 3 AS BIGINT) AS px FROM embeddings)"


def _label_pos(spark, sf):
    lab = F.col("label").cast("long")
    return D.table(spark, sf, "embeddings").select(lab.alias("label"), (2 + lab % 4).alias("y"), (2 + lab % 3).alias("x")).distinct().withColumn("star", F.col("label"))


@query("P5_box_light_curve", f"""WITH {PX_SQL}, {LAB_POS}, m AS (SELECT vec_id, median(v) AS med FROM p GROUP BY vec_id), d AS (SELECT vec_id, 3e0 * 14826e-4 * median(abs(v - med)) AS e FROM p JOIN m USING (vec_id) GROUP BY vec_id),
f AS (SELECT p.label, vec_id AS frame, sum(v) AS flux FROM p JOIN lp ON p.label = lp.label AND abs(y - py) <= 1 AND abs(x - px) <= 1 GROUP BY p.label, vec_id)
SELECT label, frame, {R('flux')} AS flux, {R('e')} AS flux_err FROM f JOIN d ON d.vec_id = frame""")
def p5(spark, sf):
    px = _px(spark, sf).withColumnRenamed("vec_id", "frame").drop("i")
    return rounded(P.box_light_curve(_label_pos(spark, sf), px, ["label"], "star").drop("star"), "flux", "flux_err")


@query("P6_box_error", f"""WITH {PX_SQL}, m AS (SELECT label, median(v) AS med FROM p GROUP BY label) SELECT label, {R('3e0 * 14826e-4 * median(abs(v - med))')} AS flux_err FROM p JOIN m USING (label) GROUP BY label""")
def p6(spark, sf):
    mm = P.median_mad(_px(spark, sf), ["label"], "v")
    return mm.select("label", r6(3.0 * P.MAD_TO_SIGMA * F.col("mad")).alias("flux_err"))


@query("P7_moving_aperture", f"""WITH {PX_SQL}, c AS (SELECT vec_id, vec_id % 8 + 25e-2 AS py, vec_id * 3 % 8 - 25e-2 AS px FROM embeddings), {clip_sql(5, 'p', 'vec_id', 'v', '5e0', library=True)[0]},
k AS (SELECT p.*, v > lo AND v < hi AS kept FROM p JOIN b4 USING (vec_id)), d AS (SELECT k.*, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS d FROM k JOIN c USING (vec_id)),
s AS (SELECT vec_id, sum(v) FILTER (d <= 15e-1) AS su, count(*) FILTER (d <= 15e-1) AS npix, avg(v) FILTER (d > 6 AND d <= 10 AND kept) AS sky, stddev_pop(v) FILTER (d > 6 AND d <= 10 AND kept) AS sky_std FROM d GROUP BY vec_id)
SELECT vec_id, npix, {R('su - npix * coalesce(sky, 0e0)')} AS flux, {R('sky_std')} AS sky_std, CASE WHEN sky_std > 0 THEN {R('(su - npix * coalesce(sky, 0e0)) / (sqrt(npix) * sky_std)', 4)} END AS sig FROM s""")
def p7(spark, sf):
    pos = D.table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("row"), (F.col("vec_id") % 8 + F.lit(0.25)).alias("py"), (F.col("vec_id") * 3 % 8 - F.lit(0.25)).alias("px"))
    out = P.moving_aperture(pos, _px(spark, sf), ["vec_id"], "row").select("vec_id", "npix", "flux", "sky_std", "sig")
    return rounded(rounded(out, "flux", "sky_std"), "sig", n=4)


PRF_SQL = "f AS (SELECT label, i, avg(v) AS p FROM p GROUP BY label, i)"


def _prf(spark, sf):
    return _px(spark, sf).groupBy("label", "i").agg(F.avg("v").alias("p"))


@query("P8_forced_psf", f"""WITH {PX_SQL}, {PRF_SQL}, j AS (SELECT vec_id, p.label, i, v, f.p FROM p JOIN f USING (label, i)), r AS (SELECT vec_id, regr_slope(v, p) AS flux, regr_intercept(v, p) AS bg, regr_sxx(v, p) AS sxx FROM j GROUP BY vec_id),
q AS (SELECT vec_id, v - flux * p - bg AS res FROM j JOIN r USING (vec_id)), m AS (SELECT vec_id, median(res) AS med FROM q GROUP BY vec_id), d AS (SELECT vec_id, median(abs(res - med)) AS mad FROM q JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, {R('flux')} AS flux, {R('bg')} AS background, {R('14826e-4 * mad / sqrt(sxx)')} AS e_flux, {R('flux / (14826e-4 * mad / sqrt(sxx))', 4)} AS sig FROM r JOIN d USING (vec_id)""")
def p8(spark, sf):
    out = P.forced_psf(_px(spark, sf).select("vec_id", "label", "i", "v"), _prf(spark, sf), ["vec_id"], ["label"], ["i"])
    return rounded(rounded(out, "flux", "background", "e_flux"), "sig", n=4)


@query("P8_scene_photometry")
def p8s(spark, sf):
    j = _px(spark, sf).join(_prf(spark, sf), ["label", "i"]).withColumn("q", F.col("x") + F.lit(0.0))
    return rounded(P.scene_photometry(j, ["vec_id"], "v", ["p", "q"]), "flux_p", "flux_q", "background", "rms")


@query("P9_aperture_fraction", f"""WITH {PX_SQL}, {PRF_SQL}, g AS (SELECT label, abs(p) AS p, i // 8 AS y, i % 8 AS x FROM f), s AS (SELECT label, sum(p) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) / sum(p) AS fr FROM g GROUP BY label)
SELECT label, {R('fr')} AS fraction, {R('25e-1 * log10(fr)')} AS zp_shift FROM s""")
def p9(spark, sf):
    f = _prf(spark, sf).select("label", F.abs("p").alias("p"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"))
    return rounded(P.aperture_fraction(f, ["label"], F.col("y").between(2, 5) & F.col("x").between(2, 5)), "fraction", "zp_shift")


@query("P10_pixel_phase_detrend")
def p10(spark, sf):
    t = D.tracks(spark, sf).select("event_id", "designation", "x", "y", "flux", "e_flux")
    return rounded(P.pixel_phase_detrend(t, "designation").select("event_id", "flux_detrended", "sig_detrended"), "flux_detrended", "sig_detrended", n=4)


@query("P11_stack_centroid")
def p11(spark, sf):
    st = _px(spark, sf).select("label", F.col("vec_id").alias("frame"), (F.col("y") - 4).alias("dy"), (F.col("x") - 4).alias("dx"), F.abs("v").alias("v"), ((F.col("vec_id") % 10) / F.lit(10.0)).alias("sx"), ((F.col("vec_id") % 7) / F.lit(7.0)).alias("sy"))
    return rounded(P.stack_centroid(st, ["label"], "frame", 4), "dx", "dy")


@query("P12_stack_or_frame")
def p12(spark, sf):
    st = _px(spark, sf).select("label", F.col("vec_id").alias("frame"), "y", "x", "v")
    return rounded(P.stack_or_frame(st, ["label"], "frame", F.col("y").between(3, 5) & F.col("x").between(3, 5)), "snr_psf")


@query("P12_psf_likeness", f"""WITH {PX_SQL}, s AS (SELECT vec_id, i, abs(v) + 1e-1 AS v FROM p), {PRF_SQL.replace('avg(v)', 'avg(abs(v) + 1e-1)')}, n AS (SELECT label, i, f.p / sum(f.p) OVER (PARTITION BY label) AS p FROM f), t AS (SELECT vec_id, sum(v) AS tot FROM s GROUP BY vec_id),
g AS (SELECT vec_id, label, sum(pow(v / tot - n.p, 2)) AS residual, corr(v, n.p) AS psf_like, sum(abs(v / tot - n.p)) AS psf_diff FROM s JOIN t USING (vec_id) JOIN n USING (i) GROUP BY vec_id, label)
SELECT vec_id, label, {R('residual', 8)} AS residual, {R('psf_like')} AS psf_like, {R('psf_diff')} AS psf_diff FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY residual, label) = 1""")
def p12b(spark, sf):
    s = _px(spark, sf).select("vec_id", "i", (F.abs("v") + 0.1).alias("v"))
    f = _px(spark, sf).groupBy("label", "i").agg(F.avg(F.abs("v") + 0.1).alias("p"))
    tot = f.groupBy("label").agg(F.sum("p").alias("t"))
    models = f.join(tot, "label").select("label", "i", (F.col("p") / F.col("t")).alias("p"))
    return rounded(rounded(P.psf_likeness(s, models, ["vec_id"], ["i"], "label"), "psf_like", "psf_diff"), "residual", n=8)


@query("A19_local_noise", f"""WITH {PX_SQL}, {POS_SQL}, o AS (SELECT a.dy, b.dx FROM (SELECT unnest(generate_series(-11, 11)) AS dy) a, (SELECT unnest(generate_series(-11, 11)) AS dx) b WHERE a.dy * a.dy + b.dx * b.dx > 4),
q AS (SELECT vec_id, greatest(0, least(7, py + dy)) AS y, greatest(0, least(7, px + dx)) AS x FROM pos, o) SELECT vec_id, {R('stddev_pop(v)')} AS bkg_std FROM q JOIN p USING (vec_id, y, x) GROUP BY vec_id""")
def a19(spark, sf):
    return rounded(P.local_noise(_pos(spark, sf).withColumn("row", F.col("vec_id")), _px(spark, sf), ["vec_id"], "row", (8, 8)).drop("row"), "bkg_std")


@query("S14_unit_resolution", f"""WITH s AS (SELECT series, pt, flux, err FROM ({D.SERIES_SQL})), z AS (SELECT star AS series, zp_ab FROM ({D.ZEROPOINTS_SQL}) WHERE zp_ab >= 20e0)
SELECT s.series, pt, {R('CASE WHEN zp_ab IS NULL THEN flux ELSE flux * 3631e0 * pow(1e1, -4e-1 * zp_ab) * 1e3 END', 8)} AS flux, CASE WHEN zp_ab IS NULL THEN 'counts' ELSE 'mJy' END AS units FROM s LEFT JOIN z USING (series)""")
def s14(spark, sf):
    s = D.series(spark, sf).select("series", "pt", "flux", F.col("err").alias("flux_err"))
    z = D.zeropoints(spark, sf).filter("zp_ab >= 20").select(F.col("star").alias("series"), "zp_ab")
    return rounded(P.resolve_units(s, z, ["series"], "mJy").select("series", "pt", "flux", "units"), "flux", n=8)


@query("P18_calibration_zeropoint")
def p18(spark, sf):
    st = D.series(spark, sf).select((F.col("series") % 10).alias("unit"), (F.col("flux") * 100).alias("flux"), "err", (20 - 2.5 * F.log10(F.col("flux") * 100) + (F.col("part") % 7) / 50).alias("mag")).withColumn("e_flux", F.col("err") * 10)
    return rounded(P.calibration_zeropoint(st, ["unit"], "mag"), "zp_ab", "e_zp_ab", "zp_scatter")


# One star per stamp, near its centre; its neighbour lies 1.8 pixels below.
_PLACE = {"y": "3 + (vec_id % 4) * 3e-1", "x": "3 + (vec_id % 3) * 35e-2"}
STAR_SQL = f"""{PX_SQL}, st AS (SELECT vec_id, y, x, round(y) AS cy, round(x) AS cx FROM (SELECT vec_id, {_PLACE['y']} AS y, {_PLACE['x']} AS x FROM embeddings)),
sp AS (SELECT vec_id, p.y - cy AS dy, p.x - cx AS dx, v, st.y - cy AS sy, st.x - cx AS sx FROM p JOIN st USING (vec_id) WHERE abs(p.y - cy) <= 2 AND abs(p.x - cx) <= 2)"""


def _star_stamps(spark, sf):
    st = D.table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("star"), F.expr(_PLACE["y"]).alias("y"), F.expr(_PLACE["x"]).alias("x"), F.lit(12.0).alias("mag"))
    return S.star_stamps(st, _px(spark, sf), ["vec_id"], stamp=5)


@query("P18_star_fits", f"""WITH {STAR_SQL}, k AS (SELECT a.a / 4e0 AS a, b.b / 4e0 AS b FROM (SELECT unnest(generate_series(-2, 2)) AS a) a, (SELECT unnest(generate_series(-2, 2)) AS b) b),
g AS (SELECT vec_id, a, b, v, exp(-0.5 * (pow(dy - sy - a, 2) + pow(dx - sx - b, 2))) AS g FROM sp, k), m AS (SELECT vec_id, a, b, v, g / sum(g) OVER (PARTITION BY vec_id, a, b) AS g FROM g),
f AS (SELECT vec_id, a, b, regr_syy(v, g) - pow(regr_sxy(v, g), 2) / regr_sxx(v, g) AS loss, regr_slope(v, g) AS flux, regr_intercept(v, g) AS bg, regr_sxx(v, g) AS sxx FROM m GROUP BY vec_id, a, b),
w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY loss, a, b) = 1)
SELECT vec_id, {R('a')} AS dy_fit, {R('b')} AS dx_fit, {R('flux')} AS flux, {R('sqrt(loss / 21e0 / sxx)')} AS e_flux, {R('bg')} AS background FROM w WHERE flux > 0""")
def p18f(spark, sf):
    """One round of shifts, as in the twin; the operator's default refines them further."""
    at = S.locate(_star_stamps(spark, sf), L.gaussian_profile(1.0), F.lit(0.5), F.lit(0.5), 5, rounds=1, polish=False)
    out = S.fit_fluxes(at, L.gaussian_profile(1.0), 5).select("vec_id", "dy_fit", "dx_fit", F.col("flux_psf").alias("flux"), F.col("e_flux_psf").alias("e_flux"), "background")
    return rounded(out, "dy_fit", "dx_fit", "flux", "e_flux", "background")


@query("P18_scene_fits", f"""WITH {STAR_SQL}, g AS (SELECT vec_id, v, exp(-0.5 * (pow(dy - sy, 2) + pow(dx - sx, 2))) AS g, exp(-0.5 * (pow(dy - sy - 18e-1, 2) + pow(dx - sx, 2))) AS h FROM sp),
m AS (SELECT vec_id, v, g / sum(g) OVER (PARTITION BY vec_id) AS p, h / sum(h) OVER (PARTITION BY vec_id) AS q FROM g),
c AS (SELECT vec_id, regr_sxx(v, p) AS pp, regr_sxx(v, q) AS qq, regr_sxy(q, p) AS pq, regr_sxy(v, p) AS pv, regr_sxy(v, q) AS qv, regr_syy(v, p) AS vv, avg(v) AS mv, avg(p) AS mp, avg(q) AS mq FROM m GROUP BY vec_id),
r AS (SELECT *, (pv * qq - qv * pq) / (pp * qq - pq * pq) AS flux, (qv * pp - pv * pq) / (pp * qq - pq * pq) AS other FROM c)
SELECT vec_id, CAST(2 AS BIGINT) AS n_scene, {R('flux')} AS flux, {R('sqrt((vv - flux * pv - other * qv) / 22e0 * qq / (pp * qq - pq * pq))')} AS e_flux, {R('mv - flux * mp - other * mq')} AS background FROM r WHERE flux > 0""")
def p18s(spark, sf):
    st = _star_stamps(spark, sf)
    near = st.select("vec_id", (F.col("y") + 1.8).alias("y"), "x", F.lit(13.0).alias("mag"))
    scene = S.with_scene(st, near, ["vec_id"], stamp=5).withColumns({"dy_fit": F.lit(0.0), "dx_fit": F.lit(0.0)})
    out = S.fit_fluxes(scene, L.gaussian_profile(1.0), 5).select("vec_id", "n_scene", F.col("flux_psf").alias("flux"), F.col("e_flux_psf").alias("e_flux"), "background")
    return rounded(out, "flux", "e_flux", "background")


@query("P22_event_light_curves", f"""WITH {PX_SQL}, {LAB_POS}, b AS (SELECT p.label, vec_id // 5 AS bin, y, x, avg(v) AS v FROM p GROUP BY p.label, vec_id // 5, y, x)
SELECT b.label, bin, {R('sum(v) * 3631e0 * pow(1e1, -4e-1 * 20e0) * 1e6')} AS flux FROM b JOIN lp ON b.label = lp.label AND abs(y - py) <= 1 AND abs(x - px) <= 1 GROUP BY b.label, bin""")
def p22(spark, sf):
    binned = _px(spark, sf).groupBy("label", F.floor(F.col("vec_id") / 5).alias("frame"), "y", "x").agg(F.avg("v").alias("v"))
    lc = P.box_light_curve(_label_pos(spark, sf), binned, ["label"], "star")
    zp = _label_pos(spark, sf).select("label", F.lit(20.0).alias("zp_ab"))
    return P.resolve_units(lc, zp, ["label"], "muJy").select("label", F.col("frame").alias("bin"), r6("flux").alias("flux"))


# Events of a unit: its frames in blocks of fifty vectors, at a sub-pixel position of the unit.
CURVES_SQL = f"""{PX_SQL}, fr AS (SELECT CAST(label AS BIGINT) AS label, vec_id AS frame, vec_id / 48e0 + 6e4 AS mjd FROM embeddings),
ev AS (SELECT label, frame // 50 AS eventid, min(frame) AS s, max(frame) AS e, 3e0 + (label % 4) * 3e-1 AS y, 3e0 + (label % 3) * 35e-2 AS x FROM fr GROUP BY label, frame // 50),
wi AS (SELECT ev.label, eventid, frame, mjd FROM ev JOIN fr ON ev.label = fr.label AND frame BETWEEN s - 10 AND e + 11)"""
DESIGN_SQL = """o AS (SELECT CAST(a.dy AS DOUBLE) AS dy, CAST(b.dx AS DOUBLE) AS dx FROM (SELECT unnest(generate_series(-2, 2)) AS dy) a, (SELECT unnest(generate_series(-2, 2)) AS dx) b),
ob AS (SELECT DISTINCT label, y, x, round(y) AS cy, round(x) AS cx FROM ev), g AS (SELECT label, cy + dy AS py, cx + dx AS px, dy, dx, exp(-0.5 * (pow(cy + dy - y, 2) + pow(cx + dx - x, 2))) AS g FROM ob, o),
de AS (SELECT label, CAST(py AS BIGINT) AS py, CAST(px AS BIGINT) AS px, g / sum(g) OVER (PARTITION BY label) AS g, dy, dx FROM g),
fi AS (SELECT p.label, vec_id AS frame, regr_slope(v, g) AS flux, regr_intercept(v, g) AS bg, regr_sxx(v, g) AS sxx FROM p JOIN de ON p.label = de.label AND p.y = py AND p.x = px GROUP BY p.label, vec_id),
re AS (SELECT p.label, frame, v - flux * g - bg AS r FROM p JOIN de ON p.label = de.label AND p.y = py AND p.x = px JOIN fi ON fi.frame = vec_id), rm AS (SELECT frame, median(r) AS m FROM re GROUP BY frame),
er AS (SELECT re.frame, median(abs(r - m)) AS mad FROM re JOIN rm USING (frame) GROUP BY re.frame), fe AS (SELECT fi.*, 14826e-4 * mad / sqrt(sxx) AS e FROM fi JOIN er USING (frame))"""


def _curves(spark, sf):
    emb = D.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("frame"))
    frames = emb.withColumn("mjd", F.col("frame") / F.lit(48.0) + 60000)
    ev = emb.groupBy("label", F.floor(F.col("frame") / 50).alias("eventid")).agg(F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))
    ev = ev.withColumns({"objid": F.col("label"), "y": 3 + (F.col("label") % 4) * F.lit(0.3), "x": 3 + (F.col("label") % 3) * F.lit(0.35)})
    zp = emb.select("label").distinct().select("label", (20 + F.col("label") / 10).alias("zp_ab"))
    return ev, frames, _px(spark, sf).withColumnRenamed("vec_id", "frame"), zp


@query("P22_profile_event_curves", f"""WITH {CURVES_SQL}, {DESIGN_SQL} SELECT wi.label, eventid, wi.frame, {R('mjd')} AS mjd, {R('flux')} AS flux, {R('e')} AS flux_err, {R('bg')} AS background FROM wi JOIN fe ON wi.frame = fe.frame""")
def p22p(spark, sf):
    ev, frames, px, _ = _curves(spark, sf)
    out = L.profile_light_curves(ev, frames, px, ["label"], L.gaussian_profile(1.0), stamp=5, size=(8, 8))
    return rounded(out.select("label", "eventid", "frame", "mjd", "flux", "flux_err", "background"), "mjd", "flux", "flux_err", "background")


@query("P22_profile_object_curves", f"""WITH {CURVES_SQL}, {DESIGN_SQL}, z AS (SELECT *, 20e0 + label / 1e1 AS zp FROM fe) SELECT label, frame, {R('zp - 25e-1 * log10(CASE WHEN flux > e THEN flux ELSE e END)')} AS mag, CASE WHEN flux > e THEN {R('25e-1 * log10(1e0 + e / flux)')} END AS mag_err, 'mag' AS units FROM z""")
def p22o(spark, sf):
    ev, frames, px, zp = _curves(spark, sf)
    out = L.light_curves(ev.select("label", "objid", "y", "x").distinct(), frames, px, ["label"], "psf", "mag", zp, L.gaussian_profile(1.0), ids=["objid"], buffer=None, stamp=5)
    return out.select("label", "frame", r6("flux").alias("mag"), r6("flux_err").alias("mag_err"), "units")


@query("P22_box_event_curves", f"""WITH {CURVES_SQL}, {DESIGN_SQL}, fr2 AS (SELECT label, sum(g) FILTER (abs(dy) <= 1 AND abs(dx) <= 1) / sum(g) AS share FROM de GROUP BY label), bo AS (SELECT DISTINCT label, floor(y + 5e-1) AS cy, floor(x + 5e-1) AS cx FROM ev),
fl AS (SELECT p.label, vec_id AS frame, sum(v) AS flux FROM p JOIN bo ON p.label = bo.label AND abs(y - cy) <= 1 AND abs(x - cx) <= 1 GROUP BY p.label, vec_id), md AS (SELECT vec_id, median(v) AS m FROM p GROUP BY vec_id), no AS (SELECT p.vec_id AS frame, 3e0 * 14826e-4 * median(abs(v - m)) AS e FROM p JOIN md USING (vec_id) GROUP BY p.vec_id),
k AS (SELECT label, 3631e0 * 1e3 * pow(1e1, -4e-1 * (20e0 + label / 1e1 + 25e-1 * log10(share))) AS k FROM fr2)
SELECT wi.label, eventid, wi.frame, {R('flux * k')} AS flux, {R('e * k')} AS flux_err, 'mJy' AS units FROM wi JOIN fl ON wi.frame = fl.frame JOIN no ON wi.frame = no.frame JOIN k ON wi.label = k.label""")
def p22b(spark, sf):
    ev, frames, px, zp = _curves(spark, sf)
    out = L.light_curves(ev, frames, px, ["label"], "aperture", "mJy", zp, L.gaussian_profile(1.0), stamp=5)
    return rounded(out.select("label", "eventid", "frame", "flux", "flux_err", "units"), "flux", "flux_err")


@query("P23_calibrator_centroids")
def p23(spark, sf):
    s = _px(spark, sf).select("vec_id", "y", "x", (F.abs("v") + 0.1).alias("v"))
    peak = P.brightest_pixel(D.table(spark, sf, "embeddings").select("vec_id", F.lit(4).cast("long").alias("y"), F.lit(4).cast("long").alias("x"), F.col("vec_id").alias("row")), s, ["vec_id"], "row")
    stamps = P.stamp_pixels(peak.select("vec_id", "row", F.col("yint_brightest").alias("y"), F.col("xint_brightest").alias("x")), s, ["vec_id"], P.offsets(2, square=True), "row")
    steps = [-0.4, -0.2, 0.0, 0.2, 0.4]
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("sy"), F.lit(b).alias("sx")) for a in steps for b in steps]))
    grid = stamps.select("dy", "dx").distinct().withColumn("shift", shifts)
    g = grid.withColumn("g", F.exp(-0.5 * ((F.col("dy") - F.col("shift.sy")) ** 2 + (F.col("dx") - F.col("shift.sx")) ** 2) / 0.8))
    tot = g.groupBy("shift").agg(F.sum("g").alias("t"))
    models = g.join(tot, "shift").select("dy", "dx", "shift", (F.col("g") / F.col("t")).alias("p"))
    best = P.psf_likeness(stamps.select("vec_id", "dy", "dx", "v"), models, ["vec_id"], ["dy", "dx"], "shift").join(peak.drop("row"), "vec_id")
    return best.select("vec_id", (F.col("xint_brightest") + F.col("shift.sx")).alias("x_psf"), (F.col("yint_brightest") + F.col("shift.sy")).alias("y_psf"), r6("psf_like").alias("psf_like"))
