"""Queries: robust statistics and calibration tables."""

from pyspark.sql import functions as F

from skyloom.operators import robust as Rb
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.registry import query


def rounded(df, *cols, n=6):
    return df.withColumns({c: r6(c, n) for c in cols})


def zp_sql(keys, src, zp="zp_ab", name="zs"):
    """SQL of a linear-space median and scaled MAD per key."""
    k = ", ".join(keys)
    return f"""{name}_m AS (SELECT {k}, 25e-1 * log10(median(pow(1e1, 4e-1 * {zp}))) AS zp, count(*) AS n FROM {src} GROUP BY {k}),
{name} AS (SELECT {k}, any_value(zp) AS zp, 14826e-4 * median(abs({zp} - zp)) AS scatter, any_value(n) AS n FROM {src} JOIN {name}_m USING ({k}) GROUP BY {k})"""


def clip_sql(n_iter, src, key, col, k, library=False):
    """SQL of a fixed number of median / population-sigma clips; ``library``: bounds stay and only narrow."""
    out, prev, op = [], f"SELECT {key}, {col} FROM {src}", "=" if library else ""
    for i in range(n_iter):
        lo, hi = f"median({col}) - {k} * stddev_pop({col})", f"median({col}) + {k} * stddev_pop({col})"
        if library and i:
            out.append(f"c{i} AS (SELECT {key}, {lo} AS l, {hi} AS h FROM ({prev}) GROUP BY {key}), b{i} AS (SELECT {key}, greatest(l, lo) AS lo, least(h, hi) AS hi FROM c{i} JOIN b{i - 1} USING ({key}))")
        else:
            out.append(f"b{i} AS (SELECT {key}, {lo} AS lo, {hi} AS hi FROM ({prev}) GROUP BY {key})")
        prev = f"SELECT {src}.{key}, {col} FROM {src} JOIN b{i} USING ({key}) WHERE {col} >{op} lo AND {col} <{op} hi"
    return ", ".join(out), f"b{n_iter - 1}"


_ACLIP, _ALAST = clip_sql(5, "cn", "one", "c", "2e0", library=True)


@query("A5_bad_frames", f"""WITH e AS (SELECT event_id, frame // frame_bin AS frame_max, frame_bin, least(greatest(frame // frame_bin * frame_bin, 0), 1500) AS pf FROM ({D.SOURCES_SQL})),
cn AS (SELECT 1 AS one, pf, CAST(count(*) AS DOUBLE) AS c FROM e GROUP BY pf), {_ACLIP}, st AS (SELECT median(c) AS m, stddev_pop(c) AS sd FROM cn JOIN {_ALAST} USING (one) WHERE c >= lo AND c <= hi)
SELECT event_id, frame_max, frame_bin, CAST(c > m + 2 * sd AS BIGINT) AS bad_frame_flag FROM e JOIN cn USING (pf), st""")
def a5(spark, sf):
    ev = D.sources(spark, sf).select("event_id", F.floor(F.col("frame") / F.col("frame_bin")).alias("frame_max"), "frame_bin")
    return Rb.flag_event_frames(ev, 1500, nsigma=2.0)


@query("A6_weighted_stats", f"""WITH s AS (SELECT objid, snr + 1e0 AS w, x, CASE WHEN event_id % 7 <> 0 THEN y END AS y, flux_sign FROM ({D.SOURCES_SQL})),
m AS (SELECT objid, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM s GROUP BY objid),
v AS (SELECT objid, sum(w * pow(x - mx, 2)) AS vx, sum(w * pow(y - my, 2)) AS vy FROM s JOIN m USING (objid) GROUP BY objid)
SELECT objid, {R('mx')} AS x, CASE WHEN n > 1 THEN {R('vx / sw', 4)} END AS var_x, {R('my')} AS y, CASE WHEN n > 1 THEN {R('vy / sw', 4)} END AS var_y FROM m JOIN v USING (objid)""")
def a6(spark, sf):
    s = D.sources(spark, sf).select("objid", (F.col("snr") + 1).alias("w"), "x", F.when(F.col("event_id") % 7 != 0, F.col("y")).alias("y"))
    out = rounded(Rb.weighted_stats(s, "objid", "w", ["x", "y"]), "x", "y")
    return rounded(out, "var_x", "var_y", n=4)


STACK_SQL = f"""tr AS (SELECT designation, t AS mjd, event_id, flux, e_flux, flux / e_flux / 6e0 AS sig FROM ({D.TRACKS_SQL})),
dc AS (SELECT designation, avg(sig) AS avg_sig, count(*) AS n_frames FROM tr GROUP BY designation),
dd AS (SELECT *, NOT coalesce(avg_sig > 6e0, false) AS stacking_needed, CAST(CASE WHEN avg_sig > 6e0 THEN 1 WHEN avg_sig > 0 AND greatest(ceil(pow(6e0 / avg_sig, 2)), 1) <= n_frames THEN greatest(ceil(pow(6e0 / avg_sig, 2)), 1) END AS BIGINT) AS n_stack FROM dc),
ch AS (SELECT tr.*, n_stack, CAST((row_number() OVER (PARTITION BY designation ORDER BY mjd, event_id) - 1) // n_stack AS BIGINT) AS bin_index FROM tr JOIN dd USING (designation) WHERE stacking_needed AND n_stack IS NOT NULL),
sk AS (SELECT designation, bin_index, avg(mjd) AS mjd, (max(mjd) - min(mjd)) / 2 AS mjd_err, sum(flux / (e_flux * e_flux)) / sum(1e0 / (e_flux * e_flux)) AS flux, 1e0 / sqrt(sum(1e0 / (e_flux * e_flux))) AS e_flux, count(*) AS n_frames FROM ch GROUP BY designation, bin_index)"""


def _stack(spark, sf):
    tr = D.tracks(spark, sf).select("designation", F.col("t").alias("mjd"), "event_id", "flux", "e_flux", (F.col("flux") / F.col("e_flux") / 6).alias("sig"))
    dec = Rb.stack_decision(tr, target=6.0)
    return dec, Rb.stack_tracks(tr, dec, order=("mjd", "event_id"))


@query("A7_stacked_means", f"WITH {STACK_SQL} SELECT designation, bin_index, {R('mjd')} AS mjd, {R('mjd_err')} AS mjd_err, {R('flux')} AS flux, {R('e_flux')} AS e_flux, n_frames FROM sk")
def a7(spark, sf):
    return rounded(_stack(spark, sf)[1].drop("sig"), "mjd", "mjd_err", "flux", "e_flux")


@query("A14_stack_summary", f"""WITH {STACK_SQL}, tp AS (SELECT designation, max(flux / e_flux) AS top FROM sk GROUP BY designation)
SELECT designation, {R('avg_sig')} AS avg_sig, stacking_needed, n_stack, n_frames, {R('CASE WHEN NOT stacking_needed THEN avg_sig ELSE top END')} AS achieved_sig FROM dd LEFT JOIN tp USING (designation)""")
def a14(spark, sf):
    return rounded(Rb.stack_summary(*_stack(spark, sf)), "avg_sig", "achieved_sig")


@query("A8_zeropoint_summary", f"WITH z AS ({D.ZEROPOINTS_SQL}), {zp_sql(['cam', 'ccd'], 'z')} SELECT cam, ccd, {R('zp')} AS zp, {R('scatter')} AS scatter, n FROM zs")
def a8(spark, sf):
    return rounded(Rb.zeropoint_summary(D.zeropoints(spark, sf), ["cam", "ccd"]), "zp", "scatter")


@query("A9_focal_plane_grid", f"""WITH z AS (SELECT *, CASE WHEN cam <= 2 THEN CASE WHEN ccd IN (4, 3) THEN 0 ELSE 1 END ELSE CASE WHEN ccd IN (2, 1) THEN 0 ELSE 1 END END AS i,
CASE WHEN cam <= 2 THEN CASE WHEN ccd IN (4, 1) THEN 0 ELSE 1 END ELSE CASE WHEN ccd IN (2, 3) THEN 0 ELSE 1 END END AS j FROM ({D.ZEROPOINTS_SQL})),
g AS (SELECT CAST(((cam - 1) * 2 + 1 - i) * 4 + CASE WHEN i = 0 THEN 3 - (cut - 1) // 4 ELSE (cut - 1) // 4 END AS BIGINT) AS "row",
 CAST(j * 4 + CASE WHEN i = 0 THEN 3 - (cut - 1) % 4 ELSE (cut - 1) % 4 END AS BIGINT) AS col, zp_ab FROM z), {zp_sql(['"row"', 'col'], 'g')}
SELECT "row", col, {R('zp')} AS zp, {R('scatter')} AS scatter, n FROM zs""")
def a9(spark, sf):
    return rounded(Rb.focal_plane_grid(D.zeropoints(spark, sf), n=4, cut="cut"), "zp", "scatter")


@query("A10_zeropoint_by_sector", f"WITH z AS ({D.ZEROPOINTS_SQL}), {zp_sql(['sector'], 'z')} SELECT sector, {R('zp')} AS zp, {R('scatter')} AS scatter, n FROM zs")
def a10(spark, sf):
    return rounded(Rb.zeropoint_summary(D.zeropoints(spark, sf), ["sector"]), "zp", "scatter")


@query("A11_binned_zeropoint", f"""WITH z AS (SELECT sector, zp_ab, rp, floor(rp / 5e-1) AS b FROM ({D.ZEROPOINTS_SQL})), {zp_sql(['sector', 'b'], 'z', name='bs')}, {zp_sql(['sector'], 'z', name='gl')},
sd AS (SELECT sector, b, stddev_pop(zp_ab) AS sd FROM z GROUP BY sector, b), u AS (SELECT sector, zp, CASE WHEN scatter > 0 THEN scatter ELSE sd END AS s, n FROM bs JOIN sd USING (sector, b)),
k AS (SELECT *, n / (s * s) AS w FROM u WHERE n >= 2 AND s > 0), c AS (SELECT sector, count(*) AS nb, 25e-1 * log10(sum(w * pow(1e1, 4e-1 * zp)) / sum(w)) AS zp, sqrt(1 / sum(w)) AS e, sum(w * s) / sum(w) AS sc FROM k GROUP BY sector)
SELECT gl.sector, {R('CASE WHEN nb >= 2 THEN c.zp ELSE gl.zp END')} AS zp_ab, {R('CASE WHEN nb >= 2 THEN c.e ELSE gl.scatter / sqrt(gl.n) END')} AS e_zp_ab, {R('CASE WHEN nb >= 2 THEN c.sc ELSE gl.scatter END')} AS zp_scatter, gl.n AS n_stars FROM gl LEFT JOIN c ON c.sector = gl.sector""")
def a11(spark, sf):
    return rounded(Rb.binned_zeropoint(D.zeropoints(spark, sf), ["sector"], min_n=2), "zp_ab", "e_zp_ab", "zp_scatter")


_CLIP, _LAST = clip_sql(5, "s", "series", "flux", "15e-1")


@query("A12_sigma_clip", f"WITH s AS (SELECT series, pt, flux FROM ({D.SERIES_SQL})), {_CLIP} SELECT series, pt, flux > lo AND flux < hi AS kept FROM s JOIN {_LAST} USING (series)")
def a12(spark, sf):
    return Rb.sigma_clip(D.series(spark, sf).select("series", "pt", "flux"), ["series"], "flux", 1.5).select("series", "pt", "kept")


@query("A13_sigma_cut_average")
def a13(spark, sf):
    stats, _ = Rb.sigma_cut_average(D.series(spark, sf).select("series", "pt", "flux", "err"), ["series"], "flux", nsigma=1.7)
    return rounded(stats, "mean", "mean_err", "stdev", "stdev_err", "x2norm")


@query("A13_error_cut_average")
def a13e(spark, sf):
    s = D.series(spark, sf).select("series", "pt", "flux", (F.col("err") * 15).alias("err"), (F.col("part") % 8).alias("bits"))
    stats, _ = Rb.sigma_cut_average(s, ["series"], "flux", noise="err", nsigma=2.0, mask="bits", mask_bits=4)
    return rounded(stats, "mean", "mean_err", "stdev", "stdev_err", "x2norm")


@query("A15_cut_offset", """WITH o AS (SELECT s_suppkey % 5 AS unit, s_acctbal / 1000e0 AS dx, s_nationkey / 10e0 AS dy, CAST(s_suppkey % 20 AS DOUBLE) AS sig FROM supplier)
SELECT unit, CASE WHEN count(*) >= 2 THEN round(median(dx), 6) + 0e0 END AS offset_x, CASE WHEN count(*) >= 2 THEN round(median(dy), 6) + 0e0 END AS offset_y, count(*) AS n_tracks_used FROM o WHERE sig >= 8 GROUP BY unit""")
def a15(spark, sf):
    o = D.table(spark, sf, "supplier").select((F.col("s_suppkey") % 5).alias("unit"), (F.col("s_acctbal") / 1000).alias("dx"), (F.col("s_nationkey") / 10).alias("dy"), (F.col("s_suppkey") % 20).alias("achieved_sig"))
    return rounded(Rb.cut_offset(o, ["unit"]), "offset_x", "offset_y")


@query("A16_apparent_magnitude", f"SELECT designation, {R('median(20e0 - 25e-1 * log10(flux))')} AS mag_measured FROM ({D.TRACKS_SQL}) WHERE flux > 0 AND flux / e_flux > 3 GROUP BY designation")
def a16(spark, sf):
    tr = D.tracks(spark, sf).withColumn("sig", F.col("flux") / F.col("e_flux"))
    return rounded(Rb.apparent_magnitude(tr, "designation", F.lit(20.0)), "mag_measured")


@query("A17_frame_noise", f"""WITH p AS ({D.PIXELS_SQL}), m AS (SELECT vec_id, median(v) AS med FROM p GROUP BY vec_id)
SELECT vec_id, {R('14826e-4 * median(abs(v - med))')} AS sigma_bg FROM p JOIN m USING (vec_id) GROUP BY vec_id""")
def a17(spark, sf):
    # A stamp has a fixed number of pixels, so its group is bounded.
    return rounded(Rb.frame_noise(D.pixels(spark, sf), ["vec_id"], "v", largest=64), "sigma_bg")


@query("A18_detection_limits", f"""WITH p AS ({D.PIXELS_SQL}), f AS (SELECT label, vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4 AS BIGINT) AS bin_index FROM (SELECT DISTINCT label, vec_id FROM p)),
k AS (SELECT * FROM f JOIN (SELECT label, bin_index FROM f GROUP BY ALL HAVING count(*) = 4) USING (label, bin_index)),
b AS (SELECT p.label, bin_index, i, avg(v) AS v FROM p JOIN k USING (vec_id) GROUP BY p.label, bin_index, i), m AS (SELECT label, bin_index, median(v) AS med FROM b GROUP BY ALL),
s AS (SELECT label, bin_index, 14826e-4 * median(abs(v - med)) AS sg FROM b JOIN m USING (label, bin_index) GROUP BY label, bin_index)
SELECT '4 frames' AS bin_label, label AS unit, bin_index, {R('sg')} AS sigma_bg, {R('20e0 - 25e-1 * log10(3 * sg * 22e-1)')} AS mag_lim_3sigma, {R('20e0 - 25e-1 * log10(5 * sg * 22e-1)')} AS mag_lim_5sigma, {R('20e0 - 25e-1 * log10(10 * sg * 22e-1)')} AS mag_lim_10sigma FROM s""")
def a18(spark, sf):
    p = D.pixels(spark, sf).withColumnRenamed("label", "unit")
    out = Rb.detection_limits(p, ["unit"], "vec_id", ["i"], "v", 20.0, 2.2, 4, "4 frames").withColumnRenamed("label", "bin_label")
    return rounded(out, "sigma_bg", "mag_lim_3sigma", "mag_lim_5sigma", "mag_lim_10sigma")


RES_SQL = "SELECT p_partkey, p_size % 10 AS tile, (p_retailprice - 1500e0) / 1000e0 AS dx, CAST(p_partkey % 21 - 10 AS DOUBLE) / 7e0 AS dy FROM part"


def _residuals(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 10).alias("tile"), ((F.col("p_retailprice") - 1500) / 1000).alias("dx"), ((F.col("p_partkey") % 21 - 10) / F.lit(7.0)).alias("dy"))


@query("A20_wcs_residuals", f"""SELECT tile, {R('quantile_cont(abs(dx), 68e-2)')} AS dx_68, {R('quantile_cont(abs(dy), 68e-2)')} AS dy_68, {R('median(dx)')} AS dx_med, {R('median(dy)')} AS dy_med FROM ({RES_SQL}) GROUP BY tile""")
def a20(spark, sf):
    return rounded(Rb.wcs_residuals(_residuals(spark, sf), ["tile"], "dx", "dy"), "dx_68", "dy_68", "dx_med", "dy_med")


@query("P21_frame_shift", f"SELECT {R('median(dx)')} AS dx_med, {R('median(dy)')} AS dy_med FROM ({RES_SQL})")
def p21(spark, sf):
    return rounded(Rb.wcs_residuals(_residuals(spark, sf), [], "dx", "dy").select("dx_med", "dy_med"), "dx_med", "dy_med")


@query("A21_snr_error_bins", f"""WITH s AS (SELECT flux, qty / flux AS dx, err / flux AS dy, CAST(floor((log10(flux) - log10(1e0)) / (log10(1000e0) - log10(1e0)) * 10) + 1 AS BIGINT) AS snr_bin FROM ({D.SERIES_SQL}) WHERE flux >= 1e0 AND flux < 1000e0)
SELECT snr_bin, count(*) AS n, {R('exp(avg(ln(flux)))')} AS snr_mid, {R('quantile_cont(abs(dx), 68e-2)')} AS x_68, {R('quantile_cont(abs(dy), 68e-2)')} AS y_68 FROM s GROUP BY snr_bin""")
def a21(spark, sf):
    s = D.series(spark, sf).select("flux", (F.col("qty") / F.col("flux")).alias("dx"), (F.col("err") / F.col("flux")).alias("dy"))
    return rounded(Rb.snr_error_bins(s, "flux", "dx", "dy", 1.0, 1000.0, 10), "snr_mid", "x_68", "y_68")


@query("A22_reference_frame", f"""WITH p AS (SELECT label AS unit, vec_id AS frame, y AS tile, v, vec_id % 16 AS quality FROM ({D.PIXELS_SQL}) WHERE (vec_id % 16) & 8 = 0), m AS (SELECT unit, frame, tile, median(v) AS med FROM p GROUP BY ALL),
q AS (SELECT unit, tile, p, quantile_cont(med, p / 100e0) AS lim FROM (SELECT unit, tile, med, unnest(generate_series(5, 100)) AS p FROM m) GROUP BY unit, tile, p ) , n AS (SELECT m.unit, frame, m.tile, any_value(med) AS med, min(p) FILTER (med <= lim) AS need FROM m JOIN q ON q.unit = m.unit AND q.tile = m.tile GROUP BY m.unit, frame, m.tile),
f AS (SELECT unit, frame, max(need) AS percentile, sum(med) AS s FROM n GROUP BY unit, frame) SELECT unit, frame, CAST(percentile AS INTEGER) AS percentile FROM f QUALIFY row_number() OVER (PARTITION BY unit ORDER BY percentile, s, frame) = 1""".replace("quantile_cont(med, p / 100e0)", "(list_sort(list(med))[1 + CAST(floor((count(*) - 1) * p / 100e0) AS BIGINT)] + (list_sort(list(med))[1 + CAST(ceil((count(*) - 1) * p / 100e0) AS BIGINT)] - list_sort(list(med))[1 + CAST(floor((count(*) - 1) * p / 100e0) AS BIGINT)]) * ((count(*) - 1) * p / 100e0 - floor((count(*) - 1) * p / 100e0)))"))
def a22(spark, sf):
    p = D.pixels(spark, sf).select(F.col("label").alias("unit"), F.col("vec_id").alias("frame"), F.col("y").alias("tile"), F.col("v").alias("value"), (F.col("vec_id") % 16).alias("quality"))
    return Rb.reference_frame(p, ["unit"], quality_bits=8).select("unit", "frame", "percentile")


@query("A23_track_counts", f"WITH {STACK_SQL} SELECT count(DISTINCT designation) AS n_tracks, count(*) FILTER (avg_sig > 2) AS n_detected FROM dc")
def a23(spark, sf):
    dec, _ = _stack(spark, sf)
    return dec.agg(F.count_distinct("designation").alias("n_tracks"), F.count_if(F.col("avg_sig") > 2).alias("n_detected"))


@query("A24_polynomial_fit")
def a24(spark, sf):
    s = D.sources(spark, sf).select((F.col("x") / 128 - 1).alias("u"), (F.col("y") / 128 - 1).alias("v"), "flux")
    s = s.withColumn("target", 3 + 2 * F.col("u") - F.col("v") + 0.5 * F.col("u") * F.col("v") + F.col("flux") / 1000)
    return rounded(Rb.polynomial_fit(s, "u", "v", ["target"], 3), "coefficient")


@query("A24_clipped_polynomial_fit")
def a24c(spark, sf):
    s = D.sources(spark, sf).select((F.col("x") / 128 - 1).alias("u"), (F.col("y") / 128 - 1).alias("v"), "flux")
    s = s.withColumn("target", 3 + 2 * F.col("u") - F.col("v") + F.when(F.col("flux") > 95, F.col("flux")).otherwise(F.col("flux") / 1000))
    return rounded(Rb.clipped_polynomial_fit(s, "u", "v", "target", 1), "coefficient")


# Tiles are the eight mask values; one fit of a plane per tile by centred sums (Cramer's rule).
TILES_SQL = f"t AS (SELECT event_id, source_mask AS tile, x / 128e0 - 1e0 AS u, y / 128e0 - 1e0 AS v, flux FROM ({D.SOURCES_SQL}))"


def plane_sql(name, src):
    return f"""{name}_s AS (SELECT tile, count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(flux) AS mf, regr_sxx(flux, u) AS uu, regr_sxx(flux, v) AS vv, regr_sxy(v, u) AS uv, regr_sxy(flux, u) AS fu, regr_sxy(flux, v) AS fv FROM {src} GROUP BY tile),
{name} AS (SELECT tile, n, mf - cu * mu - cv * mv AS c0, cu, cv FROM (SELECT *, (fu * vv - fv * uv) / (uu * vv - uv * uv) AS cu, (fv * uu - fu * uv) / (uu * vv - uv * uv) AS cv FROM {name}_s))"""


def _tiles(spark, sf):
    return D.sources(spark, sf).select("event_id", F.col("source_mask").alias("tile"), (F.col("x") / 128 - 1).alias("u"), (F.col("y") / 128 - 1).alias("v"), "flux")


def _plane(fits):
    c = lambda i: r6(F.get("flux_c", F.lit(i)))
    return fits.select("tile", "n", c(0).alias("c0"), c(2).alias("cu"), c(1).alias("cv"))


@query("A24_keyed_fits", f"WITH {TILES_SQL}, {plane_sql('a', 't')} SELECT tile, n, {R('c0')} AS c0, {R('cu')} AS cu, {R('cv')} AS cv FROM a")
def a24k(spark, sf):
    return _plane(Rb.keyed_polynomial_fits(_tiles(spark, sf), ["tile"], "u", "v", ["flux"], 1))


@query("A24_keyed_clipped_fits", f"""WITH {TILES_SQL}, {plane_sql('a', 't')}, r AS (SELECT t.*, flux - c0 - cu * u - cv * v AS r FROM t JOIN a USING (tile)), d AS (SELECT tile, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY tile),
k AS (SELECT r.* FROM r JOIN d USING (tile) WHERE NOT abs(r - m) > 15e-1 * s + 1e-12), {plane_sql('b', 'k')} SELECT tile, n, {R('c0')} AS c0, {R('cu')} AS cu, {R('cv')} AS cv FROM b""")
def a24kc(spark, sf):
    """One round of the clip, as in the twin."""
    return _plane(Rb.clipped_keyed_fits(_tiles(spark, sf), ["tile"], "u", "v", ["flux"], 1, nsigma=1.5, rounds=1)[0])
