"""Operators against literal numpy versions and planted answers."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions import angles, photometry, timecode, wcs
from skyloom.operators import dedupe, detection, events, features, filters, fits, robust, series, starfits, tracks
from skyloom.operators import lightcurves
from skyloom.operators import photometry as phot
from skyloom.operators.catalog import recovery_match
from skyloom.sources import tables, text
from skyloom.streaming import operators as stream


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_w1_gap_equal_to_limit_merges_and_signs_continue(spark):
    df = frame(spark, row=range(6), objid=[1] * 6, frame=[0, 5, 11, 3, 40, 5], flux_sign=[1, 1, 1, -1, -1, 1])
    got = events.temporal_events(df, 5).orderBy("row").toPandas()["eventid"].tolist()
    assert got == [1, 1, 2, 3, 4, 1]


def test_w1_empty_and_chunked_runs_agree(spark):
    empty = frame(spark, objid=[1], frame=[1], flux_sign=[1]).filter("objid = 9")
    assert events.temporal_events(empty, 5).count() == 0
    rng = np.random.default_rng(2)
    df = frame(spark, k=[1] * 200, frame=rng.choice(2000, 200, replace=False))
    from skyloom.operators.skew import island_ids

    runs = [island_ids(df, ["k"], ["frame"], F.col("frame") - F.col("_p") > 12, {"_p": "frame"}, "run", chunk_rows=c).orderBy("frame").toPandas()["run"].tolist() for c in (9, 10**6)]
    assert runs[0] == runs[1]


def _walk(sig, start, end, limit=3.0, misses=5):
    hits = set(np.flatnonzero(sig >= limit))
    out = []
    for step, pos in ((-1, start - 1), (1, end + 1)):
        edge, count = (start, 0) if step < 0 else (end, 0)
        while count < misses:
            if pos in hits:
                edge = pos
            else:
                count += 1
            pos += step
        out.append(edge)
    return tuple(out)


def test_w3_equals_the_literal_walk(spark):
    rng = np.random.default_rng(4)
    lcs, evs, want = [], [], {}
    for s in range(40):
        n = int(rng.integers(20, 60))
        sig = rng.uniform(0, 5, n)
        a = int(rng.integers(0, n - 3))
        b = a + int(rng.integers(0, 3))
        lcs += [(s, i, float(v)) for i, v in enumerate(sig)]
        evs.append((s, 1, a, b))
        want[s] = _walk(sig, a, b)
    lc = spark.createDataFrame(lcs, "s long, frame long, sig double")
    ev = spark.createDataFrame(evs, "s long, eventid long, frame_start long, frame_end long")
    got = {r["s"]: (r["new_start"], r["new_end"]) for r in series.extend_events(ev, lc, ["s"]).collect()}
    assert got == want


def test_a6_single_row_has_null_variance(spark):
    df = frame(spark, k=[1, 2, 2], w=[1.0, 1.0, 3.0], x=[5.0, 0.0, 4.0])
    got = robust.weighted_stats(df, "k", "w", ["x"]).orderBy("k").collect()
    assert got[0]["x"] == 5.0 and got[0]["var_x"] is None
    assert got[1]["x"] == 3.0 and got[1]["var_x"] == pytest.approx(3.0)


def _sigmacut(x, nsigma=3.0, itmax=10):
    c4 = [None, None, 0.7978845608028654, 0.8862269254527579, 0.9213177319235613, 0.9399856029866251, 0.9515328619481445]
    good, mean, std, conv = np.ones(len(x), bool), None, None, False
    for i in range(itmax):
        new = np.ones(len(x), bool) if mean is None else np.abs(x - mean) <= nsigma * std
        changed = int((new != good).sum()) if mean is not None else 0
        good = new
        n = good.sum()
        if i == 0:
            mean = np.median(x[good])
            corr = c4[n] if n <= 6 else 1 - 1 / (4 * n) - 7 / (32 * n * n) - 19 / (128 * n**3)
            std = math.sqrt(((x[good] - mean) ** 2).sum() / (n - 1)) / corr
        else:
            mean, std = x[good].mean(), x[good].std(ddof=1)
            if changed == 0:
                conv = True
                break
    return mean, std, int(n), conv


def test_a13_equals_the_literal_loop(spark):
    rng = np.random.default_rng(8)
    pdf = pd.concat([pd.DataFrame({"k": k, "x": np.r_[rng.normal(k, 1, 60), rng.normal(k + 15, 3, 5)]}) for k in range(4)])
    stats, rows = robust.sigma_cut_average(spark.createDataFrame(pdf), ["k"], "x", nsigma=2.5)
    got = stats.toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        mean, std, n, conv = _sigmacut(g["x"].to_numpy(), 2.5)
        assert got.loc[k, "mean"] == pytest.approx(mean) and got.loc[k, "stdev"] == pytest.approx(std)
        assert got.loc[k, "n_good"] == n and bool(got.loc[k, "converged"]) == conv
    assert rows.groupBy("k").agg(F.count_if("good").alias("n")).toPandas().set_index("k")["n"].to_dict() == got["n_good"].to_dict()


def test_a24_recovers_a_surface(spark):
    rng = np.random.default_rng(0)
    u, v = rng.uniform(-1, 1, (2, 500))
    df = frame(spark, u=u, v=v, t=1 + 2 * u - 3 * v + 0.5 * u * v + 4 * v**2)
    got = {(r["p"], r["q"]): r["coefficient"] for r in robust.polynomial_fit(df, "u", "v", ["t"], 2).collect()}
    want = {(0, 0): 1, (1, 0): 2, (0, 1): -3, (1, 1): 0.5, (0, 2): 4, (2, 0): 0}
    assert all(got[k] == pytest.approx(w, abs=1e-9) for k, w in want.items())


def test_a24_keyed_fits_equal_single_fits_and_clip_per_key(spark):
    rng = np.random.default_rng(3)
    terms = robust.polynomial_terms(3)
    parts, want = [], {}
    for key, n, off in (("a", 400, 0.0), ("b", 300, 5000.0), ("c", 4, 0.0)):
        x, y = off + rng.uniform(0, 40, n), off + rng.uniform(0, 40, n)
        s = x - y + 0.01 * x * y / (1 + off) + rng.normal(0, 0.1, n)
        if key == "b":
            s[:5] += 80
        parts.append(pd.DataFrame({"tile": key, "x": x, "y": y, "s": s, "t": 2 * s + 1}))
    df = pd.concat(parts)
    df.loc[len(df)] = ["b", None, 1.0, 2.0, 3.0]
    rows = spark.createDataFrame(df)
    fits_, kept = robust.clipped_keyed_fits(rows, ["tile"], "x", "y", ["s", "t"], 3)
    got, flags = {r["tile"]: r for r in fits_.collect()}, kept.toPandas()
    assert got["c"]["s_c"] is None and got["c"]["n"] == 4 and len(flags) == len(df)
    for key in ("a", "b"):
        d = flags[flags.tile == key]
        use = d.x.notna() & d.y.notna()
        for _ in range(21):
            a = np.column_stack([((d.x - d.x.mean()) / 20) ** p * ((d.y - d.y.mean()) / 20) ** q for p, q in terms])
            a_, far = a[use], pd.Series(False, index=d.index)
            for c in ("s", "t"):
                r = d[c] - a @ np.linalg.lstsq(a_, d[c][use], rcond=None)[0]
                far |= (r - r[use].mean()).abs() > 3 * r[use].std(ddof=0) + 1e-12
            if not (far & use).any():
                break
            use &= ~far
        assert (d.kept == use).all() and (key == "a" or (~use).sum() >= 6)
        model = sum(c * d.x[use] ** p * d.y[use] ** q for c, (p, q) in zip(got[key]["s_c"], terms))
        np.testing.assert_allclose(model, a[use] @ np.linalg.lstsq(a[use], d.s[use], rcond=None)[0], atol=2e-3)
    held = robust.keyed_polynomial_fits(rows.filter("tile = 'a'"), ["tile"], "x", "y", ["s"], 1, fixed={(0, 0): 0.0, (1, 0): 1.0}).first()["s_c"]
    y, s = parts[0].y, parts[0].s - parts[0].x
    np.testing.assert_allclose(held, [0.0, (y * s).sum() / (y * y).sum(), 1.0], rtol=1e-9)
    assert robust.keyed_polynomial_fits(rows.limit(0), ["tile"], "x", "y", ["s"], 1).count() == 0


def test_g2_equals_sequential_greedy(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 12, (250, 2))
    x[:80] = x[0] + rng.normal(0, 0.3, (80, 2))
    flux = rng.permutation(250).astype(float)
    got = set(dedupe.dedupe_close(frame(spark, id=range(250), x=x[:, 0], y=x[:, 1], f=flux), "id", ["x", "y"], "f", 1.0).toPandas()["id"])
    kept = []
    for i in np.argsort(-flux):
        if all(np.hypot(*(x[i] - x[j])) > 1.0 for j in kept):
            kept.append(int(i))
    assert got == set(kept)


def test_g2_settles_a_long_chain(spark):
    n = 450
    chain = frame(spark, id=range(n), x=[0.8 * k for k in range(n)], y=[0.0] * n, f=[float(n - k) for k in range(n)])
    assert sorted(r["id"] for r in dedupe.dedupe_close(chain, "id", ["x", "y"], "f", 1.0).collect()) == list(range(0, n, 2))


def test_g5_ids_flow_from_fine_to_coarse(spark):
    ev = spark.createDataFrame(
        [(10, 1, 0, 3, "-", 1, 1), (11, 2, 0, 1, "-", 1, 1), (12, 4, 0, 0, "-", 1, 1), (13, 1, 50, 52, "-", 1, 1), (14, 2, 0, 1, "Asteroid", 9, 1), (15, 4, 40, 40, "-", 5, 5)],
        "eventkey long, frame_bin long, frame_start long, frame_end long, classification string, g1 long, g2 long")
    got = {r["eventkey"]: list(r["crossbin_ids"]) for r in series.crossbin_ids(ev, "g1", "g2").collect()}
    assert got == {10: [0], 11: [0, 1], 12: [0, 1, 2], 13: [], 14: [2], 15: []} or got == {10: [0], 11: [0, 1], 12: [0, 1, 2], 13: [], 14: [2], 15: []}


def test_w9_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, k=[1] * 400, t=np.arange(400), f=rng.normal(size=400) + (np.arange(400) % 57 == 0) * 9)
    got = [sorted(map(tuple, series.local_excess(df, ["k"], ["t"], "f", window=21, block_rows=b).select("t", "local_flux_excess").collect())) for b in (60, 10**6)]
    assert got[0] == got[1] and any(flag for _, flag in got[0])


def test_p8_equals_lstsq(spark):
    rng = np.random.default_rng(5)
    prf = rng.uniform(0, 1, 25)
    v = 7.0 * prf + 2.0 + rng.normal(0, 0.1, 25)
    st = frame(spark, ev=[1] * 25, m=[1] * 25, i=range(25), v=v)
    got = phot.forced_psf(st, frame(spark, m=[1] * 25, i=range(25), p=prf), ["ev"], ["m"], ["i"]).first()
    a = np.column_stack([prf, np.ones(25)])
    sol = np.linalg.lstsq(a, v, rcond=None)[0]
    res = v - a @ sol
    e = 1.4826 * np.median(np.abs(res - np.median(res))) * math.sqrt(np.linalg.inv(a.T @ a)[0, 0])
    assert got["flux"] == pytest.approx(sol[0]) and got["background"] == pytest.approx(sol[1]) and got["e_flux"] == pytest.approx(e)


def _cube(spark):
    """A unit with 12 frames of 15x15 pixels, two sources, one NaN and one missing pixel."""
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[0:15, 0:15]
    shape = lambda y, x: np.exp(-0.5 * ((yy - y) ** 2 + (xx - x) ** 2) / 1.44)
    cube = rng.normal(0, 0.3, (12, 15, 15)) + np.arange(12)[:, None, None] * 0.1
    cube += 40 * shape(7.3, 6.6) * (1 + np.arange(12) / 10)[:, None, None] + 90 * shape(8.9, 8.2)
    cube[3, 6, 6], cube[8, 5, 8] = np.nan, np.inf
    rows = [("u", t, int(y), int(x), float(cube[t, y, x])) for t in range(12) for y in range(15) for x in range(15) if (t, y, x) != (8, 5, 8)]
    cube[8, 5, 8] = np.nan
    px = spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "frame", "y", "x", "v"]))
    frames = spark.createDataFrame([("u", t, 60000.0 + t) for t in range(12)], "unit string, frame long, mjd double")
    ev = spark.createDataFrame(
        [("u", 1, 1, 4, 6, 7.3, 6.6), ("u", 1, 2, 11, 11, 7.3, 6.6), ("u", 1, 2, 11, 11, 7.3, 6.6), ("u", 2, 1, 4, 4, 1.0, 6.0), ("x", 3, 1, 1, 2, 7.0, 7.0), ("u", 4, 1, None, 5, 7.0, 7.0)],
        "unit string, objid long, eventid long, frame_start long, frame_end long, y double, x double")
    return cube, px, frames, ev


def test_p22_profile_curves_with_neighbours_equal_lstsq(spark):
    cube, px, frames, ev = _cube(spark)
    ev = ev.withColumn("near", F.expr("array(struct(8.9D AS y, 8.2D AS x), struct(7.3D AS y, 6.6D AS x), struct(0.0D AS y, 0.0D AS x), struct(8.9D AS y, 8.2D AS x))"))
    out = lightcurves.profile_light_curves(ev, frames, px, ["unit"], lightcurves.gaussian_profile(1.2), buffer=2, neighbours="near", size=(15, 15)).toPandas()
    assert sorted(set(zip(out.objid, out.eventid))) == [(1, 1), (1, 2)]
    yy, xx = np.mgrid[3:12, 3:12]
    cols = []
    for y, x in ((7.3, 6.6), (8.9, 8.2)):
        g = np.exp(-0.5 * ((yy - y) ** 2 + (xx - x) ** 2) / 1.44)
        cols.append((g / g.sum()).ravel())
    a = np.column_stack([*cols, np.ones(81)])
    for eventid, span in ((1, range(2, 10)), (2, range(9, 12))):
        got = out[out.eventid == eventid].sort_values("frame")
        assert list(got.frame) == list(span)
        d = cube[list(span), 3:12, 3:12].reshape(len(span), 81)
        use = np.isfinite(d).all(0)
        c = np.linalg.lstsq(a[use], d[:, use].T, rcond=None)[0]
        res = d[:, use].T - a[use] @ c
        err = 1.4826 * np.median(abs(res - np.median(res, axis=0)), axis=0) * np.sqrt(np.linalg.inv(a[use].T @ a[use])[0, 0])
        np.testing.assert_allclose(got.flux, c[0], rtol=1e-9)
        np.testing.assert_allclose(got.background, c[-1], rtol=1e-7)
        np.testing.assert_allclose(got.flux_err, err, rtol=1e-9)


def test_p22_units_whole_series_and_degenerate_stamps(spark):
    cube, px, frames, ev = _cube(spark)
    zp = spark.createDataFrame([("u", 20.0)], "unit string, zp_ab double")
    g = lightcurves.gaussian_profile(1.2)
    obj = ev.select("unit", "objid", "y", "x").distinct()
    psf = lightcurves.light_curves(obj, frames, px, ["unit"], "psf", "mJy", zp, g, ids=["objid"], buffer=None)
    counts = lightcurves.light_curves(obj, frames, px, ["unit"], "psf", "counts", None, g, ids=["objid"], buffer=None)
    both = psf.filter("objid = 1").select("frame", F.col("flux").alias("m")).join(counts.filter("objid = 1"), "frame").toPandas()
    assert len(both) == 12
    np.testing.assert_allclose(both.m, both.flux * 3631e3 * 10**-8, rtol=1e-9)
    box = lightcurves.light_curves(ev, frames, px, ["unit"], "aperture", "counts", buffer=0).filter("objid = 1 AND eventid = 1").orderBy("frame").toPandas()
    np.testing.assert_allclose(box.flux, [np.nansum(cube[t, 6:9, 6:9]) for t in (4, 5, 6, 7)], rtol=1e-9)
    one = lightcurves.profile_light_curves(obj, frames, px.filter("y = 7 AND x = 7"), ["unit"], g, ids=["objid"], buffer=None).toPandas()
    assert len(one) and one[["flux", "flux_err", "background"]].isna().all().all()
    for method in ("psf", "aperture"):
        assert lightcurves.light_curves(ev.limit(0), frames, px.limit(0), ["unit"], method, "counts", profile=g).count() == 0


def test_p22_sampled_profile_is_bilinear(spark):
    grid = np.arange(25.0).reshape(5, 5)
    df = frame(spark, dy=[0.0, 0.25, -0.5, 2.0, 1.1], dx=[0.0, -0.25, 0.5, 0.0, 0.0]).withColumn("g", F.array(*[F.lit(v) for v in grid.ravel()]))
    got = [r[0] for r in df.select(lightcurves.sampled_profile(F.col("g"), 5, 2)(F.col("dy"), F.col("dx"))).collect()]
    np.testing.assert_allclose(got, [12.0, 12.0 + 2.5 - 0.5, 12.0 - 5 + 1, 0.0, 0.8 * grid[4, 2]], rtol=1e-12)


def test_p18_recovers_planted_shifts_fluxes_and_zero_points(spark):
    rng = np.random.default_rng(11)
    sigma, size = 1.1, 76
    yy, xx = np.mgrid[0:size, 0:size]
    stars, sources, pixels, truth = [], [], [], {}
    for unit, zp in (("a", 20.4), ("b", 19.9)):
        img = rng.normal(3.0, 0.5, (size, size))
        for n in range(16):
            y, x = 12 + 17 * (n // 4) + rng.uniform(-0.45, 0.45), 12 + 17 * (n % 4) + rng.uniform(-0.45, 0.45)
            mag = 11.0 + 2.4 * n / 16
            spots = [(y, x, mag, *rng.uniform(-0.15, 0.15, 2), True)]
            if n % 3 == 0:  # a close neighbour that only a scene can tell apart, where the catalogue has it
                spots.append((y + 1.8, x - 2.1, mag + 0.8, 0.0, 0.0, False))
            for sy, sx, m, dy, dx, main in spots:
                g = np.exp(-0.5 * ((yy - sy - dy) ** 2 + (xx - sx - dx) ** 2) / sigma**2)
                flux = 10 ** ((zp - m) / 2.5)
                img += flux * g / g.sum()
                sources.append((unit, sy, sx, m))
                if main:
                    stars.append((unit, n, sy, sx, m, n % 3 != 0))
                    truth[unit, n] = (flux, dy, dx)
        pixels += [(unit, int(r), int(c), float(img[r, c])) for r in range(size) for c in range(size)]
    st = spark.createDataFrame(stars, "unit string, star long, y double, x double, mag double, alone boolean")
    st = st.unionByName(spark.createDataFrame([("a", 90, 1.0, 50.0, 12.0, False), ("a", 91, None, 3.0, 12.0, True)], st.schema))
    src = spark.createDataFrame(sources + sources[:5], "unit string, y double, x double, mag double")
    img = spark.createDataFrame(pd.DataFrame(pixels, columns=["unit", "y", "x", "v"]))
    zp, fits_ = starfits.scene_calibration(st.filter("alone").drop("alone"), st.drop("alone"), src, img, ["unit"], lightcurves.gaussian_profile(sigma), free=0.5)
    got = {r["unit"]: r for r in zp.collect()}
    assert abs(got["a"]["zp_ab"] - 20.4) < 0.01 and abs(got["b"]["zp_ab"] - 19.9) < 0.01
    rows = fits_.collect()
    assert len(rows) == 32 and {r["n_scene"] for r in rows if r["star"] % 3 == 0} == {2}
    for r in rows:
        flux, dy, dx = truth[r["unit"], r["star"]]
        assert abs(r["dy_fit"] - dy) < 0.03 and abs(r["dx_fit"] - dx) < 0.03
        assert abs(r["flux_psf"] / flux - 1) < 0.05 and abs(r["background"] - 3) < 0.5 and not r["at_bound"]


def test_p18_bounds_hold_and_are_marked(spark):
    rng = np.random.default_rng(2)
    a = np.abs(rng.normal(size=(30, 3)))
    lo, hi = np.array([0.5, 0.2, -np.inf]), np.array([0.9, 0.4, np.inf])
    v = a @ np.array([1.5, 0.1, 2.0]) + rng.normal(0, 0.1, 30)
    x = starfits._bounded(a.T @ a, a.T @ v, lo, hi, np.zeros(3))
    grad = a.T @ (a @ x - v)
    assert (x >= lo).all() and (x <= hi).all()
    assert all(abs(g) < 1e-8 or (c == l and g > 0) or (c == h and g < 0) for g, c, l, h in zip(grad, x, lo, hi))
    g = np.exp(-0.5 * (np.mgrid[-4:5, -4:5] ** 2).sum(0))
    img = frame(spark, unit=["u"] * 81, y=np.repeat(np.arange(9), 9), x=np.tile(np.arange(9), 9), v=(100 * g / g.sum()).ravel() + rng.normal(0, 0.01, 81))
    star = spark.createDataFrame([("u", 1, 4.0, 4.0, 15.0)], "unit string, star long, y double, x double, mag double")
    one = starfits.star_stamps(star, img, ["unit"]).withColumns({"dy_fit": F.lit(0.0), "dx_fit": F.lit(0.0), "zp": F.lit(19.0), "tol": F.lit(0.5)})
    fit = starfits.fit_fluxes(one, lightcurves.gaussian_profile(1.0), zp="zp", tolerance="tol").first()
    assert fit["at_bound"] and abs(fit["flux_psf"] - 10 ** (4.5 / 2.5)) < 1e-6
    assert abs(starfits.fit_fluxes(one, lightcurves.gaussian_profile(1.0)).first()["flux_psf"] - 100) < 0.1
    assert starfits.star_stamps(star, img.filter("y <> 2"), ["unit"]).count() == 0


def flood(mask):
    """Lists of (y, x) of the parts of a mask, pixel by pixel."""
    left, parts = set(zip(*map(list, np.nonzero(mask)))), []
    while left:
        part, todo = [], [left.pop()]
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for n in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(part)
    return parts


def plain_segments(s, noise, fwhm, threshold, min_area):
    """Whole-image version: kernel by its formula, one flood fill, moments per part."""
    sd = fwhm / (2 * math.sqrt(2 * math.log(2)))
    half = max(5, math.ceil(6 * sd) | 1) // 2
    k = np.array([[(1 - (y * y + x * x) / (2 * sd * sd)) * math.exp(-(y * y + x * x) / (2 * sd * sd)) for x in range(-half, half + 1)] for y in range(-half, half + 1)])
    k /= np.abs(k).sum()
    h, w = s.shape
    snr = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            near = [(k[j - y + half, i - x + half], s[j, i], noise[j, i]) for j in range(max(0, y - half), min(h, y + half + 1)) for i in range(max(0, x - half), min(w, x + half + 1))]
            snr[y, x] = sum(a * b / c**2 for a, b, c in near) / math.sqrt(sum(a * a / c**2 for a, b, c in near))
    out = []
    for sign in (1, -1):
        for part in flood(sign * snr > threshold):
            if len(part) >= min_area:
                v = np.array([sign * snr[p] for p in part])
                y, x = np.array(part).T
                out.append((sign, round(fwhm, 6), len(part), round(float((v * x).sum() / v.sum()), 6), round(float((v * y).sum() / v.sum()), 6), round(float(sum(sign * s[p] for p in part)), 5)))
    return out


def test_p1_segments_over_tile_borders_equal_a_flood_fill(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(0, 1, (30, 26))
    s[12:15, :] += 4  # a source as long as the image, over all tiles
    noise = rng.uniform(0.8, 1.3, s.shape)
    y, x = np.mgrid[0:30, 0:26]
    px = frame(spark, frame=[5] * s.size, y=y.ravel(), x=x.ravel(), s=s.ravel(), noise=noise.ravel())
    for widths, threshold, area, tile in [((1.2, 2.0), 0.3, 2, 7), ((0.7,), 1.0, 1, 16), ((1.2,), 0.3, 2, 64)]:
        want = sorted(r for f in widths for r in plain_segments(s, noise, f, threshold, area))
        got = detection.segments(px, ["frame"], widths, threshold, area, tile).collect()
        assert sorted((r["flux_sign"], round(r["detection_fwhm"], 6), r["n_pixels"], round(r["xcentroid"], 6), round(r["ycentroid"], 6), round(r["flux"], 5)) for r in got) == want


def test_p1_finds_planted_sources_of_both_signs(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:96, 0:96]
    planted = [(20.3, 11.8, 60, 1), (63.6, 64.2, 45, 1), (40.0, 80.4, 50, -1), (80.7, 31.1, 70, -1)]  # the second lies on a corner of four tiles
    img = rng.normal(100, 1, y.shape) + sum(sign * f * np.exp(-0.5 * ((y - a) ** 2 + (x - b) ** 2) / 0.8) for a, b, f, sign in planted)
    px = frame(spark, frame=[0] * y.size, y=y.ravel(), x=x.ravel(), v=img.ravel())
    got = detection.detect_sources(px, ["frame"]).orderBy(F.col("snr").desc()).collect()
    for a, b, f, sign in planted:
        hits = [r for r in got if r["flux_sign"] == sign and math.hypot(r["ycentroid"] - a, r["xcentroid"] - b) < 0.5]
        assert len(hits) == 1 and hits[0]["snr"] > 5 and hits[0]["neg_extent"] < 3
    assert {(r["flux_sign"]) for r in got[:4]} == {1, -1} and all(r["ellipticity"] < 0.75 for r in got)
    bright = [r for r in got if r["flux"] > 100]
    for i, r in enumerate(bright):
        assert all(r["flux_sign"] != o["flux_sign"] or math.hypot(r["xcentroid"] - o["xcentroid"], r["ycentroid"] - o["ycentroid"]) > 1 for o in bright[:i])


def test_p1_joined_pixels_follow_long_chains():
    mask = np.zeros((41, 41), dtype=bool)
    mask[::2] = True
    for k in range(1, 41, 4):
        mask[k, -1] = mask[min(k + 2, 39), 0] = True  # one snake through all rows
    assert len(set(detection.joined_pixels(mask))) == len(flood(mask)) == 1


def test_g6_quadratic_and_clamped_acceleration(spark):
    t = np.linspace(0, 4, 9)
    df = frame(spark, track=[1] * 9 + [2] * 9, t=np.r_[t, t], x=np.r_[3 + 2 * t + 0.25 * t**2, 10 * t**2], y=np.r_[1 - t, 5 + 0 * t])
    got = {r["track"]: r for r in tracks.fit_tracks(df).collect()}
    assert got[1]["ax"] == pytest.approx(0.5) and got[1]["residual_px"] == pytest.approx(0, abs=1e-9)
    assert got[2]["ax"] == 1.0


def test_g10_finds_planted_tracks(spark):
    rows = []
    for k, (x0, vx, y0, vy) in enumerate([(20, 10, 30, 5), (200, -8, 90, 6)]):
        for i in range(30):
            t = i * 0.05
            rows.append((len(rows), t, x0 + vx * t, y0 + vy * t, "Asteroid" if i % 3 else "-", 1))
    rows.append((999, 0.3, 128.0, 240.0, "-", 1))
    ev = spark.createDataFrame(rows, "event_id long, t double, x double, y double, classification string, flux_sign long")
    got = tracks.tag_moving(ev, "event_id", min_track_events=5, rounds=2).toPandas().set_index("event_id").sort_index()
    # The first event of each object lies before its track's life.
    assert set(got.loc[1:29, "asteroid_id"]) == {1} and set(got.loc[31:59, "asteroid_id"]) == {2}
    assert got.loc[999, "asteroid_id"] == -1 and got.loc[0, "asteroid_id"] == -1 and got.loc[3, "classification"] == "Asteroid"


def test_p17_recovers_a_planted_profile(spark):
    t = np.linspace(0, 20, 120)
    dt = t - 8.0
    f = 50 * np.exp(-dt / 3) / (1 + np.exp(-dt / 0.5)) + 4 + np.random.default_rng(2).normal(0, 0.3, 120)
    w = frame(spark, ev=[1] * 120, t=t, flux=f, err=[0.3] * 120, t_start=[7.0] * 120, t_end=[14.0] * 120)
    got = fits.fit_events(w, ["ev"]).first()
    assert got["fit_ok"] and got["tau_fall"] == pytest.approx(3, rel=0.1) and got["t0"] == pytest.approx(8, abs=0.2) and got["delta_bic"] < -100 and got["redchi2_region"] < 2


def test_c4_finds_a_planted_period(spark):
    t = np.sort(np.random.default_rng(7).uniform(0, 200, 400))
    df = frame(spark, s=[1] * 400 + [2], t=np.r_[t, 5.0], f=np.r_[3 * np.sin(2 * np.pi * t / 12.5) + 1, 1.0])
    p = features.periodogram(df, "s", "t", "f")
    grid = p.filter("s = 1").orderBy("j").toPandas()
    step = 1 / (5 * (t[-1] - t[0]))
    assert grid["frequency"].to_numpy() == pytest.approx(step * np.arange(1, len(grid) + 1))
    assert len(grid) == math.ceil(1 / (2 * np.median(np.diff(t))) / step) - 1
    for j in (0, 15, 77, len(grid) - 1):
        arg = 2 * np.pi * grid["frequency"][j] * (t - t[0])
        f = 3 * np.sin(2 * np.pi * t / 12.5) + 1
        fit = np.linalg.lstsq(np.c_[np.cos(arg), np.sin(arg)], f - f.mean(), rcond=None)[0]
        assert grid["power"][j] == pytest.approx(np.hypot(*fit), rel=1e-6)
    best = features.best_period(p, "s").collect()
    assert [r["s"] for r in best] == [1] and best[0]["period"] == pytest.approx(12.5, rel=0.02)
    assert features.periodogram_peaks(p, "s").orderBy("peak").first()["peak_freq"] == pytest.approx(0.08, abs=0.002)


def test_c4_prefers_a_prominent_peak_to_a_strong_edge(spark):
    freq = np.arange(1, 301) * 0.001
    power = 8 * np.exp(-freq / 0.004) + np.where(abs(freq - 0.1) < 0.0005, 5.0, 0) + np.where(abs(freq - 0.2) < 0.0005, 4.5, 0) + np.where(abs(freq - 0.17) < 0.0005, 4.0, 0) + 0.1
    p = frame(spark, s=[1] * 300, j=range(300), frequency=freq, power=power)
    assert features.best_period(p, "s").first()["period"] == pytest.approx(10)
    got = [(r["signal_num"], r["harmonic"]) for r in features.periodogram_peaks(p, "s").orderBy("peak").collect()]
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_a5_equal_counts_flag_nothing(spark):
    ev = frame(spark, eventid=range(40), frame_max=[k % 10 for k in range(40)], frame_bin=[1] * 40)
    assert {r["bad_frame_flag"] for r in robust.flag_event_frames(ev, 100).collect()} == {0}
    ev = frame(spark, eventid=range(140), frame_max=[k % 10 if k < 40 else 3 for k in range(140)], frame_bin=[1] * 140)
    assert {r["frame_max"] for r in robust.flag_event_frames(ev, 100, nsigma=2.0).filter("bad_frame_flag = 1").collect()} == {3}


def test_clip_modes(spark):
    df = frame(spark, k=[1] * 5, v=[2.0, 2, 2, 2, 2])
    assert robust.sigma_clip(df, ["k"], "v", library=True).filter("kept").count() == 5
    assert robust.sigma_clip(df, ["k"], "v").filter("kept").count() == 0


def test_g11_keeps_all_components_that_are_needed(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(np.exp(rng.normal(size=(400, 6))), columns=list("abcdef"))
    pdf.loc[:59] = np.exp(rng.normal(5, 0.02, (60, 6)))
    df = spark.createDataFrame(pdf.assign(row=range(400)))
    w = fits.whitened(df, "row", list("abcdef"))
    assert len(w.columns) == 7
    got = fits.cluster_events(df, "row", list("abcdef"), eps=0.5).filter("cluster >= 0").toPandas()
    assert set(range(60)) <= set(got["row"]) and got.loc[got["row"] < 60, "cluster"].nunique() == 1
    assert fits.whitened(df, "row", ["a", "b"], log=False, whiten=False).columns == ["row", "w0", "w1"]


def test_c3_shapiro_on_normal_and_skewed_data(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, s=[1] * 200 + [2] * 200, pt=range(400), f=np.r_[rng.normal(size=200), rng.exponential(size=200)])
    got = {r["s"]: r["shapiro_w"] for r in features.shapiro_w(df, "s", "f").collect()}
    assert got[1] > 0.98 and got[2] < 0.9


def test_j17_prefers_the_finest_bin_and_needs_overlap(spark):
    inj = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 11.0, 1, 10.5, 5.0, "flare"), (2, 50.0, 50.0, 10.0, 11.0, 1, 10.5, 5.0, "flare")],
                                "injid long, x0 double, y0 double, i_start double, i_end double, i_sign long, i_max double, i_snr double, event_type string")
    ev = spark.createDataFrame([(7, 1, 4, 0.0, 0.0, 10.0, 11.0, 10.5, 9.0), (8, 1, 2, 1.5, 0.0, 10.2, 11.0, 10.5, 9.0), (9, 1, 1, 0.0, 0.0, 12.0, 13.0, 12.5, 9.0)],
                               "eventkey long, flux_sign long, frame_bin long, x double, y double, mjd_start double, mjd_end double, mjd_max double, snr double")
    iso = spark.createDataFrame([(50.5, 50.0, 10.4)], "x double, y double, mjd double")
    got = {r["injid"]: r for r in recovery_match(inj, ev, iso).collect()}
    assert got[1]["detected"] == "2" and got[1]["eventkey"] == 8 and got[2]["detected"] == "iso"


def test_f8_and_f20_edges(spark):
    ev = frame(spark, frame_bin=[1, 1, 1], frame_start=[3, 20, 96], frame_end=[5, 30, 99])
    bounds = frame(spark, frame_bin=[1], brk=[50], last=[100])
    assert filters.outside_boundaries(ev, bounds, 2).count() == 2
    few = frame(spark, tile=[1, 1], q=[0.2, 0.9])
    assert filters.calibrators_per_tile(few, ["tile"], "q", 10, 0.9).count() == 2


def test_expression_edges(spark):
    lit = F.lit
    assert value(spark, angles.sky_name(lit(15.0), lit(-0.5), lit(60000.7), lit(1), "EV")) == "EV 010000.00+003000.00T60000"
    assert value(spark, angles.ra_difference(lit(0.01), lit(359.99))) == pytest.approx(0.02)
    assert value(spark, timecode.packed_epoch_mjd(lit("K2669"))) == 61200.0
    assert value(spark, timecode.packed_epoch_mjd(lit("bad"))) is None
    assert value(spark, angles.degrees_to_sexagesimal(lit(-10.99999999))) == "-11:00:00.00"
    assert value(spark, photometry.convert_flux(lit(1.0), lit(2.0), "mag", lit(20.0))[1]) is None
    w = wcs.TangentWcs((100.0, 100.0), (10.0, 89.0), (-0.005, 0, 0, 0.005))
    assert spark.range(1).select(*[c.alias(n) for n, c in zip("ab", w.pixel_to_sky(lit(100.0), lit(100.0)))]).first()["b"] == pytest.approx(89.0)


def test_load_table_falls_back_to_csv(spark, tmp_path):
    pd.DataFrame({"a": [1.0, np.nan], "b": ["x", "y"]}).to_csv(tmp_path / "t.csv", index=False)
    got = tables.load_table(spark, str(tmp_path / "t"), "a double, b string").orderBy("b").collect()
    assert [r["a"] for r in got] == [1.0, None]
    with pytest.raises(FileNotFoundError):
        tables.load_all_units(spark, str(tmp_path), "nothing*.parquet").count()
    assert text.orbit_catalogue(spark.createDataFrame([("short line",)], "value string")).count() == 0


def walk(sig, frames):
    """Events of one object over all frames, absent ones with no signal, frame by frame."""
    want, start, end, misses, hits = [], -1, -1, 0, 0
    for i in range(frames):
        x = sig.get(i, 0.0)
        if start >= 0:
            misses += x < 3
            if misses >= 5:
                want.append((start, end, hits))
                start = -1
            elif x >= 3:
                end, hits = i, hits + 1
        if start < 0 and x >= 5:
            start, end, misses, hits = i, i, 0, 1
    return want


def test_st4_stream_closes_every_event_and_equals_the_batch_rule(spark, tmp_path):
    rng = np.random.default_rng(4)
    signals = {k: {int(f): float(v) for f, v in zip(rng.choice(90, 50, replace=False), rng.uniform(0, 7, 50))} for k in (1, 2, 3)}
    signals[4] = {3: 6.0}  # nothing comes after its only row
    rows = [(k, f, v) for k, s in signals.items() for f, v in s.items()] + [(1, f, 0.0) for f in list(signals[1])[:5]]
    pdf = pd.DataFrame(rows, columns=["objid", "frame", "sig"])
    pdf["ts"] = pd.to_datetime(pdf["frame"] * 60 + 30, unit="s")
    # Rows of neighbouring frames arrive in any order, in six files; a last one moves the clock on.
    pdf = pdf.iloc[np.argsort(pdf["frame"] + rng.uniform(0, 8, len(pdf)), kind="stable")]
    parts = [pdf.iloc[i * len(pdf) // 6:(i + 1) * len(pdf) // 6] for i in range(6)]
    parts.append(pd.DataFrame({"objid": [-1], "frame": [500], "sig": [0.0], "ts": pd.to_datetime([500 * 60], unit="s")}))
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate(parts):
        part.to_parquet(src / f"{i}.parquet", index=False, coerce_timestamps="us")
        os.utime(src / f"{i}.parquet", (1000 + i, 1000 + i))
    schema = "objid long, frame long, sig double, ts timestamp"
    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = stream.stream_extend(incoming, "ts", 60, lateness="9 minutes")
    stream.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted((k, *e) for k, s in signals.items() for e in walk(s, 400)) and any(r[0] == 4 for r in found)
    lc = spark.createDataFrame([(k, f, signals[k].get(f, 0.0)) for k in signals for f in range(120)], "objid long, frame long, sig double")
    opened = got.select("objid", F.row_number().over(Window.partitionBy("objid").orderBy("frame_start")).alias("eventid"), "frame_start", F.col("frame_start").alias("frame_end"), F.col("frame_end").alias("closed"))
    batch = series.extend_events(opened, lc, ["objid"])
    assert batch.filter("new_end <> closed").count() == 0 and batch.count() == len(found)
    # Once everything has closed, only the clock's own frame still waits.
    state = spark.read.format("statestore").option("stateVarName", "event").load(str(tmp_path / "ck"))
    assert state.count() == 0


def test_s3_reports_files_without_rows(spark, tmp_path):
    frame(spark, a=[1, 2]).coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no table")
    got = [r["path"] for r in tables.skipped_units(spark, str(tmp_path), "*.parquet", "a long").collect()]
    assert len(got) == 1 and got[0].endswith("bad.parquet")


def test_c4_blocks_equal_one_grid(spark):
    """Peaks over blocks with chains longer than a halo are those of a plain scan of the whole grid."""
    rng = np.random.default_rng(11)
    n, distance, wlen = 3000, 8, 40
    noise = rng.exponential(1, n)
    ramp = np.where(np.arange(n) % 5 == 2, 5 + np.arange(n) / 300, np.arange(n) % 2 * 0.1)  # one chain of ever higher maxima
    ties = np.where(np.arange(n) % 6 == 3, 4.0, 0.5)
    tables = {1: noise, 2: ramp, 3: ties}
    p = spark.createDataFrame(pd.DataFrame([(s, j, 0.01 * (j + 1), v) for s, x in tables.items() for j, v in enumerate(x.tolist())], columns=["s", "j", "frequency", "power"]))
    got = features.prominent_peaks(p, "s", 0.5, distance, wlen, block=128).toPandas()
    for s, raw in tables.items():
        x = raw / raw.mean()
        idx = [i for i in range(1, n - 1) if x[i] > x[i - 1] and x[i] > x[i + 1]]
        kept = []
        for i in sorted(idx, key=lambda i: (-x[i], i)):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)
        prom = {}
        for i in kept:
            lo = i
            while lo > max(0, i - wlen // 2) and x[lo - 1] <= x[i]:
                lo -= 1
            hi = i
            while hi < min(n - 1, i + wlen // 2) and x[hi + 1] <= x[i]:
                hi += 1
            prom[i] = x[i] - max(x[lo:i + 1].min(), x[i:hi + 1].min())
        want = sorted((i for i in kept if prom[i] >= 0.5), key=lambda i: (-round(prom[i], 9), i))
        mine = got[got["s"] == s].sort_values("peak")
        assert mine["peak"].tolist() == list(range(1, len(want) + 1))
        assert sorted(np.rint(mine["peak_freq"] * 100).astype(int) - 1) == sorted(want)
        assert mine["prominence"].to_numpy() == pytest.approx(sorted((prom[i] for i in want), reverse=True))
    few, many = (features.periodogram_peaks(p, "s", 0.5, distance, wlen, heads=h).orderBy("s", "peak").collect() for h in (3, 10_000))
    assert few == many and len(few) == len(got)


def test_c4_long_series_is_cut_into_packs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "POINTS", 50)
    monkeypatch.setattr(features, "FREQUENCIES", 64)
    rng = np.random.default_rng(3)
    t = np.r_[np.sort(rng.uniform(0, 100, 300)), [7.0] * 200]  # one time holds two fifths of the rows
    f = np.cos(t) + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "t": t, "f": f}))
    got = features.periodogram(df, "s", "t", "f").orderBy("j").toPandas()
    assert len(got) > 200 and got["j"].tolist() == list(range(len(got)))
    for j in range(0, len(got), 41):
        arg = 2 * np.pi * got["frequency"][j] * (t - t.min())
        fit = np.linalg.lstsq(np.c_[np.cos(arg), np.sin(arg)], f - f.mean(), rcond=None)[0]
        assert got["power"][j] == pytest.approx(np.hypot(*fit), rel=1e-6)


def test_c7_full_trees_fit_and_generalise(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (1200, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0, "same", np.where(x[:, 2] > 0.3, "high", "low"))
    df = spark.createDataFrame(pd.DataFrame({"i": range(1200), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    train, test = df.filter("i < 900"), df.filter("i >= 900")
    forest = features.random_forest(train, ["a", "b", "c"], "y", trees=40)
    assert forest.labels == ["high", "low", "same"] and len(forest.trees) == 40
    assert features.predict(train, forest).filter("predicted = y").count() > 890  # full depth
    out = features.predict(test, forest)
    assert out.filter("predicted = y").count() > 270 and out.filter("class_prob BETWEEN 0 AND 1").count() == 300
    again = features.predict(test, features.random_forest(train, ["a", "b", "c"], "y", trees=40))
    assert again.orderBy("i").collect() == out.orderBy("i").collect()
    gaps = spark.createDataFrame([(None, 0.5, 0.5)], "a double, b double, c double")
    assert features.predict(gaps, forest).first()[3:] == (None, None)
    assert features.predict(gaps, features.random_forest(train.limit(0), ["a", "b", "c"], "y", trees=2)).first()[3:] == (None, None)
