"""Pixel-table photometry.

Pixels are rows (keys..., frame, y, x, value); images never leave their partitions whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.photometry import convert_flux
from skyloom.operators.robust import MAD_TO_SIGMA, median_mad, sigma_clip
from skyloom.operators.skew import attach, attach_few, broadcast_if_small, exact_percentiles


def offsets(radius: float, inner: float | None = None, square: bool = False) -> list[tuple[int, int]]:
    """(dy, dx) of the pixels of a disc, an annulus or a square, row by row."""
    r = int(np.ceil(radius))
    out = []
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            d2 = dy * dy + dx * dx
            if (square or d2 <= radius * radius) and (inner is None or d2 > inner * inner):
                out.append((dy, dx))
    return out


def stamp_pixels(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], offs: Sequence[tuple[int, int]], row: str, clamp: tuple[int, int] | None = None) -> DataFrame:
    """Pixels around each position (integer y, x): an equality join on exploded offsets.

    ``clamp`` (height, width) repeats the border pixels outside the image.
    """
    table = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in offs])
    pos = positions.withColumn("_o", F.explode(table))
    py, px = F.col("y") + F.col("_o.dy"), F.col("x") + F.col("_o.dx")
    if clamp is not None:
        py = F.greatest(F.lit(0), F.least(F.lit(clamp[0] - 1), py))
        px = F.greatest(F.lit(0), F.least(F.lit(clamp[1] - 1), px))
    pos = pos.select(*keys, row, F.col("_o.dy").alias("dy"), F.col("_o.dx").alias("dx"), py.alias("y"), px.alias("x"))
    return pos.join(pixels, [*keys, "y", "x"])


def negative_extent(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], row: str, value: str = "v", radius: float = 2.0) -> DataFrame:
    """Depth of the deepest negative pixel nearby in clipped standard deviations; outside counts as 0."""
    kept = sigma_clip(pixels, keys, value, 3.0, 5, library=True).filter("kept")
    std = kept.groupBy(*keys).agg(F.stddev_pop(value).alias("_std"))
    offs = offsets(radius)
    near = stamp_pixels(positions, pixels, keys, offs, row).groupBy(*keys, row).agg(F.min(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    near = near.withColumn("_m", F.when(F.col("_n") < len(offs), F.least(F.col("_m"), F.lit(0.0))).otherwise(F.col("_m")))
    return attach(near, std, keys).select(*keys, row, (F.greatest(F.lit(0.0), -F.col("_m")) / F.col("_std")).alias("neg_extent"))


def brightest_pixel(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], row: str, value: str = "v", over: Sequence[str] = ()) -> DataFrame:
    """Brightest pixel of the 3x3 block, first in row order on ties.  ``over`` lists frame
    columns whose images are summed first."""
    near = stamp_pixels(positions, pixels, keys, offsets(1, square=True), row)
    group = [k for k in keys if k not in over]
    if over:
        near = near.groupBy(*group, row, "y", "x").agg(F.sum(value).alias(value))
    best = near.filter(F.col(value).isNotNull()).groupBy(*group, row).agg(F.min(F.struct((-F.col(value)).alias("v"), "y", "x")).alias("_b"))
    return best.select(*group, row, F.col("_b.y").alias("yint_brightest"), F.col("_b.x").alias("xint_brightest"))


def mask_lookup(positions: DataFrame, mask: DataFrame, keys: Sequence[str], edge: int, size: tuple[int, int]) -> DataFrame:
    """Mask bits at the pixel, and only positions more than ``edge`` pixels inside the image."""
    inside = (F.col("x") > edge) & (F.col("x") < size[1] - edge) & (F.col("y") > edge) & (F.col("y") < size[0] - edge)
    return positions.filter(inside).join(mask, [*keys, "y", "x"], "left").withColumn("source_mask", F.coalesce("source_mask", F.lit(0).cast("long")))


def box_light_curve(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], row: str, radius: float = 1.5, value: str = "v", frame: str = "frame") -> DataFrame:
    """Box sums per frame and their error from the frame's scaled MAD; an all-NULL box is 0."""
    side = 2 * int(np.floor(radius)) + 1
    offs = offsets(int(np.floor(radius)), square=True)
    noise = median_mad(pixels, [*keys, frame], value).select(*keys, frame, (np.sqrt(float(side * side)) * MAD_TO_SIGMA * F.col("mad")).alias("flux_err"))
    lc = stamp_pixels(positions, pixels, keys, offs, row).groupBy(*keys, row, frame).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("flux"))
    return attach(lc, noise, [*keys, frame])


def moving_aperture(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], row: str, radius: float = 1.5, value: str = "v") -> DataFrame:
    """Aperture flux at moving positions with a local annulus sky.

    ``positions`` has real-valued px, py.  Pixels belong to the aperture or annulus by their
    centres; pixels beyond five sigma of the frame are left out of the sky.
    """
    r_in, r_out = 2 * radius + 3, 2 * radius + 7
    clipped = sigma_clip(pixels, keys, value, 5.0, 5, library=True)
    pos = positions.withColumns({"y": F.floor(F.col("py") + 0.5), "x": F.floor(F.col("px") + 0.5)})
    near = stamp_pixels(pos, clipped, keys, offsets(int(np.ceil(r_out)) + 1, square=True), row)
    near = near.join(positions.select(*keys, row, "px", "py"), [*keys, row])
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    ap, sky = d <= radius, (d > r_in) & (d <= r_out) & F.col("kept")
    s = near.groupBy(*keys, row).agg(F.sum(F.when(ap, F.col(value))).alias("_sum"), F.count_if(ap).alias("npix"), F.avg(F.when(sky, F.col(value))).alias("sky"), F.stddev_pop(F.when(sky, F.col(value))).alias("sky_std"))
    s = s.withColumn("flux", F.col("_sum") - F.col("npix") * F.coalesce("sky", F.lit(0.0))).drop("_sum")
    return s.withColumn("sig", F.when(F.col("sky_std") > 0, F.col("flux") / (F.sqrt("npix") * F.col("sky_std"))))


def forced_psf(stamps: DataFrame, prf: DataFrame, keys: Sequence[str], prf_keys: Sequence[str], pixel: Sequence[str], value: str = "v", model: str = "p", frame: str | None = None) -> DataFrame:
    """Linear fit of stamp = flux * PRF + background per key.

    The least-squares line is Spark's regression aggregate.  A pixel that is missing in any
    frame of a key is dropped in all of them.
    """
    keys, group = list(keys), [k for k in keys if k != frame]
    rows = stamps.join(prf, [*prf_keys, *pixel])
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    if frame is not None:
        bad = rows.filter(~ok).select(*group, *pixel).distinct()
        rows = rows.join(bad, [*group, *pixel], "left_anti")
    else:
        rows = rows.filter(ok)
    fit = rows.groupBy(*keys).agg(F.regr_slope(value, model).alias("flux"), F.regr_intercept(value, model).alias("background"), F.regr_sxx(value, model).alias("_sxx"))
    res = rows.join(fit, keys).withColumn("_res", F.col(value) - F.col("flux") * F.col(model) - F.col("background"))
    # A stamp has a fixed number of pixels, so the exact medians are bounded.
    mad = median_mad(res, keys, "_res", largest=1).select(*keys, "mad")
    out = fit.join(mad, keys).withColumn("e_flux", MAD_TO_SIGMA * F.col("mad") / F.sqrt("_sxx"))
    return out.withColumn("sig", F.when(F.col("e_flux") > 0, F.col("flux") / F.col("e_flux"))).drop("_sxx", "mad")


def scene_photometry(stamps: DataFrame, keys: Sequence[str], value: str, models: Sequence[str]) -> DataFrame:
    """P8/P18 with neighbours: joint linear fit of several model columns and a constant per stamp.

    A stamp's few hundred pixels are one Arrow group; fluxes come in the order of ``models``.
    """
    keys, models = list(keys), list(models)
    types = dict(stamps.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"flux_{m} double" for m in models] + ["background double", "rms double"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.column_stack([pdf[m].to_numpy(float) for m in models] + [np.ones(len(pdf))])
        v = pdf[value].to_numpy(float)
        use = np.isfinite(v) & np.isfinite(a).all(1)
        if use.sum() <= a.shape[1]:
            return pd.DataFrame([[*key, *[np.nan] * (len(models) + 2)]])
        sol = np.linalg.lstsq(a[use], v[use], rcond=None)[0]
        return pd.DataFrame([[*key, *sol, float(np.sqrt(np.mean((v[use] - a[use] @ sol) ** 2)))]])

    return stamps.select(*keys, value, *models).groupBy(*keys).applyInPandas(fit, schema)


def aperture_fraction(prf: DataFrame, keys: Sequence[str], inside: Column, model: str = "p") -> DataFrame:
    """Share of the PRF inside the box and the zero-point shift it causes."""
    f = prf.groupBy(*keys).agg((F.sum(F.when(inside, F.col(model))) / F.sum(model)).alias("fraction"))
    return f.withColumn("zp_shift", 2.5 * F.log10("fraction"))


def pixel_phase_detrend(df: DataFrame, key: str, flux: str = "flux", err: str | None = "e_flux", rounds: int = 4, nsigma: float = 3.0, min_points: int = 20) -> DataFrame:
    """P10: remove the dependence of a track's flux on the sub-pixel position.

    The quadratic surface is fitted from normal-equation sums, so a long track is never
    collected; its few coefficients per key come from one small Arrow group of sums per round.
    """
    from skyloom.session import cut_lineage

    x, y = F.col("x") - F.rint("x"), F.col("y") - F.rint("y")
    base = df.withColumns({"xfrac": x, "yfrac": y})
    terms = {"t0": F.lit(1.0), "t1": F.col("xfrac"), "t2": F.col("yfrac"), "t3": F.col("xfrac") * F.col("yfrac"), "t4": F.col("xfrac") ** 2, "t5": F.col("yfrac") ** 2}
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    ktype = dict(df.dtypes)[key]

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = r._asdict()
                m = np.zeros((6, 6))
                for a, b in pairs:
                    i, j = names.index(a), names.index(b)
                    m[i, j] = m[j, i] = d[f"m_{a}_{b}"]
                sol = np.linalg.lstsq(m, np.array([d[f"v_{a}"] for a in names]), rcond=None)[0]
                rows.append([d[key], *sol])
            yield pd.DataFrame(rows, columns=[key, *[f"c_{n}" for n in names]])

    model = lambda: sum((F.col(f"c_{n}") * terms[n] for n in names[1:]), F.col("c_t0"))
    use = base.filter(F.col(flux).isNotNull() & ~F.isnan(flux))
    sizes = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    use = use.join(sizes.select(key), key, "left_semi")
    cur, coeffs, last = use, None, None
    for _ in range(rounds):
        sums = cur.groupBy(key).agg(*[F.sum(terms[a] * terms[b]).alias(f"m_{a}_{b}") for a, b in pairs], *[F.sum(F.col(flux) * terms[a]).alias(f"v_{a}") for a in names])
        coeffs = cut_lineage(sums.mapInPandas(solve, f"{key} {ktype}, " + ", ".join(f"c_{n} double" for n in names)))
        resid = attach(cur.select(key, *[c for c in cur.columns if c != key]), coeffs, [key]).withColumn("_res", F.col(flux) - model())
        mm = median_mad(resid, [key], "_res").select(key, F.col("median").alias("_rm"), (F.col("mad") * MAD_TO_SIGMA).alias("_rs"))
        keep = attach(resid, mm, [key]).filter((F.col("_rs") <= 0) | (F.abs(F.col("_res") - F.col("_rm")) < nsigma * F.col("_rs")))
        cur = cut_lineage(keep.select(*use.columns))
        size = cur.count()
        if size == last:
            break
        last = size
    fitted = attach(base, coeffs, [key]).withColumn("_model", model())
    mean = fitted.groupBy(key).agg(F.avg("_model").alias("_mean"))
    out = attach(fitted, mean, [key]).withColumn("flux_detrended", F.col(flux) - F.coalesce(F.col("_model") - F.col("_mean"), F.lit(0.0)))
    out = out.drop("_model", "_mean", *[f"c_{n}" for n in names])
    return out.withColumn("sig_detrended", F.when(F.col(err) > 0, F.col("flux_detrended") / F.col(err))) if err else out


def stack_centroid(stamps: DataFrame, keys: Sequence[str], frame: str, half: int, value: str = "v", shift_x: str = "sx", shift_y: str = "sy", window: float = 2.0, min_stamps: int = 5) -> DataFrame:
    """Offset of the flux-weighted centroid of the mean stamp after bilinear sub-pixel shifts.

    Stamp pixels are (dy, dx) around the predicted pixel; shifts are the fractional parts.
    """
    fx, fy = F.col(shift_x), F.col(shift_y)
    w = F.array(*[F.struct(F.lit(i).alias("iy"), F.lit(j).alias("ix"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    # A pixel at dx carries flux to dx - fx: between dx - 1 (share fx) and dx (share 1 - fx).
    moved = stamps.withColumn("_w", F.explode(w)).select(*keys, frame, (F.col("dy") - F.col("_w.iy")).alias("dy"), (F.col("dx") - F.col("_w.ix")).alias("dx"), (F.col(value) * F.col("_w.w")).alias("v"))
    n = stamps.groupBy(*keys).agg(F.count_distinct(frame).alias("n_stamps"))
    mean = moved.filter((F.abs("dy") < half) & (F.abs("dx") < half)).groupBy(*keys, "dy", "dx").agg(F.sum("v").alias("v")).join(n, list(keys)).withColumn("v", F.col("v") / F.col("n_stamps"))
    floor_ = exact_percentiles(mean, keys, {"_med": ("v", 0.5)}, largest=1)
    near = mean.join(floor_, list(keys)).filter((F.abs("dy") <= window) & (F.abs("dx") <= window)).withColumn("_p", F.greatest(F.col("v") - F.col("_med"), F.lit(0.0)))
    out = near.groupBy(*keys).agg((F.sum(F.col("_p") * F.col("dx")) / F.sum("_p")).alias("dx"), (F.sum(F.col("_p") * F.col("dy")) / F.sum("_p")).alias("dy"), F.first("n_stamps").alias("n_stamps"))
    return out.filter(F.col("n_stamps") >= min_stamps)


def psf_likeness(stamps: DataFrame, models: DataFrame, keys: Sequence[str], pixel: Sequence[str], shift: str, value: str = "v", model: str = "p") -> DataFrame:
    """The best of a grid of shifted models per stamp by residual, its correlation and difference.

    ``models`` has one normalised model per shift; every stamp meets the fixed shift grid.
    """
    keys = list(keys)
    norm = stamps.groupBy(*keys).agg(F.sum(value).alias("_total"))
    rows = stamps.join(norm, keys).join(broadcast_if_small(models), list(pixel))
    v = F.col(value) / F.col("_total")
    score = rows.groupBy(*keys, shift).agg(F.sum((v - F.col(model)) ** 2).alias("residual"), F.corr(value, model).alias("psf_like"), F.sum(F.abs(v - F.col(model))).alias("psf_diff"))
    return score.groupBy(*keys).agg(F.min(F.struct("residual", shift, "psf_like", "psf_diff")).alias("_b")).select(*keys, "_b.*")


def stack_or_frame(stamps: DataFrame, keys: Sequence[str], frame: str, core: Column, value: str = "v", exposure: float = 600.0) -> DataFrame:
    """Signal-to-noise of the core in each frame and in the stack, and the better of the two."""
    keys = list(keys)

    def snr(df: DataFrame, part: list[str]) -> DataFrame:
        good = sigma_clip(df, part, value, 3.0, 5).filter("kept").groupBy(*part).agg(F.stddev_pop(value).alias("_noise"))
        s = df.groupBy(*part).agg(F.sum(F.when(core, F.col(value))).alias("_f"), F.count_if(core).alias("_npix")).join(good, part)
        return s.select(*part, (F.col("_f") / F.sqrt(F.col("_npix") * F.col("_noise") ** 2 + F.greatest(F.col("_f"), F.lit(0.0)) / exposure)).alias("snr"))

    single = snr(stamps, [*keys, frame]).groupBy(*keys).agg(F.min(F.struct((-F.col("snr")).alias("s"), frame)).alias("_b"))
    pix = [c for c in stamps.columns if c not in (*keys, frame, value)]
    stacked = snr(stamps.groupBy(*keys, *pix).agg(F.sum(value).alias(value)), keys)
    both = single.join(stacked, keys)
    use_frame = -F.col("_b.s") >= F.col("snr")
    return both.select(*keys, F.when(use_frame, -F.col("_b.s")).otherwise(F.col("snr")).alias("snr_psf"), F.when(use_frame, F.col(f"_b.{frame}")).alias("best_frame"), (~use_frame).cast("long").alias("psf_stacked"))


def local_noise(positions: DataFrame, pixels: DataFrame, keys: Sequence[str], row: str, size: tuple[int, int], value: str = "v", inner: float = 2.0, outer: int = 11) -> DataFrame:
    """Standard deviation of the pixels around each source, the centre left out, borders repeated."""
    offs = [o for o in offsets(outer, square=True) if o[0] ** 2 + o[1] ** 2 > inner * inner]
    return stamp_pixels(positions, pixels, keys, offs, row, clamp=size).groupBy(*keys, row).agg(F.stddev_pop(value).alias("bkg_std"))


def resolve_units(df: DataFrame, zeropoints: DataFrame, keys: Sequence[str], units: str, flux: str = "flux", err: str = "flux_err") -> DataFrame:
    """Convert with the unit's zero-point; without one the counts stay."""
    out = attach(df, zeropoints.select(*keys, F.col("zp_ab").alias("_zp")), keys)
    f, e = convert_flux(flux, err, units, F.col("_zp"))
    have = F.col("_zp").isNotNull()
    return out.withColumns({"_f": F.when(have, f).otherwise(F.col(flux)), "_e": F.when(have, e).otherwise(F.col(err)), "units": F.when(have, F.lit(units)).otherwise(F.lit("counts"))}).drop(
        "_zp", flux, err).withColumnsRenamed({"_f": flux, "_e": err})


def calibration_zeropoint(stars: DataFrame, keys: Sequence[str], mag: str, max_err_factor: float = 3.0, tolerance: float = 1e-3, rounds: int = 100) -> DataFrame:
    """Zero-point of a unit from fitted star fluxes, refitted on the stars that agree with it.

    ``stars`` has flux, e_flux and a catalogue magnitude; A16's error mask and A11's binned
    combine are applied, outliers beyond five scatters leave, until the zero-point settles; ``converged``
    tells whether every unit did within ``rounds``.
    """
    from skyloom.operators.filters import keep_good_errors
    from skyloom.operators.robust import binned_zeropoint
    from skyloom.session import cut_lineage

    keys = list(keys)
    good = stars.filter("flux > 0").withColumns({"zp_ab": F.col(mag) + 2.5 * F.log10("flux"), "e_zp": 1.0857 * F.col("e_flux") / F.col("flux"), "rp": F.col(mag)})
    good = keep_good_errors(good, "e_zp", keys, max_err_factor).select(*keys, "zp_ab", "rp")
    cur, zp = good, None
    for _ in range(rounds):
        new = cut_lineage(binned_zeropoint(cur, keys))
        if zp is not None:
            step = new.join(zp.select(*keys, F.col("zp_ab").alias("_old")), keys).agg(F.max(F.abs(F.col("zp_ab") - F.col("_old")))).first()[0]
            if step is None or step < tolerance:
                return new.withColumn("converged", F.lit(True))
        zp = new
        # A unit has many stars: its limits go to them, not they to it.
        lim = attach_few(good, zp.select(*keys, F.col("zp_ab").alias("_z"), F.col("zp_scatter").alias("_s")), keys)
        cur = lim.filter(F.abs(F.col("zp_ab") - F.col("_z")) <= F.greatest(5 * F.col("_s"), F.lit(1e-6))).drop("_z", "_s")
    return zp.withColumn("converged", F.lit(False))
