"""Robust and calibration statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import c4
from skyloom.functions.photometry import scale_to_zp, zp_to_scale
from skyloom.operators.skew import OrderedScan, attach, broadcast_if_small, exact_percentiles, largest_group
from skyloom.session import cut_lineage

MAD_TO_SIGMA = 1.4826


def _attach_any(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics back on rows; without keys they are one row."""
    return attach(df, stats, keys) if keys else df.crossJoin(F.broadcast(stats))


def median_mad(df: DataFrame, keys: Sequence[str], col: str, largest: int | None = None) -> DataFrame:
    """Exact median and median absolute deviation per key (two passes)."""
    keys = list(keys)
    med = exact_percentiles(df, keys, {"median": (col, 0.5)}, largest=largest)
    dev = _attach_any(df.select(*keys, col), med, keys).withColumn("_dev", F.abs(F.col(col) - F.col("median")))
    mad = exact_percentiles(dev, keys, {"mad": ("_dev", 0.5)}, largest=largest)
    return med.join(mad, keys) if keys else med.crossJoin(F.broadcast(mad))


def sigma_clip(df: DataFrame, keys: Sequence[str], col: str, nsigma: float = 3.0, max_iter: int = 5, library: bool = False) -> DataFrame:
    """Iterative clip around the median by population standard deviations; adds ``kept``.

    By default a value on a bound goes and every round looks at all rows again.  With ``library``
    (A5, P2, P7) a value on a bound stays, so that equal values survive a deviation of 0, and
    what one round rejected never returns: the bounds only narrow.  A round is one aggregate
    over the rows inside the last bounds; only one row per key moves on.  The loop ends when no
    key's statistics change.
    """
    keys = list(keys)
    # Every round reads the values: they are projected and materialised once, not recomputed per round.
    good = cut_lineage(df.filter(F.col(col).isNotNull() & ~F.isnan(col)).select(*keys, col))
    largest = largest_group(good, keys)
    low, high = F.col("_lo"), F.col("_hi")
    inside = (F.col(col) >= low) & (F.col(col) <= high) if library else (F.col(col) > low) & (F.col(col) < high)
    bounds, seen = None, None
    for _ in range(max_iter):
        cur = good if bounds is None else _attach_any(good, bounds, keys).filter(inside)
        stat = exact_percentiles(cur, keys, {"_med": (col, 0.5)}, largest=largest, also=[F.stddev_pop(col).alias("_std"), F.count(F.lit(1)).alias("_n")])
        stat = cut_lineage(stat.select(*keys, "_n", "_med", "_std"))
        now = stat.agg(F.sum("_n"), F.sum("_med"), F.sum("_std"), F.count(F.lit(1))).first()
        if now == seen:
            break
        seen = now
        new = stat.select(*keys, (F.col("_med") - nsigma * F.col("_std")).alias("_lo"), (F.col("_med") + nsigma * F.col("_std")).alias("_hi"))
        if library and bounds is not None:
            old = bounds.select(*keys, F.col("_lo").alias("_plo"), F.col("_hi").alias("_phi"))
            both = new.join(old, keys) if keys else new.crossJoin(F.broadcast(old))
            new = cut_lineage(both.select(*keys, F.greatest("_lo", "_plo").alias("_lo"), F.least("_hi", "_phi").alias("_hi")))
        bounds = new
    return _attach_any(df, bounds, keys).withColumn("kept", F.coalesce(inside, F.lit(False))).drop("_lo", "_hi")


def sigma_cut_average(df: DataFrame, keys: Sequence[str], col: str, noise: str | None = None, nsigma: float | None = 3.0, max_iter: int = 10,
                      mask: str | None = None, mask_bits: int | None = None, first_median: bool = True, sigma_cut: bool = False,
                      first_percentile: float | None = None, percentile_min: int = 3) -> tuple[DataFrame, DataFrame]:
    """Iterative sigma-cut average per key.

    Returns (statistics, rows with ``good``).  The first round may use the median or a
    percentile cut; with ``noise`` and without ``sigma_cut`` the cut is in units of each row's
    error and the mean is inverse-variance weighted.  Rows are always cut against the
    last statistics, so one row per key is all that is carried; keys converge independently.
    """
    keys = list(keys)
    by_error = noise is not None and not sigma_cut
    x = F.col(col).cast("double")
    e = F.col(noise).cast("double") if noise else None
    m = F.col(mask).cast("long") if mask else None
    masked = F.lit(False) if mask is None else F.coalesce(m != 0 if mask_bits is None else m.bitwiseAND(F.lit(mask_bits).cast("long")) != 0, F.lit(False))
    present = x.isNotNull() & ~F.isnan(x)
    if e is not None:
        present = present & e.isNotNull() & ~F.isnan(e)
    base = df.withColumns({"_masked": masked, "_use": ~masked & present})
    use = base.filter("_use").drop("_masked", "_use")
    counts = base.groupBy(*keys).agg(F.count_if("_masked").alias("n_mask"), F.count_if(~F.col("_masked") & ~F.col("_use")).alias("n_nan"), F.count_if("_use").alias("_total"))

    def passes(mean: str, stdev: str) -> Column:
        return F.coalesce(F.abs(x - F.col(mean)) <= (nsigma * e if by_error else nsigma * F.col(stdev)), F.lit(True))

    def statistics(good: DataFrame, median_round: bool) -> DataFrame:
        n = F.count(F.lit(1))
        if median_round:
            centre = exact_percentiles(good, keys, {"mean": (col, 0.5), **({"_em": (noise, 0.5)} if by_error else {})})
            centre = centre.join(good.groupBy(*keys).agg(n.alias("n_good")), keys) if keys else centre.crossJoin(F.broadcast(good.agg(n.alias("n_good"))))
        else:
            mean = F.sum(x / (e * e)) / F.sum(1 / (e * e)) if by_error else F.avg(x)
            centre = good.groupBy(*keys).agg(n.alias("n_good"), mean.alias("mean"), F.stddev_samp(x).alias("_sd"),
                                             *([F.sqrt(1 / F.sum(1 / (e * e))).alias("_em")] if by_error else []))
        r2 = (x - F.col("mean")) ** 2
        sums = _attach_any(good, centre.select(*keys, "mean"), keys).groupBy(*keys).agg(
            F.sum(r2).alias("_ss"), *([F.sum(r2 / (e * e)).alias("_x2")] if e is not None else []))
        both = centre.join(sums, keys) if keys else centre.crossJoin(F.broadcast(sums))
        nd = F.col("n_good").cast("double")
        stdev = F.sqrt(F.col("_ss") / (nd - 1)) / c4("n_good") if median_round else F.col("_sd")
        both = both.withColumn("stdev", F.when(nd > 1, stdev))
        if by_error:
            err = F.col("_em") / F.sqrt(nd - 1) if median_round else F.col("_em")
        else:
            err = F.col("stdev") / F.sqrt(nd - 1)
        x2 = (F.col("_x2") if e is not None else F.col("_ss") / (F.col("stdev") ** 2)) / (nd - 1)
        return both.select(*keys, "n_good", "mean", "stdev", F.when(nd > 1, err).alias("mean_err"), F.when(nd > 1, x2).alias("x2norm"))

    def first_rows() -> DataFrame:
        if first_percentile is None or by_error:
            return use
        centre = exact_percentiles(use, keys, {"_c": (col, 0.5)}) if first_median else use.groupBy(*keys).agg(F.avg(x).alias("_c"))
        res = _attach_any(use, centre, keys).withColumn("_res", F.abs(x - F.col("_c")))
        res = _attach_any(res, exact_percentiles(res, keys, {"_cut": ("_res", first_percentile / 100)}), keys)
        sizes = res.groupBy(*keys).agg(F.count_if(F.col("_res") < F.col("_cut")).alias("_nb"), F.count(F.lit(1)).alias("_na"))
        rank = OrderedScan(_attach_any(res, sizes, keys), keys, ["_res"]).row_number("_rk").done()
        ok = F.when(F.col("_na") <= percentile_min, F.lit(True)).when(F.col("_nb") >= percentile_min, F.col("_res") < F.col("_cut")).otherwise(F.col("_rk") <= percentile_min)
        return rank.filter(ok).drop("_c", "_res", "_cut", "_nb", "_na", "_rk")

    iterate = nsigma is not None and nsigma > 0
    cols = ["n_good", "mean", "stdev", "mean_err", "x2norm", "n_changed", "iterations", "converged", "done", "_cm", "_cs"]
    none = F.lit(None).cast("double")
    # _cm and _cs are the statistics the current good set was cut with.
    state = statistics(first_rows(), first_median and iterate).withColumns({
        "n_changed": F.lit(0).cast("long"), "iterations": F.lit(0).cast("long"), "converged": F.lit(not iterate),
        "done": F.lit(not iterate) | F.col("stdev").isNull(), "_cm": none, "_cs": none})
    state = cut_lineage(state.select(*keys, *cols))
    for i in range(1, max_iter):
        live = state.filter(~F.col("done"))
        if live.isEmpty():
            break
        mine = live.select(*keys, F.col("mean").alias("_pm"), F.col("stdev").alias("_ps"), F.col("_cm").alias("_qm"), F.col("_cs").alias("_qs"))
        rows = use.join(mine, keys) if keys else use.crossJoin(F.broadcast(mine))
        rows = rows.withColumns({"_now": passes("_pm", "_ps"), "_was": F.col("_qm").isNull() | passes("_qm", "_qs")})
        changed = rows.groupBy(*keys).agg(F.count_if(F.col("_now") != F.col("_was")).alias("n_changed"))
        stat = statistics(rows.filter("_now").drop("_pm", "_ps", "_qm", "_qs", "_now", "_was"), False)
        nxt = stat.join(changed, keys).join(mine, keys) if keys else stat.crossJoin(F.broadcast(changed)).crossJoin(F.broadcast(mine))
        stop = F.col("n_changed") == 0
        flat = F.col("stdev").isNull() if by_error else F.col("stdev").isNull() | (F.col("stdev") == 0)
        nxt = nxt.withColumns({"iterations": F.lit(i).cast("long"), "converged": stop & ~flat, "done": stop | flat, "_cm": F.col("_pm"), "_cs": F.col("_ps")})
        state = cut_lineage(nxt.select(*keys, *cols).unionByName(state.filter("done")))
    flagged = _attach_any(base, state.select(*keys, "_cm", "_cs"), keys)
    good = F.col("_use") & (F.col("_cm").isNull() | (passes("_cm", "_cs") if iterate else F.lit(True)))
    stats = state.join(counts, keys) if keys else state.crossJoin(F.broadcast(counts))
    nd = F.col("n_good").cast("double")
    stats = stats.select(
        *keys, "mean", "mean_err", "stdev", F.when(nd > 1, F.col("stdev") / F.sqrt(2 * nd)).alias("stdev_err"), "x2norm", "n_good",
        (F.col("_total") - F.col("n_good")).alias("n_clip"), "n_changed", "n_mask", "n_nan", "converged", "iterations")
    return stats, flagged.withColumn("good", good).drop("_masked", "_use", "_cm", "_cs")


def flag_event_frames(events: DataFrame, max_frame: int, nsigma: float = 7.0, keys: Sequence[str] = ()) -> DataFrame:
    """A5: mark events whose peak frame holds an outlying number of events."""
    frame = F.least(F.greatest(F.col("frame_max") * F.col("frame_bin"), F.lit(0)), F.lit(max_frame))
    tagged = events.withColumn("_pf", frame)
    counts = tagged.groupBy(*keys, "_pf").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    kept = sigma_clip(counts, keys, "_c", nsigma, library=True).filter("kept")
    med = exact_percentiles(kept, keys, {"_med": ("_c", 0.5)})
    std = kept.groupBy(*keys).agg(F.stddev_pop("_c").alias("_std"))
    limit = med.join(std, list(keys)) if keys else med.crossJoin(F.broadcast(std))
    bad = _attach_any(counts, limit, keys).withColumn("bad_frame_flag", (F.col("_c") > F.col("_med") + nsigma * F.col("_std")).cast("long"))
    flagged = attach(tagged, bad.select(*keys, "_pf", "bad_frame_flag"), [*keys, "_pf"]).drop("_pf")
    return flagged.withColumn("bad_frame_flag", F.coalesce("bad_frame_flag", F.lit(0).cast("long")))


def weighted_stats(df: DataFrame, key: str, weight: str, columns: Sequence[str], first: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Weighted mean and weighted variance per group; one-row groups keep value and NULL variance.

    The denominator is the sum of all weights, also of rows whose value is missing.
    """
    w = F.col(weight)
    sums = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s_{c}") for c in columns],
        *[F.first(c).alias(f"_v_{c}") for c in columns], *[F.min_by(c, order or c).alias(f"_f_{c}") for c in first])
    means = sums.select(key, "_n", "_w", *[F.when(F.col("_n") == 1, F.col(f"_v_{c}")).otherwise(F.col(f"_s_{c}") / F.col("_w")).alias(f"_m_{c}") for c in columns],
                        *[F.col(f"_f_{c}") for c in first])
    second = attach(df, means.select(key, *[f"_m_{c}" for c in columns]), [key]).groupBy(key).agg(
        *[F.sum(w * (F.col(c) - F.col(f"_m_{c}")) ** 2).alias(f"_q_{c}") for c in columns])
    both = means.join(second, key)
    return both.select(key, *[x for c in columns for x in (
        F.col(f"_m_{c}").alias(c), F.when(F.col("_n") > 1, F.col(f"_q_{c}") / F.col("_w")).alias(f"var_{c}"))], *[F.col(f"_f_{c}").alias(c) for c in first])


def stack_decision(df: DataFrame, key: str = "designation", sig: str = "sig", target: float = 5.0) -> DataFrame:
    """Whether and how deep to stack each track."""
    s = df.groupBy(key).agg(F.avg(sig).alias("avg_sig"), F.count(F.lit(1)).alias("n_frames"))
    need = F.greatest(F.ceil((target / F.col("avg_sig")) ** 2), F.lit(1)).cast("long")
    stacking = ~F.coalesce(F.col("avg_sig") > target, F.lit(False))
    n = F.when(~stacking, F.lit(1)).when((F.col("avg_sig") > 0) & (need <= F.col("n_frames")), need)
    return s.select(key, "avg_sig", stacking.alias("stacking_needed"), n.cast("long").alias("n_stack"), "n_frames")


def stack_tracks(df: DataFrame, decision: DataFrame, key: str = "designation", order: Sequence[str] = ("mjd",), flux: str = "flux", err: str = "e_flux") -> DataFrame:
    """Inverse-variance weighted mean per chunk of ``n_stack`` frames."""
    todo = decision.filter(F.col("stacking_needed") & F.col("n_stack").isNotNull()).select(key, "n_stack")
    rows = OrderedScan(df.join(todo, key), [key], list(order)).row_number("_rn").done()
    t, w = F.col(order[0]), 1 / (F.col(err) * F.col(err))
    out = rows.withColumn("bin_index", F.floor((F.col("_rn") - 1) / F.col("n_stack"))).groupBy(key, "bin_index").agg(
        F.avg(t).alias("mjd"), ((F.max(t) - F.min(t)) / 2).alias("mjd_err"), (F.sum(F.col(flux) * w) / F.sum(w)).alias("flux"),
        (1 / F.sqrt(F.sum(w))).alias("e_flux"), F.count(F.lit(1)).alias("n_frames"))
    return out.withColumn("sig", F.col("flux") / F.col("e_flux"))


def stack_summary(decision: DataFrame, stacked: DataFrame, key: str = "designation") -> DataFrame:
    """Decision with the significance that stacking achieved."""
    top = stacked.groupBy(key).agg(F.max("sig").alias("_top"))
    return decision.join(top, key, "left").withColumn(
        "achieved_sig", F.when(~F.col("stacking_needed"), F.col("avg_sig")).otherwise(F.col("_top"))).drop("_top")


def cut_offset(offsets: DataFrame, keys: Sequence[str] = (), min_sig: float = 8.0, min_tracks: int = 2) -> DataFrame:
    """Median offset over well detected tracks; NULL from too few."""
    good = offsets.filter(F.col("achieved_sig") >= min_sig)
    med = exact_percentiles(good, keys, {"offset_x": ("dx", 0.5), "offset_y": ("dy", 0.5)})
    n = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks_used"))
    both = n.join(med, list(keys)) if keys else n.crossJoin(F.broadcast(med))
    keep = lambda c: F.when(F.col("n_tracks_used") >= min_tracks, F.col(c)).alias(c)
    return both.select(*keys, keep("offset_x"), keep("offset_y"), "n_tracks_used")


def apparent_magnitude(df: DataFrame, key: str, zp: Column, min_sig: float = 3.0) -> DataFrame:
    """Median magnitude of positive, significant fluxes."""
    good = df.filter((F.col("flux") > 0) & (F.col("sig") > min_sig)).withColumn("_mag", zp - 2.5 * F.log10("flux"))
    return exact_percentiles(good, [key], {"mag_measured": ("_mag", 0.5)})


def zeropoint_summary(df: DataFrame, keys: Sequence[str], zp: str = "zp_ab", also: Sequence[Column] = ()) -> DataFrame:
    """Median in linear flux space, scatter as scaled MAD in magnitudes, count; ``also`` adds plain aggregates.

    The rows are read for the counts and for each of the two medians; few keys are broadcast to them.
    """
    keys = list(keys)
    n = cut_lineage(df.groupBy(*keys).agg(F.count(zp).alias("n"), F.count(F.lit(1)).alias("_rows"), *also))
    largest = n.agg(F.max("_rows")).first()[0] or 0
    n = n.drop("_rows")
    lin = df.withColumn("_lin", zp_to_scale(zp))
    med = cut_lineage(exact_percentiles(lin, keys, {"_m": ("_lin", 0.5)}, largest=largest).withColumn("zp", scale_to_zp("_m")).drop("_m"))
    few = df.select(*keys, zp)
    dev = (few.join(broadcast_if_small(med), keys, "left") if keys else few.crossJoin(F.broadcast(med))).withColumn("_dev", F.abs(F.col(zp) - F.col("zp")))
    mad = exact_percentiles(dev, keys, {"_mad": ("_dev", 0.5)}, largest=largest).withColumn("scatter", F.col("_mad") * MAD_TO_SIGMA).drop("_mad")
    return med.join(mad, keys).join(n, keys) if keys else med.crossJoin(F.broadcast(mad)).crossJoin(F.broadcast(n))


# Detector numbers of a camera's 2x2 block, upper row first, for the two
# lower and the two upper cameras of the strip.  Detectors of the upper row are turned by 180 degrees.
CCD_LOWER = [[4, 3], [1, 2]]
CCD_UPPER = [[2, 1], [3, 4]]


def focal_plane_cell(cam: str, ccd: str, n: int = 1, cut: str | None = None, north: bool = False) -> tuple[Column, Column]:
    """(row, column), from the lower left, of a detector or of a cut of its n x n split."""
    place = F.when(F.lit(north), 4 - F.col(cam)).otherwise(F.col(cam) - 1).cast("int")

    def where(layout, axis):
        entries = [(layout[i][j], (i, j)[axis]) for i in (0, 1) for j in (0, 1)]
        return F.element_at(F.create_map(*[F.lit(v) for pair in entries for v in pair]), F.col(ccd).cast("int"))

    i, j = (F.when(place < 2, where(CCD_LOWER, axis)).otherwise(where(CCD_UPPER, axis)) for axis in (0, 1))
    row, column = place * 2 + (1 - i), j
    if cut is not None:
        k = F.col(cut).cast("long") - 1
        a, b = F.floor(k / n), k % n
        turned = i == 0
        row = row * n + F.when(turned, n - 1 - a).otherwise(a)
        column = column * n + F.when(turned, n - 1 - b).otherwise(b)
    return row.cast("long"), column.cast("long")


def focal_plane_grid(df: DataFrame, keys: Sequence[str] = (), zp: str = "zp_ab", n: int = 1, cut: str | None = None) -> DataFrame:
    """Combined zero-point per grid cell."""
    row, col = focal_plane_cell("cam", "ccd", n, cut)
    return zeropoint_summary(df.withColumns({"row": row, "col": col}), [*keys, "row", "col"], zp)


def binned_zeropoint(df: DataFrame, keys: Sequence[str], zp: str = "zp_ab", mag: str = "rp", width: float = 0.5, min_n: int = 5) -> DataFrame:
    """Magnitude-binned robust combine, in linear flux space.

    Bins with fewer than ``min_n`` stars or no scatter are left out; with fewer than two usable
    bins (or stars) the global median and MAD are used.
    """
    keys = list(keys)
    ok = df.filter(F.col(zp).isNotNull() & F.col(mag).isNotNull()).withColumn("_b", F.floor(F.col(mag) / width))
    part = [*keys, "_b"]
    bins = cut_lineage(zeropoint_summary(ok, part, zp, [F.stddev_pop(zp).alias("_sd")]))
    stars = bins.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_stars"))
    bins = bins.withColumn("scatter", F.when(F.col("scatter") > 0, F.col("scatter")).otherwise(F.col("_sd")))
    bins = bins.filter((F.col("n") >= min_n) & (F.col("scatter") > 0))
    w = F.col("n") / (F.col("scatter") * F.col("scatter"))
    comb = bins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bins"), scale_to_zp(F.sum(w * zp_to_scale("zp")) / F.sum(w)).alias("_zp"), F.sqrt(1 / F.sum(w)).alias("_e"),
        (F.sum(w * F.col("scatter")) / F.sum(w)).alias("_s"))
    both = stars.join(comb, keys, "left") if keys else stars.crossJoin(F.broadcast(comb))
    both = cut_lineage(both.withColumn("_use", (F.col("n_stars") >= min_n) & (F.coalesce("n_bins", F.lit(0)) >= 2)))
    # Only units whose bins do not do need all their rows once more.
    rest = both.filter(~F.col("_use"))
    if rest.isEmpty():
        both = both.withColumns({"_gzp": F.lit(None).cast("double"), "_gs": F.lit(None).cast("double")})
    else:
        rows = ok.join(broadcast_if_small(rest.select(*keys)), keys, "left_semi") if keys else ok
        glob = zeropoint_summary(rows, keys, zp).drop("n").withColumnsRenamed({"zp": "_gzp", "scatter": "_gs"})
        both = both.join(glob, keys, "left") if keys else both.crossJoin(F.broadcast(glob))
    use, ge = F.col("_use"), F.col("_gs") / F.sqrt(F.greatest("n_stars", F.lit(1)))
    return both.select(*keys, F.when(use, F.col("_zp")).otherwise(F.col("_gzp")).alias("zp_ab"), F.when(use, F.col("_e")).otherwise(F.when(ge > 0, ge).otherwise(F.col("_gs"))).alias("e_zp_ab"),
                       F.when(use, F.col("_s")).otherwise(F.col("_gs")).alias("zp_scatter"), "n_stars")


def frame_noise(pixels: DataFrame, keys: Sequence[str], value: str, largest: int | None = None) -> DataFrame:
    """Scaled spatial MAD per frame."""
    return median_mad(pixels, keys, value, largest).select(*keys, (F.col("mad") * MAD_TO_SIGMA).alias("sigma_bg"))


def detection_limits(pixels: DataFrame, keys: Sequence[str], frame: str, pixel: Sequence[str], value: str, zp: Column | float, noise_factor: float, n_bin: int, label: str) -> DataFrame:
    """3, 5 and 10 sigma limiting magnitudes of frames averaged in blocks of ``n_bin``; the rest block is dropped."""
    keys = list(keys)
    z = F.lit(float(zp)) if isinstance(zp, (int, float)) else zp
    frames = OrderedScan(pixels.select(*keys, frame).distinct(), keys, [frame]).row_number("_rn").done()
    frames = frames.withColumn("bin_index", F.floor((F.col("_rn") - 1) / n_bin)).drop("_rn")
    full = frames.groupBy(*keys, "bin_index").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_bin).drop("_n")
    frames = frames.join(full, [*keys, "bin_index"], "left_semi")
    binned = pixels.join(frames, [*keys, frame]).groupBy(*keys, "bin_index", *pixel).agg(F.avg(value).alias("_v"))
    noise = frame_noise(binned, [*keys, "bin_index"], "_v")
    lim = lambda s: F.when(F.col("sigma_bg") > 0, z - 2.5 * F.log10(s * F.col("sigma_bg") * noise_factor))
    return noise.select(F.lit(label).alias("label"), *keys, "bin_index", "sigma_bg", lim(3).alias("mag_lim_3sigma"), lim(5).alias("mag_lim_5sigma"), lim(10).alias("mag_lim_10sigma"))


def wcs_residuals(df: DataFrame, keys: Sequence[str], dx: str, dy: str) -> DataFrame:
    """68th percentile of |dx|, |dy| and median offsets per tile."""
    return exact_percentiles(df, keys, {"dx_68": (F.abs(F.col(dx)), 0.68), "dy_68": (F.abs(F.col(dy)), 0.68), "dx_med": (dx, 0.5), "dy_med": (dy, 0.5)})


def snr_error_bins(df: DataFrame, snr: str, dx: str, dy: str, low: float, high: float, bins: int) -> DataFrame:
    """68th percentile of the absolute errors per logarithmic signal-to-noise bin."""
    import math

    b = F.width_bucket(F.log10(snr), F.lit(math.log10(low)), F.lit(math.log10(high)), F.lit(bins))
    tagged = df.withColumn("snr_bin", b).filter(F.col("snr_bin").between(1, bins))
    n = tagged.groupBy("snr_bin").agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg(F.log(F.col(snr)))).alias("snr_mid"))
    q = exact_percentiles(tagged, ["snr_bin"], {"x_68": (F.abs(F.col(dx)), 0.68), "y_68": (F.abs(F.col(dy)), 0.68)})
    return n.join(q, "snr_bin")


def fit_error_curve(snr: np.ndarray, err: np.ndarray) -> tuple[float, float, float]:
    """(a, b, c) of sqrt((a snr^-b)^2 + c^2) through the few bin values, by a nested grid on (b, c)."""
    best = (np.inf, 1.0, 1.0, 0.0)
    b_lo, b_hi, c_lo, c_hi = 0.05, 3.0, 0.0, float(np.min(err))
    for _ in range(6):
        for b in np.linspace(b_lo, b_hi, 41):
            basis = snr ** (-2 * b)
            for c in np.linspace(c_lo, c_hi, 41):
                a2 = max(0.0, float(np.sum(basis * (err**2 - c**2)) / np.sum(basis**2)))
                cost = float(np.sum((np.sqrt(a2 * basis + c * c) - err) ** 2))
                if cost < best[0]:
                    best = (cost, a2**0.5, b, c)
        wb, wc = (b_hi - b_lo) / 10, (c_hi - c_lo) / 10
        b_lo, b_hi = max(0.01, best[2] - wb), best[2] + wb
        c_lo, c_hi = max(0.0, best[3] - wc), best[3] + wc
    return best[1:]


def reference_frame(tiles: DataFrame, keys: Sequence[str], quality_bits: int = 7407) -> DataFrame:
    """The frame whose tile medians are all low: the smallest percentile p = 5, 6, ... at which a
    frame has every tile at or below that percentile of the tile, then the least sum of medians.

    ``tiles`` has frame, tile, value and quality; frames with any of the bits set are out.
    """
    keys = list(keys)
    good = tiles.filter(F.col("quality").bitwiseAND(F.lit(quality_bits).cast("long")) == 0)
    med = exact_percentiles(good, [*keys, "frame", "tile"], {"med": ("value", 0.5)})
    probs = {f"_p{p}": ("med", p / 100) for p in range(5, 101)}
    limits = exact_percentiles(med, [*keys, "tile"], probs)
    both = attach(med, limits, [*keys, "tile"])
    # The least percentile at which each tile passes; a frame passes when its worst tile does.
    first = F.array_min(F.filter(F.array(*[F.when(F.col("med") <= F.col(f"_p{p}"), F.lit(p)) for p in range(5, 101)]), lambda v: v.isNotNull()))
    frames = both.withColumn("_need", F.coalesce(first, F.lit(100))).groupBy(*keys, "frame").agg(F.max("_need").alias("percentile"), F.sum("med").alias("sum_med"))
    pick = frames.groupBy(*keys).agg(F.min(F.struct("percentile", "sum_med", "frame")).alias("_b"))
    return pick.select(*keys, "_b.frame", "_b.percentile", "_b.sum_med")


def polynomial_terms(order: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]


def polynomial_fit(df: DataFrame, x: str, y: str, targets: Sequence[str], order: int, keep: Column | None = None) -> DataFrame:
    """Least-squares polynomial surfaces through normal-equation sums.

    One aggregate of at most (2 order + 1)(order + 1) moments leaves the executors, whatever
    the number of rows; the small system is solved from that single row.
    """
    rows = df.filter(keep) if keep is not None else df
    terms = polynomial_terms(order)
    power = lambda p, q: F.pow(F.col(x), F.lit(float(p))) * F.pow(F.col(y), F.lit(float(q)))
    moments = sorted({(a + c, b + d) for a, b in terms for c, d in terms})
    aggs = [F.sum(power(p, q)).alias(f"m_{p}_{q}") for p, q in moments]
    aggs += [F.sum(F.col(t) * power(p, q)).alias(f"t_{t}_{p}_{q}") for t in targets for p, q in terms]
    row = rows.agg(*aggs).first()
    a = np.array([[row[f"m_{p + r}_{q + s}"] for r, s in terms] for p, q in terms])
    scale = np.sqrt(np.diag(a))
    out = []
    for t in targets:
        rhs = np.array([row[f"t_{t}_{p}_{q}"] for p, q in terms])
        sol = np.linalg.lstsq(a / np.outer(scale, scale), rhs / scale, rcond=None)[0] / scale
        out += [(t, p, q, float(c)) for (p, q), c in zip(terms, sol)]
    return df.sparkSession.createDataFrame(out, "target string, p int, q int, coefficient double")


def clipped_polynomial_fit(df: DataFrame, x: str, y: str, target: str, order: int, nsigma: float = 3.0, max_iter: int = 5) -> DataFrame:
    """A24 with A13's cut: refit without rows beyond ``nsigma`` standard deviations of the residuals."""
    keep, last = None, -1
    for _ in range(max_iter):
        coeffs = polynomial_fit(df, x, y, [target], order, keep)
        model = F.lit(0.0)
        for r in coeffs.collect():  # a few dozen coefficients
            model = model + r["coefficient"] * F.pow(F.col(x), F.lit(float(r["p"]))) * F.pow(F.col(y), F.lit(float(r["q"])))
        resid = F.col(target) - model
        stats = (df.filter(keep) if keep is not None else df).agg(F.avg(resid), F.stddev_samp(resid)).first()
        keep = F.abs(resid - stats[0]) <= nsigma * stats[1]
        n = df.filter(keep).count()
        if n == last:
            break
        last = n
    return coeffs


def keyed_polynomial_fits(df: DataFrame, keys: Sequence[str], x: str, y: str, targets: Sequence[str], order: int, fixed: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """A24 for many tiles at once: (keys, n, <target>_c: coefficients in the order of ``polynomial_terms``).

    The sums of all keys are one aggregate, solved row by row in Arrow batches; rows with a NULL key or a NULL or NaN input
    are left out.  ``fixed`` holds coefficients that are given instead of fitted (a constant of 0, or a scale of 1 without rotation).
    Coordinates are centred and scaled per key before the sums, which keeps high orders accurate, and turned back after.
    A key with fewer distinct equations than free terms has NULL coefficients.
    """
    keys, targets, fixed = list(keys), list(targets), dict(fixed or {})
    terms = polynomial_terms(order)
    free = [t for t in terms if t not in fixed]
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in (x, y, *targets)] + [F.col(k).isNotNull() for k in keys]
    rows = df.filter(reduce(and_, ok))
    box = rows.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"_{n}{c_}") for c, c_ in ((x, "x"), (y, "y")) for n, f in (("lo", F.min), ("hi", F.max))])
    mid = lambda a: (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2
    half = lambda a: F.when(F.col(f"_hi{a}") > F.col(f"_lo{a}"), (F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2).otherwise(F.lit(1.0))
    box = box.select(*keys, mid("x").alias("_mx"), mid("y").alias("_my"), half("x").alias("_hx"), half("y").alias("_hy"))
    u, v = (F.col(x) - F.col("_mx")) / F.col("_hx"), (F.col(y) - F.col("_my")) / F.col("_hy")
    scaled = attach(rows, box, keys).withColumns({"_u": u, "_v": v})
    power = lambda p, q: F.pow("_u", F.lit(float(p))) * F.pow("_v", F.lit(float(q)))
    moments = sorted({(a + c, b + d) for a, b in terms for c, d in terms})
    given = reduce(lambda s, t: s + fixed[t] * F.pow(F.col(x), F.lit(float(t[0]))) * F.pow(F.col(y), F.lit(float(t[1]))), fixed, F.lit(0.0))
    sums = scaled.groupBy(*keys, "_mx", "_my", "_hx", "_hy").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(power(p, q)) for p, q in moments]).alias("_m"),
        F.array(*[F.sum((F.col(t) - given) * power(p, q)) for t in targets for p, q in terms]).alias("_t"))
    types = dict(sums.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "n"]) + "".join(f", `{t}_c` array<double>" for t in targets)
    place = {m: i for i, m in enumerate(moments)}
    look = np.array([[place[p + r, q + s] for r, s in terms] for p, q in terms])

    def solve(batches):
        for pdf in batches:
            out = pdf[[*keys, "n"]].copy()
            found: dict[str, list] = {t: [] for t in targets}
            for r in range(len(pdf)):
                mx, my, hx, hy = (float(pdf[c].iat[r]) for c in ("_mx", "_my", "_hx", "_hy"))
                a = np.asarray(pdf["_m"].iat[r], float)[look]
                # Each free power of (x, y) as a sum of powers of the scaled coordinates.
                back = np.zeros((len(free), len(terms)))
                for i, (p, q) in enumerate(free):
                    for j, (k, m) in enumerate(terms):
                        if k <= p and m <= q:
                            back[i, j] = comb(p, k) * comb(q, m) * mx ** (p - k) * hx**k * my ** (q - m) * hy**m
                if len(free) == len(terms):
                    g, scale = a, np.sqrt(np.maximum(np.diag(a), 1e-300))
                else:
                    g = back @ a @ back.T
                    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
                g = g / np.outer(scale, scale)
                solvable = pdf["n"].iat[r] >= len(free) and np.linalg.matrix_rank(g, hermitian=True) == len(free)
                for i, t in enumerate(targets):
                    if not solvable:
                        found[t].append(None)
                        continue
                    b = np.asarray(pdf["_t"].iat[r], float)[i * len(terms):(i + 1) * len(terms)]
                    if len(free) == len(terms):
                        c = np.linalg.solve(back.T, np.linalg.solve(g, b / scale) / scale)
                    else:
                        c = np.linalg.solve(g, back @ b / scale) / scale
                    by = {**fixed, **dict(zip(free, c))}
                    found[t].append([float(by[k]) for k in terms])
            for t in targets:
                out[f"{t}_c"] = found[t]
            yield out

    return sums.mapInPandas(solve, schema)


def polynomial_value(x: str, y: str, coefficients: str, order: int) -> Column:
    """The surface of ``keyed_polynomial_fits`` at (x, y)."""
    parts = [F.get(coefficients, F.lit(i)) * F.pow(F.col(x), F.lit(float(p))) * F.pow(F.col(y), F.lit(float(q))) for i, (p, q) in enumerate(polynomial_terms(order))]
    return reduce(lambda a, b: a + b, parts)


def clipped_keyed_fits(df: DataFrame, keys: Sequence[str], x: str, y: str, targets: Sequence[str], order: int, nsigma: float = 3.0, rounds: int = 20, fixed: dict[tuple[int, int], float] | None = None) -> tuple[DataFrame, DataFrame]:
    """A24 with a clip for all keys at once: (fits, rows with ``kept``).

    A round fits every target on the kept rows and drops those beyond ``nsigma`` population deviations from the mean residual in
    any of them; it ends when no key loses a row (or after ``rounds``, as the single fit's rule has it).
    """
    keys, targets = list(keys), list(targets)
    rows = cut_lineage(df.withColumn("kept", reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in (x, y, *targets)] + [F.col(k).isNotNull() for k in keys])))
    for n in range(rounds + 1):
        fits = keyed_polynomial_fits(rows.filter("kept"), keys, x, y, targets, order, fixed)
        fits = cut_lineage(fits)
        if n == rounds:
            break
        both = attach(rows, fits.drop("n"), keys).withColumns({f"_r{i}": F.col(t) - polynomial_value(x, y, f"{t}_c", order) for i, t in enumerate(targets)})
        stats = both.filter("kept").groupBy(*keys).agg(*[f(f"_r{i}").alias(f"_{a}{i}") for i in range(len(targets)) for a, f in (("m", F.avg), ("s", F.stddev_pop))])
        far = [F.abs(F.col(f"_r{i}") - F.col(f"_m{i}")) > nsigma * F.col(f"_s{i}") + 1e-12 for i in range(len(targets))]
        after = attach(both, stats, keys).withColumn("_far", F.col("kept") & F.coalesce(reduce(or_, far), F.lit(False)))
        after = cut_lineage(after.select(*df.columns, (F.col("kept") & ~F.col("_far")).alias("kept"), "_far"))
        lost = after.filter("_far").limit(1).count()
        rows = after.drop("_far")
        if not lost:
            break
    return fits, rows
