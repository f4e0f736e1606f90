"""Light-curve features and classification."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from skyloom.operators.skew import OrderedScan, attach, exact_percentiles, spread
from skyloom.operators.spatial import pairs_within
from skyloom.session import cut_lineage

FEATURE_NAMES = ["amplitude", "hl_amp_ratio", "kurtosis", "max_95_gap", "mean_variance", "mean_abs_deviation", "period", "phase_cusum", "phase_mean_variance",
                 "phi21", "phi31", "quartile31", "r21", "r31", "shapiro_w", "skewness", "slope_per10", "slope_per90", "stetson_k", "weighted_std", "weighted_mean"]


def scale_and_trim(df: DataFrame, key: str, flux: str = "flux", low: float = 2.5, high: float = 97.5) -> DataFrame:
    """Z-score per series, then only values strictly inside the two percentiles.

    The percentiles are those of the values themselves, which the score keeps in order: sums added
    up twice may differ in their last bits, and a limit that falls on a value must not depend on them.
    """
    st = df.groupBy(key).agg(F.avg(flux).alias("_m"), F.stddev_pop(flux).alias("_s"))
    q = exact_percentiles(df, [key], {"_lo": (flux, low / 100), "_hi": (flux, high / 100)})
    inside = attach(attach(df, q, [key]), st, [key]).filter((F.col(flux) > F.col("_lo")) & (F.col(flux) < F.col("_hi")))
    z = inside.withColumn(flux, (F.col(flux) - F.col("_m")) / F.col("_s")).drop("_m", "_s", "_lo", "_hi")
    return z.filter(~F.isnan(flux))


def sequence_stats(df: DataFrame, key: str, order: Sequence[str], flux: str, centre: DataFrame, prefix: str = "") -> DataFrame:
    """Sum of squared steps and range of the cumulative sum around ``_centre`` per series."""
    rows = attach(df, centre.select(key, "_centre"), [key]).withColumn("_c", F.col(flux) - F.col("_centre"))
    scan = OrderedScan(rows, [key], list(order)).lag({"_p": flux}).running_sum("_cs", F.col("_c")).done()
    return scan.groupBy(key).agg(F.sum((F.col(flux) - F.col("_p")) ** 2).alias(prefix + "step2"), (F.max("_cs") - F.min("_cs")).alias(prefix + "cusum_range"))


def non_periodic_features(df: DataFrame, key: str, order: Sequence[str], flux: str = "flux") -> DataFrame:
    """Shape statistics of each series, with the series' own standard deviation as every point's error."""
    x = F.col(flux)
    st = df.groupBy(key).agg(
        F.count(flux).cast("double").alias("n"), F.avg(flux).alias("_centre"), F.stddev_pop(flux).alias("std"), F.skewness(flux).alias("skewness"), F.kurtosis(flux).alias("kurtosis"), F.max(flux).alias("_max"))
    q = exact_percentiles(df, [key], {"_med": (flux, 0.5), "_q25": (flux, 0.25), "_q75": (flux, 0.75), "_q95": (flux, 0.95)})
    both = st.join(q, key)
    rows = attach(df, both.select(key, "_centre", "_med", "std"), [key]).withColumn("_dev", F.abs(x - F.col("_med")))
    mad = exact_percentiles(rows, [key], {"mean_abs_deviation": ("_dev", 0.5)})
    res = (x - F.col("_med")) / F.col("std")
    up = x > F.col("_centre")
    d2 = (x - F.col("_centre")) ** 2
    second = rows.groupBy(key).agg(F.sum(F.abs(res)).alias("_r1"), F.sum(res * res).alias("_r2"), F.avg(F.when(up, d2)).alias("_hi2"), F.avg(F.when(~up, d2)).alias("_lo2"))
    seq = sequence_stats(df, key, order, flux, st)
    j = both.join(mad, key).join(second, key).join(seq, key)
    n, sd = F.col("n"), F.col("std")
    return j.select(
        key, "n", "skewness", "kurtosis", "mean_abs_deviation", F.col("_centre").alias("weighted_mean"), sd.alias("weighted_std"),
        (F.col("_r1") / F.sqrt("_r2") / F.sqrt(n)).alias("stetson_k"), (F.col("_q75") - F.col("_q25")).alias("quartile31"), (F.col("step2") / (n - 1) / sd**2).alias("mean_variance"),
        (F.col("cusum_range") / n / sd).alias("mm_cusum"), (1 - F.col("_q95") / F.col("_max")).alias("max_95_gap"), F.sqrt(F.col("_hi2") / F.col("_lo2")).alias("hl_amp_ratio"))


# Acklam's rational approximation of the normal quantile.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile with a relative error near 1e-9."""
    def poly(coeffs: Sequence[float], x: Column, tail: float | None = None) -> Column:
        out = F.lit(0.0)
        for c in coeffs:
            out = out * x + c
        return out if tail is None else out * x + tail

    q = p - 0.5
    central = poly(_A, q * q) * q / poly(_B, q * q, 1.0)
    edge = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(_C, edge) / poly(_D, edge, 1.0)
    return F.when((p >= 0.02425) & (p <= 1 - 0.02425), central).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def shapiro_w(df: DataFrame, key: str, flux: str = "flux", tie: str = "pt") -> DataFrame:
    """Shapiro-Wilk W by Royston's weights, from ranks and sums (n > 5)."""
    n_df = df.groupBy(key).agg(F.count(flux).cast("double").alias("n"), F.avg(flux).alias("_mean"))
    ranked = attach(OrderedScan(df.select(key, flux, tie), [key], [flux, tie]).row_number("_i").done(), n_df, [key])
    n, i, x = F.col("n"), F.col("_i"), F.col(flux)
    m = normal_quantile((i - 0.375) / (n + 0.25))
    ranked = ranked.withColumn("_q", m)
    last, prev = i == n, i == n - 1
    s = ranked.groupBy(key).agg(
        F.first("n").alias("n"), F.sum(F.col("_q") ** 2).alias("mm"), F.max(F.when(last, F.col("_q"))).alias("mn"), F.max(F.when(prev, F.col("_q"))).alias("mp"), F.sum((x - F.col("_mean")) ** 2).alias("ss"),
        F.max(F.when(last, x)).alias("xn"), F.max(F.when(prev, x)).alias("xp"), F.max(F.when(i == 1, x)).alias("x1"), F.max(F.when(i == 2, x)).alias("x2"),
        F.sum(F.when((i > 2) & (i < n - 1), F.col("_q") * x)).alias("inner"))
    u = 1 / F.sqrt("n")
    poly = lambda cs: sum((c * F.pow(u, F.lit(float(k))) for k, c in cs), F.lit(0.0))
    # Royston's polynomial corrections of the two outer weights.
    an = F.col("mn") / F.sqrt("mm") + poly([(1, 0.221157), (2, -0.147981), (3, -2.07119), (4, 4.434685), (5, -2.706056)])
    ap = F.col("mp") / F.sqrt("mm") + poly([(1, 0.042981), (2, -0.293762), (3, -1.752461), (4, 5.682633), (5, -3.582633)])
    s = s.withColumns({"an": an, "ap": ap})
    phi = (F.col("mm") - 2 * F.col("mn") ** 2 - 2 * F.col("mp") ** 2) / (1 - 2 * F.col("an") ** 2 - 2 * F.col("ap") ** 2)
    total = F.col("an") * (F.col("xn") - F.col("x1")) + F.col("ap") * (F.col("xp") - F.col("x2")) + F.col("inner") / F.sqrt(phi)
    return s.select(key, F.when(F.col("n") > 5, total * total / F.col("ss")).alias("shapiro_w"))


def frequency_grid(df: DataFrame, key: str, time: str, oversample: int = 5) -> DataFrame:
    """C4: (key, df, n_freq) of each series' own grid: steps of 1 / (``oversample`` x time span), from one
    step up to half the sampling rate (one over twice the median gap between different times)."""
    times = df.select(key, time).distinct()
    gaps = OrderedScan(times, [key], [time]).lag({"_before": time}).done().withColumn("_gap", F.col(time) - F.col("_before")).filter("_gap > 0")
    mid = exact_percentiles(gaps, [key], {"_median": ("_gap", 0.5)})
    span = times.groupBy(key).agg((F.max(time) - F.min(time)).alias("_span"))
    grid = span.join(mid, key).filter("_span > 0").withColumn("df", 1 / (oversample * F.col("_span")))
    return grid.select(key, "df", F.greatest(F.lit(0), F.ceil(1 / (2 * F.col("_median")) / F.col("df")) - 1).cast("long").alias("n_freq"))


FREQUENCIES = 4096  # of a block of a grid
POINTS = 16384  # of a pack of a series


def periodogram(df: DataFrame, key: str, time: str, flux: str, grid: DataFrame | None = None) -> DataFrame:
    """C4: least-squares amplitude at each frequency of a series' grid (key, df, n_freq); by default its own.

    Rows of one time are added up first, so that hashes of the times deal a series into packs of about
    ``POINTS`` of them.  A row per (series, pack, block of ``FREQUENCIES``) is the unit of work: no task
    holds a whole series or grid, and the sums of a block that are exchanged are few beside its
    products.  NULL times and fluxes are left out.
    """
    df = df.select(key, time, flux).filter(F.col(time).isNotNull() & F.col(flux).isNotNull())
    work = _work(df, key, time, flux, frequency_grid(df, key, time) if grid is None else grid)
    names = ["cc", "ss", "cs", "fc", "fs"]
    ktype = next(f.dataType for f in df.schema.fields if f.name == key)
    schema = StructType([StructField(key, ktype), StructField("j", LongType()), *[StructField(c, DoubleType()) for c in ("frequency", *names)]])
    part = work.mapInArrow(_block_sums, schema)
    s = part.groupBy(key, "j").agg(F.max("frequency").alias("frequency"), *[F.sum(n).alias(n) for n in names])
    # Where sine and cosine are not independent on the sampling there is no amplitude.
    det = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    det = F.when(det > 1e-9 * F.col("cc") * F.col("ss"), det)
    a = (F.col("fc") * F.col("ss") - F.col("fs") * F.col("cs")) / det
    b = (F.col("fs") * F.col("cc") - F.col("fc") * F.col("cs")) / det
    return s.select(key, "j", "frequency", F.sqrt(a * a + b * b).alias("power"))


def _work(df: DataFrame, key: str, time: str, flux: str, grid: DataFrame) -> DataFrame:
    """(key, df, n_freq, _block, t, f, w): packs of points, one row for each block of their grid."""
    mean = df.groupBy(key).agg(F.avg(flux).alias("_m"), F.min(time).alias("_t0"), F.count(F.lit(1)).alias("_n")).join(grid.filter("n_freq > 0"), key)
    points = df.groupBy(key, time).agg(F.sum(flux).alias("_f"), F.count(F.lit(1)).cast("double").alias("_w"))
    points = attach(points, mean, [key]).filter("n_freq > 0")
    point = F.struct((F.col(time) - F.col("_t0")).cast("double").alias("t"), (F.col("_f") - F.col("_w") * F.col("_m")).cast("double").alias("f"), F.col("_w").alias("w"))
    pack = F.pmod(F.xxhash64(time), F.ceil(F.col("_n") / POINTS)).alias("_pack")
    packs = points.select(key, "df", "n_freq", pack, point.alias("_p")).groupBy(key, "_pack").agg(
        F.first("df").alias("df"), F.first("n_freq").alias("n_freq"), F.collect_list("_p").alias("_p"))
    work = packs.select(key, "_pack", "df", "n_freq", *[F.col(f"_p.{c}").alias(c) for c in ("t", "f", "w")],
                        F.explode(F.sequence(F.lit(0), F.floor((F.col("n_freq") - 1) / FREQUENCIES).cast("int"))).alias("_block"))
    return spread(work, key, "_pack", "_block").select(key, "df", "n_freq", "_block", "t", "f", "w")


def _block_sums(batches):
    """Trigonometric sums of each pack of points at each frequency of its block."""
    m = 64
    for batch in batches:
        for i in range(batch.num_rows):
            step, n, block = (batch.column(c)[i].as_py() for c in (1, 2, 3))
            t, f, w = (batch.column(c)[i].values.to_numpy() for c in (4, 5, 6))
            first = block * FREQUENCIES + 1
            count = min(FREQUENCIES, n - first + 1)
            # exp(i j x) = exp(i (first + q m) x) exp(i r x): all sums of a block are one matrix
            # product, and those of the squares the same at twice the frequency.
            lead = first + m * np.arange(-(-count // m))
            one, twice = np.zeros((2, len(lead), m), dtype=complex)
            for lo in range(0, len(t), 2048):
                x = 2 * np.pi * step * t[lo:lo + 2048]
                coarse, fine = np.exp(1j * np.outer(lead, x)), np.exp(1j * np.outer(x, np.arange(m)))
                one += (coarse * f[lo:lo + 2048]) @ fine
                twice += (coarse ** 2 * w[lo:lo + 2048]) @ fine ** 2
            one, twice, j = one.reshape(-1)[:count], twice.reshape(-1)[:count], np.arange(first, first + count)
            columns = [j - 1, j * step, (w.sum() + twice.real) / 2, (w.sum() - twice.real) / 2, twice.imag / 2, one.real, one.imag]
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], count), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                                             [batch.schema.names[0], "j", "frequency", "cc", "ss", "cs", "fc", "fs"])


def _prominences(p: np.ndarray, peaks: np.ndarray, wlen: int) -> np.ndarray:
    half, out = wlen // 2, np.empty(len(peaks))
    for k, i in enumerate(peaks):
        lo, hi = max(0, i - half), min(len(p), i + half + 1)
        higher = np.flatnonzero(p[lo:i] > p[i])
        left = p[lo + higher[-1]:i + 1].min() if len(higher) else p[lo:i + 1].min()
        higher = np.flatnonzero(p[i + 1:hi] > p[i])
        right = p[i:i + 1 + higher[0]].min() if len(higher) else p[i:hi].min()
        out[k] = p[i] - max(left, right)
    return out


OPEN, KEPT, DROPPED = 0, 1, 2


def _thin(j: np.ndarray, height: np.ndarray, state: np.ndarray, distance: int, known: tuple[float, float]) -> np.ndarray:
    """States of the peaks (ascending ``j``) as far as those seen tell: the highest of a neighbourhood stays.

    ``known`` is the range of ``j`` that is seen whole; a peak whose neighbourhood reaches out of it can
    be dropped by a higher one that stays, but not kept.
    """
    state = state.copy()
    lows, highs = np.searchsorted(j, j - distance, side="right"), np.searchsorted(j, j + distance, side="left")
    for i in np.argsort(-height, kind="stable"):
        if state[i] != OPEN:
            continue
        near = np.arange(lows[i], highs[i])
        above = state[near[(height[near] > height[i]) | ((height[near] == height[i]) & (near < i))]]
        if (above == KEPT).any():
            state[i] = DROPPED
        elif (above == DROPPED).all() and j[i] - distance >= known[0] and j[i] + distance <= known[1]:
            state[i] = KEPT
    return state


def _dealt(df: DataFrame, block: int, halo: int) -> DataFrame:
    """Rows by ``_block`` of ``j``, those within ``halo`` of a border also to the block beyond it."""
    j = F.col("j")
    return df.withColumn("_block", F.explode(F.sequence(F.floor((j - halo) / block), F.floor((j + halo) / block)))).filter("_block >= 0")


def prominent_peaks(power: DataFrame, key: str, prominence: float = 3.0, distance: int = 20, wlen: int = 300, block: int = FREQUENCIES) -> DataFrame:
    """C4: (key, peak, peak_freq, peak_power, prominence, step): local maxima, the most prominent first.

    The power is measured in units of its mean; ``j`` counts a series' frequencies without gaps.  Of maxima
    closer than ``distance`` the highest stays.  Grids are cut into blocks with halos, so
    memory does not grow with a grid; what a block cannot decide, because it hangs on a chain of ever
    higher maxima that leaves its halo, is decided in further rounds over the maxima only.
    """
    halo = max(block // 4, wlen // 2 + 2, 2 * distance)
    grid = power.groupBy(key).agg(F.avg("power").alias("_mean"), F.max("j").alias("_last"), F.min("frequency").alias("_f0"), F.max("frequency").alias("_f1"))
    rows = attach(power, grid, [key]).withColumn("_p", F.coalesce(F.col("power") / F.col("_mean"), F.lit(0.0)))
    ktype = next(f.dataType for f in power.schema.fields if f.name == key)
    fields = [("j", LongType()), ("frequency", DoubleType()), ("power", DoubleType()), ("_p", DoubleType()), ("prominence", DoubleType()), ("_last", LongType()), ("_step", DoubleType()), ("_state", IntegerType())]
    schema = StructType([StructField(key, ktype), *[StructField(n, t) for n, t in fields]])
    names = [n for n, _ in fields]

    def seen(pdf: pd.DataFrame, number: int) -> tuple[float, float]:
        low, high = number * block - halo, (number + 1) * block + halo - 1
        return (-np.inf if low <= 0 else low), (np.inf if high >= pdf["_last"].iat[0] else high)

    def core(pdf: pd.DataFrame, number: int) -> pd.DataFrame:
        return pdf[pdf["j"] // block == number]

    def find(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j").reset_index(drop=True)
        p, j = pdf["_p"].to_numpy(float), pdf["j"].to_numpy()
        idx = np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:])) + 1
        out = pdf.iloc[idx].copy()
        # The outermost maxima of a halo may be missing.
        low, high = seen(pdf, k[1])
        out["_state"] = _thin(j[idx], p[idx], np.full(len(idx), OPEN), distance, (low + 1, high - 1)).astype(np.int32)
        mine = (out["j"] // block == k[1]).to_numpy()
        out = out[mine].copy()
        out["prominence"] = _prominences(p, idx[mine], wlen)
        return out[[key, *names]]

    def again(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j").reset_index(drop=True)
        low, high = seen(pdf, k[1])
        pdf["_state"] = _thin(pdf["j"].to_numpy(), pdf["_p"].to_numpy(), pdf["_state"].to_numpy(), distance, (low + 1, high - 1)).astype(np.int32)
        return core(pdf, k[1])[[key, *names]]

    step = F.when(F.col("_last") > 0, (F.col("_f1") - F.col("_f0")) / F.col("_last")).otherwise(0.0)
    first = _dealt(rows.select(key, "j", "frequency", "power", "_p", "_last", step.alias("_step")), block, halo)
    peaks = cut_lineage(first.groupBy(key, "_block").applyInPandas(find, schema))
    while not peaks.filter(f"_state = {OPEN}").isEmpty():
        peaks = cut_lineage(_dealt(peaks, block, halo).groupBy(key, "_block").applyInPandas(again, schema))
    kept = peaks.filter((F.col("_state") == KEPT) & (F.col("prominence") >= prominence)).withColumn("_order", -F.col("prominence"))
    ranked = OrderedScan(kept, [key], ["_order", "j"]).row_number("peak").done()
    return ranked.select(key, "peak", F.col("frequency").alias("peak_freq"), F.col("power").alias("peak_power"), "prominence", F.col("_step").alias("step"))


HEADS = 64  # peaks of a series that are looked at for new signals in one round


def periodogram_peaks(power: DataFrame, key: str, prominence: float = 3.0, distance: int = 20, wlen: int = 300, heads: int = HEADS) -> DataFrame:
    """C4: peaks by falling prominence, as signals and their harmonics.

    Each peak joins the first signal of whose leading frequency it is a harmonic, to a tenth and
    three grid steps; a peak that is of none leads a new signal.  A round finds the signals that the next
    ``heads`` peaks of every series lead and gives them all their harmonics.
    """
    return signals(prominent_peaks(power, key, prominence, distance, wlen), key, heads)


def signals(peaks: DataFrame, key: str, heads: int = HEADS) -> DataFrame:
    """C4: ``peaks`` with their signals and harmonics, as in ``periodogram_peaks``."""
    ready = cut_lineage(peaks.withColumn("_base", F.lit(0).cast("long")))
    ratio = lambda freq, lead: freq / lead
    fits = lambda freq, lead, step: F.bround(ratio(freq, lead), 1) - F.floor(ratio(freq, lead)) <= 3 * step
    done = None
    while True:
        front = ready.groupBy(key).agg(F.min("peak").alias("_from"))
        first = attach(ready, front, [key]).filter(F.col("peak") < F.col("_from") + heads)
        first = first.groupBy(key).agg(F.max("step").alias("_s"), F.array_sort(F.collect_list(F.struct("peak", "peak_freq"))).alias("_h"))
        leads = F.aggregate("_h", F.array().cast("array<double>"), lambda known, x: F.when(
            F.exists(known, lambda lead: fits(x["peak_freq"], lead, F.col("_s"))), known).otherwise(F.concat(known, F.array(x["peak_freq"]))))
        placed = attach(ready, first.select(key, leads.alias("_leads")), [key])
        at = F.array_position(F.transform("_leads", lambda lead: fits(F.col("peak_freq"), lead, F.col("step"))), True)
        placed = placed.withColumn("_at", at)
        placed = cut_lineage(placed.withColumns({
            "signal_num": F.when(F.col("_at") > 0, F.col("_base") + F.col("_at")).cast("long"),
            "harmonic": F.when(F.col("_at") > 0, F.floor(ratio(F.col("peak_freq"), F.get("_leads", F.col("_at").cast("int") - 1)))).cast("long"),
            "_base": F.col("_base") + F.size("_leads")}).drop("_leads", "_at"))
        found = placed.filter("signal_num IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        ready = placed.filter("signal_num IS NULL").drop("signal_num", "harmonic")
        if ready.isEmpty():
            return done.select(key, "peak", "peak_freq", "peak_power", "prominence", "signal_num", "harmonic")


def _thinned(j: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Whether each peak (ascending ``j``) of a whole grid stays: ``_thin`` in rounds over all peaks at once."""
    state, n = np.full(len(j), OPEN), len(j)
    steps = [k for k in range(1, distance) if k < n and (j[k:] - j[:-k] < distance).any()]
    pairs = [(k, j[k:] - j[:-k] < distance, height[:-k] >= height[k:]) for k in steps]
    while (state == OPEN).any():
        beaten, still = np.zeros(n, dtype=bool), state == OPEN
        for k, near, left in pairs:
            both = near & still[:-k] & still[k:]
            beaten[k:] |= both & left
            beaten[:-k] |= both & ~left
        won = still & ~beaten
        state[won] = KEPT
        for k, near, _ in pairs:
            state[k:][near & won[:-k] & still[k:]] = DROPPED
            state[:-k][near & won[k:] & still[:-k]] = DROPPED
    return state == KEPT


def _series_peaks(prominence: float, distance: int, wlen: int):
    def run(batches):
        for batch in _block_sums(batches):
            frequency, cc, ss, cs, fc, fs = (batch.column(c).to_numpy() for c in range(2, 8))
            with np.errstate(all="ignore"):
                det = cc * ss - cs ** 2
                det = np.where(det > 1e-9 * cc * ss, det, np.nan)
                power = np.sqrt(((fc * ss - fs * cs) / det) ** 2 + ((fs * cc - fc * cs) / det) ** 2)
                known = ~np.isnan(power)
                mean = power[known].mean() if known.any() else 0.0
                p = np.where(known, power, 0.0) / mean if mean else np.zeros(len(power))
            idx = np.flatnonzero((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:])) + 1
            idx = idx[_thinned(idx, p[idx], distance)]
            height = _prominences(p, idx, wlen)
            idx, height = idx[height >= prominence], height[height >= prominence]
            order = np.lexsort((idx, -height))
            idx, height, n = idx[order], height[order], len(idx)
            if n:
                step = (frequency[-1] - frequency[0]) / (len(p) - 1)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[0], n), pa.array(np.arange(1, n + 1)), *[pa.array(c) for c in (frequency[idx], power[idx], height, np.full(n, step))]],
                                                 [batch.schema.names[0], "peak", "peak_freq", "peak_power", "prominence", "step"])

    return run


def series_peaks(df: DataFrame, key: str, time: str, flux: str, prominence: float = 3.0, distance: int = 20, wlen: int = 300) -> DataFrame:
    """C4: ``prominent_peaks`` of the series' own periodograms, whose powers are written nowhere for series of one pack and one block.

    Longer series or grids take the general way by ``periodogram``.
    """
    df = df.select(key, time, flux).filter(F.col(time).isNotNull() & F.col(flux).isNotNull())
    grid = cut_lineage(frequency_grid(df, key, time).join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), key))
    fits = (F.col("_rows") <= POINTS) & (F.col("n_freq") <= FREQUENCIES)
    ktype = next(f.dataType for f in df.schema.fields if f.name == key)
    schema = StructType([StructField(key, ktype), StructField("peak", LongType()), *[StructField(c, DoubleType()) for c in ("peak_freq", "peak_power", "prominence", "step")]])
    found = _work(df, key, time, flux, grid.filter(fits).drop("_rows")).mapInArrow(_series_peaks(prominence, distance, wlen), schema)
    large = grid.filter(~fits).drop("_rows")
    if large.isEmpty():
        return found
    rest = prominent_peaks(periodogram(df.join(large.select(key), key, "left_semi"), key, time, flux, large), key, prominence, distance, wlen)
    return found.unionByName(rest.withColumn("peak", F.col("peak").cast("long")))


def best_period(power: DataFrame, key: str, prominence: float = 3.0, distance: int = 20, wlen: int = 300) -> DataFrame:
    """C4: period of the most prominent peak of each series; series without a peak have none and are left out."""
    return best_peak(prominent_peaks(power, key, prominence, distance, wlen), key)


def best_peak(peaks: DataFrame, key: str) -> DataFrame:
    """C4: (key, period) of each series' first peak."""
    return peaks.filter("peak = 1").select(key, (1 / F.col("peak_freq")).alias("period"))


def fourier_features(df: DataFrame, key: str, periods: DataFrame, time: str = "t", flux: str = "flux", order: int = 3) -> DataFrame:
    """Harmonic fit of the folded series by normal-equation sums.

    The argument of the harmonics is the folded time itself (in days), not the phase, as in the
    definition this reproduces.
    """
    r = F.pmod(F.col(time), F.col("period"))
    rows = attach(df.select(key, time, flux), periods, [key]).withColumn("_r", r)
    terms = [F.lit(1.0)] + [F.cos(2 * math.pi * k * F.col("_r")) for k in range(1, order + 1)] + [F.sin(2 * math.pi * k * F.col("_r")) for k in range(1, order + 1)]
    m = len(terms)
    rows = rows.withColumns({f"b{i}": t for i, t in enumerate(terms)})
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = rows.groupBy(key).agg(*[F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"m{i}_{j}") for i, j in pairs], *[F.sum(F.col(flux) * F.col(f"b{i}")).alias(f"v{i}") for i in range(m)])
    ktype = dict(df.dtypes)[key]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = np.zeros((m, m))
                for i, j in pairs:
                    a[i, j] = a[j, i] = row[f"m{i}_{j}"]
                out.append([row[key], *np.linalg.lstsq(a, np.array([row[f"v{i}"] for i in range(m)]), rcond=None)[0]])
            yield pd.DataFrame(out, columns=[key, *[f"c{i}" for i in range(m)]])

    c = sums.mapInPandas(solve, f"{key} {ktype}, " + ", ".join(f"c{i} double" for i in range(m)))
    amp = [F.sqrt(F.col(f"c{k}") ** 2 + F.col(f"c{k + order}") ** 2) for k in range(1, order + 1)]
    ph = [F.atan(-F.col(f"c{k}") / F.col(f"c{k + order}")) for k in range(1, order + 1)]
    return c.select(key, amp[0].alias("amplitude"), (amp[1] / amp[0]).alias("r21"), (amp[2] / amp[0]).alias("r31"), (ph[1] - 2 * ph[0]).alias("phi21"), (ph[2] - 3 * ph[0]).alias("phi31"))


def folded_features(df: DataFrame, key: str, periods: DataFrame, tie: str, time: str = "t", flux: str = "flux") -> DataFrame:
    """Step variance, cumulative range and slope percentiles in folded order."""
    rows = attach(df.select(key, tie, time, flux), periods, [key]).withColumn("_r", F.pmod(F.col(time), F.col("period")))
    st = rows.groupBy(key).agg(F.avg(flux).alias("_centre"), F.stddev_pop(flux).alias("_sd"), F.count(flux).cast("double").alias("_n"))
    rows = attach(rows, st, [key]).withColumn("_c", F.col(flux) - F.col("_centre"))
    scan = OrderedScan(rows, [key], ["_r", tie]).lag({"_pf": flux, "_pr": "_r"}).running_sum("_cs", F.col("_c")).done()
    step = F.col(flux) - F.col("_pf")
    scan = scan.withColumn("_slope", F.when(step != 0, (F.col("_r") - F.col("_pr")) / step))
    agg = scan.groupBy(key).agg(F.sum(step * step).alias("_s2"), (F.max("_cs") - F.min("_cs")).alias("_range"), F.first("_n").alias("_n"), F.first("_sd").alias("_sd"))
    q = exact_percentiles(scan.filter("_slope IS NOT NULL"), [key], {"slope_per10": ("_slope", 0.1), "slope_per90": ("_slope", 0.9)})
    return agg.join(q, key, "left").select(key, (F.col("_s2") / (F.col("_n") - 1) / F.col("_sd") ** 2).alias("phase_mean_variance"),
                                           (F.col("_range") / F.col("_n") / F.col("_sd")).alias("phase_cusum"), "slope_per10", "slope_per90")


def feature_table(df: DataFrame, key: str, tie: str, periods: DataFrame | None = None, time: str = "t", flux: str = "flux", prominence: float = 3.0) -> DataFrame:
    """The 21 features of every series; series with an undefined feature, as one
    without a prominent period, are dropped."""
    if periods is None:
        periods = cut_lineage(best_peak(series_peaks(df, key, time, flux, prominence), key))
    out = non_periodic_features(df, key, [time, tie], flux).join(shapiro_w(df, key, flux, tie), key).join(periods, key)
    out = out.join(fourier_features(df, key, periods, time, flux), key).join(folded_features(df, key, periods, tie, time, flux), key)
    return out.select(key, *FEATURE_NAMES).dropna()


@dataclass
class Forest:
    """Trees as arrays per node: feature, threshold (left if not above it), left child (right is the next), class shares."""
    features: list[str]
    labels: list[str]
    trees: list[bytes]


def _grow(x: np.ndarray, edges: list[np.ndarray], y: np.ndarray, classes: int, rng, sample: float, max_depth: int) -> dict:
    """One full tree, level by level: each level's class counts are one histogram over (node, bin, class).

    ``x`` are bins, ``edges`` the upper ends of all bins but the last.  Rows are drawn with Poisson weights of mean ``sample``.
    """
    weight = rng.poisson(sample, len(y)).astype(float)
    rows = np.flatnonzero(weight)
    x, y, weight = x[rows], y[rows], weight[rows]
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    feature, threshold, left, share = [], [], [], []
    node, width, made = np.zeros(len(y), dtype=np.int64), 1, 1
    for depth in range(max_depth + 1):
        total = np.bincount(node * classes + y, weights=weight, minlength=width * classes).reshape(width, classes)
        size = total.sum(axis=1)
        own = (total ** 2).sum(axis=1) / np.maximum(size, 1e-300)
        best, pick, cut = own + 1e-9, np.full(width, -1), np.zeros(width, dtype=np.int64)
        draw = np.argsort(rng.random((width, x.shape[1])), axis=1)[:, :tries]
        for c in range(x.shape[1]):
            mine = (draw == c).any(axis=1)
            if depth == max_depth or not mine.any() or not len(edges[c]):
                continue
            at, bins = np.cumsum(mine) - 1, len(edges[c]) + 1
            # Histograms of as many nodes at a time as fit some tens of megabytes.
            group = max(1, 2_000_000 // (bins * classes))
            chosen = np.flatnonzero(mine)
            inside = mine[node]
            place, bin_, label, w = at[node[inside]], x[inside, c], y[inside], weight[inside]
            by_place = np.argsort(place, kind="stable")
            borders = np.searchsorted(place[by_place], np.arange(0, len(chosen) + group, group))
            for g, (lo, hi) in enumerate(zip(borders[:-1], borders[1:])):
                nodes = chosen[g * group:(g + 1) * group]
                r = by_place[lo:hi]
                hist = np.bincount(((place[r] - g * group) * bins + bin_[r]) * classes + label[r], weights=w[r], minlength=len(nodes) * bins * classes)
                below = hist.reshape(len(nodes), bins, classes).cumsum(axis=1)[:, :-1]
                above = total[nodes][:, None, :] - below
                nb, na = below.sum(axis=2), above.sum(axis=2)
                gain = np.where((nb > 0) & (na > 0), (below ** 2).sum(axis=2) / np.maximum(nb, 1e-300) + (above ** 2).sum(axis=2) / np.maximum(na, 1e-300), -1.0)
                top = gain.argmax(axis=1)
                value = gain[np.arange(len(nodes)), top]
                better = value > best[nodes]
                best[nodes[better]], pick[nodes[better]], cut[nodes[better]] = value[better], c, top[better]
        split = pick >= 0
        children = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        feature.append(pick)
        left.append(children)
        threshold.append(np.array([edges[c][b] if c >= 0 else 0.0 for c, b in zip(pick, cut)]))
        share.append(total / np.maximum(size, 1e-300)[:, None])
        if not split.any():
            break
        on = split[node]
        x, y, weight, node = x[on], y[on], weight[on], node[on]
        right = x[np.arange(len(node)), pick[node]] > cut[node]
        node = children[node] + right - made
        width, made = 2 * int(split.sum()), made + 2 * int(split.sum())
    return {"feature": np.concatenate(feature).astype(np.int16), "threshold": np.concatenate(threshold), "left": np.concatenate(left).astype(np.int32),
            "share": np.concatenate(share).astype(np.float32)}


def _encode(tree: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def random_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 200, sample: float = 0.66, seed: int = 7, max_depth: int = 30,
                  max_rows: int = 20_000, max_bins: int = 128) -> Forest:
    """Random forest (Gini, sqrt features, 0.66 sample, full depth).

    It is fitted on at most ``max_rows`` labelled rows, those of the smallest hashes; this bound makes the rows small
    enough to broadcast and the forest small enough to travel once.  Each tree grows
    whole within one task, from a seed of its own, so a lost executor regrows the same trees.  Rows with a NULL label
    or feature teach nothing; without any row every prediction is NULL.
    """
    cols = list(features)
    spark = train.sparkSession
    rows = train.select(F.col(label).cast("string").alias("_label"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]).dropna()
    order = F.xxhash64(*rows.columns)
    data = rows.orderBy(order, *rows.columns).limit(max_rows).toPandas()  # bounded by max_rows
    labels = sorted(data["_label"].unique().tolist())
    if not labels:
        return Forest(cols, [], [])
    y = np.searchsorted(np.array(labels), data["_label"].to_numpy(dtype=str)).astype(np.int64)
    values = data[[f"_x{i}" for i in range(len(cols))]].to_numpy(float)
    edges = []
    for c in range(len(cols)):
        known = np.unique(values[:, c])
        if len(known) > max_bins:
            known = np.unique(np.quantile(values[:, c], np.arange(1, max_bins + 1) / max_bins, method="lower"))
        edges.append((known[:-1] + known[1:]) / 2)
    x = np.column_stack([np.searchsorted(e, values[:, c], side="left") for c, e in enumerate(edges)]).astype(np.int64)
    shared = spark.sparkContext.broadcast((x, edges, y, len(labels)))

    def grow(batches):
        x, edges, y, classes = shared.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tree = _grow(x, edges, y, classes, np.random.default_rng([seed, t]), sample, max_depth)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([_encode(tree)], pa.binary())], ["id", "tree"])

    numbers = spark.range(trees, numPartitions=min(trees, 4 * spark.sparkContext.defaultParallelism))
    grown = numbers.mapInArrow(grow, "id long, tree binary").orderBy("id").collect()
    return Forest(cols, labels, [bytes(r["tree"]) for r in grown])


def predict(df: DataFrame, forest: Forest) -> DataFrame:
    """Predicted class and its probability (mean share over the trees) for each row; NULL where a feature is."""
    shared = df.sparkSession.sparkContext.broadcast((forest.labels, forest.trees))

    def shares(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        labels, packed = shared.value
        trees = [dict(np.load(io.BytesIO(t))) for t in packed]
        for cols in columns:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            known = np.flatnonzero(~np.isnan(x).any(axis=1)) if trees else np.zeros(0, dtype=int)
            total = np.zeros((len(known), max(1, len(labels))))
            for tree in trees:
                at, going = np.zeros(len(known), dtype=np.int64), np.arange(len(known))
                while len(going):
                    here = at[going]
                    inner = tree["feature"][here] >= 0
                    going, here = going[inner], here[inner]
                    at[going] = tree["left"][here] + (x[known[going], tree["feature"][here]] > tree["threshold"][here])
                total += tree["share"][at]
            name, prob = np.full(len(x), None, dtype=object), np.full(len(x), np.nan)
            if len(known):
                top = total.argmax(axis=1)
                name[known], prob[known] = np.array(labels, dtype=object)[top], total[np.arange(len(known)), top] / len(trees)
            yield pd.DataFrame({"predicted": name, "class_prob": prob})

    guess = F.pandas_udf(shares, "predicted string, class_prob double")
    out = df.withColumn("_guess", guess(*[F.col(c).cast("double") for c in forest.features]))
    prob = F.col("_guess.class_prob")
    return out.withColumns({"predicted": F.col("_guess.predicted"), "class_prob": F.when(~F.isnan(prob), prob)}).drop("_guess")


def confusion(pred: DataFrame, label: str, guess: str = "predicted") -> DataFrame:
    """Counts and row-normalised shares of each (label, prediction)."""
    c = pred.groupBy(label, guess).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(label).agg(F.sum("n").alias("_t"))
    return c.join(t, label).select(label, guess, "n", (F.col("n") / F.col("_t")).alias("share"))


def class_report(pred: DataFrame, label: str, guess: str = "predicted") -> DataFrame:
    """Precision, recall and F1 per class, with the overall accuracy."""
    hit = F.col(label) == F.col(guess)
    rec = pred.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(hit).alias("_hit"))
    pre = pred.groupBy(F.col(guess).alias("class")).agg(F.count(F.lit(1)).alias("_said"))
    acc = pred.agg(F.avg(hit.cast("double")).alias("accuracy"))
    j = rec.join(pre, "class", "left").crossJoin(F.broadcast(acc))  # one row
    p, r = F.coalesce(F.col("_hit") / F.col("_said"), F.lit(0.0)), F.col("_hit") / F.col("support")
    return j.select("class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"), "accuracy")


def neighbour_separation(stars: DataFrame, row: str, coords: Sequence[str], radius: float, out: str = "nn_dist") -> DataFrame:
    """Distance to the nearest other star, at most ``radius``."""
    cs = [f"_q{i}" for i in range(len(coords))]
    # Stars that share a position are at distance zero of each other; places are compared once.
    places = stars.groupBy(*coords).agg(F.count(F.lit(1)).alias("_copies"))
    other = places.select(*[F.col(c).alias(q) for c, q in zip(coords, cs)])
    near = pairs_within(places.filter("_copies = 1").select(*coords), other, list(coords), cs, radius, dist="_d").filter(F.col("_d") > 0)
    best = near.groupBy(*coords).agg(F.min("_d").alias("_d"))
    merged = places.join(best, list(coords), "left").select(*coords, F.when(F.col("_copies") > 1, F.lit(0.0)).otherwise(F.coalesce("_d", F.lit(float(radius)))).alias(out))
    return attach(stars, merged, list(coords))
