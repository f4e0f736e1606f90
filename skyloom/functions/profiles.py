"""Model profiles of light curves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import _c

BAZIN_FEATURES = ["tau_ratio", "t_peak_off", "peak", "fwhm", "rise_time", "decay_time", "fluence"]
# The profile is looked at from 12 rise times before to 18 fall times after t0.
BEFORE, AFTER = 12.0, 18.0
HALVINGS, PANELS = 50, 2000


def _clip50(x: Column) -> Column:
    return F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))


def bazin(t, a, t0, tau_rise, tau_fall, offset) -> Column:
    """rise/decay profile with exponents limited to +-50."""
    dt = _c(t) - _c(t0)
    fall = F.exp(_clip50(-dt / _c(tau_fall)))
    return _c(a) * fall / (1.0 + F.exp(_clip50(-dt / _c(tau_rise)))) + _c(offset)


def bazin_exposed(t, a, t0, tau_rise, tau_fall, offset, exposure: float, supersample: int = 7) -> Column:
    """The profile averaged over an exposure centred on ``t``."""
    if exposure <= 0 or supersample <= 1:
        return bazin(t, a, t0, tau_rise, tau_fall, offset)
    total = None
    for i in range(supersample):
        shift = (i / (supersample - 1) - 0.5) * exposure
        term = bazin(_c(t) + shift, a, t0, tau_rise, tau_fall, offset)
        total = term if total is None else total + term
    return total / supersample


def _shape(dt: Column, rise: Column, fall: Column) -> Column:
    return F.exp(_clip50(-dt / fall)) / (1.0 + F.exp(_clip50(-dt / rise)))


def _halving(inside: Column, outside: Column, level: Column, rise: Column, fall: Column) -> Column:
    """Where the profile crosses ``level`` between a point above it and one below."""
    start = F.struct(inside.cast("double").alias("i"), outside.cast("double").alias("o"), level.alias("v"), rise.alias("r"), fall.alias("f"))

    def step(s, _):
        mid = (s["i"] + s["o"]) / 2
        above = _shape(mid, s["r"], s["f"]) >= s["v"]
        return F.struct(F.when(above, mid).otherwise(s["i"]).alias("i"), F.when(above, s["o"]).otherwise(mid).alias("o"), s["v"].alias("v"), s["r"].alias("r"), s["f"].alias("f"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda s: s["i"])


def bazin_features(a, t0, tau_rise, tau_fall) -> Column:
    """Shape descriptors of a fitted profile, as a struct of ``BAZIN_FEATURES``.

    The derivative vanishes at ``rise * ln(fall / rise - 1)``, limited to the range looked at (a
    profile that falls faster than it rises is highest at the range's start).  Half-maximum
    crossings are found by halving, the fluence by the trapezoidal rule.  All but the ratio are
    NULL unless amplitude and both times are positive.
    """
    a, rise, fall = _c(a), _c(tau_rise), _c(tau_fall)
    first, last = -BEFORE * rise, AFTER * fall
    top_at = F.when(fall > rise, F.least(F.greatest(rise * F.log(fall / rise - 1), first), last)).otherwise(first)
    top = _shape(top_at, rise, fall)
    left = F.when(_shape(first, rise, fall) >= top / 2, first).otherwise(_halving(top_at, first, top / 2, rise, fall))
    right = F.when(_shape(last, rise, fall) >= top / 2, last).otherwise(_halving(top_at, last, top / 2, rise, fall))
    width = (last - first) / PANELS
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(PANELS - 1)), F.lit(0.0), lambda s, i: s + _shape(first + width * i, rise, fall))
    area = width * (inner + (_shape(first, rise, fall) + _shape(last, rise, fall)) / 2)
    fine = (a > 0) & (rise > 0) & (fall > 0)
    values = [fall / F.when(rise > 0, rise), top_at, a * top, right - left, top_at - left, right - top_at, a * area]
    return F.struct(*[(v if n == "tau_ratio" else F.when(fine, v)).alias(n) for n, v in zip(BAZIN_FEATURES, values)])


def exposed_sinusoid(t_min, period_min, cadence_min: float, phase=0.0) -> Column:
    """Sinusoid integrated over the exposure, before scaling to unit peak."""
    w = 2 * math.pi / _c(period_min)
    upper = F.cos(w * (_c(t_min) + cadence_min / 2) + _c(phase))
    lower = F.cos(w * (_c(t_min) - cadence_min / 2) + _c(phase))
    return (lower - upper) / w


_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _emg_cdf(z: np.ndarray, k: float) -> np.ndarray:
    """CDF of a unit Gaussian convolved with an exponential of scale ``k``."""
    normal = 0.5 * _erfc(-z / math.sqrt(2))
    if k < 1e-6:
        return normal
    u = (z - 1 / k) / math.sqrt(2)
    expo = 1 / (2 * k * k) - z / k
    # Where the exponent overflows, its Gaussian factor is zero to machine precision.
    tail = np.where(expo < 700, np.exp(np.minimum(expo, 700)) * 0.5 * _erfc(-u), 0.0)
    return normal - tail


def _emg_pdf(z: np.ndarray, k: float) -> np.ndarray:
    if k < 1e-6:
        return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    expo = 1 / (2 * k * k) - z / k
    return np.where(expo < 700, np.exp(np.minimum(expo, 700)) * 0.5 * _erfc(-(z - 1 / k) / math.sqrt(2)) / k, 0.0)


# Fixed values of the flare placement: largest shape parameter, level that bounds the
# active part, margin on either side of it.
K_MAX, ACTIVE_LEVEL, MARGIN = 8.0, 0.05, 0.05


def _root(positive: float, negative: float, fn) -> float:
    """Where ``fn`` changes sign between a point where it is positive and one where it isn't."""
    for _ in range(60):
        mid = (positive + negative) / 2
        if fn(mid) > 0:
            positive = mid
        else:
            negative = mid
    return positive


def flare_extent(k: float) -> tuple[float, float]:
    """Where the density of shape ``k`` passes ``ACTIVE_LEVEL`` of its maximum, rising and falling.

    A Gaussian with an exponential tail has its maximum where it crosses the bare Gaussian:
    its derivative is their difference over ``k``.
    """
    density = lambda z: float(_emg_pdf(np.array(z), k))
    far = 5 + 10 * k
    mode = 0.0 if k < 1e-6 else _root(-5.0, far, lambda z: math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) - density(z))
    above = lambda z: density(z) - ACTIVE_LEVEL * density(mode)
    return _root(mode, -5.0, above), _root(mode, far, above)


def emg_flare(duty_frac: float = 0.6, cadence_min: float = 10.0):
    """A pandas UDF (K, minutes since start, event minutes) to flux before unit scaling.

    The asymmetric flare is integrated exactly over each exposure; negative K mirrors it.  Its
    active part fills the duty fraction but for the margins.
    """

    @F.pandas_udf("double")
    def flux(k: pd.Series, t_min: pd.Series, event_min: pd.Series) -> pd.Series:
        shape = np.clip(k.to_numpy(dtype=float), -1, 1)
        window = event_min.to_numpy(dtype=float) / duty_frac
        middle, half = t_min.to_numpy(dtype=float) / window, cadence_min / 2 / window
        span = duty_frac * (1 - 2 * MARGIN)
        out = np.empty(len(k))
        for value in np.unique(shape):
            at = shape == value
            inner = abs(value) * K_MAX
            rising, falling = flare_extent(inner)
            # From minutes to the density's units; a mirrored flare is read from its end backwards.
            per = (falling - rising) / span
            centre = middle[at] if value >= 0 else span - middle[at]
            early, late = rising + (centre - half[at]) * per, rising + (centre + half[at]) * per
            out[at] = _emg_cdf(late, inner) - _emg_cdf(early, inner)
        return pd.Series(out)

    return flux
