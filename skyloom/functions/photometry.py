"""Fluxes, magnitudes and zero-points as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import _c

# AB zero flux in Jy and the scale of each flux-density unit.
AB_ZERO_JY = 3631.0
UNIT_SCALE = {"jy": 1.0, "mjy": 1e3, "mujy": 1e6, "ujy": 1e6}

# Fixed value: slope parameter of the H-G system when none was measured.
DEFAULT_SLOPE_G = 0.15


def zp_to_scale(zp) -> Column:
    """Magnitude zero-point to linear scale."""
    return F.pow(F.lit(10.0), 0.4 * _c(zp))


def scale_to_zp(scale) -> Column:
    """E14."""
    return 2.5 * F.log10(_c(scale))


def convert_flux(flux, err, units: str, zp=None) -> tuple[Column, Column]:
    """Counts to flux density or AB magnitude.

    Magnitudes of points with flux <= err are limits from the error, with NULL error.
    """
    f, e = _c(flux), _c(err)
    u = units.lower()
    if u in ("count", "counts"):
        return f, e
    if zp is None:
        raise ValueError(f"units {units!r} need a zero-point")
    z = _c(zp)
    if u == "mag":
        seen = f > e
        mag = z - 2.5 * F.log10(F.when(seen, f).otherwise(e))
        return mag, F.when(seen, 2.5 * F.log10(1.0 + e / f))
    if u not in UNIT_SCALE:
        raise ValueError(f"unknown units {units!r}")
    k = AB_ZERO_JY * F.pow(F.lit(10.0), -0.4 * z) * UNIT_SCALE[u]
    return f * k, e * k


def flux_to_mag(flux, err, limit_sigma: float | None = None, zp=0.0) -> tuple[Column, Column]:
    """Magnitude and error; below ``limit_sigma`` an upper limit with NULL error.

    For 0 < S/N < N the limit is flux + N err, for S/N <= 0 it is N err.
    """
    f, e, z = _c(flux), _c(err), _c(zp)
    # A logarithm of a value that is not positive stays NULL.
    log = lambda x: F.when(x > 0, -2.5 * F.log10(x))
    mag, dmag = log(f), 2.5 / math.log(10.0) * e / f
    if limit_sigma is None:
        return mag + z, dmag
    sn, n = f / e, float(limit_sigma)
    value = F.when(sn >= n, mag).when(sn > 0, log(f + n * e)).when(sn <= 0, log(n * e))
    return value + z, F.when(sn >= n, dmag)


def colour(m1, e1, m2, e2) -> tuple[Column, Column]:
    """Colour and its error, NULL as soon as one input is."""
    a, b = _c(e1), _c(e2)
    return _c(m1) - _c(m2), F.sqrt(a * a + b * b)


def hg_magnitude(h, g, r_helio, delta, phase_deg) -> Column:
    """Apparent magnitude in the two-parameter H-G system."""
    tan_half = F.tan(F.radians(_c(phase_deg)) / 2)
    slope = F.coalesce(_c(g), F.lit(DEFAULT_SLOPE_G))
    phi1 = F.exp(-3.33 * F.pow(tan_half, F.lit(0.63)))
    phi2 = F.exp(-1.87 * F.pow(tan_half, F.lit(1.22)))
    term = F.greatest((1 - slope) * phi1 + slope * phi2, F.lit(1e-10))
    return _c(h) + 5 * F.log10(_c(r_helio) * _c(delta)) - 2.5 * F.log10(term)


def star_radius_px(mag) -> Column:
    """Exclusion radius of a star, 4 px at magnitude 10, kept in [2, 20]."""
    return F.greatest(F.lit(2.0), F.least(F.lit(20.0), 4.0 * F.pow(F.lit(10.0), -0.2 * (_c(mag) - 10.0))))
