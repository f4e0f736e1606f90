"""Rounding, error models and small-sample corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.angles import _c

# c4(n) for n = 2..6.
C4_TABLE = [0.7978845608028654, 0.8862269254527579, 0.9213177319235613, 0.9399856029866251, 0.9515328619481445]

# Fixed values of the localisation model: error scale, default pixel error, PSF-likeness limit.
LOCALISATION_SCALE = 1.136
DEFAULT_PIXEL_ERROR = 0.5
PSF_LIKE_LIMIT = 0.5


def round_half_up(x) -> Column:
    """floor(x + 0.5)."""
    return F.floor(_c(x) + 0.5)


def round_half_even(x) -> Column:
    """IEEE rounding, as light-curve extraction needs it."""
    return F.rint(_c(x))


def gaussian(x, amplitude, centre, sigma) -> Column:
    """E17."""
    z = (_c(x) - _c(centre)) / _c(sigma)
    return _c(amplitude) * F.exp(-0.5 * z * z)


def power_law(x, a, b) -> Column:
    """A * x**b."""
    return _c(a) * F.pow(_c(x), _c(b))


def snr_error(snr, a, b, c) -> Column:
    """sqrt((a * snr**-b)**2 + c**2)."""
    fall = _c(a) * F.pow(_c(snr), -_c(b))
    return F.sqrt(fall * fall + _c(c) * _c(c))


def localisation_error(err, wcs_err, psf_like) -> Column:
    """Centroid and astrometric error in quadrature, or the default without a calibration."""
    e, w = _c(err), _c(wcs_err)
    usable = e.isNotNull() & w.isNotNull() & (_c(psf_like) > PSF_LIKE_LIMIT)
    return F.when(usable, F.sqrt(e * e + w * w) * LOCALISATION_SCALE).otherwise(F.lit(DEFAULT_PIXEL_ERROR))


def c4(n) -> Column:
    """Bias of the sample standard deviation; table to n = 6, then the series."""
    n = _c(n)
    table = F.array(*[F.lit(v) for v in C4_TABLE])
    nd = n.cast("double")
    series = 1.0 - 1.0 / (4.0 * nd) - 7.0 / (32.0 * nd * nd) - 19.0 / (128.0 * nd * nd * nd)
    return F.when(n < 2, F.lit(None).cast("double")).when(n <= 6, F.element_at(table, n.cast("int") - 1)).otherwise(series)
