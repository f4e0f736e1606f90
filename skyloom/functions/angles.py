"""Angles on the sky as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# North galactic pole (right ascension, declination) and the galactic
# longitude of the north celestial pole, J2000, in degrees.
GALACTIC_POLE_RA = 192.85948
GALACTIC_POLE_DEC = 27.12825
GALACTIC_NCP_LON = 122.93192


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def separation_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """Haversine separation of two directions in degrees."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    sin_dec = F.sin(F.radians(dec2 - dec1) / 2)
    sin_ra = F.sin(F.radians(ra2 - ra1) / 2)
    h = sin_dec * sin_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sin_ra * sin_ra
    return 2 * F.degrees(F.asin(F.sqrt(F.least(F.lit(1.0), h)))) * 3600


def ra_difference(a, b) -> Column:
    """A - b wrapped into [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0


def mahalanobis(dra_cosdec: Column, ddec: Column, ra_err, dec_err) -> Column:
    """Separation in units of the positional errors."""
    return F.sqrt((dra_cosdec / _c(ra_err)) ** 2 + (ddec / _c(dec_err)) ** 2)


def galactic(ra, dec) -> tuple[Column, Column]:
    """Galactic longitude (0-360) and latitude in degrees."""
    ra, dec = F.radians(_c(ra) - GALACTIC_POLE_RA), F.radians(_c(dec))
    pole = F.radians(F.lit(GALACTIC_POLE_DEC))
    sin_b = F.sin(dec) * F.sin(pole) + F.cos(dec) * F.cos(pole) * F.cos(ra)
    y = F.cos(dec) * F.sin(ra)
    x = F.sin(dec) * F.cos(pole) - F.cos(dec) * F.sin(pole) * F.cos(ra)
    lon = F.pmod(F.lit(GALACTIC_NCP_LON) - F.degrees(F.atan2(y, x)), F.lit(360.0))
    return lon, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_b))))


def _split60(value: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(value)
    minutes = F.floor((value - whole) * 60)
    return whole, minutes, ((value - whole) * 60 - minutes) * 60


def sky_name(ra, dec, mjd_start, total_events, prefix: str) -> Column:
    """E5: ``<prefix> HHMMSS.ss+DDMMSS.ss``, with ``T<mjd>`` for objects with one event.

    The sign follows the whole-degree part, so -0.x degrees is written with a plus.
    """
    ra, dec = _c(ra), _c(dec)
    h, m, s = _split60(ra / 15)
    d, dm, ds = _split60(F.abs(dec))
    sign = F.when((dec < 0) & (d > 0), F.lit("-")).otherwise(F.lit("+"))
    body = F.concat(
        F.lit(prefix + " "), F.format_string("%02d%02d%05.2f", h, m, s), sign, F.format_string("%02d%02d%05.2f", d, dm, ds))
    return F.when(_c(total_events) == 1, F.concat(body, F.lit("T"), _c(mjd_start).cast("long").cast("string"))).otherwise(body)


def sexagesimal_to_degrees(text, hours: bool = False) -> Column:
    """``a:b:c`` or ``a b c`` to degrees; the sign of the text applies to all parts."""
    t = F.trim(_c(text))
    parts = F.split(F.regexp_replace(t, "^[+-]", ""), "[:\\s]+")
    size = F.size(parts)
    piece = lambda i: F.when(size > i, F.element_at(parts, i + 1).cast("double")).otherwise(F.lit(0.0))
    value = piece(0) + piece(1) / 60 + piece(2) / 3600
    value = F.when(t.startswith("-"), -value).otherwise(value)
    return value * 15 if hours else value


def degrees_to_sexagesimal(value, hours: bool = False, decimals: int = 2) -> Column:
    """Degrees to ``[+-]dd:mm:ss.ss`` (or ``hh:mm:ss.ss``); seconds that round to 60 carry over."""
    v = _c(value)
    unit = F.abs(v) / 15 if hours else F.abs(v)
    total = F.floor(unit * 3600 * 10**decimals + 0.5)
    per_min = 60 * 10**decimals
    secs = (total % per_min) / 10**decimals
    mins = F.floor(total / per_min) % 60
    whole = F.floor(total / (60 * per_min))
    width = 3 + decimals
    body = F.format_string(f"%02d:%02d:%0{width}.{decimals}f", whole, mins.cast("long"), secs)
    return body if hours else F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+")), body)


def check_range(ra, dec) -> Column:
    """NULL when 0 <= ra < 360 and |dec| <= 90, otherwise the query fails."""
    ra, dec = _c(ra), _c(dec)
    return F.assert_true((ra >= 0) & (ra < 360) & (F.abs(dec) <= 90), F.lit("coordinates out of range"))
