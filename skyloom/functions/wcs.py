"""Tangent-plane world coordinates with polynomial distortion, tiles and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import _c, ra_difference

# First science column of a detector and its side in pixels.
FIRST_COLUMN, DETECTOR_SIDE = 44, 2048


def polynomial(u: Column, v: Column, coeffs: dict[tuple[int, int], float]) -> Column:
    """Sum of c[p, q] * u**p * v**q."""
    total = F.lit(0.0)
    for (p, q), c in sorted(coeffs.items()):
        term = F.lit(float(c))
        for _ in range(p):
            term = term * u
        for _ in range(q):
            term = term * v
        total = total + term
    return total


class TangentWcs:
    """One detector's astrometric solution; every method returns Column expressions.

    ``a`` and ``b`` are forward distortion terms, ``crpix`` is the reference pixel, ``crval``
    the reference direction and ``cd`` the 2x2 matrix in degrees per pixel, row by row.
    """

    def __init__(self, crpix, crval, cd, a=None, b=None):
        self.crpix, self.crval, self.cd = crpix, crval, cd
        self.a, self.b = dict(a or {}), dict(b or {})

    def pixel_to_sky(self, x, y) -> tuple[Column, Column]:
        u, v = _c(x) - self.crpix[0], _c(y) - self.crpix[1]
        uu, vv = u + polynomial(u, v, self.a), v + polynomial(u, v, self.b)
        xi = F.radians(self.cd[0] * uu + self.cd[1] * vv)
        eta = F.radians(self.cd[2] * uu + self.cd[3] * vv)
        dec0 = F.radians(F.lit(float(self.crval[1])))
        den = F.cos(dec0) - eta * F.sin(dec0)
        ra = F.pmod(F.lit(float(self.crval[0])) + F.degrees(F.atan2(xi, den)), F.lit(360.0))
        dec = F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + den * den)))
        return ra, dec

    def sky_to_tangent(self, ra, dec) -> tuple[Column, Column]:
        da = F.radians(ra_difference(ra, F.lit(float(self.crval[0]))))
        d, d0 = F.radians(_c(dec)), F.radians(F.lit(float(self.crval[1])))
        den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(da)
        ahead = den > 0
        xi = F.when(ahead, F.degrees(F.cos(d) * F.sin(da) / den))
        eta = F.when(ahead, F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da)) / den))
        return xi, eta

    def undistorted(self, ra, dec) -> tuple[Column, Column]:
        xi, eta = self.sky_to_tangent(ra, dec)
        c = self.cd
        det = c[0] * c[3] - c[1] * c[2]
        return (c[3] * xi - c[1] * eta) / det, (c[0] * eta - c[2] * xi) / det

    def with_pixels(self, df: DataFrame, ra: str, dec: str, x: str = "x", y: str = "y", iterations: int = 6) -> DataFrame:
        """Add pixel columns; the distortion is inverted by a fixed number of fixed-point steps.

        Directions on the far hemisphere get NULL.  The steps run inside ``aggregate``, so the
        expression does not grow with their number.
        """
        uu, vv = self.undistorted(ra, dec)
        start = F.struct(uu.alias("u"), vv.alias("v"))
        if self.a or self.b:
            start = F.aggregate(
                F.array_repeat(start, iterations), start,
                lambda acc, first: F.struct((first["u"] - polynomial(acc["u"], acc["v"], self.a)).alias("u"),
                                            (first["v"] - polynomial(acc["u"], acc["v"], self.b)).alias("v")))
        out = df.withColumn("_uv", start)
        return out.withColumns({x: F.col("_uv.u") + self.crpix[0], y: F.col("_uv.v") + self.crpix[1]}).drop("_uv")

    def sky_errors(self, x, y, x_err, y_err, delta: float = 0.1) -> tuple[Column, Column]:
        """Pixel errors to sky errors by a finite-difference Jacobian."""
        ra, dec = self.pixel_to_sky(x, y)
        ra_x, dec_x = self.pixel_to_sky(_c(x) + delta, y)
        ra_y, dec_y = self.pixel_to_sky(x, _c(y) + delta)
        ex, ey = _c(x_err) / delta, _c(y_err) / delta
        part = lambda p, q: F.sqrt((p * ex) ** 2 + (q * ey) ** 2)
        ra_err = part(ra_difference(ra_x, ra), ra_difference(ra_y, ra))
        return F.abs(ra_err * F.cos(F.radians(dec))), part(dec_x - dec, dec_y - dec)


def tile_corner(index, n: int, overlap: int = 10) -> dict[str, Column]:
    """Lower corner, centre and half side of tile ``index`` (0-based) of an n x n split."""
    i = _c(index).cast("long")
    col, row = i % n, F.floor(i / n)
    step = DETECTOR_SIDE / n
    shift = lambda k: F.when(k == n - 1, F.lit(float(overlap))).when(k != 0, F.lit(float(overlap // 2))).otherwise(F.lit(0.0))
    x = F.floor(FIRST_COLUMN + col * step).cast("double") - shift(col)
    y = F.floor(row * step).cast("double") - shift(row)
    half = float(-(-(-(-DETECTOR_SIDE // n)) // 2) + overlap // 2)
    return {"corner_x": x, "corner_y": y, "centre_x": x + half, "centre_y": y + half, "half_side": F.lit(half)}


def tile_of(x, y, n: int) -> Column:
    """1-based tile that owns a detector pixel, NULL outside the science area."""
    cx = F.floor((_c(x) - FIRST_COLUMN) * n / DETECTOR_SIDE)
    cy = F.floor(_c(y) * n / DETECTOR_SIDE)
    inside = (cx >= 0) & (cx < n) & (cy >= 0) & (cy < n)
    return F.when(inside, (cy * n + cx + 1).cast("long"))


def error_outline(df: DataFrame, ra: str, dec: str, radius_deg: str, points: int = 1000) -> DataFrame:
    """One row per outline point of a circular error region."""
    angle = F.col("outline") * F.lit(2 * 3.141592653589793 / (points - 1))
    return df.withColumn("outline", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumns({
        "outline_ra": F.col(ra) + F.col(radius_deg) * F.cos(angle),
        "outline_dec": F.col(dec) + F.col(radius_deg) * F.sin(angle),
    })
