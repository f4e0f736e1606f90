"""Fits of calibration stars and the zero-point that their scenes share.

A star's stamp has a fixed number of pixels and its shift is sought on grids that halve from round to round, so each star
is one row with bounded arrays; the linear systems are solved in Arrow batches.  Rows only meet where a unit's zero-point
is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.filters import keep_good_errors
from skyloom.operators.lightcurves import Profile, stamp_column
from skyloom.operators.photometry import calibration_zeropoint, offsets
from skyloom.operators.robust import binned_zeropoint, sigma_clip
from skyloom.operators.skew import attach
from skyloom.session import cut_lineage

GRID = [(j, i) for j in range(-2, 3) for i in range(-2, 3)]  # a round's shifts, in steps
INNER = 2  # errors come from the 5x5 pixels around the star


def star_stamps(stars: DataFrame, image: DataFrame, keys: Sequence[str], star: str = "star", stamp: int = 9, value: str = "v") -> DataFrame:
    """``stars`` (keys, star, y, x, ...) with cy, cx and the stamp's values ``_v`` row by row.

    Stars whose stamp leaves the image or holds a NULL, NaN or infinite pixel are left out, as are all but one row of equal
    ids (the least).
    """
    keys = list(keys)
    offs = offsets(stamp // 2, square=True)
    rest = [c for c in stars.columns if c not in (*keys, star)]
    one = stars.filter(F.col("y").isNotNull() & F.col("x").isNotNull()).groupBy(*keys, star).agg(F.min(F.struct(*rest)).alias("_s")).select(*keys, star, "_s.*")
    one = one.withColumns({"cy": F.rint("y").cast("long"), "cx": F.rint("x").cast("long")})
    table = F.array(*[F.struct(F.lit(i).alias("pix"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offs)])
    want = one.select(*keys, star, "cy", "cx", F.explode(table).alias("_o")).select(
        *keys, star, F.col("_o.pix").alias("pix"), (F.col("cy") + F.col("_o.dy")).alias("y"), (F.col("cx") + F.col("_o.dx")).alias("x"))
    v = F.col(value).cast("double")
    pixels = image.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, "y", "x", v.alias("v"))
    got = want.join(pixels, [*keys, "y", "x"]).groupBy(*keys, star).agg(F.sort_array(F.collect_list(F.struct("pix", "v"))).alias("_p"))
    return one.join(got.filter(F.size("_p") == len(offs)).select(*keys, star, F.col("_p.v").alias("_v")), [*keys, star])


def with_scene(stamps: DataFrame, sources: DataFrame, keys: Sequence[str], star: str = "star", stamp: int = 9) -> DataFrame:
    """Adds arrays ``_ny``, ``_nx`` and ``_nm`` of the other sources inside the stamp, one per position.

    Stamps with as many sources as pixels cannot be solved; they are counted out before anything is gathered.
    """
    keys = list(keys)
    half, side = stamp // 2, float(stamp)
    grid = lambda c: F.floor(F.col(c) / side)
    pts = sources.filter(F.col("y").isNotNull() & F.col("x").isNotNull()).groupBy(*keys, F.col("y").cast("double").alias("ny"), F.col("x").cast("double").alias("nx")).agg(F.min("mag").alias("nmag"))
    pts = pts.withColumns({"_ky": grid("ny"), "_kx": grid("nx")})
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half - 0.5) / side), F.floor((F.col(c) + half + 0.5) / side)))
    near = stamps.select(*keys, star, "y", "x", "cy", "cx").withColumn("_ky", reach("cy")).withColumn("_kx", reach("cx")).join(pts, [*keys, "_ky", "_kx"])
    inside = lambda n, c: (F.col(n) >= F.col(c) - half - 0.5) & (F.col(n) < F.col(c) + half + 0.5)
    near = near.filter(inside("ny", "cy") & inside("nx", "cx") & ~((F.col("ny") == F.col("y")) & (F.col("nx") == F.col("x"))))
    many = near.groupBy(*keys, star).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > stamp * stamp - 3)
    listed = near.join(many, [*keys, star], "left_anti").groupBy(*keys, star).agg(
        F.sort_array(F.collect_list(F.struct(F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("nmag").cast("double").alias("mag")))).alias("_n"))
    listed = listed.select(*keys, star, *[F.col(f"_n.{c}").alias(n) for c, n in (("y", "_ny"), ("x", "_nx"), ("mag", "_nm"))])
    return attach(stamps.join(many, [*keys, star], "left_anti"), listed, [*keys, star])


def _designed(df: DataFrame, profile: Profile, stamp: int, shifts: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Adds ``_t``, the star's profile at each shift, and ``_f``, the neighbours' profiles, one after the other."""
    half, sy, sx = stamp // 2, F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    moved = F.flatten(F.transform(F.array(*[F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")) for a, b in shifts]), lambda s: stamp_column(profile, half, sy + s["a"], sx + s["b"])))
    none = F.array().cast("array<double>")
    fixed = F.flatten(F.zip_with("_ny", "_nx", lambda a, b: stamp_column(profile, half, a - F.col("cy"), b - F.col("cx")))) if "_ny" in df.columns else none
    return df.withColumns({"_t": moved, "_f": F.coalesce(fixed, none)})


def locate(df: DataFrame, profile: Profile, tol_y: Column, tol_x: Column, stamp: int = 9, rounds: int = 4, polish: bool = True) -> DataFrame:
    """Adds dy_fit and dx_fit, the shift within the tolerance whose linear fit leaves the least squares.

    Each round tries 5 x 5 shifts around the last best, in steps that begin at half the tolerance and halve; ``polish``
    ends with a parabola per axis.  Equal squares go to the smaller shift in y, then x.
    """
    npix, cols = stamp * stamp, df.columns
    out = df.withColumns({"dy_fit": F.lit(0.0), "dx_fit": F.lit(0.0), "_ty": F.coalesce(tol_y.cast("double"), F.lit(0.0)), "_tx": F.coalesce(tol_x.cast("double"), F.lit(0.0))})

    def chooser(step: float, last: bool):
        def best(batches):
            for pdf in batches:
                sy, sx = np.zeros(len(pdf)), np.zeros(len(pdf))
                for r in range(len(pdf)):
                    v, t = np.asarray(pdf["_v"].iat[r], float), np.asarray(pdf["_t"].iat[r], float).reshape(25, npix)
                    # Project constant and neighbours out; what is left of a shifted profile explains the rest.
                    q = np.linalg.qr(np.vstack([np.ones(npix), np.asarray(pdf["_f"].iat[r], float).reshape(-1, npix)]).T)[0]
                    v, t = v - q @ (q.T @ v), t - (t @ q) @ q.T
                    norm = (t * t).sum(1)
                    loss = np.where(norm > 1e-14, v @ v - (t @ v) ** 2 / np.maximum(norm, 1e-300), v @ v)
                    ty, tx = pdf["_ty"].iat[r], pdf["_tx"].iat[r]
                    y = np.clip([pdf["dy_fit"].iat[r] + j * step * ty for j, _ in GRID], -ty, ty)
                    x = np.clip([pdf["dx_fit"].iat[r] + i * step * tx for _, i in GRID], -tx, tx)
                    k = min(range(25), key=lambda n: (loss[n], y[n], x[n]))
                    sy[r], sx[r] = y[k], x[k]
                    if last:
                        for pos, by, tol in ((sy, 5, ty), (sx, 1, tx)):
                            place = k // 5 if by == 5 else k % 5
                            if 0 < place < 4 and abs(pos[r]) < tol:
                                a, b, c = loss[k - by], loss[k], loss[k + by]
                                if a + c > 2 * b:
                                    pos[r] = np.clip(pos[r] + 0.5 * step * tol * (a - c) / (a - 2 * b + c), -tol, tol)
                yield pdf[[*cols, "_ty", "_tx"]].assign(dy_fit=sy, dx_fit=sx)

        return best

    base = [f"`{n}` {t}" for n, t in df.dtypes] + ["_ty double", "_tx double", "dy_fit double", "dx_fit double"]
    for n in range(rounds):
        step = 0.5 ** (n + 1)
        near = lambda c, t, k: F.least(F.greatest(F.col(c) + k * step * F.col(t), -F.col(t)), F.col(t))
        grid = _designed(out, profile, stamp, [(near("dy_fit", "_ty", j), near("dx_fit", "_tx", i)) for j, i in GRID])
        out = grid.mapInPandas(chooser(step, polish and n == rounds - 1), ", ".join(base))
    return out.drop("_ty", "_tx")


def fit_fluxes(df: DataFrame, profile: Profile, stamp: int = 9, zp: str | None = None, tolerance: str | None = None) -> DataFrame:
    """Adds flux_psf, e_flux_psf, background, n_scene and at_bound; stars without a positive flux are left out.

    With neighbours (``with_scene``) all fluxes are fitted together.  ``zp`` and ``tolerance`` name columns with the unit's
    zero-point and a number of magnitudes: each source's flux then stays within that of its catalogue magnitude, sources without a
    magnitude are free; ``at_bound`` marks stars whose flux lies within its error of a bound.
    """
    npix, scene = stamp * stamp, "_ny" in df.columns
    inner = np.array([max(abs(dy), abs(dx)) <= INNER for dy, dx in offsets(stamp // 2, square=True)])
    out = _designed(df, profile, stamp, [(F.col("dy_fit"), F.col("dx_fit"))])
    mags = F.concat(F.array(F.col("mag").cast("double")), F.coalesce("_nm", F.array().cast("array<double>"))) if scene else F.array(F.col("mag").cast("double"))
    around = lambda m, side: F.when(m.isNotNull(), F.pow(F.lit(10.0), (F.col(zp) + side * F.col(tolerance) - m) / 2.5))
    no = F.array().cast("array<double>")
    out = out.withColumns({"_lo": F.transform(mags, lambda m: around(m, -1)) if zp else no, "_hi": F.transform(mags, lambda m: around(m, 1)) if zp else no})
    keep = df.columns

    def solve(batches):
        for pdf in batches:
            res = np.full((len(pdf), 4), np.nan)
            bound = np.zeros(len(pdf), bool)
            for r in range(len(pdf)):
                v = np.asarray(pdf["_v"].iat[r], float)
                a = np.vstack([np.asarray(pdf["_t"].iat[r], float), np.asarray(pdf["_f"].iat[r], float).reshape(-1, npix), np.ones(npix)]).T
                k = a.shape[1] - 1
                if npix < k + 1 or not np.isfinite(a).all():
                    continue
                g, b = a.T @ a, a.T @ v
                if np.linalg.matrix_rank(a) < k + 1:
                    continue
                x = np.linalg.solve(g, b)
                lo, hi = np.full(k + 1, -np.inf), np.full(k + 1, np.inf)
                if len(pdf["_lo"].iat[r]):
                    low, high = np.asarray(pdf["_lo"].iat[r], float), np.asarray(pdf["_hi"].iat[r], float)
                    lo[:k], hi[:k] = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
                if ((x < lo) | (x > hi)).any():
                    x = _bounded(g, b, lo, hi, x)
                d = v - a @ x
                if scene:
                    dof = inner.sum() - (k + 1)
                    s2 = (d[inner] ** 2).sum() / dof if dof > 0 else (d**2).sum() / max(npix - (k + 1), 1)
                    e = np.sqrt(s2 * np.linalg.inv(g)[0, 0])
                else:
                    p, n = a[inner, 0], inner.sum()
                    det = n * (p * p).sum() - p.sum() ** 2
                    e = np.sqrt((d[inner] ** 2).sum() / (n - 4) * n / det) if det > 0 else np.nan
                res[r] = x[0], e, x[-1], k
                slack = e if np.isfinite(e) else 0.0
                bound[r] = x[0] - slack <= lo[0] or x[0] + slack >= hi[0]
            yield pdf[keep].assign(flux_psf=res[:, 0], e_flux_psf=res[:, 1], background=res[:, 2], n_scene=res[:, 3], at_bound=bound)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", flux_psf double, e_flux_psf double, background double, n_scene double, at_bound boolean"
    return out.mapInPandas(solve, schema).filter("flux_psf > 0").withColumn("n_scene", F.col("n_scene").cast("long"))


def _bounded(g, b, lo, hi, start, rounds: int = 2000):
    """Least squares within bounds by cyclic descent on the normal equations, which is exact in the limit."""
    x = np.clip(start, lo, hi)
    for _ in range(rounds):
        before = x.copy()
        for k in range(len(x)):
            x[k] = np.clip(x[k] + (b[k] - g[k] @ x) / g[k, k], lo[k], hi[k])
        if np.max(np.abs(x - before)) <= 1e-12 * (1 + np.max(np.abs(x))):
            break
    return x


def _zeropoints(fits: DataFrame) -> DataFrame:
    return fits.withColumns({"zp_ab": F.col("mag") + 2.5 * F.log10("flux_psf"), "e_zp_ab": F.lit(2.5 / np.log(10)) * F.col("e_flux_psf") / F.col("flux_psf"), "rp": F.col("mag")})


def scene_calibration(
    isolated: DataFrame, stars: DataFrame, sources: DataFrame, image: DataFrame, keys: Sequence[str], profile: Profile, star: str = "star", stamp: int = 9, free: float = 1.0,
    pos_nsig: float = 3.0, min_tolerance_mag: float = 0.5, rounds: int = 3, settle: float = 1e-3, max_err_factor: float = 3.0, max_err: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """(zero-points per unit, fitted scenes).

    Stage 1 fits ``isolated`` stars alone within ``free`` pixels and combines them.  Stage 2 fits every star of ``stars`` with all
    ``sources`` in its stamp: the star may move by ``pos_nsig`` clipped scatters of stage 1 from its catalogue position (a shift common to all is the alignment's task), fluxes stay near the zero-point's; the
    zero-point is combined again until no unit's moves by ``settle``.  Shifts don't depend on the zero-point and are sought once.
    Units without a zero-point of stage 1 get none.
    """
    keys = list(keys)
    tol = F.lit(float(free))
    first = cut_lineage(_zeropoints(fit_fluxes(locate(star_stamps(isolated, image, keys, star, stamp), profile, tol, tol, stamp), profile, stamp)).drop("_v"))
    zp = calibration_zeropoint(first.select(*keys, "mag", F.col("flux_psf").alias("flux"), F.col("e_flux_psf").alias("e_flux")), keys, "mag", max_err_factor).drop("converged")
    spread = None
    for axis in ("y", "x"):
        kept = sigma_clip(first.select(*keys, f"d{axis}_fit"), keys, f"d{axis}_fit", 3.0, 5).filter("kept")
        s = kept.groupBy(*keys).agg((pos_nsig * F.stddev_pop(f"d{axis}_fit")).alias(f"_p{axis}"))
        spread = s if spread is None else spread.join(s, keys)
    scenes = attach(with_scene(star_stamps(stars, image, keys, star, stamp), sources, keys, star, stamp), spread, keys)
    scenes = cut_lineage(locate(scenes, profile, F.col("_py"), F.col("_px"), stamp).drop("_py", "_px"))
    fits = None
    for _ in range(rounds):
        zp = cut_lineage(zp)
        wide = scenes.join(zp.select(*keys, F.col("zp_ab").alias("_zp"), F.greatest(3 * F.coalesce("e_zp_ab", F.lit(min_tolerance_mag)), F.lit(min_tolerance_mag)).alias("_tol")), keys)
        fits = cut_lineage(_zeropoints(fit_fluxes(wide, profile, stamp, "_zp", "_tol").drop("_zp", "_tol", "_v", "_ny", "_nx", "_nm")))
        good = keep_good_errors(fits.filter(~F.col("at_bound")), "e_zp_ab", keys, max_err_factor, max_err)
        new = cut_lineage(binned_zeropoint(good, keys))
        moved = new.join(zp.select(*keys, F.col("zp_ab").alias("_old")), keys).agg(F.max(F.abs(F.col("zp_ab") - F.col("_old")))).first()[0]
        # Units that have lost all good scenes keep their last zero-point.
        zp = new.unionByName(zp.join(new, keys, "left_anti").select(new.columns))
        if moved is None or moved < settle:
            break
    return zp, fits
