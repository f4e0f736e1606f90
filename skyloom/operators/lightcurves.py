"""Light curves of many events or objects at once, by box or by profile fit (P22, with P5, P6, P8 and P9).

Pixels are rows (keys..., frame, y, x, value), frames are rows (keys..., frame, mjd).  Only the pixels of the stamps in
the asked frames are joined; a stamp has a fixed number of pixels, so what is gathered per position and frame is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.photometry import offsets, resolve_units
from skyloom.operators.robust import MAD_TO_SIGMA, median_mad
from skyloom.operators.skew import attach

Profile = Callable[[Column, Column], Column]
WORD = 62  # pixels to a word of the good-pixel mask


def gaussian_profile(sigma: float) -> Profile:
    """A round Gaussian of the distance (dy, dx) from the source."""
    return lambda dy, dx: F.exp((dy * dy + dx * dx) * (-0.5 / sigma**2))


def sampled_profile(grid: Column, side: int, oversample: int) -> Profile:
    """Bilinear values of an oversampled profile; ``grid`` is an array column of ``side`` x ``side`` samples, row by row,
    centred on the middle sample.  Outside the samples the profile is 0."""
    middle = (side - 1) // 2

    def at(dy: Column, dx: Column) -> Column:
        v, u = dy * oversample + middle, dx * oversample + middle
        j, i = F.floor(v), F.floor(u)

        def sample(r: Column, c: Column) -> Column:
            inside = (r >= 0) & (r < side) & (c >= 0) & (c < side)
            return F.when(inside, F.get(grid, (r * side + c).cast("int"))).otherwise(F.lit(0.0))

        fy, fx = v - j, u - i
        return (1 - fy) * ((1 - fx) * sample(j, i) + fx * sample(j, i + 1)) + fy * ((1 - fx) * sample(j + 1, i) + fx * sample(j + 1, i + 1))

    return at


def stamp_column(profile: Profile, half: int, sub_y: Column, sub_x: Column) -> Column:
    """The profile of a source at (sub_y, sub_x) from the stamp's central pixel, as an array with sum 1, or of zeros."""
    places = F.array(*[F.struct(F.lit(float(dy)).alias("dy"), F.lit(float(dx)).alias("dx")) for dy, dx in offsets(half, square=True)])
    raw = F.transform(places, lambda o: profile(o["dy"] - sub_y, o["dx"] - sub_x))
    # Values and sum are bound to a variable of a lambda each, or every pixel would compute them again.
    summed = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))).alias("t")))
    return F.flatten(F.transform(summed, lambda s: F.transform(s["r"], lambda p: F.when(s["t"] > 0, p / s["t"]).otherwise(F.lit(0.0)))))


def event_windows(events: DataFrame, frames: DataFrame, keys: Sequence[str], ids: Sequence[str], buffer: int | None) -> DataFrame:
    """(keys, ids, frame, mjd) of every event: ``buffer`` frames before its start to ``buffer + 1`` after its end, where
    there are such frames; with None the whole series.  Events that are listed twice count once."""
    keys, ids = list(keys), list(ids)
    if buffer is None:
        return events.select(*keys, *ids).distinct().join(frames.select(*keys, "frame", "mjd"), keys)
    span = F.sequence((F.col("frame_start") - buffer).cast("long"), (F.col("frame_end") + buffer + 1).cast("long"))
    usable = events.filter("frame_end >= frame_start").select(*keys, *ids, F.explode(span).alias("frame")).distinct()
    return usable.join(frames.select(*keys, "frame", "mjd"), [*keys, "frame"])


def _positions(events: DataFrame, keys: list[str], ids: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per event; of rows with equal ids the least position counts."""
    cols = ["y", "x", *extra]
    return events.groupBy(*keys, *ids).agg(F.min(F.struct(*cols)).alias("_p")).select(*keys, *ids, *[F.col(f"_p.{c}").alias(c) for c in cols])


def _stamp_rows(places: DataFrame, windows: DataFrame, pixels: DataFrame, keys: list[str], ids: list[str], offs: list[tuple[int, int]], value: str) -> DataFrame:
    """(keys, ids, frame, mjd, pix, v) of the stamps; ``places`` has the central pixel cy, cx."""
    table = F.array(*[F.struct(F.lit(i).alias("pix"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offs)])
    want = attach(windows, places, [*keys, *ids]).withColumn("_o", F.explode(table)).select(
        *keys, *ids, "frame", "mjd", F.col("_o.pix").alias("pix"), (F.col("cy") + F.col("_o.dy")).cast("long").alias("y"), (F.col("cx") + F.col("_o.dx")).cast("long").alias("x"))
    return want.join(pixels.select(*keys, "frame", "y", "x", F.col(value).cast("double").alias("v")), [*keys, "frame", "y", "x"])


def box_light_curves(events: DataFrame, frames: DataFrame, pixels: DataFrame, keys: Sequence[str], ids: Sequence[str] = ("objid", "eventid"), buffer: int | None = 10, radius: float = 1.5, value: str = "v") -> DataFrame:
    """P22 by P5/P6: sums of the box around floor(position + 0.5) per frame, errors from the scaled MAD of the whole frame.

    Pixels that are NULL or NaN count as 0; a frame without any pixel of the box gives no row.
    """
    keys, ids = list(keys), list(ids)
    side = 2 * int(np.floor(radius)) + 1
    windows = event_windows(events, frames, keys, ids, buffer)
    at = _positions(events, keys, ids).select(*keys, *ids, F.floor(F.col("y") + 0.5).alias("cy"), F.floor(F.col("x") + 0.5).alias("cx"))
    rows = _stamp_rows(at, windows, pixels, keys, ids, offsets(int(np.floor(radius)), square=True), value)
    flux = rows.groupBy(*keys, *ids, "frame", "mjd").agg(F.coalesce(F.sum(F.when(~F.isnan("v"), F.col("v"))), F.lit(0.0)).alias("flux"))
    used = pixels.join(windows.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi").filter(F.col(value).isNotNull() & ~F.isnan(value))
    noise = median_mad(used, [*keys, "frame"], value).select(*keys, "frame", (float(side) * MAD_TO_SIGMA * F.col("mad")).alias("flux_err"))
    return attach(flux, noise, [*keys, "frame"])


def profile_light_curves(
    events: DataFrame, frames: DataFrame, pixels: DataFrame, keys: Sequence[str], profile: Profile, ids: Sequence[str] = ("objid", "eventid"),
    buffer: int | None = 10, stamp: int = 9, value: str = "v", neighbours: str | None = None, profile_columns: Sequence[str] = (), size: tuple[int, int] | None = None,
) -> DataFrame:
    """P22 by P8: forced fit of [profile, neighbours' profiles, constant] at a fixed position to every frame.

    ``neighbours`` names an array column of structs (y, x): other sources; those within half a stamp are fitted too, the
    source itself is not.  ``profile_columns`` are the columns of ``events`` that ``profile`` reads.  A pixel that is missing,
    NULL or NaN in one of an event's frames is left out of all of them.  With ``size`` (height, width) events whose stamp
    leaves the image are left out.  Where fewer than one pixel more than terms is left, or the terms depend on each other,
    flux, error and background are NULL.
    """
    keys, ids = list(keys), list(ids)
    half = stamp // 2
    offs = offsets(half, square=True)
    windows = event_windows(events, frames, keys, ids, buffer)
    at = _positions(events, keys, ids, [*profile_columns, *([neighbours] if neighbours else [])])
    at = at.withColumns({"cy": F.rint("y").cast("long"), "cx": F.rint("x").cast("long")})
    if size is not None:
        at = at.filter((F.col("cy") >= half) & (F.col("cx") >= half) & (F.col("cy") < size[0] - half) & (F.col("cx") < size[1] - half))
        windows = windows.join(at.select(*keys, *ids), [*keys, *ids], "left_semi")
    column = lambda y, x: stamp_column(profile, half, y - F.col("cy"), x - F.col("cx"))
    terms = F.array(column(F.col("y"), F.col("x")))
    if neighbours:
        near = F.filter(F.array_distinct(F.coalesce(F.col(neighbours), F.array().cast(dict(events.dtypes)[neighbours]))), lambda s: (
            (F.abs(s["y"] - F.col("y")) <= half) & (F.abs(s["x"] - F.col("x")) <= half) & ~((s["y"] == F.col("y")) & (s["x"] == F.col("x")))))
        terms = F.concat(terms, F.transform(near, lambda s: column(s["y"].cast("double"), s["x"].cast("double"))))
    design = at.select(*keys, *ids, F.flatten(terms).alias("_a"))

    words = [f"_g{j}" for j in range(-(-len(offs) // WORD))]
    ok = F.col("v").isNotNull() & ~F.isnan("v")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pix") % WORD).cast("int"))
    rows = _stamp_rows(at.select(*keys, *ids, "cy", "cx"), windows, pixels, keys, ids, offs, value)
    cells = rows.groupBy(*keys, *ids, "frame", "mjd").agg(
        F.sort_array(F.collect_list(F.when(ok, F.struct("pix", "v")))).alias("_v"),
        *[F.bit_or(F.when(ok & (F.floor(F.col("pix") / WORD) == j), bit).otherwise(F.lit(0).cast("long"))).alias(w) for j, w in enumerate(words)])
    good = cells.groupBy(*keys, *ids).agg(*[F.bit_and(w).alias(w) for w in words])
    wide = attach(cells.select(*keys, *ids, "frame", "mjd", F.col("_v.pix").alias("_pix"), F.col("_v.v").alias("_val")), good.join(design, [*keys, *ids]), [*keys, *ids])
    types = dict(wide.dtypes)
    group, npix = [*keys, *ids], len(offs)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*group, "frame", "mjd"]) + ", flux double, flux_err double, background double"

    def solve(batches):
        for pdf in batches:
            out = pdf[[*group, "frame", "mjd"]].copy()
            fits = np.full((len(pdf), 3), np.nan)
            for rows_ in pdf.groupby(group, dropna=False, sort=False).indices.values():
                first = pdf.iloc[rows_[0]]
                a = np.vstack([np.asarray(first["_a"], float).reshape(-1, npix), np.ones(npix)]).T
                use = np.array([int(first[words[p // WORD]]) >> (p % WORD) & 1 for p in range(npix)], bool) & np.isfinite(a).all(1)
                if use.sum() < a.shape[1] + 1 or np.linalg.matrix_rank(a[use]) < a.shape[1]:
                    continue
                a, d = a[use], np.full((len(rows_), npix), np.nan)
                for k, r in enumerate(rows_):
                    d[k, np.asarray(pdf["_pix"].iat[r], int)] = np.asarray(pdf["_val"].iat[r], float)
                d = d[:, use]
                inverse = np.linalg.inv(a.T @ a)
                c = d @ a @ inverse
                res = d - c @ a.T
                mad = np.median(np.abs(res - np.median(res, axis=1, keepdims=True)), axis=1)
                fits[rows_] = np.column_stack([c[:, 0], MAD_TO_SIGMA * mad * np.sqrt(inverse[0, 0]), c[:, -1]])
            out[["flux", "flux_err", "background"]] = fits
            yield out

    return wide.mapInPandas(solve, schema)


def box_fraction(events: DataFrame, keys: Sequence[str], ids: Sequence[str], profile: Profile, stamp: int = 9, radius: float = 1.5, profile_columns: Sequence[str] = ()) -> DataFrame:
    """P9 per event: the profile's share inside the box, of all of it in the stamp."""
    buf = int(np.floor(radius))
    at = _positions(events, list(keys), list(ids), profile_columns)
    sub = lambda c: F.col(c) - F.rint(c)

    def total(half: int) -> Column:
        places = F.array(*[F.struct(F.lit(float(dy)).alias("dy"), F.lit(float(dx)).alias("dx")) for dy, dx in offsets(half, square=True)])
        return F.aggregate(F.transform(places, lambda o: profile(o["dy"] - sub("y"), o["dx"] - sub("x"))), F.lit(0.0), lambda a, b: a + b)

    return at.select(*keys, *ids, (total(buf) / total(stamp // 2)).alias("fraction"))


def light_curves(
    events: DataFrame, frames: DataFrame, pixels: DataFrame, keys: Sequence[str], method: str = "aperture", units: str = "counts", zeropoints: DataFrame | None = None,
    profile: Profile | None = None, ids: Sequence[str] = ("objid", "eventid"), buffer: int | None = 10, stamp: int = 9, radius: float = 1.5, value: str = "v",
    neighbours: str | None = None, profile_columns: Sequence[str] = (), size: tuple[int, int] | None = None,
) -> DataFrame:
    """(keys, ids, frame, mjd, flux, flux_err, units) of all listed events, or of objects by ``ids=["objid"]`` and no buffer.

    ``zeropoints`` has keys and zp_ab; where it has none the curve stays in counts.  A box's zero-point takes in the flux that
    the profile leaves outside.
    """
    keys, ids = list(keys), list(ids)
    if method == "aperture":
        lc = box_light_curves(events, frames, pixels, keys, ids, buffer, radius, value)
    elif method == "psf":
        lc = profile_light_curves(events, frames, pixels, keys, profile, ids, buffer, stamp, value, neighbours, profile_columns, size).drop("background")
    else:
        raise ValueError(f"unknown method {method!r}")
    if units.lower() in ("count", "counts"):
        return lc.withColumn("units", F.lit("counts"))
    if zeropoints is None:
        raise ValueError(f"units {units!r} need zero-points")
    zp = zeropoints.select(*keys, "zp_ab")
    if method == "aperture" and profile is not None:
        lost = box_fraction(events, keys, ids, profile, stamp, radius, profile_columns)
        zp = attach(lost, zp, keys).select(*keys, *ids, (F.col("zp_ab") + 2.5 * F.log10("fraction")).alias("zp_ab"))
        return resolve_units(lc, zp, [*keys, *ids], units)
    return resolve_units(lc, zp, keys, units)
