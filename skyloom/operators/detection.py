"""Matched-filter source detection on pixel tables.

An image is dealt into square tiles with a halo as wide as the widest kernel.  A tile is
filtered at all scales in one array step, its pixels above the threshold are joined into
parts, and only sums over parts and the pixels on its border leave it.  Parts that touch over
a border become one source through the connected components of the touching pairs, so a
source may cover any number of tiles and no task sees more than one tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.components import connected_components
from skyloom.operators.dedupe import dedupe_close
from skyloom.operators.photometry import offsets, stamp_pixels
from skyloom.operators.robust import MAD_TO_SIGMA, median_mad, sigma_clip
from skyloom.operators.skew import attach
from skyloom.operators.skew import spread as spread_rows
from skyloom.session import cut_lineage

# Kernel widths (full width at half maximum, in pixels), threshold, area, thinning radius, aperture and cuts.
WIDTHS = tuple(float(w) for w in np.linspace(0.7, 2.0, 10))
THRESHOLD, MIN_AREA, THIN_RADIUS, APERTURE, MIN_SNR, MAX_NEGATIVE, MAX_ELLIPTICITY = 0.3, 2, 1.0, 1.5, 3.0, 3.0, 0.75

TILE = 64
SUMS = ["n_pixels", "w", "wx", "wy", "wxx", "wyy", "wxy", "flux"]


def mexican_hat(fwhm: float) -> np.ndarray:
    """Negative Laplacian of a Gaussian with unit absolute sum, on an odd square of six deviations (five pixels at least)."""
    sd = fwhm / np.sqrt(8 * np.log(2))
    half = max(5, int(np.ceil(6 * sd)) | 1) // 2
    u = (np.arange(-half, half + 1) / sd) ** 2 / 2
    r = u[:, None] + u[None, :]
    hat = (1 - r) * np.exp(-r)
    return hat / np.abs(hat).sum()


def matched_snr(signal: np.ndarray, weight: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of kernel x signal x weight over the root of the sum of kernel^2 x weight, where ``weight`` is the inverse variance.

    Pixels of no weight are missing: they add nothing.
    """
    half = len(kernel) // 2
    s, w = np.pad(signal * weight, half), np.pad(weight, half)
    top, below = np.zeros_like(signal), np.zeros_like(signal)
    h, v = signal.shape
    for dy in range(len(kernel)):
        for dx in range(len(kernel)):
            k = kernel[dy, dx]
            top += k * s[dy:dy + h, dx:dx + v]
            below += k * k * w[dy:dy + h, dx:dx + v]
    return np.where(weight > 0, top / np.sqrt(np.where(below > 0, below, 1.0)), 0.0)


def joined_pixels(mask: np.ndarray) -> np.ndarray:
    """Per pixel of ``mask`` (in row order) the first pixel of its part; pixels join their eight neighbours."""
    number = np.full(mask.shape, -1)
    n = int(mask.sum())
    number[mask] = np.arange(n)
    pairs = []
    for a, b in ((number[:, :-1], number[:, 1:]), (number[:-1], number[1:]), (number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])):
        both = (a >= 0) & (b >= 0)
        pairs.append(np.stack([a[both], b[both]]))
    u, v = np.concatenate(pairs, axis=1)
    first = np.arange(n)
    while True:
        low, high = np.minimum(first[u], first[v]), np.maximum(first[u], first[v])
        if (low == high).all():
            return first
        np.minimum.at(first, high, low)
        while (first[first] != first).any():
            first = first[first]


def _parts(keys: Sequence[str], widths: Sequence[float], threshold: float, tile: int):
    kernels = [mexican_hat(w) for w in widths]
    ring = 1  # of pixels around a tile whose membership is known too
    reach = max(len(k) for k in kernels) // 2 + ring

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[-2]), int(key[-1])
        y0, x0 = ty * tile - reach, tx * tile - reach
        side = tile + 2 * reach
        at = (pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0)
        signal, noise = np.zeros((side, side)), np.zeros((side, side))
        signal[at] = pdf["s"].to_numpy(float)
        noise[at] = pdf["noise"].to_numpy(float)
        good = np.isfinite(signal) & np.isfinite(noise) & (noise > 0)
        signal = np.where(good, signal, 0.0)
        weight = np.where(good, 1.0 / np.where(good, noise, 1.0) ** 2, 0.0)
        core = slice(reach, reach + tile)
        wide = slice(reach - ring, reach + tile + ring)
        out = []
        # A tile beside the image has a halo only.
        for i, kernel in enumerate(kernels if weight[core, core].any() else ()):
            snr = matched_snr(signal, weight, kernel)
            for sign in (1, -1):
                seen = sign * snr[wide, wide]
                above = seen > threshold
                inside = above[ring:-ring, ring:-ring]
                if not inside.any():
                    continue
                first = joined_pixels(inside)
                y, x = np.nonzero(inside)
                w, flux = seen[ring:-ring, ring:-ring][inside], sign * signal[core, core][inside]
                py, px = y + ty * tile, x + tx * tile
                heads, of = np.unique(first, return_inverse=True)
                add = lambda v: np.bincount(of, weights=v, minlength=len(heads))
                rows = {"kind": 0, "scale": i, "flux_sign": sign, "part_y": py[heads], "part_x": px[heads], "y": 0, "x": 0, "n_pixels": np.bincount(of, minlength=len(heads)),
                        "w": add(w), "wx": add(w * px), "wy": add(w * py), "wxx": add(w * px * px), "wyy": add(w * py * py), "wxy": add(w * px * py), "flux": add(flux)}
                out.append(pd.DataFrame(rows))
                if above.sum() == inside.sum():
                    continue  # nothing beyond the border
                # Pixels on the tile's border (kind 1), and those beyond it that touch them (kind 2).
                edge = (y == 0) | (x == 0) | (y == tile - 1) | (x == tile - 1)
                ey, ex, part = y[edge], x[edge], first[edge]
                for kind, dy, dx in [(1, 0, 0), *[(2, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]]:
                    ny, nx = ey + dy, ex + dx
                    beyond = (ny < 0) | (nx < 0) | (ny >= tile) | (nx >= tile)
                    take = above[ny + ring, nx + ring] & (beyond if kind == 2 else ~beyond)
                    if take.any():
                        p = part[take]
                        out.append(pd.DataFrame({"kind": kind, "scale": i, "flux_sign": sign, "part_y": py[p], "part_x": px[p], "y": ny[take] + ty * tile, "x": nx[take] + tx * tile}))
        rows = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["kind", "scale", "flux_sign", "part_y", "part_x", "y", "x"])
        for name in SUMS:
            if name not in rows:
                rows[name] = np.nan
        rows["n_pixels"] = rows["n_pixels"].fillna(0)
        for name, value in zip(keys, key):
            rows[name] = value
        return rows

    return run, reach


def segments(pixels: DataFrame, keys: Sequence[str], widths: Sequence[float] = WIDTHS, threshold: float = THRESHOLD, min_area: int = MIN_AREA, tile: int = TILE) -> DataFrame:
    """Connected pixels above ``threshold`` for every kernel width and both signs, over pixels (keys, y, x, s, noise).

    ``s`` is the background-free value and ``noise`` its deviation; pixels without them are missing.
    Position and shape are moments of the filtered values, ``flux`` sums the unfiltered ones.
    """
    keys = list(keys)
    kinds = dict(pixels.dtypes)
    run, reach = _parts(keys, widths, threshold, tile)
    tiles = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    spread = pixels.select(*keys, "y", "x", "s", "noise", F.explode(tiles("y")).alias("_ty")).withColumn("_tx", F.explode(tiles("x")))
    # Tiles that hold a halo only find nothing.
    own = pixels.select(*keys, F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx")).distinct()
    spread = spread.join(own, [*keys, "_ty", "_tx"], "left_semi")
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "kind int, scale int, flux_sign long, part_y long, part_x long, y long, x long, n_pixels long", *[f"{s} double" for s in SUMS[1:]]])
    found = cut_lineage(spread_rows(spread, *keys, "_ty", "_tx").groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema))
    layer = [*keys, "scale", "flux_sign"]
    node = F.struct(*layer, "part_y", "part_x")
    own = found.filter("kind = 1").select(*layer, "y", "x", node.alias("u"))
    beyond = found.filter("kind = 2").select(*layer, "y", "x", node.alias("v"))
    roots = connected_components(own.join(beyond, [*layer, "y", "x"]).select("u", "v").distinct())
    parts = found.filter("kind = 0").withColumn("_node", node).join(roots.withColumnsRenamed({"node": "_node", "root": "_root"}), "_node", "left")
    whole = parts.groupBy(*layer, F.coalesce("_root", "_node").alias("_node")).agg(*[F.sum(s).alias(s) for s in SUMS]).filter(F.col("n_pixels") >= min_area)
    x, y = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
    whole = whole.withColumns({"xcentroid": x, "ycentroid": y, "_xx": F.col("wxx") / F.col("w") - x * x, "_yy": F.col("wyy") / F.col("w") - y * y, "_xy": F.col("wxy") / F.col("w") - x * y})
    # A source of no width in some direction counts as one pixel wide there.
    thin = F.when(F.col("_xx") * F.col("_yy") - F.col("_xy") ** 2 < 1 / 144, F.lit(1 / 12)).otherwise(F.lit(0.0))
    whole = whole.withColumns({"_xx": F.col("_xx") + thin, "_yy": F.col("_yy") + thin})
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(((F.col("_xx") - F.col("_yy")) / 2) ** 2 + F.col("_xy") ** 2)
    a, b = F.sqrt(F.greatest(half + root, F.lit(0.0))), F.sqrt(F.greatest(half - root, F.lit(0.0)))
    fwhm = F.element_at(F.array(*[F.lit(float(w)) for w in widths]), F.col("scale") + 1)
    return whole.select(*keys, "flux_sign", fwhm.alias("detection_fwhm"), F.col("_node").alias("source"), "n_pixels", "xcentroid", "ycentroid", "flux", a.alias("a"), b.alias("b"),
                        (0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))).alias("theta"))


def _covered(x: Column, y: Column, radius: float, parts: int = 5) -> Column:
    """Share of a pixel's ``parts`` x ``parts`` points that lie within ``radius`` of (x, y), measured from its centre."""
    steps = [(k + 0.5) / parts - 0.5 for k in range(parts)]
    points = [F.when((x - sx) ** 2 + (y - sy) ** 2 <= radius * radius, 1).otherwise(0) for sy in steps for sx in steps]
    total = points[0]
    for p in points[1:]:
        total = total + p
    return total / float(parts * parts)


def background_free(pixels: DataFrame, keys: Sequence[str], value: str = "v", mesh: int = 24) -> DataFrame:
    """(keys, y, x, s, noise): values less the median of their mesh cell, with its scaled MAD."""
    keys = list(keys)
    cell = [*keys, "_my", "_mx"]
    px = pixels.withColumns({"_my": F.floor(F.col("y") / mesh), "_mx": F.floor(F.col("x") / mesh)})
    # A cell has mesh x mesh pixels, so exact medians are bounded.
    return attach(px, median_mad(px, cell, value, largest=mesh * mesh), cell).select(
        *keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col(value) - F.col("median")).cast("double").alias("s"), (F.col("mad") * MAD_TO_SIGMA).cast("double").alias("noise"))


def detect_sources(pixels: DataFrame, keys: Sequence[str], value: str = "v", mesh: int = 24, widths: Sequence[float] = WIDTHS, threshold: float = THRESHOLD,
                   min_area: int = MIN_AREA, thin_radius: float = THIN_RADIUS, aperture: float = APERTURE, min_snr: float = MIN_SNR, max_neg_extent: float = MAX_NEGATIVE,
                   max_ellipticity: float = MAX_ELLIPTICITY, gain: float = 1.0, tile: int = TILE) -> DataFrame:
    """Sources of both signs, found at all kernel widths and thinned to the brightest within ``thin_radius``.

    The aperture's variance is the pixels' plus flux / ``gain``.  Sources that overlap at a width are
    one source there: they are not deblended.
    """
    keys = list(keys)
    sub = cut_lineage(background_free(pixels, keys, value, mesh))
    found = dedupe_close(segments(sub, keys, widths, threshold, min_area, tile), "source", ["xcentroid", "ycentroid"], "flux", thin_radius, keys=[*keys, "flux_sign"])
    found = cut_lineage(found.withColumns({"y": F.bround("ycentroid").cast("long"), "x": F.bround("xcentroid").cast("long")}))
    reach = max(int(np.ceil(aperture + 0.5)), 2)
    here = F.struct("source", "flux_sign", (F.col("xcentroid") - F.col("x")).alias("fx"), (F.col("ycentroid") - F.col("y")).alias("fy"))
    near = stamp_pixels(found.withColumn("_at", here), sub, keys, offsets(reach, square=True), "_at")
    share = _covered(F.col("_at.fx") - F.col("dx"), F.col("_at.fy") - F.col("dy"), aperture)
    signed = F.col("s") * F.col("_at.flux_sign")
    disc = F.col("dy") ** 2 + F.col("dx") ** 2 <= 4
    sums = near.groupBy(F.col("_at.source").alias("source")).agg(
        F.sum(share * signed).alias("_f"), F.sum(share * F.col("noise") ** 2).alias("_v"), F.min(F.when(disc, signed)).alias("_low"), F.count_if(disc).alias("_n"))
    clipped = sigma_clip(sub, keys, "s", 3.0, 5, library=True).filter("kept").groupBy(*keys).agg(F.stddev_pop("s").alias("_std"))
    out = attach(found.join(sums, "source"), clipped, keys)
    # Pixels outside the image count as 0.
    low = F.when(F.col("_n") < len(offsets(2.0)), F.least("_low", F.lit(0.0))).otherwise(F.col("_low"))
    out = out.withColumns({"snr": F.col("_f") / F.sqrt(F.col("_v") + F.greatest("_f", F.lit(0.0)) / gain), "neg_extent": F.greatest(F.lit(0.0), -low) / F.col("_std"),
                           "ellipticity": 1 - F.col("b") / F.greatest("a", F.lit(1e-6)), "fwhm": 2 * np.sqrt(2 * np.log(2)) * F.sqrt(F.col("a") * F.col("b"))})
    out = out.filter((F.col("snr") >= min_snr) & (F.col("neg_extent") < max_neg_extent) & (F.col("ellipticity") < max_ellipticity))
    return out.select(*keys, "flux_sign", "xcentroid", "ycentroid", F.floor(F.col("xcentroid") + 0.5).alias("xint"), F.floor(F.col("ycentroid") + 0.5).alias("yint"), "n_pixels", "flux", "snr",
                      "detection_fwhm", "a", "b", "theta", "fwhm", "ellipticity", "neg_extent")
