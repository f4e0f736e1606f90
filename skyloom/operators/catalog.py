"""Catalogue cross-matches."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import _c, mahalanobis, ra_difference, separation_arcsec
from skyloom.functions.photometry import star_radius_px
from skyloom.operators.components import density_groups
from skyloom.operators.skew import OrderedScan, attach, best_per_key, broadcast_if_small, group_stats, nulls_last, pooled_medians
from skyloom.operators.spatial import any_within, box_candidates, cell, chord, euclid, nearest_within, pairs_within, unit_vector
from skyloom.session import cut_lineage

# Refinement factors of the closest approach: the least reach that surely holds a pair of an object settles it.
# Cells are as wide as the first reach; those that may hold the approach are cut ``FINER`` times finer.
APPROACH_LEVELS = (32, 8, 2, 1)
FINER = 32

SKIPPED_CLASSES = ["Asteroid", "CosmicRay", "Junk"]


def cone_search(catalogue: DataFrame, ra: float, dec: float, radius_deg: float, max_mag: float | None = None,
                mag: str = "gmag") -> DataFrame:
    """Box predicates that reach the scan, magnitude cut, then the exact separation."""
    out = catalogue.filter(F.col("dec").between(dec - radius_deg, dec + radius_deg))
    if max_mag is not None:
        out = out.filter(F.col(mag) < max_mag)
    cosd = math.cos(math.radians(min(89.9, abs(dec) + radius_deg)))
    half = radius_deg / cosd
    if half < 180:
        lo, hi = (ra - half) % 360, (ra + half) % 360
        out = out.filter(F.col("ra").between(lo, hi) if lo <= hi else (F.col("ra") >= lo) | (F.col("ra") <= hi))
    sep = separation_arcsec("ra", "dec", ra, dec)
    return out.withColumn("sep_arcsec", sep).filter(F.col("sep_arcsec") < radius_deg * 3600)


def cross_match(obs: DataFrame, cat: DataFrame, cat_id: str, tol_arcsec: float = 42.0, columns: Sequence[str] = (),
                defaults: dict | None = None, spherical: bool = False) -> DataFrame:
    """Nearest catalogue row within the tolerance, with defaults for unmatched rows.

    Flat RA/Dec distance as the default; ``spherical`` matches unit vectors instead.
    """
    if spherical:
        base, other = obs.withColumns(unit_vector("ra", "dec")), cat.withColumns(unit_vector("ra", "dec"))
        axes, radius = ["_ux", "_uy", "_uz"], chord(tol_arcsec)
    else:
        base, other, axes, radius = obs, cat, ["ra", "dec"], tol_arcsec / 3600
    hit = nearest_within(base, other, axes, axes, cat_id, radius, dist="match_dist").drop("_ux", "_uy", "_uz")
    if not spherical:
        hit = hit.withColumn(cat_id, F.when(F.col("match_dist") < radius, F.col(cat_id)))
    out = attach(hit, cat.select(cat_id, *columns), [cat_id]) if columns else hit
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def append_unmatched(first: DataFrame, second: DataFrame, tol_arcsec: float = 2.0) -> DataFrame:
    """Add the rows of ``second`` that have no row of ``first`` within the tolerance (on the sphere)."""
    uv = ["_ux", "_uy", "_uz"]
    fresh = any_within(second.withColumns(unit_vector("ra", "dec")), first.select("ra", "dec").withColumns(unit_vector("ra", "dec")),
                       uv, uv, chord(tol_arcsec), negate=True).drop(*uv)
    return first.unionByName(fresh, allowMissingColumns=True)


def density_match(a: DataFrame, b: DataFrame, a_id: str, b_id: str, distance_arcsec: float = 42.0) -> DataFrame:
    """Joint clustering of two catalogues; per mixed cluster the first row of ``a`` with its closest ``b``."""
    both = a.select(F.col(a_id).alias("_id"), F.lit(0).alias("_side"), "ra", "dec").unionByName(
        b.select(F.col(b_id).alias("_id"), F.lit(1).alias("_side"), "ra", "dec"))
    both = both.withColumn("_key", F.col("_id") * 2 + F.col("_side"))
    lab = density_groups(both, "_key", ["ra", "dec"], distance_arcsec / 3600, 2, label="_lab").filter("_lab IS NOT NULL")
    heads = lab.filter("_side = 0").groupBy("_lab").agg(F.min_by(F.struct(F.col("_id").alias(a_id), "ra", "dec"), "_id").alias("_h"))
    # One head per cluster, so this join is linear in the members.
    cand = attach(lab.filter("_side = 1"), heads, ["_lab"]).filter("_h IS NOT NULL")
    d2 = (F.col("ra") - F.col("_h.ra")) ** 2 + (F.col("dec") - F.col("_h.dec")) ** 2
    best = cand.groupBy("_lab").agg(F.first(F.col(f"_h.{a_id}")).alias(a_id), F.min(F.struct(d2.alias("d2"), F.col("_id").alias("b"))).alias("_m"))
    return best.select(a_id, F.col("_m.b").alias(b_id), F.sqrt("_m.d2").alias("match_dist"))


def closest_pair(a: DataFrame, b: DataFrame, a_id: str, b_id: str, axes: Sequence[str], limit: float) -> DataFrame:
    """The closest pair of two tables, if it is below ``limit``."""
    hit = nearest_within(b.select(b_id, *axes), a.select(a_id, *axes), axes, axes, a_id, limit, dist="pair_dist")
    return hit.filter(F.col("pair_dist") < limit).select(a_id, b_id, "pair_dist").orderBy("pair_dist", b_id, a_id).limit(1)


def attach_catalogue(rows: DataFrame, cat: DataFrame, cat_id: str, columns: Sequence[str], distance_arcsec: float = 42.0,
                     min_entry: int = 2, objid: str = "objid") -> DataFrame:
    """Catalogue columns on all rows of the objects that match; others get 0."""
    mean = rows.groupBy(objid).agg(F.avg("ra").alias("ra"), F.avg("dec").alias("dec"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_entry)
    match = density_match(mean, cat, objid, cat_id, distance_arcsec)
    named = match.join(cat.select(cat_id, *columns), cat_id).select(objid, *columns)
    out = attach(rows, named, [objid])
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in columns})


def merge_methods(first: DataFrame, second: DataFrame, tol_deg: float = 31.5 / 3600, objid: str = "objid", frame: str = "frame") -> DataFrame:
    """Relabel matching objects of a second detection method, give new ids to the rest,
    then one row per (objid, frame), the first method winning."""
    means = lambda df: df.groupBy(objid).agg(F.avg("ra").alias("ra"), F.avg("dec").alias("dec"))
    left = means(second).withColumnRenamed(objid, "_old")
    hit = nearest_within(left, means(first).withColumnRenamed(objid, "_new"), ["ra", "dec"], ["ra", "dec"], "_new", tol_deg)
    fresh = OrderedScan(hit.filter("_new IS NULL").select("_old"), [], ["_old"]).row_number("_rn").done()
    top = first.agg(F.max(objid).alias("_top"))  # one row
    fresh = fresh.crossJoin(F.broadcast(top)).select("_old", (F.col("_rn") + F.col("_top")).alias("_new"))
    names = hit.filter("_new IS NOT NULL").select("_old", "_new").unionByName(fresh).withColumnRenamed("_old", objid)
    renamed = attach(second, names, [objid]).withColumn(objid, F.col("_new")).drop("_new")
    both = first.withColumn("_src", F.lit(0)).unionByName(renamed.withColumn("_src", F.lit(1)))
    return best_per_key(both, [objid, frame], ["_src", "row"]).drop("_src")


def brightest_star(events: DataFrame, stars: DataFrame, sigma: float = 3.0, event: str = "eventkey", cell: float = 0.05) -> DataFrame:
    """The star of each event within ``sigma`` Mahalanobis units: brightest RP, else brightest G, else first.

    A wrapped error box with cos(dec) selects candidates by grid cell before the exact test.
    Classes that are no stars are skipped.
    """
    real = ~F.coalesce(F.col("classification").isin(SKIPPED_CLASSES), F.lit(False)) if "classification" in events.columns else F.lit(True)
    # Events with one place and errors share their star, and of stars at one place the first in order can win.
    place = {"_era": F.when(real, F.col("ra")), "_edec": F.col("dec"), "_sx": F.col("ra_err"), "_sy": F.col("dec_err")}
    small = events.select(*[c.alias(n) for n, c in place.items()]).filter("_era IS NOT NULL").distinct()
    cosd = F.greatest(F.cos(F.radians("_edec")), F.lit(1e-6))
    first = F.struct(*[c.alias(f"_{i}") for i, c in enumerate((*nulls_last("rpmag"), *nulls_last("gmag")))], F.col("source").alias("s"))
    pts = stars.groupBy(F.col("ra").alias("_ra"), F.col("dec").alias("_dec")).agg(F.min(first).alias("_o"))
    cells = int(round(360 / cell))
    cand = box_candidates(small, pts, [("_era", sigma * F.col("_sx") / cosd), ("_edec", sigma * F.col("_sy"))], ["_ra", "_dec"], cell, {0: cells})
    dra = ra_difference("_ra", "_era") * F.cos(F.radians("_edec"))
    ddec = F.col("_dec") - F.col("_edec")
    near = cand.filter((F.abs(dra) <= sigma * F.col("_sx")) & (F.abs(ddec) <= sigma * F.col("_sy"))
                       & (mahalanobis(dra, ddec, "_sx", "_sy") <= sigma))
    best = near.groupBy(*place).agg(F.min("_o").alias("_b"))
    out = attach(events.withColumns(place), best.select(*place, F.col("_b.s").alias("star_source")), list(place)).drop(*place)
    return out.withColumn("gaia_id", F.coalesce(F.col("star_source").cast("string"), F.lit("-"))).drop("star_source").select(*events.columns, "gaia_id")


def variable_class(events: DataFrame, variables: DataFrame, sigma: float = 3.0, event: str = "eventkey", cell: float = 0.05) -> DataFrame:
    """Class of the first variable inside the plain error box (no wrap, no cos(dec))."""
    small = events.select(event, F.col("ra").alias("_era"), F.col("dec").alias("_edec"), F.col("ra_err").alias("_sx"), F.col("dec_err").alias("_sy"))
    pts = variables.select("cat_idx", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), "var_type")
    cand = box_candidates(small, pts, [("_era", sigma * F.col("_sx")), ("_edec", sigma * F.col("_sy"))], ["_ra", "_dec"], cell)
    near = cand.filter((F.abs(F.col("_ra") - F.col("_era")) < sigma * F.col("_sx")) & (F.abs(F.col("_dec") - F.col("_edec")) < sigma * F.col("_sy")))
    first = near.groupBy(event).agg(F.min_by("var_type", "cat_idx").alias("_type"))
    return attach(events, first, [event]).withColumn("classification", F.coalesce("_type", "classification")).drop("_type")


def pooled_offset(det: DataFrame, pred: DataFrame, search_px: float = 5.0, min_pairs: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Median (dx, dy) of all same-frame pairs within ``search_px``; (0, 0) from too few pairs."""
    # Copies of a place are one row with their number; pairs are counted into bins and never written.
    one = det.groupBy(*keys, "frame", F.col("xcentroid").alias("_dx0"), F.col("ycentroid").alias("_dy0")).agg(F.count(F.lit(1)).alias("_nd"))
    two = pred.groupBy(*keys, "frame", F.col("x").alias("_px"), F.col("y").alias("_py")).agg(F.count(F.lit(1)).alias("_np"))
    pairs = pairs_within(one, two, ["_dx0", "_dy0"], ["_px", "_py"], search_px, [*keys, "frame"])
    diffs = pairs.select(*keys, (F.col("_dx0") - F.col("_px")).alias("offset_x"), (F.col("_dy0") - F.col("_py")).alias("offset_y"), (F.col("_nd") * F.col("_np")).alias("_w"))
    both = pooled_medians(diffs, keys, ["offset_x", "offset_y"], -search_px, search_px, "_w").withColumnRenamed("_n", "n_pairs")
    keep = lambda c: F.when(F.col("n_pairs") >= min_pairs, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return both.select(*keys, "n_pairs", keep("offset_x"), keep("offset_y"))


def _boxes(points: DataFrame, keys: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """The least box around the points of each key: {name}x0, {name}x1, {name}y0, {name}y1."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{name}{axis}{i}") for axis, c in (("x", x), ("y", y)) for i, f in enumerate((F.min, F.max))])


def _box_distances(a: str, b: str) -> tuple[Column, Column]:
    """(least, greatest) distance that points of two boxes can have, with room for rounding."""
    near, far = [], []
    for axis in "xy":
        a0, a1, b0, b1 = (F.col(f"{n}{axis}{i}") for n in (a, b) for i in (0, 1))
        near.append((F.greatest(F.lit(0.0), a0 - b1, b0 - a1), F.lit(0.0)))
        far.append((F.greatest(a1 - b0, b1 - a0), F.lit(0.0)))
    return euclid(near) * (1 - 1e-9), euclid(far) * (1 + 1e-9)


def _closest_boxes(pairs: DataFrame, objid: str, cols: Sequence[str], within: float, settle: float) -> tuple[DataFrame, DataFrame]:
    """(objects with a pair surely within ``settle``, their pairs of boxes that may hold the closest approach)."""
    least, most = _box_distances("_a", "_b")
    near = pairs.withColumns({"_least": least, "_most": most}).filter(F.col("_least") <= within)
    sure = cut_lineage(near.groupBy(objid).agg(F.min("_most").alias("_sure")).filter(F.col("_sure") <= settle))
    return sure, cut_lineage(near.join(broadcast_if_small(sure), objid).filter(F.col("_least") <= F.col("_sure")).select(*cols))


def identify_moving(det: DataFrame, pred: DataFrame, offset: DataFrame | None = None, max_dist: float = 3.0, objid: str = "objid") -> DataFrame:
    """Per object the closest approach of an offset-corrected prediction in a shared frame; all objects stay.

    Points are gathered in small cells.  The boxes around a cell's points tell which pairs of cells can hold an object's
    closest approach; these are looked at again in smaller cells, and only what then stays compares points.
    """
    off = offset if offset is not None else pooled_offset(det, pred)
    side = max_dist / APPROACH_LEVELS[0]
    known = lambda *cols: reduce(and_, [F.abs(F.col(c)) < float("inf") for c in cols])  # NULL and NaN are near nothing
    cells = lambda x, y, a, b: {f"{a}x": cell(x, side), f"{a}y": cell(y, side), f"{b}x": cell(x, side / FINER), f"{b}y": cell(y, side / FINER)}
    moved = pred.crossJoin(F.broadcast(off.select("offset_x", "offset_y")))  # one row per unit
    moved = moved.select("designation", "frame", (F.col("x") + F.col("offset_x")).alias("_px"), (F.col("y") + F.col("offset_y")).alias("_py")).filter(known("_px", "_py"))
    # Of predictions at one place and frame the first can win.  Sums in another order would move them, so they are kept.
    moved = cut_lineage(moved.groupBy("frame", "_px", "_py").agg(F.min("designation").alias("designation"))).withColumns(cells("_px", "_py", "_q", "_s"))
    points = det.select(objid, "frame", F.col("xcentroid").alias("_x"), F.col("ycentroid").alias("_y")).filter(known("_x", "_y")).withColumns(cells("_x", "_y", "_c", "_f"))
    mine, theirs = [objid, "frame", "_cx", "_cy"], ["frame", "_qx", "_qy"]
    todo, places, found = cut_lineage(_boxes(points, mine, "_x", "_y", "_a")), cut_lineage(_boxes(moved, theirs, "_px", "_py", "_b")), None
    for factor in APPROACH_LEVELS:
        reach, last = max_dist / factor, factor == APPROACH_LEVELS[-1]
        # Blocks four times as wide as the reach copy a box to about two of them; a cell lies in the block of its lower corner.
        wide, room = 4 * reach, reach * (1 + 1e-6)
        lhs = todo.withColumns({f"_k{i}": cell(F.col(c) * side, wide) for i, c in enumerate(("_cx", "_cy"))})
        rhs = places
        for i, axis in enumerate("xy"):
            rhs = rhs.withColumn(f"_k{i}", F.explode(F.sequence(cell(F.col(f"_b{axis}0") - room - 1.001 * side, wide), cell(F.col(f"_b{axis}1") + room, wide))))
        # The planner takes exploded rows for as few as they came from and would broadcast them.
        sure, hit = _closest_boxes(lhs.join(rhs.hint("merge"), ["frame", "_k0", "_k1"]), objid, [*mine, *theirs[1:]], reach, float("inf") if last else reach)
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(sure, objid, "left_anti")
        if todo.isEmpty():
            break
    some = broadcast_if_small(found.select(*mine).distinct())
    asked = broadcast_if_small(found.select(*theirs).distinct())
    points, moved = cut_lineage(points.join(some, mine, "left_semi").distinct()), cut_lineage(moved.join(asked, theirs, "left_semi"))
    inner = found.join(_boxes(points, [*mine, "_fx", "_fy"], "_x", "_y", "_a"), mine).join(_boxes(moved, [*theirs, "_sx", "_sy"], "_px", "_py", "_b"), theirs)
    both = _closest_boxes(inner, objid, [*mine, *theirs[1:], "_fx", "_fy", "_sx", "_sy"], max_dist, float("inf"))[1]
    near = both.join(points, [*mine, "_fx", "_fy"]).join(moved, [*theirs, "_sx", "_sy"])
    near = near.withColumn("_d", euclid([(F.col("_x"), F.col("_px")), (F.col("_y"), F.col("_py"))])).filter(F.col("_d") <= max_dist)
    best = near.groupBy(objid).agg(F.min("_d").alias("_d"), F.min_by(F.struct("designation", "frame"), F.struct("_d", "designation", "frame")).alias("_m"))
    return det.select(objid).distinct().join(best, objid, "left").select(
        objid, F.col("_m.designation").alias("designation"), F.col("_d").alias("dist_px"), F.col("_m.frame").alias("match_frame"))


def upgrade_class(events: DataFrame, matches: DataFrame | None, objid: str = "objid") -> DataFrame:
    """Match columns on events; matched events become asteroids.  Without an ephemeris the columns are NULL."""
    names = {"designation": "known_asteroid_designation", "dist_px": "known_asteroid_dist_px", "match_frame": "known_asteroid_frame"}
    if matches is None:
        return events.withColumns({names["designation"]: F.lit(None).cast("string"), names["dist_px"]: F.lit(None).cast("double"),
                                   names["match_frame"]: F.lit(None).cast("long")})
    out = attach(events, matches.select(objid, *[F.col(c).alias(n) for c, n in names.items()]), [objid])
    return out.withColumn("classification", F.when(F.col(names["designation"]).isNotNull(), F.lit("Asteroid")).otherwise(F.col("classification")))


def contaminating_star(points: DataFrame, stars: DataFrame, row: str, max_px: float = 20.0) -> DataFrame:
    """Per point the star with the least distance minus brightness-scaled radius within ``max_px``.

    Of stars at the same place only the brightest can win, so copies collapse first.
    """
    st = stars.filter(F.col("mag").isNotNull()).select(F.col("star_idx"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col("mag").alias("_sm"))
    st = st.groupBy("_sx", "_sy").agg(F.min(F.struct("_sm", "star_idx")).alias("_b")).select("_sx", "_sy", "_b._sm", "_b.star_idx")
    st = st.withColumn("_rad", star_radius_px("_sm"))
    # A small cell keeps only the stars that could win somewhere in it: none whose least margin there exceeds another's greatest.
    side = max_px / 8
    half = side / 2 * math.sqrt(2) + 1e-9
    pts = points.select(row, F.col("x").alias("_x"), F.col("y").alias("_y")).withColumns({"_fx": cell("_x", side), "_fy": cell("_y", side)})
    middles = pts.select("_fx", "_fy").distinct().withColumns({"_mx": (F.col("_fx") + 0.5) * side, "_my": (F.col("_fy") + 0.5) * side})
    seen = pairs_within(middles, st, ["_mx", "_my"], ["_sx", "_sy"], max_px + half, dist="_dm")
    greatest = F.when(F.col("_dm") + half <= max_px, F.col("_dm") + half - F.col("_rad"))
    able = group_stats(seen, ["_fx", "_fy"], F.min(greatest).alias("_top")).filter(
        F.col("_top").isNull() | (F.col("_dm") - half - F.col("_rad") <= F.col("_top"))).select("_fx", "_fy", "_sx", "_sy", "_rad", "star_idx", "_sm")
    near = pts.join(able, ["_fx", "_fy"]).withColumn("_d", euclid([(F.col("_x"), F.col("_sx")), (F.col("_y"), F.col("_sy"))])).filter(F.col("_d") <= max_px)
    best = near.groupBy(row).agg(F.min(F.struct((F.col("_d") - F.col("_rad")).alias("margin"), "star_idx", "_d", "_sm")).alias("_m"))
    out = attach(points, best, [row])
    return out.withColumns({
        "near_star_proximity": F.coalesce(F.col("_m.margin") < 0, F.lit(False)), "contaminating_star_dist_px": F.col("_m._d"),
        "contaminating_star_mag": F.col("_m._sm"), "contaminating_star_idx": F.coalesce(F.col("_m.star_idx"), F.lit(-1))}).drop("_m")


def recovery_match(injections: DataFrame, events: DataFrame, isolated: DataFrame | None = None, radius: float = 2.0, min_iou: float = 0.0,
                   weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0), keys: Sequence[str] = ()) -> DataFrame:
    """Best event per injection.

    An event must have the sign, lie within ``radius``, overlap in time and reach the
    overlap ratio; the finest time bin with a match wins, then the least weighted score.
    Unmatched injections with an isolated detection nearby are ``iso``, the others ``n``.
    """
    inj = injections.select(*keys, "injid", F.col("i_sign").alias("flux_sign"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"),
                            F.col("i_start").alias("_is"), F.col("i_end").alias("_ie"), F.col("i_max").alias("_im"), F.col("i_snr").alias("_isnr"))
    ev = events.select(*keys, "flux_sign", "eventkey", "frame_bin", F.col("x").alias("_ex"), F.col("y").alias("_ey"), F.col("mjd_start").alias("_es"),
                       F.col("mjd_end").alias("_ee"), F.col("mjd_max").alias("_em"), F.col("snr").alias("_esnr"))
    near = pairs_within(inj, ev, ["_x0", "_y0"], ["_ex", "_ey"], radius, [*keys, "flux_sign"], dist="centroid_sep")
    inter = F.least("_ee", "_ie") - F.greatest("_es", "_is")
    eps = F.lit(2.220446049250313e-16)
    near = near.filter(inter > 0).withColumn("temporal_iou", inter / (F.greatest("_ee", "_ie") - F.least("_es", "_is"))).filter(F.col("temporal_iou") >= min_iou)
    d_ev, d_in = F.greatest(F.col("_ee") - F.col("_es"), eps), F.greatest(F.col("_ie") - F.col("_is"), eps)
    near = near.withColumns({"duration_ratio": F.greatest(d_ev, d_in) / F.least(d_ev, d_in), "peak_offset_min": F.abs(F.col("_em") - F.col("_im")) * 1440.0})
    ws, wo, wd, wp = weights
    score = (ws * F.col("centroid_sep") + wo * (1 - F.col("temporal_iou")) + wd * F.abs(F.log("duration_ratio"))
             + wp * F.col("peak_offset_min") / F.greatest(d_in * 1440.0, F.lit(1.0)))
    near = near.withColumn("match_score", score)
    best = near.groupBy("injid").agg(F.min_by(
        F.struct("eventkey", "frame_bin", "centroid_sep", "temporal_iou", "duration_ratio", "peak_offset_min", "match_score",
                 (F.col("_esnr") / F.col("_isnr")).alias("snr_ratio")),
        F.struct("frame_bin", "match_score", "eventkey")).alias("_m"))
    out = attach(injections, best, ["injid"])
    found = F.when(F.col("_m.frame_bin") == 1, F.lit("y")).when(F.col("_m").isNotNull(), F.col("_m.frame_bin").cast("string"))
    if isolated is not None:
        iso = pairs_within(injections.select(*keys, "injid", F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("i_start").alias("_is"), F.col("i_end").alias("_ie")),
                           isolated.select(*keys, F.col("x").alias("_qx"), F.col("y").alias("_qy"), F.col("mjd").alias("_qt")),
                           ["_x0", "_y0"], ["_qx", "_qy"], radius, keys)
        iso = iso.filter((F.col("_qt") >= F.col("_is")) & (F.col("_qt") <= F.col("_ie"))).select("injid", F.lit(True).alias("_iso")).distinct()
        out = attach(out, iso, ["injid"])
        found = F.coalesce(found, F.when(F.col("_iso"), F.lit("iso")))
    return out.select(*injections.columns, F.coalesce(found, F.lit("n")).alias("detected"), "_m.*")


def recovery_summary(matched: DataFrame, snr: str = "i_snr", edges: tuple[float, float, int] = (0.0, 100.0, 10)) -> DataFrame:
    """Recovered share per event type and signal-to-noise bin."""
    return matched.groupBy("event_type", F.width_bucket(snr, F.lit(edges[0]), F.lit(edges[1]), F.lit(edges[2])).alias("snr_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("detected").isin("n", "iso")).alias("n_recovered"),
        F.count_if(F.col("detected") == "iso").alias("n_isolated"))


def sources_in_stamp(centres: DataFrame, sources: DataFrame, half: float, keys: Sequence[str] = ()) -> DataFrame:
    """All sources inside the square stamp around each centre."""
    near = box_candidates(centres, sources, [("cx", F.lit(float(half))), ("cy", F.lit(float(half)))], ["sx", "sy"], max(half, 1e-9))
    return near.filter((F.abs(F.col("sx") - F.col("cx")) <= half) & (F.abs(F.col("sy") - F.col("cy")) <= half))


def points_in_tiles(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """Every tile (lo/hi corners) that holds a point; tiles may overlap."""
    boxed = tiles.withColumns({"_cx": (F.col("x_lo") + F.col("x_hi")) / 2, "_cy": (F.col("y_lo") + F.col("y_hi")) / 2})
    near = box_candidates(boxed, points, [("_cx", (F.col("x_hi") - F.col("x_lo")) / 2), ("_cy", (F.col("y_hi") - F.col("y_lo")) / 2)], ["x", "y"], size)
    return near.filter((F.col("x") >= F.col("x_lo")) & (F.col("x") < F.col("x_hi")) & (F.col("y") >= F.col("y_lo")) & (F.col("y") < F.col("y_hi"))).drop("_cx", "_cy")


def in_ellipse(x, y, cx, cy, a, b) -> Column:
    """Analytic containment in an axis-parallel ellipse."""
    return ((_c(x) - _c(cx)) / _c(a)) ** 2 + ((_c(y) - _c(cy)) / _c(b)) ** 2 <= 1


def in_polygon(x, y, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges; points on an edge are outside."""
    px, py = _c(x), _c(y)
    crossings, on = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]]):
        beside = py.between(float(min(y1, y2)), float(max(y1, y2)))
        if y1 == y2:
            on = on | (beside & px.between(float(min(x1, x2)), float(max(x1, x2))))
            continue
        # The edge is px + lean * py = at.
        lean = (x1 - x2) / (y2 - y1)
        side, at = px + py * lean, F.lit(x1 + y1 * lean)
        spans = (F.lit(float(y1)) > py) != (F.lit(float(y2)) > py)
        crossings = crossings + F.when(spans & (side < at), 1).otherwise(0)
        on = on | (beside & (side == at))
    return (crossings % 2 == 1) & ~on


def flag_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, tol_arcsec: float = 5.0, columns: Sequence[str] = ()) -> DataFrame:
    """Columns of the nearest row of ``b`` within the tolerance, NULL otherwise (flat distances)."""
    hit = nearest_within(a, b, ["ra", "dec"], ["ra", "dec"], b_id, tol_arcsec / 3600, dist="_deg")
    out = attach(hit, b.select(b_id, *columns), [b_id])
    return out.withColumn("dist_arcsec", F.col("_deg") * 3600).drop("_deg")


def survey_route(df: DataFrame, dec: str, preferred: str | None = None, split_dec: float = -28.0) -> DataFrame:
    """An explicit survey when available, else the northern or the southern one."""
    default = F.when(F.col(dec) > split_dec, F.lit("north")).otherwise(F.lit("south"))
    return df.withColumn("survey", F.coalesce(F.col(preferred), default) if preferred else default)
