"""Predicates and selections on event, object and measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import _c, separation_arcsec
from skyloom.operators.skew import OrderedScan, attach, attach_few, best_per_key, exact_percentiles
from skyloom.operators.spatial import box_candidates
from skyloom.session import cut_lineage

# The classes behind ``var``; the object filter lacks RRLyrae.
VARIABLE_CLASSES = ["VCR", "VRRLyr", "VEB", "VLPV", "VST", "VAGN", "VRM", "VMSO", "RRLyrae"]
OBJECT_VARIABLE_CLASSES = ["VCR", "VRRLyr", "VEB", "VLPV", "VST", "VAGN", "VRM", "VMSO"]


def classification_is(col, wanted: str, for_objects: bool = False) -> Column:
    """case-insensitive class test; leading ``!`` or ``~`` negates, ``var`` names all variables."""
    name = wanted.lstrip("!~").lower()
    classes = (OBJECT_VARIABLE_CLASSES if for_objects else VARIABLE_CLASSES) if name in ("var", "variable") else [name]
    hit = F.lower(_c(col)).isin([c.lower() for c in classes])
    return ~hit if wanted.startswith(("!", "~")) else hit


def duration_within(duration, frame_bin, low=None, high=None) -> Column:
    """limits are given in unbinned frames."""
    cond = F.lit(True)
    if high is not None:
        cond = cond & (_c(duration) <= F.lit(high) / _c(frame_bin))
    if low is not None:
        cond = cond & (_c(duration) >= F.lit(low) / _c(frame_bin))
    return cond


def centroid_error_within(ex, ey, limit: float) -> Column:
    """F5."""
    return _c(ex) ** 2 + _c(ey) ** 2 <= 2 * limit * limit


def latitude_within(gal_b, limits) -> Column:
    """|b| inside [low, high]; a single number means up to the pole."""
    low, high = (limits, 90.0) if isinstance(limits, (int, float)) else (min(limits), max(limits))
    return F.abs(_c(gal_b)).between(low, high)


def no_crossbins(ids) -> Column:
    """the event was not seen in another time bin."""
    return F.size(_c(ids)) == 0


def star_filter(events: DataFrame, mode, objects: DataFrame | None = None) -> DataFrame:
    """``True`` keeps events without a star, ``'hard'`` also needs an object without one,
    ``False`` keeps events with a star, ``None`` keeps all."""
    if mode is None:
        return events
    if mode is False:
        return events.filter(F.col("gaia_id") != "-")
    out = events.filter(F.col("gaia_id") == "-")
    if mode == "hard":
        out = out.join(objects.filter(F.col("gaia_id") == "-").select("objid"), "objid", "left_semi")
    return out


def outside_boundaries(events: DataFrame, bounds: DataFrame, buffer: float) -> DataFrame:
    """F8: drop events that overlap a frame within buffer/frame_bin of a boundary.

    ``bounds`` has one row per frame_bin: brk (last frame of the first part) and last.  It
    is as small as the list of time bins, and joins on that key.
    """
    reach = F.floor(F.lit(float(buffer)) / F.col("frame_bin"))
    edges = F.array(F.lit(0).cast("long"), F.col("brk"), F.col("brk") + 1, F.col("last"))
    touched = F.exists(edges, lambda b: (
        F.greatest(b - reach, F.lit(0)) <= F.col("frame_end")) & (F.least(b + reach, F.col("last")) >= F.col("frame_start"))
        & (F.greatest(b - reach, F.lit(0)) <= F.least(b + reach, F.col("last"))))
    joined = events.join(bounds, "frame_bin", "left")
    return joined.filter(~F.coalesce(touched, F.lit(False))).select(*events.columns)


def filter_events(events: DataFrame, *, frame_bin=None, flux_sign=None, classification=None, star=None, no_asteroids=False,
                  no_straps=False, no_cosmic_rays=False, no_junk=True, min_duration=None, max_duration=None, min_events=None,
                  max_events=None, lc_sig_max=None, lc_sig_med=None, lc_flat=None, image_sig_max=None, psf_like=None,
                  galactic_latitude=None, centroid_err=None, crossbins=True, exclude_bad_frames=False, objects=None,
                  bounds=None, boundary_buffer=None) -> DataFrame:
    """all optional predicates, joined by AND; an omitted one costs nothing."""
    c = F.col
    out = star_filter(events, star, objects)
    tests = [
        (no_asteroids, lambda: c("classification") != "Asteroid"),
        (no_cosmic_rays, lambda: c("classification") != "CosmicRay"),
        (no_junk, lambda: c("classification") != "Junk"),
        (no_straps, lambda: c("source_mask") < 4),
        (frame_bin is not None, lambda: c("frame_bin") == frame_bin),
        (not crossbins, lambda: no_crossbins("crossbin_ids")),
        (exclude_bad_frames, lambda: c("bad_frame_flag") == 0),
        (lc_flat is not None, lambda: c("lc_flat") == int(bool(lc_flat))),
        (galactic_latitude is not None, lambda: latitude_within("gal_b", galactic_latitude)),
        (classification is not None, lambda: classification_is("classification", classification)),
        (min_duration is not None or max_duration is not None, lambda: duration_within("frame_duration", "frame_bin", min_duration, max_duration)),
        (lc_sig_max is not None, lambda: c("lc_sig_max") >= lc_sig_max),
        (lc_sig_med is not None, lambda: c("lc_sig_med") >= lc_sig_med),
        (image_sig_max is not None, lambda: c("image_sig_max") >= image_sig_max),
        (min_events is not None, lambda: c("total_events") >= min_events),
        (max_events is not None, lambda: c("total_events") <= max_events),
        (flux_sign is not None, lambda: c("flux_sign") == flux_sign),
        (psf_like is not None, lambda: c("psf_like") >= psf_like),
        (centroid_err is not None, lambda: centroid_error_within("xcentroid_err", "ycentroid_err", centroid_err)),
    ]
    for wanted, make in tests:
        if wanted:
            out = out.filter(make())
    return outside_boundaries(out, bounds, boundary_buffer) if boundary_buffer is not None else out


def filter_objects(objects: DataFrame, *, ra=None, dec=None, distance=None, min_events=None, max_events=None, classification=None,
                   flux_sign=None, lc_sig_max=None, min_length_frame=None, max_length_frame=None, min_length_mjd=None,
                   max_length_mjd=None, galactic_latitude=None, centroid_err=None, star=None) -> DataFrame:
    """cone (arcsec), class, significance and event-length limits on objects."""
    c = F.col
    out = star_filter(objects, star)
    tests = [
        (distance is not None, lambda: separation_arcsec("ra", "dec", float(ra), float(dec)) < distance),
        (min_events is not None, lambda: c("n_events") >= min_events),
        (max_events is not None, lambda: c("n_events") <= max_events),
        (classification is not None, lambda: classification_is("classification", classification, for_objects=True)),
        (flux_sign is not None, lambda: c("flux_sign") == flux_sign),
        (lc_sig_max is not None, lambda: c("lc_sig_max") >= lc_sig_max),
        (min_length_frame is not None, lambda: c("max_eventlength_frame") >= min_length_frame),
        (max_length_frame is not None, lambda: c("max_eventlength_frame") <= max_length_frame),
        (min_length_mjd is not None, lambda: c("max_eventlength_mjd") >= min_length_mjd),
        (max_length_mjd is not None, lambda: c("max_eventlength_mjd") <= max_length_mjd),
        (galactic_latitude is not None, lambda: latitude_within("gal_b", galactic_latitude)),
        (centroid_err is not None, lambda: centroid_error_within("xcentroid_err", "ycentroid_err", centroid_err)),
    ]
    for wanted, make in tests:
        if wanted:
            out = out.filter(make())
    return out


def crossbin_events(events: DataFrame, ids: Sequence[int]) -> DataFrame:
    """events that share any of ``ids``."""
    return events.filter(F.arrays_overlap("crossbin_ids", F.array(*[F.lit(i).cast("long") for i in ids])))


def crossbin_partners(events: DataFrame, event_id: str = "eventkey") -> DataFrame:
    """F10 for every event at once: (event, distinct partner) pairs over their shared ids."""
    one = events.select(event_id, F.explode("crossbin_ids").alias("_cb"))
    other = one.select(F.col(event_id).alias("partner"), "_cb")
    return one.join(other, "_cb").select(event_id, "partner").distinct()


def filter_injections(df: DataFrame, *, event_type=None, detected=None, min_duration=None, max_duration=None, min_snr=None,
                      max_snr=None, min_k=None, max_k=None) -> DataFrame:
    """selections on an injection table; the lower K limit is a lower limit."""
    c = F.col
    tests = [
        (event_type is not None, lambda: c("event_type") == event_type),
        (detected is not None, lambda: (c("detected") != "n") if detected else (c("detected") == "n")),
        (min_duration is not None, lambda: c("mjd_duration") >= min_duration),
        (max_duration is not None, lambda: c("mjd_duration") <= max_duration),
        (min_snr is not None, lambda: c("snr") >= min_snr),
        (max_snr is not None, lambda: c("snr") <= max_snr),
        (min_k is not None, lambda: c("K") >= min_k),
        (max_k is not None, lambda: c("K") <= max_k),
    ]
    for wanted, make in tests:
        if wanted:
            df = df.filter(make())
    return df


def fit_passes(df: DataFrame, max_delta_bic=-6.0, max_redchi2=3.0, min_snr=5.0, rise=(None, None), fall=(None, None)) -> Column:
    """quality flag of a fitted event; a missing value fails, a missing column is skipped."""
    have = set(df.columns)
    cond = F.col("fit_ok").cast("boolean") if "fit_ok" in have else F.lit(True)
    tests = [("delta_bic", None, max_delta_bic), ("redchi2_region", None, max_redchi2), ("A_snr", min_snr, None),
             ("tau_rise", *rise), ("tau_fall", *fall)]
    for name, low, high in tests:
        if name not in have:
            continue
        if low is not None:
            cond = cond & (F.col(name) >= low)
        if high is not None:
            cond = cond & (F.col(name) <= high)
    return F.coalesce(cond, F.lit(False))


def in_range(col, low=None, high=None, exclude_low=False, exclude_high=False, outside=False) -> Column:
    """range test with open or closed ends; ``outside`` selects the complement."""
    c = _c(col)
    cond = c.isNotNull()
    if low is not None:
        cond = cond & (c > low if exclude_low else c >= low)
    if high is not None:
        cond = cond & (c < high if exclude_high else c <= high)
    return c.isNotNull() & ~cond if outside else cond


def equals(col, value) -> Column:
    """equality where None means a null test."""
    return _c(col).isNull() if value is None else _c(col) == value


def masked(col, bits: int | None = None) -> Column:
    """any of ``bits`` set (any bit at all when None)."""
    c = _c(col).cast("long")
    return c != 0 if bits is None else c.bitwiseAND(F.lit(bits).cast("long")) != 0


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """F15/T6."""
    return a.unionByName(b).distinct()


def intersection_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One aggregate over both sides instead of two anti joins."""
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.select(*cols).withColumn("_s", F.lit(2)))
    return both.groupBy(*cols).agg(F.bit_or("_s").alias("_m")).filter(F.col("_m") < 3).select(*cols)


def keep_good_errors(df: DataFrame, err: str, keys: Sequence[str] = (), factor: float | None = 3.0, cap: float | None = None) -> DataFrame:
    """F16: finite, positive errors up to ``factor`` medians and up to an absolute cap."""
    good = df.filter(F.col(err).isNotNull() & ~F.isnan(err) & (F.col(err) > 0) & (F.col(err) < float("inf")))
    if factor is not None and factor > 0:
        sizes = cut_lineage(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        meds = exact_percentiles(good, keys, {"_med": (err, 0.5)}, largest=sizes.agg(F.max("_n")).first()[0] or 0)
        if keys:
            good = attach_few(good, meds.join(sizes, list(keys)), list(keys))
        else:
            good = good.crossJoin(F.broadcast(meds.crossJoin(sizes)))  # one row
        good = good.filter((F.col("_n") < 2) | (F.col(err) <= factor * F.col("_med"))).drop("_med", "_n")
    return good.filter(F.col(err) <= cap) if cap is not None else good


def isolated_stars(cal: DataFrame, catalogue: DataFrame, radius_deg: float, delta_mag: float = 2.0, inner_arcsec: float = 0.5,
                   cell_deg: float | None = None) -> DataFrame:
    """calibrators without a neighbour between ``inner_arcsec`` and the radius that is
    brighter than star + delta.  Distances are flat with cos(dec) of the calibrator."""
    size = cell_deg or radius_deg
    # All that a star asks of its place is the brightest neighbour there, so stars at one place ask once.
    box = cal.select(F.col("ra").alias("_cra"), F.col("dec").alias("_cdec")).distinct()
    cosd = F.greatest(F.cos(F.radians(F.col("_cdec"))), F.lit(1e-3))
    pts = catalogue.filter(F.col("rpmag").isNotNull()).select(F.col("ra").alias("_nra"), F.col("dec").alias("_ndec"), F.col("rpmag").alias("_nrp"))
    # Only the brightest of several copies of a position can matter.
    pts = pts.groupBy("_nra", "_ndec").agg(F.min("_nrp").alias("_nrp"))
    near = box_candidates(box, pts, [("_cra", F.lit(radius_deg) / cosd), ("_cdec", F.lit(radius_deg))], ["_nra", "_ndec"], size)
    sep = F.sqrt(((F.col("_nra") - F.col("_cra")) * F.cos(F.radians("_cdec"))) ** 2 + (F.col("_ndec") - F.col("_cdec")) ** 2) * 3600
    brightest = near.filter((sep > inner_arcsec) & (sep < radius_deg * 3600)).groupBy("_cra", "_cdec").agg(F.min("_nrp").alias("_nrp"))
    placed = attach(cal.withColumns({"_cra": F.col("ra"), "_cdec": F.col("dec")}), brightest, ["_cra", "_cdec"])
    return placed.filter(~F.coalesce(F.col("_nrp") < F.col("rpmag") + delta_mag, F.lit(False))).select(*cal.columns)


def candidate_window(events: DataFrame, t0: float, cadence: float, buffer: float, max_duration: float, min_sig: float,
                     key: str = "objid", sig: str = "snr", row: str = "eventkey") -> DataFrame:
    """Events starting in (t0 - cadence, t0 + buffer), short and significant; the best per object."""
    hit = events.filter((F.col("mjd_start") > t0 - cadence) & (F.col("mjd_start") < t0 + buffer)
                        & (F.col("mjd_end") - F.col("mjd_start") < max_duration) & (F.col(sig) > min_sig))
    return best_per_key(hit, [key], [-F.col(sig), F.col(row)])


def calibrators_per_tile(df: DataFrame, tile: Sequence[str], quality: str, min_stars: int, start: float, step: float = 0.05) -> DataFrame:
    """per tile, the highest threshold start, start - step, ... that keeps ``min_stars`` stars.

    A tile with too few stars at any threshold keeps all of its stars.
    """
    # Thresholds are numbered from 0; a star enters at the first one it clears.
    enters = F.greatest(F.lit(0), F.ceil((F.lit(start) - F.col(quality)) / F.lit(step) - 1e-9)).cast("long")
    staged = df.withColumn("_level", enters)
    counts = staged.groupBy(*tile, "_level").agg(F.count(F.lit(1)).alias("_n"))
    cum = OrderedScan(counts, list(tile), ["_level"]).running_sum("_cum", F.col("_n")).done()
    cut = cum.groupBy(*tile).agg(
        F.coalesce(F.min(F.when(F.col("_cum") >= min_stars, F.col("_level"))), F.max("_level")).alias("_cut"), F.sum("_n").alias("_total"))
    return attach(staged, cut, list(tile)).filter("_level <= _cut").withColumn(
        "threshold", F.lit(start) - F.col("_cut") * F.lit(step)).drop("_level", "_cut", "_total")
