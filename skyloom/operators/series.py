"""Ordered light-curve operators."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.skew import CHUNK_ROWS, OrderedScan, attach, group_stats, island_ids, largest_group, spread
from skyloom.session import cut_lineage

BLOCK_ROWS = 50_000


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, take: Sequence[str],
                 tolerance: float | None = None, inner: bool = False) -> DataFrame:
    """Columns ``take`` of the right row nearest in time, ties to the earlier one.

    Both sides are merged in time order once; each left row reads the last right row before
    it and the next one after it.  ``right_on`` must be unique per key.
    """
    keys = list(keys)
    packed = F.struct(F.col(right_on).cast("double").alias("_rt"), *take)
    lhs = left.select(*keys, F.col(left_on).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rhs = right.select(*keys, F.col(right_on).cast("double").alias("_t"), F.lit(0).alias("_side"), packed.alias("_hit"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    scan = OrderedScan(both, keys, ["_t", "_side"]).fill({"_before": "_hit"}).fill({"_after": "_hit"}, forward=False)
    out = scan.done().filter("_side = 1")
    d_before, d_after = F.col("_t") - F.col("_before._rt"), F.col("_after._rt") - F.col("_t")
    use_before = F.col("_before").isNotNull() & (F.col("_after").isNull() | (d_before <= d_after))
    hit = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    out = out.withColumn("_pick", hit)
    if tolerance is not None:
        out = out.withColumn("_pick", F.when(F.abs(F.col("_t") - F.col("_pick._rt")) <= tolerance, F.col("_pick")))
    if inner:
        out = out.filter("_pick IS NOT NULL")
    return out.select("_row.*", *[F.col("_pick")[c].alias(c) for c in take])


def interpolate(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of ``value`` at ``left_on``; the end values continue outside."""
    keys = list(keys)
    lhs = left.select(*keys, F.col(left_on).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rhs = right.select(*keys, F.col(right_on).cast("double").alias("_t"), F.lit(0).alias("_side"),
                       F.struct(F.col(right_on).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_hit"))
    scan = OrderedScan(lhs.unionByName(rhs, allowMissingColumns=True), keys, ["_t", "_side"])
    done = scan.fill({"_a": "_hit"}).fill({"_b": "_hit"}, forward=False).done().filter("_side = 1")
    a, b = F.col("_a"), F.col("_b")
    inner = a["v"] + (b["v"] - a["v"]) * (F.col("_t") - a["t"]) / (b["t"] - a["t"])
    return done.select("_row.*", F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == F.col("_t")), a["v"]).otherwise(inner).alias(out))


def split_largest_gap(df: DataFrame, keys: Sequence[str], time: str, out: str = "part") -> DataFrame:
    """1 before the largest gap of each key, 2 from there on (ties: the first gap)."""
    scan = OrderedScan(df, keys, [time]).lag({"_prev": time}).done()
    gap = F.col(time) - F.col("_prev")
    brk = scan.groupBy(*keys).agg(F.min_by(time, F.when(gap.isNotNull(), F.struct(-gap, F.col(time)))).alias("_brk"))
    return attach(df, brk, keys).withColumn(out, F.when(F.col(time) >= F.col("_brk"), 2).otherwise(1).cast("long")).drop("_brk")


def frame_bins(frames: DataFrame, keys: Sequence[str], time: str, n: int, values: Sequence[str], segment: str = "segment") -> DataFrame:
    """Mean over blocks of ``n`` frames that never cross a segment border; NULLs are skipped.

    Bin numbers run on over the segments of a key.
    """
    part = [*keys, segment]
    numbered = OrderedScan(frames, part, [time]).row_number("_rn").done().withColumn("_block", F.floor((F.col("_rn") - 1) / n))
    binned = numbered.groupBy(*part, "_block").agg(*[F.avg(v).alias(v) for v in (time, *values)], F.count(F.lit(1)).alias("n_frames"))
    return OrderedScan(binned, keys, [segment, "_block"]).row_number("bin_index").done().withColumn("bin_index", F.col("bin_index") - 1).drop("_block")


def block_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, values: Sequence[str]) -> DataFrame:
    """Plain block means; an incomplete last block is dropped."""
    numbered = OrderedScan(df, keys, order).row_number("_rn").done().withColumn("block", F.floor((F.col("_rn") - 1) / n))
    return numbered.groupBy(*keys, "block").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).drop("_n")


def extend_events(events: DataFrame, lc: DataFrame, keys: Sequence[str], event: str = "eventid", sig_limit: float = 3.0, misses: int = 5) -> DataFrame:
    """Grow events over significant frames until ``misses`` insignificant frames were passed.

    The misses add up and are never reset.  With k(f) the number of hits up to frame f, the
    misses between an event's end and a later hit f are (f - k(f)) - (end - k(end)), so the
    walk becomes an equality join on ``misses`` values of f - k(f) and a min / max.
    """
    keys = list(keys)
    hit = (F.col("sig") >= sig_limit).cast("long")
    cum = OrderedScan(lc.select(*keys, "frame", F.coalesce(hit, F.lit(0)).alias("_hit")), keys, ["frame"]).running_sum("_k", F.col("_hit")).done()
    levels = cum.filter("_hit = 1").groupBy(*keys, (F.col("frame") - F.col("_k")).alias("_g")).agg(
        F.min("frame").alias("_lo"), F.max("frame").alias("_hi"), F.count(F.lit(1)).alias("_c"))
    at = lambda name, k: cum.select(*keys, F.col("frame").alias(name), F.col("_k").alias(k))
    ev = events.join(at("frame_end", "_ke"), [*keys, "frame_end"], "left")
    ev = ev.join(cum.select(*keys, F.col("frame").alias("frame_start"), (F.col("_k") - F.col("_hit")).alias("_ks")), [*keys, "frame_start"], "left")
    ev = ev.withColumns({"_g_end": F.col("frame_end") - F.col("_ke"), "_g_start": F.col("frame_start") - 1 - F.col("_ks")})
    span = F.sequence(F.lit(0), F.lit(misses - 1))
    probe = ev.select(*keys, event, "frame_start", "frame_end", F.explode(F.concat(
        F.transform(span, lambda i: F.struct(F.lit(1).alias("dir"), (F.col("_g_end") + i).alias("_g"))),
        F.transform(span, lambda i: F.struct(F.lit(-1).alias("dir"), (F.col("_g_start") - i).alias("_g"))))).alias("_p"))
    probe = probe.select(*keys, event, "frame_start", "frame_end", "_p.dir", "_p._g")
    # A level may straddle the event; only its part beyond the border counts.
    reach = probe.join(levels, [*keys, "_g"]).groupBy(*keys, event).agg(
        F.max(F.when((F.col("dir") == 1) & (F.col("_hi") > F.col("frame_end")), F.col("_hi"))).alias("_new_end"),
        F.min(F.when((F.col("dir") == -1) & (F.col("_lo") < F.col("frame_start")), F.col("_lo"))).alias("_new_start"))
    out = ev.join(reach, [*keys, event], "left").withColumns({
        "new_start": F.coalesce("_new_start", "frame_start"), "new_end": F.coalesce("_new_end", "frame_end")})
    return out.drop("_ke", "_ks", "_g_end", "_g_start", "_new_start", "_new_end")


def frames_in_events(events: DataFrame, keys: Sequence[str], event: str = "eventid") -> DataFrame:
    """One row per frame an event covers."""
    return events.select(*keys, event, F.explode(F.sequence("frame_start", "frame_end")).alias("frame"))


def event_significance(events: DataFrame, lc: DataFrame, keys: Sequence[str], event: str = "eventid", buffer: float = 0.2,
                       window: float = 1.0, wanted: DataFrame | None = None) -> DataFrame:
    """Peak and mean significance of each event against its local baseline.

    The baseline lies between ``buffer`` and ``buffer + window`` days on both sides and leaves
    out frames of sibling events.  Fewer than two baseline points give NULL.  ``wanted`` are those
    of the events that are measured, by default all.
    """
    keys = list(keys)
    times = lc.select(*keys, "frame", "mjd")
    ev = (events if wanted is None else wanted).select(*keys, event, "frame_start", "frame_end", "flux_sign")
    ends = ev.join(times.withColumnsRenamed({"frame": "frame_start", "mjd": "_t0"}), [*keys, "frame_start"]).join(
        times.withColumnsRenamed({"frame": "frame_end", "mjd": "_t1"}), [*keys, "frame_end"])
    marks = {"b0": F.col("_t0") - buffer, "b1": F.col("_t1") + buffer, "w0": F.col("_t0") - buffer - window, "w1": F.col("_t1") + buffer + window}
    long = ends.select(*keys, event, F.explode(F.array(*[F.struct(F.lit(n).alias("mark"), c.alias("at")) for n, c in marks.items()])).alias("_m"))
    near = asof_nearest(long.select(*keys, event, "_m.mark", "_m.at"), times, keys, "at", "mjd", ["frame"])
    wide = near.groupBy(*keys, event).agg(*[F.max(F.when(F.col("mark") == n, F.col("frame"))).alias(n) for n in marks])
    ev = ev.join(wide, [*keys, event])
    tagged = lc.join(frames_in_events(events, keys, event).groupBy(*keys, "frame").agg(F.min(event).alias("_in")), [*keys, "frame"], "left")
    # Each event reaches only its own window, so it is copied to the blocks of frames it touches.
    width = 64
    ev = ev.withColumn("_b", F.explode(F.sequence(F.floor(F.col("w0") / width), F.floor(F.col("w1") / width))))
    rows = tagged.withColumn("_b", F.floor(F.col("frame") / width)).join(ev, [*keys, "_b"])
    f, flux = F.col("frame"), F.col("flux")
    base = F.col("_in").isNull() & (((f > F.col("w0")) & (f < F.col("b0"))) | ((f < F.col("w1")) & (f > F.col("b1"))))
    inside = (f >= F.col("frame_start")) & (f <= F.col("frame_end"))
    up = F.col("flux_sign") >= 0
    first_best = lambda sign: F.min_by("frame", F.when(inside, F.struct(sign * flux, f)))
    stats = rows.groupBy(*keys, event).agg(
        F.percentile(F.when(base, flux), 0.5).alias("_med"), F.stddev_pop(F.when(base, flux)).alias("_std"), F.count_if(base).alias("_n"),
        F.regr_slope(F.when(base, flux), F.when(base, F.col("mjd"))).alias("_slope"),
        F.max(F.when(inside, flux)).alias("_max"), F.min(F.when(inside, flux)).alias("_min"), F.avg(F.when(inside, flux)).alias("_mean"),
        first_best(-1).alias("_fmax"), first_best(1).alias("_fmin"), F.max(up).alias("_up"))
    ok = (F.col("_n") >= 2) & (F.col("_std") > 0)
    z = lambda c: (F.col(c) - F.col("_med")) / F.col("_std")
    return stats.select(
        *keys, event, F.when(F.col("_up"), F.col("_max")).otherwise(F.col("_min")).alias("flux_max"),
        F.when(F.col("_up"), F.col("_fmax")).otherwise(F.col("_fmin")).alias("frame_max"),
        F.when(ok, F.when(F.col("_up"), z("_max")).otherwise(F.abs(z("_min")))).alias("lc_sig_max"),
        F.when(ok, F.when(F.col("_up"), z("_mean")).otherwise(F.abs(z("_mean")))).alias("lc_sig_med"),
        F.coalesce(ok & (F.abs("_slope") / F.col("_std") < 2) & (F.abs("_med") < F.col("_std")) & (F.col("_std") < 5), F.lit(False)).cast("long").alias("lc_flat"),
        F.when(ok, F.col("_med")).alias("base_median"), F.when(ok, F.col("_std")).alias("base_std"))


def classify_short(events: DataFrame, lc: DataFrame, stats: DataFrame, keys: Sequence[str], event: str = "eventid") -> DataFrame:
    """Cosmic rays and junk among unbinned positive events with one frame or two detections."""
    keys = list(keys)
    cand = events.join(stats.select(*keys, event, "base_median", "base_std"), [*keys, event], "left")
    cand = cand.filter((F.col("frame_bin") == 1) & (F.col("flux_sign") == 1) & ((F.col("frame_duration") == 1) | (F.col("n_detections") == 2)))
    rows = frames_in_events(cand, keys, event).join(lc.select(*keys, "frame", "flux"), [*keys, "frame"])
    rows = rows.join(cand.select(*keys, event, "base_median", "base_std"), [*keys, event])
    sig = (F.col("flux") - F.col("base_median")) / F.col("base_std")
    ranked = rows.withColumn("_sig", sig).groupBy(*keys, event).agg(
        F.count_if(F.col("_sig") >= 5).alias("_n5"), F.count_if(F.col("_sig") >= 3).alias("_n3"),
        F.min(F.struct((-F.col("_sig")).alias("s"), "frame")).alias("_top"), F.collect_list(F.struct((-F.col("_sig")).alias("s"), "frame")).alias("_all"))
    # Candidates last a few frames, so the sorted list stays short.
    second = F.element_at(F.array_sort("_all"), 2)["frame"]
    ranked = ranked.withColumn("_gap", F.when(F.size("_all") > 1, F.abs(second - F.col("_top.frame"))))
    j = events.join(ranked.drop("_all", "_top"), [*keys, event], "left")
    one = F.col("frame_duration") == 1
    label = (
        F.when(F.col("_n5").isNull(), F.lit("-"))
        .when(one, F.when(F.col("_n5") == 1, F.lit("CosmicRay")).otherwise(F.lit("Junk")))
        .when((F.col("_n5") == 1) & (F.col("_n3") == 1), F.lit("CosmicRay"))
        .when((F.col("frame_duration") > 2) & (F.col("_gap") > 1), F.when(F.col("_n5") > 0, F.lit("CosmicRay")).otherwise(F.lit("Junk")))
        .otherwise(F.lit("-")))
    return j.withColumn("classification", label).drop("_n5", "_n3", "_gap")


REACH = 16  # frames on either side of an event that are looked at first


def recheck_moving(events: DataFrame, lc: DataFrame, keys: Sequence[str], event: str = "eventid", misses: int = 5) -> DataFrame:
    """New limits for moving objects from a half-day baseline; the duration is end - start.

    Each event has its own baseline, so the light curve is scaled per event, but only ``REACH``
    frames around it; events whose frames on some side miss fewer than ``misses`` times are looked at again
    with eight times as many.
    """
    keys, limit = list(keys), 3.0
    part = [*keys, event]
    events = cut_lineage(events)
    moving = events.filter(F.col("classification") == "Asteroid")
    stats = event_significance(events, lc, keys, event, 0.2, 0.5, moving).select(*part, "base_median", "base_std")
    todo = cut_lineage(moving.select(*part, "frame_start", "frame_end").join(stats, part))
    grown, reach, width = None, REACH, 64
    while grown is None or not todo.isEmpty():
        low, high = F.col("frame_start") - reach, F.col("frame_end") + reach
        near = todo.withColumn("_b", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
        rows = lc.select(*keys, "frame", "flux", F.floor(F.col("frame") / width).alias("_b")).join(near.hint("merge"), [*keys, "_b"]).filter(F.col("frame").between(low, high))
        scaled = cut_lineage(rows.select(*part, "frame", "frame_start", "frame_end", ((F.col("flux") - F.col("base_median")) / F.col("base_std")).alias("sig")))
        ids = todo.select(*part, F.lit(1).alias("_one"), "frame_start", "frame_end")
        out = extend_events(ids, scaled.select(*part, "frame", "sig"), part, "_one", limit, misses).select(*part, "new_start", "new_end")
        hit = F.col("sig") >= limit
        short = scaled.groupBy(*part).agg(F.count_if(hit & (F.col("frame") < F.col("frame_start"))).alias("_before"), F.count_if(hit & (F.col("frame") > F.col("frame_end"))).alias("_after"))
        short = short.filter(reach - F.greatest("_before", "_after") < misses).select(*part)
        again = cut_lineage(todo.join(short, part, "left_semi"))
        settled = cut_lineage(out.join(again.select(*part), part, "left_anti"))
        grown = settled if grown is None else grown.unionByName(settled)
        todo, reach = again, 8 * reach
    t = lc.select(*keys, "frame", "mjd")
    grown = grown.join(t.withColumnsRenamed({"frame": "new_start", "mjd": "_ms"}), [*keys, "new_start"]).join(
        t.withColumnsRenamed({"frame": "new_end", "mjd": "_me"}), [*keys, "new_end"])
    j = events.join(grown, part, "left")
    hit = F.col("new_start").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    return j.withColumns({
        "n_detections": pick(F.col("n_detections") + (F.col("frame_start") - F.col("new_start")) + (F.col("new_end") - F.col("frame_end")), "n_detections"),
        "frame_duration": pick(F.col("new_end") - F.col("new_start"), "frame_duration"),
        "mjd_start": pick(F.col("_ms"), "mjd_start"), "mjd_end": pick(F.col("_me"), "mjd_end"),
        "frame_start": pick(F.col("new_start"), "frame_start"), "frame_end": pick(F.col("new_end"), "frame_end"),
    }).drop("new_start", "new_end", "_ms", "_me")


def local_excess(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 151, sigma: float = 3.0,
                 out: str = "local_flux_excess", block_rows: int = BLOCK_ROWS, largest: int | None = None) -> DataFrame:
    """|residual from the centred rolling median| above ``sigma`` rolling MADs.

    Tracks are cut into blocks of rows that carry the neighbouring rows three nested
    windows need, so each Arrow batch is bounded and the result equals the unblocked one.
    """
    keys, halo = list(keys), 3 * (window // 2)
    largest = largest_group(df, keys) if largest is None else largest
    numbered = OrderedScan(df, keys, list(order), largest=largest).row_number("_rn").done()
    own = F.floor((F.col("_rn") - 1) / block_rows)
    first = F.floor(F.greatest(F.col("_rn") - 1 - halo, F.lit(0)) / block_rows)
    last = F.floor((F.col("_rn") - 1 + halo) / block_rows)
    copies = numbered.withColumns({"_own": own, "_block": F.explode(F.sequence(first, last))})
    cols = [c for c in df.columns]
    schema = copies.select(*cols, "_own", "_block").schema.add(out, "boolean")

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        roll = lambda s: s.rolling(window, center=True, min_periods=5).median()
        s = pdf[value].astype(float)
        resid = s - roll(s)
        mad = roll((resid - roll(resid)).abs()) * 1.4826
        pdf[out] = (resid.abs() > sigma * mad).to_numpy()
        return pdf.loc[pdf["_own"] == pdf["_block"], [*cols, "_own", "_block", out]]

    # Tracks of one block each lie together already.
    part = keys if keys and largest <= block_rows else [*keys, "_block"]
    flagged = copies.select(*cols, "_rn", "_own", "_block").groupBy(*part).applyInPandas(flag, schema)
    return flagged.drop("_own", "_block")


def _over_runs(runs: DataFrame, part: Sequence[str], name: str, agg: Column, largest: int) -> DataFrame:
    """``agg`` of each run on its rows; bounded runs lie together already and are read once."""
    if largest <= CHUNK_ROWS:
        return runs.withColumn(name, agg.over(Window.partitionBy(*part)))
    return group_stats(runs, part, agg.alias(name))


def spread_over_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, member: str, out: str, largest: int | None = None) -> DataFrame:
    """A run of consecutive ``flag`` rows is marked as a whole when any row has ``member``."""
    largest = largest_group(df, keys) if largest is None else largest
    runs = island_ids(df, keys, order, F.col(flag) != F.col("_pf"), {"_pf": flag}, "_run", largest=largest)
    marked = _over_runs(runs, [*keys, "_run"], "_any", F.bool_or(member), largest)
    return marked.withColumn(out, F.col(flag) & F.coalesce("_any", F.lit(False))).drop("_run", "_any")


def long_same_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, same: str, min_length: int, out: str, largest: int | None = None) -> DataFrame:
    """Runs of ``flag`` with one unchanged ``same`` value over at least ``min_length`` rows."""
    largest = largest_group(df, keys) if largest is None else largest
    change = (F.col(flag) != F.col("_pf")) | ~F.col(same).eqNullSafe(F.col("_ps"))
    runs = island_ids(df, keys, order, F.col("_pf").isNotNull() & change, {"_pf": flag, "_ps": same}, "_run", largest=largest)
    sized = _over_runs(runs, [*keys, "_run"], "_len", F.count(F.lit(1)), largest)
    return sized.withColumn(out, F.col(flag) & (F.col("_len") >= min_length)).drop("_run", "_len")


def contamination_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, min_run: int = 15) -> DataFrame:
    """Near a bright star, and in a local excess or in a long run near one star (needs J15's columns)."""
    largest = largest_group(df, keys)
    out = local_excess(df, keys, order, value, largest=largest)
    if largest > CHUNK_ROWS:
        # The scans over split series read their rows several times.
        out = cut_lineage(out)
    out = spread_over_runs(out, keys, order, "local_flux_excess", "near_star_proximity", "_burst", largest)
    out = long_same_runs(out, keys, order, "near_star_proximity", "contaminating_star_idx", min_run, "_long", largest)
    return out.withColumn("near_bright_star", F.col("_burst") | F.col("_long")).drop("_burst", "_long")


def gap_limited_window(starts: DataFrame, times: DataFrame, keys: Sequence[str], cadence_min: float, max_days: str, gap_factor: float = 10.0) -> DataFrame:
    """Exclusive end frame of a window that stops at a big gap or after ``max_days`` days.

    ``starts`` has frame_start and a column with the length; the run of gap-free frames is
    found once for the whole series.
    """
    keys = list(keys)
    runs = island_ids(times, keys, ["mjd"], F.col("mjd") - F.col("_p") > gap_factor * cadence_min / 1440.0, {"_p": "mjd"}, "_run")
    at = starts.join(runs.select(*keys, F.col("frame").alias("frame_start"), F.col("mjd").alias("_t0"), "_run"), [*keys, "frame_start"])
    ends = runs.groupBy(*keys, "_run").agg(F.max("frame").alias("_last"), F.max("mjd").alias("_tl"))
    at = at.join(ends, [*keys, "_run"]).withColumn("_limit", F.col("_t0") + F.col(max_days))
    # The last frame not after the limit, read by an as-of look-up.
    before = _asof_before(at, times, keys, "_limit", "mjd", "frame", "_by_time")
    return before.withColumn("frame_end", F.least("_last", F.greatest("_by_time", "frame_start")) + 1).drop("_run", "_t0", "_last", "_tl", "_limit", "_by_time")


def _asof_before(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, take: str, out: str) -> DataFrame:
    lhs = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rhs = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.col(take).alias("_hit"))
    scan = OrderedScan(lhs.unionByName(rhs, allowMissingColumns=True), keys, ["_t", "_side"]).fill({"_got": "_hit"})
    return scan.done().filter("_side = 1").select("_row.*", F.col("_got").alias(out))


def orbit_correction(lc: DataFrame, refs: DataFrame, keys: Sequence[str], segment: str = "segment") -> DataFrame:
    """Bring all segments to the baseline of the segment with the quietest reference.

    ``refs`` has the reference's aperture flux and standard deviation per key and segment.
    """
    primary = refs.groupBy(*keys).agg(F.min_by("ref_flux", F.struct("ref_std", segment)).alias("_f0"))
    delta = refs.join(primary, list(keys)).select(*keys, segment, (F.col("_f0") - F.col("ref_flux")).alias("_delta"))
    return attach(lc, delta, [*keys, segment]).withColumn("flux_corrected", F.col("flux") + F.coalesce("_delta", F.lit(0.0))).drop("_delta")


def event_frame_list(start, end, brightest, n_frames, buffer: int = 2, interval: int = 1, minimum: int = 5) -> Column:
    """Frames of an event's cut-outs: stepped window with buffer, the brightest frame, at least five."""
    s, e, b, n = (F.col(c) if isinstance(c, str) else c for c in (start, end, brightest, n_frames))
    base = F.sequence((s - buffer).cast("long"), (e + buffer).cast("long"), F.lit(interval).cast("long"))
    base = F.array_sort(F.array_union(base, F.array(b.cast("long"))))
    missing = F.greatest(F.lit(0), F.lit(minimum) - F.size(base))
    tail = F.when(missing > 0, F.transform(F.sequence(F.lit(1), missing), lambda i: F.element_at(base, -1) + i * interval)).otherwise(F.array().cast("array<bigint>"))
    clipped = F.transform(F.concat(base, tail), lambda f: F.greatest(F.lit(0), F.least(f, n - 1)).cast("long"))
    return F.array_sort(F.array_distinct(clipped))


def crossbin_ids(events: DataFrame, group: str, wide_group: str, event: str = "eventkey", out: str = "crossbin_ids") -> DataFrame:
    """Ids shared by overlapping events of different time bins.

    Events of one group that overlap in time (within one bin) pass their ids from finer to
    coarser bins; moving objects use the wider group.  Ids held by more than one event are
    numbered densely, other events get an empty list.

    What an event takes in depends only on its groups, bin and times.  Events that agree in these
    are one class; ids travel between classes, bin by bin, and a class's list is written once and
    read by its events, so that only the result itself holds a list for each event.
    """
    events = cut_lineage(events.withColumns({"_lo": F.col("frame_start") * F.col("frame_bin"), "_hi": F.col("frame_end") * F.col("frame_bin")}))
    place = lambda kind, key: F.struct(F.lit(kind).alias("_kind"), F.col(key).alias("_key"))
    fine = events.select(F.col(event).alias("_e"), F.when(F.col("classification") == "Asteroid", place(1, wide_group)).otherwise(place(0, group)).alias("_k"),
                         F.col("frame_bin").alias("_fb"), F.col("_lo").alias("_flo"), F.col("_hi").alias("_fhi")).select("_e", "_k._kind", "_k._key", "_fb", "_flo", "_fhi")
    coarse = events.select(F.col(event).alias("_e"), F.explode(F.array(place(0, group), place(1, wide_group))).alias("_k"),
                           F.col("frame_bin").alias("_cb"), F.col("_lo").alias("_clo"), F.col("_hi").alias("_chi")).select("_e", "_k._kind", "_k._key", "_cb", "_clo", "_chi")
    giver, taker = ["_kind", "_key", "_fb", "_flo", "_fhi"], ["_kind", "_key", "_cb", "_clo", "_chi"]
    # Equality on a time block keeps long groups from being compared pair by pair.
    block = 512
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))
    links = cut_lineage(
        fine.select(*giver).distinct().withColumn("_tb", blocks(F.col("_flo"), F.col("_fhi")))
        .join(coarse.select(*taker).distinct().withColumn("_tb", blocks(F.col("_clo") - F.col("_cb"), F.col("_chi") + F.col("_cb"))), ["_kind", "_key", "_tb"])
        .filter((F.col("_cb") > F.col("_fb")) & (F.col("_flo") <= F.col("_chi") + F.col("_cb")) & (F.col("_fhi") >= F.col("_clo") - F.col("_cb")))
        .select(*giver, *taker[2:]).distinct())
    taken = None
    for wide in sorted(r[0] for r in links.select("_cb").distinct().collect()):
        to = links.filter(F.col("_cb") == wide)
        members = fine.join(to.select(*giver).distinct(), giver, "left_semi")
        given = members.select(*giver, F.col("_e").alias("_id"))
        if taken is not None:
            # Members also pass on what they took in from finer bins.
            held = coarse.withColumnsRenamed({"_kind": "_ck", "_key": "_cg"}).join(members, "_e").select("_ck", "_cg", *taker[2:], *giver).distinct()
            before = taken.withColumnsRenamed({"_kind": "_ck", "_key": "_cg"})
            given = given.union(held.join(before, ["_ck", "_cg", *taker[2:]]).select(*giver, "_id")).distinct()
        level = cut_lineage(to.join(given, giver).select(*taker, "_id").distinct())
        taken = level if taken is None else taken.union(level)
    if taken is None:
        return events.drop("_lo", "_hi").withColumn(out, F.array().cast("array<bigint>"))
    # An id in some class's list is held by an event of a coarser bin beside its own.
    ranked = OrderedScan(taken.select("_id").distinct(), [], ["_id"]).row_number("_rank").done().withColumn("_rank", F.col("_rank") - 1)
    ranked = cut_lineage(ranked)
    lists = cut_lineage(taken.join(ranked, "_id").groupBy(*taker).agg(F.collect_list("_rank").alias("_l")))
    own = ranked.select(F.col("_id").alias(event), F.array("_rank").alias("_l"))
    joined = events.join(own.withColumnRenamed("_l", "_own"), event, "left")
    for kind, key in ((0, group), (1, wide_group)):
        names = {"_key": key, "_cb": "frame_bin", "_clo": "_lo", "_chi": "_hi", "_l": f"_l{kind}"}
        # The lists are long and the rows that read them few: these are dealt over all tasks.
        joined = spread(joined, *list(names.values())[:4]).join(lists.filter(F.col("_kind") == kind).drop("_kind").withColumnsRenamed(names), list(names.values())[:4], "left")
    none = F.array().cast("array<bigint>")
    ids = F.sort_array(F.array_union(F.concat(*[F.coalesce(c, none) for c in ("_own", "_l0")]), F.coalesce("_l1", none)))
    return joined.select(*[c for c in events.columns if c not in ("_lo", "_hi")], ids.alias(out))
