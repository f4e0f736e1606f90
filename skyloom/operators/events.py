"""From detections to events and objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.skew import OrderedScan, attach, best_per_key, group_stats, island_ids


def temporal_events(df: DataFrame, max_gap: float, key: str = "objid", frame: str = "frame", sign: str = "flux_sign",
                    out: str = "eventid", starting_id: int = 1) -> DataFrame:
    """Label runs of frames no more than ``max_gap`` apart, per object and sign.

    Ids of the negative sign continue after the positive ones.  Runs are found on the
    distinct frames of an object, so repeated detections of a frame cost nothing there.
    """
    frames = df.select(key, sign, frame).distinct()
    runs = island_ids(frames, [key, sign], [frame], F.col(frame) - F.col("_prev") > max_gap, {"_prev": frame}, "_run")
    first = runs.groupBy(key).agg(F.max(F.when(F.col(sign) > 0, F.col("_run"))).alias("_shift"))
    runs = attach(runs, first, [key])
    shift = F.when(F.col(sign) > 0, F.lit(0)).otherwise(F.coalesce("_shift", F.lit(0)))
    ids = runs.select(key, sign, frame, (F.col("_run") + shift + (starting_id - 1)).alias(out))
    return attach(df, ids, [key, sign, frame])


def consecutive_runs(df: DataFrame, keys: Sequence[str], order: str, out: str = "run", max_step: float = 2) -> DataFrame:
    """Split where consecutive points differ by more than two."""
    return island_ids(df, keys, [order], F.col(order) - F.col("_prev") > max_step, {"_prev": order}, out)


def count_per_object(df: DataFrame, key: str = "objid", out: str = "n_detections") -> DataFrame:
    """A1: rows per object written on each row."""
    return group_stats(df, [key], F.count(F.lit(1)).alias(out))


def number_events(df: DataFrame, key: str = "objid", order: Sequence[str] = ("frame_bin", "frame_start", "eventid")) -> DataFrame:
    """A2: total_events per object and a fresh running eventid."""
    totals = group_stats(df, [key], F.count(F.lit(1)).alias("total_events"))
    return OrderedScan(totals, [key], list(order)).row_number("_new").done().drop("eventid").withColumnRenamed("_new", "eventid")


def event_rollup(sources: DataFrame, keys: Sequence[str] = ("frame_bin", "objid", "eventid")) -> DataFrame:
    """A4: one row per event; duration counts both end frames."""
    order = F.struct("frame", "event_id")
    return sources.groupBy(*keys).agg(
        F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"),
        (F.max("frame") - F.min("frame") + 1).alias("frame_duration"),
        F.min("mjd").alias("mjd_start"), F.max("mjd").alias("mjd_end"), (F.max("mjd") - F.min("mjd")).alias("mjd_duration"),
        F.max("snr").alias("image_sig_max"), F.max("flux_sign").alias("flux_sign"),
        F.min_by("source_mask", order).alias("source_mask"), F.count(F.lit(1)).alias("n_detections"))


CARRIED = ["sector", "cam", "ccd", "cut", "xcentroid", "ycentroid", "ra", "dec", "gal_l", "gal_b", "xcentroid_err",
           "ycentroid_err", "ra_err", "dec_err", "image_sig_max", "lc_sig_max", "gaia_id", "frame_bin", "sky_name",
           "known_asteroid_designation", "known_asteroid_dist_px", "known_asteroid_frame"]
# Columns that change name between the event and the object table.
RENAMED = {"flux_max": "flux_maxsig", "frame_max": "frame_maxsig", "mjd_max": "mjd_maxsig", "psf_like": "psf_maxsig"}


def smallest_mode(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Most frequent value, ties to the smallest; counting by value first keeps hot keys spread."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_c"), F.col(col))).alias(out))


def objects_rollup(events: DataFrame, key: str = "objid", tie: str = "eventid") -> DataFrame:
    """A3: one row per object, carrying the columns of its most significant event.

    flux_sign is the sum of the distinct signs, so mixed objects get 0.
    """
    have = set(events.columns)
    carried = [c for c in CARRIED if c in have]
    renamed = {c: n for c, n in RENAMED.items() if c in have}
    top = F.struct(*carried, *[F.col(c).alias(n) for c, n in renamed.items()], F.col("classification").alias("_top_class"),
                   *([F.col("asteroid_id").alias("_top_asteroid")] if "asteroid_id" in have else []))
    # Missing significance sorts last; ties go to the first event.
    rank = F.struct(F.col("image_sig_max").isNull(), -F.col("image_sig_max"), F.col(tie))
    out = events.groupBy(key).agg(
        F.min_by(top, rank).alias("_top"), F.count(F.lit(1)).alias("n_events"),
        F.min("frame_duration").alias("min_eventlength_frame"), F.max("frame_duration").alias("max_eventlength_frame"),
        F.min("mjd_duration").alias("min_eventlength_mjd"), F.max("mjd_duration").alias("max_eventlength_mjd"),
        F.sum_distinct("flux_sign").alias("flux_sign"))
    out = out.join(smallest_mode(events, [key], "classification", "_mode"), key, "left")
    lone = (F.col("_top._top_class") == "Asteroid") & (F.col("n_events") < 2)
    kind = F.when(lone, F.lit("Asteroid")).otherwise(F.col("_mode"))
    cols = [F.col("_top")[c].alias(c) for c in [*carried, *renamed.values()]]
    extra = [F.when(lone, F.col("_top._top_asteroid").cast("string")).otherwise(F.lit("-")).alias("asteroid_id")] if "asteroid_id" in have else []
    return out.select(
        key, "n_events", "flux_sign", "min_eventlength_frame", "max_eventlength_frame", "min_eventlength_mjd",
        "max_eventlength_mjd", F.when(kind == "RRLyrae", F.lit("VRRLyr")).otherwise(kind).alias("classification"), *cols, *extra)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in ``order``."""
    return best_per_key(df, list(keys), list(order))


def relabel(df: DataFrame, row_id: str, objid: str = "objid", frame_bin: str = "frame_bin", out: str = "newid") -> DataFrame:
    """One dense id per (objid, frame_bin); each noise row (objid 0) gets its own id above them."""
    real = df.filter(F.col(objid) != 0)
    pairs = real.groupBy(objid, frame_bin).agg(F.count(F.lit(1)).alias("_n"))
    ranked = OrderedScan(pairs, [], [objid, frame_bin]).row_number(out).done()
    named = attach(real, ranked, [objid, frame_bin]).drop("_n")
    top = F.broadcast(ranked.agg(F.coalesce(F.max(out), F.lit(0)).alias("_top")))  # one row
    noise = OrderedScan(df.filter(F.col(objid) == 0), [], [row_id]).row_number(out).done().crossJoin(top)
    return named.unionByName(noise.withColumn(out, F.col(out) + F.col("_top")).drop("_top"))


def renumber_survivors(df: DataFrame, label: str, min_count: int, out: str = "new_label", lost: int = -1) -> DataFrame:
    """Labels with at least ``min_count`` rows become 1..k, all others ``lost``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    kept = OrderedScan(sizes.filter((F.col("_n") >= min_count) & F.col(label).isNotNull()), [], [label]).row_number(out).done()
    return attach(df, kept, [label]).drop("_n").withColumn(out, F.coalesce(out, F.lit(lost).cast("long")))


def ordered_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """the schema's columns that exist, in schema order."""
    return df.select(*[c for c in order if c in df.columns])


