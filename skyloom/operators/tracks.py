"""Moving objects: track fits, growth, merging and linking."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from skyloom.operators.components import connected_components, density_groups, number_labels
from skyloom.operators.skew import attach, spread
from skyloom.session import cut_lineage


def seed_tracks(points: DataFrame, row: str, eps_space: float = 6.0, eps_time: float = 0.5, min_samples: int = 3, keys: Sequence[str] = (), out: str = "track") -> DataFrame:
    """Density clusters in (x / eps, y / eps, t / tau); NULL marks unclustered points."""
    scaled = points.withColumns({"_sx": F.col("x") / eps_space, "_sy": F.col("y") / eps_space, "_st": F.col("t") / eps_time})
    return density_groups(scaled, row, ["_sx", "_sy", "_st"], 1.0, min_samples, keys, out).drop("_sx", "_sy", "_st")


def fit_tracks(points: DataFrame, track: str = "track", keys: Sequence[str] = (), quadratic: bool = True, max_accel: float = 1.0) -> DataFrame:
    """x(t), y(t) per track from sums; the acceleration is kept in +-max_accel by refitting the line.

    Two combinable aggregates (mean time, centred sums) and one for the residual.
    """
    part = [*keys, track]
    pts = points.filter(F.col(track).isNotNull()).select(*part, "t", "x", "y")
    ref = pts.groupBy(*part).agg(F.avg("t").alias("t_ref"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("n_points"))
    c = attach(pts, ref.select(*part, "t_ref"), part).withColumn("d", F.col("t") - F.col("t_ref"))
    d, q = F.col("d"), F.col("d") ** 2 / 2
    s = c.groupBy(*part).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(d * d).alias("s2"), F.sum(d * q).alias("s3"), F.sum(q * q).alias("s4"),
        *[F.sum(F.col(v)).alias(f"m0{v}") for v in "xy"], *[F.sum(F.col(v) * d).alias(f"m1{v}") for v in "xy"], *[F.sum(F.col(v) * q).alias(f"m2{v}") for v in "xy"])
    n, s2, s3, s4 = (F.col(k) for k in ("n", "s2", "s3", "s4"))
    h = s2 / 2  # sum of q
    # Schur complement of the 3x3 system after removing the constant and the linear term.
    schur = s4 - h * h / n - s3 * s3 / s2
    fits = {}
    for v in "xy":
        free = (F.col(f"m2{v}") - h * F.col(f"m0{v}") / n - s3 * F.col(f"m1{v}") / s2) / schur
        bent = F.lit(quadratic) & (n >= 3) & (schur > 1e-12 * s4)
        fits[f"a{v}"] = F.when(bent, F.greatest(F.lit(-max_accel), F.least(F.lit(max_accel), free))).otherwise(F.lit(0.0))
    s = s.withColumns(fits)
    s = s.withColumns({f"v{v}": F.when(s2 > 0, (F.col(f"m1{v}") - F.col(f"a{v}") * s3) / s2).otherwise(F.lit(0.0)) for v in "xy"})
    s = s.withColumns({f"{v}0": (F.col(f"m0{v}") - F.col(f"a{v}") * h) / n for v in "xy"})
    model = s.select(*part, "x0", "vx", "ax", "y0", "vy", "ay").join(ref, part)
    res = attach(pts, model, part)
    px, py = predicted("t")
    rms = res.groupBy(*part).agg(F.sqrt(F.avg((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2)).alias("residual_px"))
    return model.join(rms, part)


def predicted(t: str) -> tuple[Column, Column]:
    dt = F.col(t) - F.col("t_ref")
    return (F.col("x0") + F.col("vx") * dt + 0.5 * F.col("ax") * dt * dt, F.col("y0") + F.col("vy") * dt + 0.5 * F.col("ay") * dt * dt)


def _laid_out(tracks: DataFrame, radius: float, lo: Column, hi: Column, step: float, size: float, slack: Column | None = None) -> DataFrame:
    """Tracks over the time steps (``_tb``) between ``lo`` and ``hi`` and the cells (``_kx``, ``_ky``) within ``radius`` of them; ``slack`` times the acceleration is added."""
    bins = tracks.withColumn("_tb", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))
    bins = bins.withColumn("_tc", (F.col("_tb") + 0.5) * step)
    cx, cy = predicted("_tc")
    speed = lambda v, a: (F.abs(F.col(v) + F.col(a) * (F.col("_tc") - F.col("t_ref"))) + F.abs(F.col(a)) * step / 2) * step / 2
    more = lambda a: F.lit(0.0) if slack is None else F.abs(F.col(a)) * slack
    reach_x, reach_y = speed("vx", "ax") + radius + more("ax"), speed("vy", "ay") + radius + more("ay")
    bins = bins.withColumns({"_kx": F.explode(F.sequence(F.floor((cx - reach_x) / size), F.floor((cx + reach_x) / size)))})
    return bins.withColumns({"_ky": F.explode(F.sequence(F.floor((cy - reach_y) / size), F.floor((cy + reach_y) / size)))}).drop("_tc")


def near_tracks(points: DataFrame, tracks: DataFrame, row: str, radius: float, lo: Column, hi: Column, keys: Sequence[str] = (), track: str = "track", step: float = 0.25, keep: Sequence[str] = ()) -> DataFrame:
    """(row, track, distance) of points closer than ``radius`` to a track's prediction, with the points' columns ``keep``.

    Tracks are laid out over time steps between ``lo`` and ``hi`` and the cells they can reach in a
    step, so points meet tracks by equality on (step, cell) and never all tracks of a unit.
    """
    size = max(2.0 * radius, 1.0)
    bins = _laid_out(tracks, radius, lo, hi, step, size)
    pts = points.select(*keys, row, "t", "x", "y", *keep, F.floor(F.col("t") / step).alias("_tb"), F.floor(F.col("x") / size).alias("_kx"), F.floor(F.col("y") / size).alias("_ky"))
    # Few points can meet many tracks, so they are dealt into as many tasks as there are.
    j = spread(pts, *keys, "_tb", "_kx", "_ky").join(bins.hint("merge"), [*keys, "_tb", "_kx", "_ky"])
    px, py = predicted("t")
    j = j.withColumns({"dist": F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2), "px": px, "py": py})
    return j.filter(F.col("dist") < radius).select(*keys, row, "t", *keep, track, "dist", "px", "py", "t_min", "t_max")


def _time_range(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("t").alias("_t_lo"), F.max("t").alias("_t_hi"))


def _with_range(tracks: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    rng = _time_range(points, keys)
    return tracks.join(rng, list(keys)) if keys else tracks.crossJoin(F.broadcast(rng))


def grow_tracks(points: DataFrame, row: str, eps: float = 5.0, keys: Sequence[str] = (), track: str = "track", rounds: int = 5, **fit) -> DataFrame:
    """Unclustered points join the first track whose prediction is closer than ``eps``."""
    cur = points
    for _ in range(rounds):
        model = fit_tracks(cur, track, keys, **fit)
        loose = cur.filter(F.col(track).isNull())
        hit = near_tracks(loose, _with_range(model, cur, keys), row, eps, F.col("_t_lo"), F.col("_t_hi"), keys, track)
        first = cut_lineage(hit.groupBy(row).agg(F.min(track).alias("_new")))
        if first.isEmpty():
            break
        cur = cut_lineage(cur.join(first, row, "left").withColumn(track, F.coalesce(track, "_new")).drop("_new"))
    return cur


def _largest_close(named: DataFrame, model: DataFrame, eps: float, keys: Sequence[str], track: str, step: float = 1.0, first_ranks: int = 32) -> DataFrame:
    """(keys..., _own, to): the first track, by falling size and then by name, before ``_own`` whose mean distance from its points is below ``eps``.

    A mean distance is at least the distance of the means, so only the middle of a track's points
    looks for partners.  The partners of a cell are ranked and tried in bands that grow
    eightfold; a track that has found one leaves, so crowded cells list no pairs.
    """
    keys = list(keys)
    good = named.filter(F.col("t").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    size = max(2.0 * eps, 1.0)
    own_n = model.select(*keys, F.col(track).alias("_own"), F.col("n_points").alias("_own_n"))
    mid = good.groupBy(*keys, "_own").agg(F.avg("t").alias("_mt"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.var_pop("t").alias("_mv")).join(own_n, [*keys, "_own"])
    cells = ["_tb", "_kx", "_ky"]
    todo = cut_lineage(mid.withColumns({"_tb": F.floor(F.col("_mt") / step), "_kx": F.floor(F.col("_mx") / size), "_ky": F.floor(F.col("_my") / size)}))
    lim = mid.groupBy(*keys).agg(F.min("_mt").alias("_t_lo"), F.max("_mt").alias("_t_hi"), (F.max("_mv") / 2).alias("_slack"))
    near = model.join(lim, keys) if keys else model.crossJoin(F.broadcast(lim))
    near = _laid_out(near, eps * (1 + 1e-6), F.col("_t_lo"), F.col("_t_hi"), step, size, F.col("_slack"))
    # Cells without a middle have no use.
    near = near.join(todo.select(*keys, *cells).distinct(), [*keys, *cells], "left_semi")
    order = Window.partitionBy(*keys, *cells).orderBy(F.desc("n_points"), track)
    near = cut_lineage(near.withColumn("_rank", F.row_number().over(order)).select(*keys, *cells, "_rank", track, "n_points", "t_ref", "x0", "vx", "ax", "y0", "vy", "ay"))
    before_own = F.struct(-F.col("n_points"), F.col(track)) < F.struct(-F.col("_own_n"), F.col("_own"))
    out, low, high = None, 0, first_ranks
    while True:
        band = near.filter((F.col("_rank") > low) & (F.col("_rank") <= high))
        mx, my = predicted("_mt")
        mx, my = mx + 0.5 * F.col("ax") * F.col("_mv"), my + 0.5 * F.col("ay") * F.col("_mv")
        pairs = todo.join(band.hint("merge"), [*keys, *cells]).filter(before_own & (F.sqrt((F.col("_mx") - mx) ** 2 + (F.col("_my") - my) ** 2) < eps * (1 + 1e-6)))
        pairs = pairs.select(*keys, "_own", track, "n_points", "t_ref", "x0", "vx", "ax", "y0", "vy", "ay")
        px, py = predicted("t")
        mean = pairs.join(good.select(*keys, "_own", "t", "x", "y").hint("merge"), [*keys, "_own"]).groupBy(*keys, "_own", track, "n_points").agg(F.avg(F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2)).alias("mean_dist"))
        found = mean.filter(F.col("mean_dist") < eps).groupBy(*keys, "_own").agg(F.min(F.struct((-F.col("n_points")).alias("n"), F.col(track).alias("to"))).alias("_b"))
        found = cut_lineage(found.select(*keys, "_own", "_b.to"))
        out = found if out is None else out.unionByName(found)
        # Others go on where their cell holds a further track before them.
        following = near.filter(F.col("_rank") == high + 1).select(*keys, *cells, "n_points", track)
        left = todo.join(found, [*keys, "_own"], "left_anti").join(following, [*keys, *cells]).filter(before_own).select(*todo.columns)
        todo = cut_lineage(left)
        if todo.isEmpty():
            return out
        low, high = high, high * 8


def merge_tracks(points: DataFrame, row: str, eps: float = 10.0, keys: Sequence[str] = (), track: str = "track", rounds: int = 5, **fit) -> DataFrame:
    """A track joins a larger one when its points lie on average within ``eps`` of it.

    A track is absorbed by its largest close partner that is not itself absorbed by a larger one.
    """
    cur = points
    for _ in range(rounds):
        model = cut_lineage(fit_tracks(cur, track, keys, **fit))
        named = cur.filter(F.col(track).isNotNull()).withColumn("_own", F.col(track)).drop(track)
        best = _largest_close(named, model, eps, keys, track)
        absorbed = best.select(*keys, F.col("_own").alias("to"))
        now = cut_lineage(best.join(absorbed, [*keys, "to"], "left_anti"))
        if now.isEmpty():
            break
        cur = cut_lineage(attach(cur, now.withColumnRenamed("_own", track), [*keys, track]).withColumn(track, F.coalesce("to", track)).drop("to"))
    return cur


def cross_tracks(points: DataFrame, row: str, max_dist: float = 2.0, limit: float = 256.0, keys: Sequence[str] = (), track: str = "track", step: float = 0.05, **fit) -> DataFrame:
    """Tracks that come within ``max_dist`` at the same time inside the field become one.

    Both tracks are sampled on one time grid; the closest approach inside a step follows from the
    relative motion, taken as straight within it.  Tracks that share a cell of side max_dist/sqrt(2) in
    the middle of a step are close without comparison and all linked to the cell's first one; only samples
    in neighbouring cells of tracks that these links leave apart are compared, so crowded cells list no pairs.
    """
    model = _with_range(fit_tracks(points, track, keys, **fit), points, keys)
    grid = model.withColumn("_tb", F.explode(F.sequence(F.floor(F.col("_t_lo") / step), F.floor(F.col("_t_hi") / step)))).withColumn("_tc", (F.col("_tb") + 0.5) * step)
    px, py = predicted("_tc")
    dt = F.col("_tc") - F.col("t_ref")
    pos = grid.select(*keys, track, "_tb", px.alias("px"), py.alias("py"), (F.col("vx") + F.col("ax") * dt).alias("ux"), (F.col("vy") + F.col("ay") * dt).alias("uy"))
    pos = pos.filter(F.col("px").between(-max_dist, limit + max_dist) & F.col("py").between(-max_dist, limit + max_dist))
    # The field's border is decided pair by pair, so only tracks that stay inside for the step are linked unseen.
    side, half = max_dist / math.sqrt(2) * (1 - 1e-6), step / 2
    inner = F.lit(True)
    for p, u in (("px", "ux"), ("py", "uy")):
        reach = F.abs(F.col(u)) * half * (1 + 1e-6)
        inner = inner & (F.col(p) - reach >= 0) & (F.col(p) + reach <= limit)
    tight = [*keys, "_tb", F.floor(F.col("px") / side).alias("_sx"), F.floor(F.col("py") / side).alias("_sy")]
    inside = pos.filter(inner).select(track, *tight)
    first = inside.groupBy(*keys, "_tb", "_sx", "_sy").agg(F.min(track).alias("_first"), F.max(track).alias("_last")).filter("_first < _last").drop("_last")
    sure = inside.join(first, [*keys, "_tb", "_sx", "_sy"]).filter(F.col(track) != F.col("_first")).select(F.col(track).alias("u"), F.col("_first").alias("v")).distinct()
    roots = cut_lineage(connected_components(sure))
    # Cells are wide enough for the approach during one step.
    size = 4 * max_dist
    named = attach(pos, roots.withColumnRenamed("node", track), [track]).withColumn("root", F.coalesce("root", track))
    named = named.withColumns({"_kx": F.floor(F.col("px") / size), "_ky": F.floor(F.col("py") / size)})
    held = cut_lineage(named.groupBy(*keys, "_tb", "_kx", "_ky").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")))
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = held.withColumn("_o", ring).withColumns({"_kx": F.col("_kx") + F.col("_o.i"), "_ky": F.col("_ky") + F.col("_o.j")})
    mixed = around.groupBy(*keys, "_tb", "_kx", "_ky").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    # Only cells with a second root in reach are compared, and only across roots.
    a = cut_lineage(named.join(mixed, [*keys, "_tb", "_kx", "_ky"], "left_semi"))
    cells = a.select(*keys, "_tb", "_kx", "_ky", "root").distinct()
    b_cells = cells.select(*keys, "_tb", F.col("_kx").alias("_jx"), F.col("_ky").alias("_jy"), F.col("root").alias("_other_root"), ring.alias("_o"))
    b_cells = b_cells.withColumns({"_kx": F.col("_jx") + F.col("_o.i"), "_ky": F.col("_jy") + F.col("_o.j")}).drop("_o")
    meet = cells.join(b_cells.hint("merge"), [*keys, "_tb", "_kx", "_ky"]).filter("root <> _other_root")
    b = a.withColumnsRenamed({track: "_other", "px": "qx", "py": "qy", "ux": "wx", "uy": "wy", "root": "_other_root", "_kx": "_jx", "_ky": "_jy"})
    j = a.join(meet.hint("merge"), [*keys, "_tb", "_kx", "_ky", "root"]).join(b.hint("merge"), [*keys, "_tb", "_jx", "_jy", "_other_root"]).filter(F.col(track) < F.col("_other"))
    rx, ry, sx, sy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy"), F.col("ux") - F.col("wx"), F.col("uy") - F.col("wy")
    s2 = sx * sx + sy * sy
    tau = F.when(s2 > 0, F.greatest(F.lit(-step / 2), F.least(F.lit(step / 2), -(rx * sx + ry * sy) / s2))).otherwise(F.lit(0.0))
    j = j.withColumn("_tau", tau)
    close = F.sqrt((rx + sx * F.col("_tau")) ** 2 + (ry + sy * F.col("_tau")) ** 2)
    at_x, at_y = F.col("px") + F.col("ux") * F.col("_tau"), F.col("py") + F.col("uy") * F.col("_tau")
    near = j.filter((close < max_dist) & at_x.between(0, limit) & at_y.between(0, limit))
    # The links of a pair of roots are all one.
    edges = near.select(F.col("root").alias("u"), F.col("_other_root").alias("v")).distinct()
    upper = connected_components(edges).select(F.col("root").alias("_up"), F.col("node").alias("root"))
    members = roots.select("node", "root").unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    comp = attach(members, upper, ["root"]).select("node", F.coalesce("_up", "root").alias("root"))
    low = comp.join(comp.groupBy("root").agg(F.min("node").alias("_low")), "root").select(F.col("node").alias(track), "_low")
    return attach(points, low, [track]).withColumn(track, F.coalesce("_low", track)).drop("_low")


def link_detections(points: DataFrame, tracks: DataFrame, row: str, radius: float = 2.0, limit: float = 256.0, keys: Sequence[str] = (), track: str = "track") -> DataFrame:
    """Nearest track within ``radius`` during its life and inside the field; NULL when none.

    The least distance is found first and its first track in a second pass: plain minima are kept in hash tables, while
    a minimum of (distance, track) would sort and spill all pairs.
    """
    def hits(pts: DataFrame, *keep: str) -> DataFrame:
        hit = near_tracks(pts, tracks, row, radius, F.col("t_min"), F.col("t_max"), keys, track, keep=keep)
        return hit.filter(F.col("t").between(F.col("t_min"), F.col("t_max")) & F.col("px").between(0, limit) & F.col("py").between(0, limit))

    points = points.drop(track)
    least = cut_lineage(hits(points).groupBy(row).agg(F.min("dist").alias("link_dist")))
    same = hits(points.join(least, row), "link_dist").filter(F.col("dist") == F.col("link_dist"))
    best = same.groupBy(row).agg(F.min(track).alias(track), F.min("link_dist").alias("link_dist"))
    return points.join(best, row, "left")


def tag_moving(events: DataFrame, row: str, min_track_events: int = 10, keys: Sequence[str] = (), min_samples: int = 3, eps_space: float = 6.0, eps_time: float = 0.5,
               grow_eps: float = 5.0, merge_eps: float = 10.0, crossing: float = 2.0, limit: float = 256.0, radius: float = 2.0, rounds: int = 5) -> DataFrame:
    """Seed, grow, merge and cross tracks of moving candidates, then link the other events.

    Result: asteroid_id 1..k for tracks, 0 for unlinked candidates, -1 for other events; linked
    events become asteroids.  Negative events are never linked.
    """
    cols = [c for c in events.columns]
    cand = events.filter(F.col("classification") == "Asteroid")
    tr = cut_lineage(seed_tracks(cand.select(*keys, row, "t", "x", "y"), row, eps_space, eps_time, min_samples, keys))
    tr = grow_tracks(tr, row, grow_eps, keys, rounds=rounds)
    tr = merge_tracks(tr, row, merge_eps, keys, rounds=rounds)
    tr = cut_lineage(cross_tracks(tr, row, crossing, limit, keys))
    size = tr.filter("track IS NOT NULL").groupBy("track").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_track_events)
    tr = attach(tr, size, ["track"]).withColumn("track", F.when(F.col("_n").isNotNull(), F.col("track"))).drop("_n")
    tr = cut_lineage(number_labels(tr, "track", "asteroid_id", keys, noise=0))
    model = fit_tracks(tr.filter("asteroid_id > 0").drop("track").withColumnRenamed("asteroid_id", "track"), "track", keys)
    rest = events.filter(F.col("classification") != "Asteroid")
    linked = link_detections(rest.filter("flux_sign <> -1").select(*keys, row, "t", "x", "y"), model, row, radius, limit, keys).select(row, F.col("track").alias("_link"))
    rest = rest.join(linked, row, "left").withColumns({
        "asteroid_id": F.coalesce("_link", F.lit(-1).cast("long")), "classification": F.when(F.col("_link").isNotNull(), F.lit("Asteroid")).otherwise(F.col("classification"))}).drop("_link")
    return cand.join(tr.select(row, "asteroid_id"), row).select(*cols, "asteroid_id").unionByName(rest.select(*cols, "asteroid_id"))


def com_motion(stamps: DataFrame, event: str, frame: str = "frame", value: str = "v") -> DataFrame:
    """Distance of the 3x3 centroids of the first and the last frame with half the maximum flux."""
    v = F.greatest(F.col(value), F.lit(0.0))
    per = stamps.groupBy(event, frame).agg(F.sum(value).alias("flux"), (F.sum(v * F.col("dx")) / F.sum(v)).alias("cx"), (F.sum(v * F.col("dy")) / F.sum(v)).alias("cy"))
    top = per.groupBy(event).agg(F.max("flux").alias("_top"))
    good = attach(per, top, [event]).filter(F.col("flux") >= F.col("_top") / 2)
    ends = good.groupBy(event).agg(F.min_by(F.struct("cx", "cy"), frame).alias("a"), F.max_by(F.struct("cx", "cy"), frame).alias("b"))
    return ends.select(event, F.sqrt((F.col("a.cx") - F.col("b.cx")) ** 2 + (F.col("a.cy") - F.col("b.cy")) ** 2).alias("com_motion"))


def _gaussian_scores(t: np.ndarray, f: np.ndarray, ok: np.ndarray, iterations: int) -> np.ndarray:
    """Scores of many windows at once, a row each; ``ok`` marks the points in use, which are the first of a row."""
    n = ok.sum(axis=1)
    t, f = np.where(ok, t, 0.0), np.where(ok, f, 0.0)
    mean = f.sum(axis=1) / np.maximum(n, 1)
    ss = (np.where(ok, f - mean[:, None], 0.0) ** 2).sum(axis=1)
    score, use = np.zeros(len(t)), (n >= 4) & (ss > 0)
    if not use.any():
        return score
    t, f, ok, n, ss = t[use], f[use], ok[use], n[use], ss[use]
    rows, ordered = np.arange(len(t)), np.sort(np.where(ok, f, np.inf), axis=1)
    middle = (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2
    top = np.where(ok, f, -np.inf).argmax(axis=1)
    span = np.where(ok, t, -np.inf).max(axis=1) - np.where(ok, t, np.inf).min(axis=1)
    p = np.stack([f[rows, top] - middle, t[rows, top], np.maximum(1.0, span / 6), middle], axis=1)
    lam, cost, diag = np.full(len(t), 1e-3), np.full(len(t), np.inf), np.arange(4)
    for _ in range(iterations):
        z = (t - p[:, 1:2]) / p[:, 2:3]
        g = np.exp(-0.5 * z * z)
        r = np.where(ok, f - p[:, :1] * g - p[:, 3:], 0.0)
        cost = (r * r).sum(axis=1)
        jac = np.where(ok[:, :, None], np.stack([g, p[:, :1] * g * z / p[:, 2:3], p[:, :1] * g * z * z / p[:, 2:3], np.ones_like(t)], axis=2), 0.0)
        a = jac.transpose(0, 2, 1) @ jac
        b = (jac.transpose(0, 2, 1) @ r[:, :, None])
        damped = a.copy()
        damped[:, diag, diag] += lam[:, None] * (a[:, diag, diag] + 1e-12)
        q = p + (np.linalg.pinv(damped, rcond=4 * np.finfo(float).eps, hermitian=True) @ b)[:, :, 0]
        q[:, 2] = np.maximum(np.abs(q[:, 2]), 1e-3)
        new = (np.where(ok, f - q[:, :1] * np.exp(-0.5 * ((t - q[:, 1:2]) / q[:, 2:3]) ** 2) - q[:, 3:], 0.0) ** 2).sum(axis=1)
        better = new < cost
        lam, p = np.where(better, lam / 3, lam * 5), np.where(better[:, None], q, p)
        cost = np.minimum(cost, new)
    score[use] = np.maximum(0.0, 1 - cost / ss)
    return score


def gaussian_score(lc: DataFrame, event: str, time: str = "frame", flux: str = "flux", iterations: int = 30, points: int = 100_000) -> DataFrame:
    """R^2 of a Gaussian plus constant fitted to each event's window of a few dozen points, at least 0.

    Windows travel as arrays in order of time and are fitted together, at most ``points`` padded points at once.
    """
    known = F.col(time).isNotNull() & F.col(flux).isNotNull() & ~F.isnan(F.col(flux).cast("double"))
    point = F.when(known, F.struct(F.col(time).cast("double").alias("t"), F.col(flux).cast("double").alias("f")))
    windows = lc.groupBy(event).agg(F.array_sort(F.collect_list(point)).alias("_p")).select(event, F.col("_p.t").alias("t"), F.col("_p.f").alias("f"))
    etype = windows.schema[event].dataType

    def fit(batches):
        for batch in batches:
            ts, fs = ([np.asarray(v, dtype=float) for v in batch.column(c).to_pylist()] for c in (1, 2))
            sizes, scores = np.array([len(v) for v in ts], dtype=int), np.zeros(batch.num_rows)
            by_size, lo = np.argsort(sizes, kind="stable"), 0
            while lo < len(by_size):
                hi = lo + 1
                while hi < len(by_size) and (hi + 1 - lo) * sizes[by_size[hi]] <= points:
                    hi += 1
                at = by_size[lo:hi]
                wide = max(1, sizes[at].max())
                t, f, ok = np.zeros((len(at), wide)), np.zeros((len(at), wide)), np.zeros((len(at), wide), dtype=bool)
                for k, i in enumerate(at):
                    good = np.isfinite(ts[i]) & np.isfinite(fs[i])
                    m = int(good.sum())
                    t[k, :m], f[k, :m], ok[k, :m] = ts[i][good], fs[i][good], True
                scores[at] = _gaussian_scores(t, f, ok, iterations)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], [batch.schema.names[0], "gaussian_score"])

    return windows.mapInArrow(fit, StructType([StructField(event, etype), StructField("gaussian_score", DoubleType())]))


# Pairs (least centroid motion, least Gaussian score) of a moving object.
MOTION_LIMITS = [(1.0, 0.0), (0.75, 0.7), (0.5, 0.9)]


def is_moving(com: str = "com_motion", score: str = "gaussian_score") -> Column:
    """Motion and light-curve shape of a moving object."""
    cond = F.lit(False)
    for motion, fit in MOTION_LIMITS:
        cond = cond | ((F.col(com) >= motion) & (F.col(score) >= fit))
    return F.coalesce(cond, F.lit(False))


def moving_candidates(finest_bin: int = 1) -> Column:
    """Events that may be moving objects at all."""
    return (F.col("frame_duration").between(2, 50) & (F.col("lc_sig_max") >= 5) & (F.col("flux_sign") == 1) & (F.col("frame_bin") == finest_bin)
            & ~F.col("classification").isin("CosmicRay", "Junk"))


def straight_lines(stamps: DataFrame, event: str, threshold: Column, min_votes: int = 10, angles: int = 180, value: str = "v") -> DataFrame:
    """Whether the bright pixels of a stamp hold a straight line (votes over angle and distance).

    ``stamps`` has one maximum image per event; an approximation of a probabilistic line search.
    """
    on = stamps.filter(threshold).select(event, "dy", "dx")
    theta = F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))
    votes = on.withColumn("_a", theta).withColumn("_rho", F.rint(F.col("dx") * F.cos(F.col("_a") * F.lit(math.pi / angles)) + F.col("dy") * F.sin(F.col("_a") * F.lit(math.pi / angles))))
    best = votes.groupBy(event, "_a", "_rho").agg(F.count(F.lit(1)).alias("votes")).groupBy(event).agg(F.max("votes").alias("votes"))
    return best.withColumn("has_line", F.col("votes") >= min_votes)


