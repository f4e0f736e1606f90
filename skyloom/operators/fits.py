"""Rise-and-decay fits of event light curves (P17) and clustering of the fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from skyloom.operators.components import density_groups
from skyloom.operators.skew import attach, spread

FIT_COLUMNS = ["A", "A_err", "t0", "tau_rise", "tau_rise_err", "tau_fall", "tau_fall_err", "offset", "A_snr", "redchi2_region", "delta_bic", "delta_chi2"]


def _profiles(t, p, exposure, supersample):
    """(shapes of unit height, models) at times ``t``, a window in each row; exposures are averages over shifts.

    The exponentials of a time and of a shift are multiplied, and the product is held between exp(-50) and exp(50).
    """
    shift = (np.arange(supersample) / (supersample - 1) - 0.5) * exposure if exposure > 0 else np.zeros(1)
    dt = t - p[:, 1:2]
    low, high = np.exp(-50.0), np.exp(50.0)
    ahead = [np.exp(-dt / p[:, i : i + 1]) for i in (2, 3)]
    steps = [np.exp(-shift[None, :] / p[:, i : i + 1]) for i in (2, 3)]
    shape = np.zeros_like(t)
    for k in range(len(shift)):
        rise, fall = (np.clip(x * s[:, k : k + 1], low, high) for x, s in zip(ahead, steps))
        shape += fall / (1 + rise)
    shape /= len(shift)
    return shape, p[:, :1] * shape + p[:, 4:]


def _edges(t, ok):
    return np.where(ok, t, np.inf).min(axis=1), np.where(ok, t, -np.inf).max(axis=1)


def _bounded_fits(t, f, e, ok, exposure, supersample, iterations=60):
    """Damped least squares with parameters projected into their bounds, a window in each row; (parameters, errors).

    ``ok`` marks the points in use.  Windows that have settled leave the loop.
    """
    n, rows = ok.sum(axis=1), np.arange(len(t))
    first, last = _edges(t, ok)
    span = np.where(last > first, last - first, 1.0)
    ordered = np.sort(np.where(ok, f, np.inf), axis=1)
    base = (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2
    top = np.where(ok, f, -np.inf).argmax(axis=1)
    zero, inf = np.zeros(len(t)), np.full(len(t), np.inf)
    low = np.stack([zero, first - span, zero + 1e-3, zero + 1e-3, -inf], axis=1)
    high = np.stack([inf, last + span, 5 * span, 10 * span, inf], axis=1)
    jump = f[rows, top] - base
    p = np.clip(np.stack([np.where(jump > 0, jump, 1.0), t[rows, top], 0.05 * span, 0.2 * span, base], axis=1), low + 1e-6, high - 1e-6)
    lam, jac, out, err, diag = np.full(len(t), 1e-2), np.zeros((*t.shape, 5)), p.copy(), np.zeros_like(p), np.arange(5)
    w = np.where(ok, 1 / np.where(ok, e, 1.0), 0.0)
    at = rows  # the windows still in the loop
    shape, m = _profiles(t, p, exposure, supersample)
    for _ in range(iterations):
        r = (f - m) * w
        cost = (r * r).sum(axis=1)
        jac = np.empty((*t.shape, 5))
        jac[:, :, 0], jac[:, :, 4] = shape * w, w
        for i in (1, 2, 3):
            h = 1e-6 * np.maximum(np.abs(p[:, i]), 1e-3)
            q = p.copy()
            q[:, i] = np.where(q[:, i] + h <= high[:, i], q[:, i] + h, q[:, i] - h)
            jac[:, :, i] = (_profiles(t, q, exposure, supersample)[1] - m) / (q[:, i] - p[:, i])[:, None] * w
        a, g = jac.transpose(0, 2, 1) @ jac, jac.transpose(0, 2, 1) @ r[:, :, None]
        improved, new, nshape, nm, least = np.zeros(len(t), bool), p.copy(), shape.copy(), m.copy(), cost.copy()
        ask = np.arange(len(t))
        for _ in range(8):
            damped = a[ask]
            damped[:, diag, diag] += lam[ask, None] * (damped[:, diag, diag] + 1e-12)
            step = np.linalg.pinv(damped, rcond=5 * np.finfo(float).eps, hermitian=True) @ g[ask]
            q = np.clip(p[ask] + step[:, :, 0], low[ask], high[ask])
            qs, qm = _profiles(t[ask], q, exposure, supersample)
            cn = (((f[ask] - qm) * w[ask]) ** 2).sum(axis=1)
            better = cn < cost[ask]
            won = ask[better]
            improved[won], new[won], nshape[won], nm[won], least[won] = True, q[better], qs[better], qm[better], cn[better]
            lam[won] = np.maximum(lam[won] / 4, 1e-9)
            ask = ask[~better]
            lam[ask] *= 4
            if not len(ask):
                break
        settled = ~improved | (cost - least < 1e-10 * np.maximum(cost, 1e-12))
        out[at] = new
        err[at[settled]] = np.sqrt(np.clip(np.linalg.pinv(a[settled])[:, diag, diag], 0, np.inf))
        go = ~settled
        last_a, p, shape, m = a[go], new[go], nshape[go], nm[go]
        t, f, w, low, high, lam, at = t[go], f[go], w[go], low[go], high[go], lam[go], at[go]
        if not len(at):
            break
    else:
        err[at] = np.sqrt(np.clip(np.linalg.pinv(last_a)[:, diag, diag], 0, np.inf))
    return out, err


def _fit_statistics(t, f, e, ok, start, end, exposure, supersample, above):
    """``FIT_COLUMNS`` and the points of the region, a window in each row."""
    p, err = _bounded_fits(t, f, e, ok, exposure, supersample)
    m = _profiles(t, p, exposure, supersample)[1]
    bump = np.where(ok, m - p[:, 4:], 0.0)
    peak = bump[np.arange(len(t)), np.abs(bump).argmax(axis=1)][:, None]
    region = (peak != 0) & (bump / np.where(peak != 0, peak, 1.0) > above)
    region = ok & (region | ((t >= start[:, None]) & (t <= end[:, None])))
    region = np.where((region.sum(axis=1) < 3)[:, None], ok, region)
    n, w = region.sum(axis=1), np.where(region, 1 / np.where(ok, e, 1.0) ** 2, 0.0)
    chi_fit, chi_flat = (w * (f - m) ** 2).sum(axis=1), (w * (f - p[:, 4:]) ** 2).sum(axis=1)
    snr = np.where(err[:, 0] > 0, p[:, 0] / np.where(err[:, 0] > 0, err[:, 0], 1.0), np.nan)
    red = np.where(n > 5, chi_fit / np.where(n > 5, n - 5, 1), np.nan)
    return np.stack([p[:, 0], err[:, 0], p[:, 1], p[:, 2], err[:, 2], p[:, 3], err[:, 3], p[:, 4], snr, red, chi_fit - chi_flat + 4 * np.log(n), chi_flat - chi_fit], axis=1), n


def fit_events(windows: DataFrame, keys: Sequence[str], exposure: float = 0.0, supersample: int = 7, above: float = 0.05, points: int = 20_000) -> DataFrame:
    """Fit each event's window and compare with a flat baseline over the event region.

    ``windows`` holds the points of each event's fit window (t, flux, err, t_start, t_end): a few
    event durations, cut out in Spark beforehand.  The region is where the model rises above
    ``above`` of its peak, or the detected interval.  Windows travel as arrays in order of time and
    are fitted together, at most ``points`` padded points at once.
    """
    keys = list(keys)
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("t", "flux", "err")])
    # Few bytes, but much work: adaptive execution would merge them into one task.
    packed = spread(windows, *keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(point)).alias("_p"), F.min(F.col("t_start").cast("double")).alias("_s"), F.min(F.col("t_end").cast("double")).alias("_e"))
    packed = packed.select(*keys, "_p.t", "_p.flux", "_p.err", "_s", "_e")
    schema = StructType([packed.schema[k] for k in keys] + [StructField("fit_ok", BooleanType())] + [StructField(c, DoubleType()) for c in FIT_COLUMNS] + [StructField("n_region", LongType())])

    def fit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [[np.asarray(v, dtype=float) for v in batch.column(len(keys) + i).to_pylist()] for i in range(3)]
            start, end = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in (3, 4))
            good = [np.isfinite(t) & np.isfinite(f) & np.isfinite(e) & (e > 0) for t, f, e in zip(*cols)]
            sizes = np.array([g.sum() for g in good], dtype=int)
            values, region = np.full((batch.num_rows, len(FIT_COLUMNS)), np.nan), np.zeros(batch.num_rows, dtype=np.int64)
            by_size = np.argsort(sizes, kind="stable")
            by_size = by_size[sizes[by_size] >= 6]
            lo = 0
            while lo < len(by_size):
                hi = lo + 1
                while hi < len(by_size) and (hi + 1 - lo) * sizes[by_size[hi]] <= points:
                    hi += 1
                at = by_size[lo:hi]
                part, ok = np.zeros((3, len(at), sizes[at[-1]])), np.zeros((len(at), sizes[at[-1]]), dtype=bool)
                for k, i in enumerate(at):
                    ok[k, : sizes[i]] = True
                    for c in range(3):
                        part[c, k, : sizes[i]] = cols[c][i][good[i]]
                        # Points that only fill a row repeat its last one.
                        part[c, k, sizes[i] :] = part[c, k, sizes[i] - 1]
                with np.errstate(over="ignore", invalid="ignore"):
                    values[at], region[at] = _fit_statistics(*part, ok, start[at], end[at], exposure, supersample, above)
                lo = hi
            arrays = [batch.column(i) for i in range(len(keys))] + [pa.array(sizes >= 6)] + [pa.array(v, from_pandas=True) for v in values.T] + [pa.array(region)]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return packed.mapInArrow(fit, schema)


def busy_objects(events: DataFrame, keys: Sequence[str], max_events: int) -> DataFrame:
    """Objects with more than ``max_events`` positive events, and how many."""
    return events.filter("flux_sign > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") > max_events)


def event_windows(events: DataFrame, lc: DataFrame, keys: Sequence[str], event: str, cadence: float, n_durations: float = 3.0) -> DataFrame:
    """Light-curve points within ``n_durations`` around each positive event, of every object.

    Events reach their points by equality on time blocks; ``busy_objects`` lists the objects that a
    caller may want to leave out.
    """
    keys = list(keys)
    ev = events.filter("flux_sign > 0")
    dur = F.greatest(F.col("t_end") - F.col("t_start"), F.lit(cadence))
    mid = (F.col("t_start") + F.col("t_end")) / 2
    ev = ev.select(*keys, event, "t_start", "t_end", (mid - n_durations * dur / 2).alias("_lo"), (mid + n_durations * dur / 2).alias("_hi"))
    block = 64 * cadence
    ev = ev.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor(F.col("_hi") / block))))
    rows = lc.select(*keys, "t", "flux", "err", F.floor(F.col("t") / block).alias("_b")).join(ev, [*keys, "_b"])
    return rows.filter(F.col("t").between(F.col("_lo"), F.col("_hi"))).select(*keys, event, "t", "flux", "err", "t_start", "t_end")


def whitened(df: DataFrame, row: str, features: Sequence[str], variance: float = 0.99, log: bool = True, whiten: bool = True) -> DataFrame:
    """Features (their log10 with ``log``; rows without a usable value go), standardised and, with
    ``whiten``, rotated to the components that explain ``variance`` and scaled to unit variance:
    columns w0, w1, ..."""
    good = df
    for c in features:
        good = good.filter(F.col(c) > 0 if log else F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    logs = good.select(row, *[(F.log10(c) if log else F.col(c).cast("double")).alias(c) for c in features])
    st = logs.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    z = logs.select(row, *[((F.col(c) - st[f"m_{c}"]) / (st[f"s_{c}"] or 1.0)).alias(c) for c in features])
    if not whiten:
        return z.select(row, *[F.col(c).alias(f"w{i}") for i, c in enumerate(features)])
    vec = VectorAssembler(inputCols=list(features), outputCol="v").transform(z)
    model = PCA(k=len(features), inputCol="v", outputCol="pc").fit(vec)
    share = np.cumsum(model.explainedVariance.toArray())
    k = min(int(np.searchsorted(share, variance) + 1), len(features))
    pcs = model.transform(vec).select(row, vector_to_array("pc").alias("pc"))
    sd = pcs.agg(*[F.stddev_pop(F.col("pc")[i]).alias(f"s{i}") for i in range(k)]).first()
    return pcs.select(row, *[(F.col("pc")[i] / (sd[f"s{i}"] or 1.0)).alias(f"w{i}") for i in range(k)])


def cluster_events(df: DataFrame, row: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 15, **kw) -> DataFrame:
    """Density clusters of whitened fit features; -1 is noise and -2 a row with unusable features."""
    w = whitened(df, row, features, **kw)
    lab = density_groups(w, row, [c for c in w.columns if c != row], eps, min_samples, label="cluster")
    out = df.join(lab.select(row, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")), row, "left")
    return out.withColumn("cluster", F.coalesce("cluster", F.lit(-2).cast("long")))


def template_members(clustered: DataFrame, row: str, template: int) -> DataFrame:
    """Rows in the template's cluster (none when the template is noise)."""
    own = clustered.filter(F.col(row) == template).select("cluster").filter("cluster >= 0")
    return clustered.join(own, "cluster", "left_semi")


def cluster_stability(df: DataFrame, row: str, features: Sequence[str], template: int, sizes: Sequence[int] = (10, 15, 20, 30, 50), eps: float = 0.5, **kw) -> DataFrame:
    """Share of the runs (one per minimum size) in which a row shares the template's cluster."""
    w = whitened(df, row, features, **kw)
    coords = [c for c in w.columns if c != row]
    hits = None
    for size in sizes:
        lab = density_groups(w, row, coords, eps, size, label="cluster").select(row, "cluster")
        own = lab.filter((F.col(row) == template) & F.col("cluster").isNotNull()).select("cluster")
        got = lab.join(own, "cluster", "left_semi").select(row)
        hits = got if hits is None else hits.unionByName(got)
    n = hits.groupBy(row).agg((F.count(F.lit(1)) / len(sizes)).alias("stability"))
    return attach(df, n, [row]).withColumn("stability", F.coalesce("stability", F.lit(0.0)))
