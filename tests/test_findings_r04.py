"""Findings of round 4: whole results, and work that grows no faster than the input."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import queries
from skyloom.operators import catalog, filters, fits, robust, series, skew


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_p17_windows_are_fitted_together_and_as_alone(spark):
    rng, rows = np.random.default_rng(3), []
    for ev, n in enumerate((4, 9, 30, 30, 61)):
        t = 60000 + np.arange(n) / 12
        dt = t - t[n // 3]
        f = 40 * np.exp(-dt / 0.8) / (1 + np.exp(-dt / 0.1)) + 2 + rng.normal(0, 0.2, n)
        rows.append(pd.DataFrame({"ev": ev, "t": t, "flux": f, "err": 0.3, "t_start": t[n // 3], "t_end": t[n // 3] + 0.5}))
    w = spark.createDataFrame(pd.concat(rows).sample(frac=1, random_state=1))
    together = fits.fit_events(w, ["ev"])
    assert "MapInArrow" in plan(together) and "FlatMapGroups" not in plan(together)
    got = together.orderBy("ev").toPandas()
    alone = fits.fit_events(w, ["ev"], points=1).orderBy("ev").toPandas()
    assert got["fit_ok"].tolist() == [False, True, True, True, True] and got["n_region"].tolist() == alone["n_region"].tolist()
    assert np.allclose(got["delta_chi2"], alone["delta_chi2"], rtol=1e-6, equal_nan=True) and (got["redchi2_region"].iloc[2:] < 2).all()


def test_p17_objects_with_many_events_keep_them(spark, tmp_path):
    """An object of 45 events and one of a single event, each an hour's burst on a quiet curve, through the query."""
    n = 45
    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=40 * i + 2 * j) for i in range(n) for j in range(2)]
    ev = pd.DataFrame({"event_id": range(2 * n + 2), "ts": ts + ts[:2], "user_id": [1] * 2 * n + [2] * 2, "event_type": "view", "value": 90.0, "props": ""})
    spark.createDataFrame(ev).write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["P17_profile_fits"](spark, str(tmp_path)).groupBy("objid").count().orderBy("objid").collect()
    assert [tuple(r) for r in got] == [(1, n), (2, 1)]


def _crossbins(ev):
    """Literal propagation of ids over pairs of events, from finer to coarser bins."""
    rows = sorted(ev.to_dict("records"), key=lambda r: r["frame_bin"])
    holds = {r["eventkey"]: {r["eventkey"]} for r in rows}
    for c in rows:
        for f in rows:
            key = "g2" if f["classification"] == "Asteroid" else "g1"
            a, b = f["frame_bin"], c["frame_bin"]
            if a < b and f[key] == c[key] and f["frame_start"] * a <= c["frame_end"] * b + b and f["frame_end"] * a >= c["frame_start"] * b - b:
                holds[c["eventkey"]] |= holds[f["eventkey"]]
    held = pd.Series([i for ids in holds.values() for i in ids]).value_counts()
    rank = {i: k for k, i in enumerate(sorted(held[held > 1].index))}
    return {e: sorted(rank[i] for i in ids if i in rank) for e, ids in holds.items()}


def test_g5_ids_of_crowded_groups_equal_the_pairs(spark, monkeypatch):
    rng, n = np.random.default_rng(4), 400
    ev = pd.DataFrame({"eventkey": rng.permutation(n), "frame_bin": rng.choice([1, 2, 6], n), "g1": rng.integers(0, 60, n), "g2": rng.integers(0, 3, n),
                       "classification": rng.choice(["Asteroid", "-", None], n)})
    start = rng.integers(0, 80, n)
    ev["frame_start"], ev["frame_end"] = start // ev.frame_bin, (start + 8) // ev.frame_bin
    got = {r.eventkey: list(r.crossbin_ids) for r in series.crossbin_ids(spark.createDataFrame(ev), "g1", "g2").collect()}
    assert got == _crossbins(ev)
    # Copies: 300 events each at three places in time are three classes with three links between them.
    written, real = [], series.cut_lineage
    monkeypatch.setattr(series, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    same = pd.DataFrame({"eventkey": range(900), "frame_bin": np.repeat([1, 2, 6], 300), "g1": 1, "g2": 1, "classification": "-", "frame_start": 0, "frame_end": 1})
    out = series.crossbin_ids(spark.createDataFrame(same), "g1", "g2").filter("eventkey >= 600").select(F.size("crossbin_ids").alias("n"))
    assert {r.n for r in out.collect()} == {600} and max(df.count() for df in written) < 2000
    assert sorted(df.count() for df in written)[:2] == [2, 3]


def test_j12_closest_approach_of_crowded_frames_without_copies_of_points(spark, monkeypatch):
    rng, n = np.random.default_rng(8), 1500
    det = pd.DataFrame({"objid": rng.integers(0, 12, n), "frame": rng.integers(0, 3, n), "xcentroid": rng.uniform(0, 30, n), "ycentroid": rng.uniform(0, 30, n)})
    pred = pd.DataFrame({"designation": rng.permutation(n), "frame": rng.integers(0, 3, n), "x": rng.uniform(0, 30, n), "y": rng.uniform(0, 30, n)})
    # Objects that come close at every scale, one at exactly equal distances, one without a hit, and values that are near nothing.
    det.loc[n - 5 :, ["objid", "frame", "xcentroid", "ycentroid"]] = [[20, 7, 0.0, 0.0], [21, 8, 50.0, 5.0], [22, 9, 0.0, 0.0], [23, 7, 1.0, 1.7], [20, 9, np.nan, 1.0]]
    pred.loc[n - 5 :, ["frame", "x", "y"]] = [[7, 1.0, 0.0], [7, -1.0, 0.0], [8, 52.9, 5.0], [9, 3.1, 0.0], [9, np.nan, 0.0]]
    det = det.astype({"objid": int, "frame": int})
    pred = pred.astype({"frame": int})
    pairs = det.merge(pred, on="frame")
    pairs["d"] = np.sqrt((pairs.xcentroid - pairs.x) * (pairs.xcentroid - pairs.x) + (pairs.ycentroid - pairs.y) * (pairs.ycentroid - pairs.y))
    want = pairs[pairs.d <= 3].sort_values(["d", "designation", "frame"]).groupby("objid").first()
    off = spark.range(1).select(F.lit(0.0).alias("offset_x"), F.lit(0.0).alias("offset_y"))
    joined = []
    monkeypatch.setattr(catalog, "pairs_within", lambda *a, **k: joined.append(a))
    got = catalog.identify_moving(spark.createDataFrame(det), spark.createDataFrame(pred), off).toPandas().set_index("objid").sort_index()
    assert got.index.tolist() == sorted(det.objid.unique()) and got.loc[22].isna().all() and not joined
    got = got.loc[want.index]
    assert np.allclose(got.dist_px, want.d) and got.designation.tolist() == want.designation.tolist() and got.match_frame.tolist() == want.index.map(want.frame).tolist()


def test_p18_rows_of_few_units_stay_where_they_are(spark):
    i = F.col("id")
    stars = spark.range(1_500_000).select((i % 3).alias("unit"), (1 + (i * 7919) % 101 / F.lit(50.0)).alias("e_zp"), (i % 7).alias("x"))
    good = filters.keep_good_errors(stars, "e_zp", ["unit"], 1.2)
    assert "SortMergeJoin" not in plan(good) and "BroadcastHashJoin" in plan(good) and 0 < good.count() < 1_500_000
    # Percentiles of groups that are too large for one task: values below the bracket, NULLs and a key without a value.
    rng = np.random.default_rng(2)
    v = rng.normal(size=4000).round(3)
    df = frame(spark, k=np.r_[np.zeros(4000), np.ones(5), np.full(3, 2.0)], v=np.r_[v, [np.nan] * 5, [4.0, 1.0, 2.0]]).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = skew.exact_percentiles(df, ["k"], {"m": ("v", 0.5), "q": ("v", 0.1)}, hot_rows=10).orderBy("k").toPandas()
    assert np.allclose(got["m"], [np.median(v), np.nan, 2.0], equal_nan=True) and np.allclose(got["q"], [np.quantile(v, 0.1), np.nan, 1.2], equal_nan=True)


def test_p18_units_without_usable_bins_take_all_their_stars(spark):
    """One unit has two bins of scattered stars, the other a few stars of one bin each."""
    rng = np.random.default_rng(6)
    a = pd.DataFrame({"unit": 1, "rp": np.repeat([10.1, 11.1], 40), "zp_ab": 20 + rng.normal(0, 0.05, 80)})
    b = pd.DataFrame({"unit": 2, "rp": [9.1, 10.1, 11.1, 12.1, 13.1, 14.1], "zp_ab": [20.0, 20.1, 20.2, 20.3, 20.4, None]})
    got = robust.binned_zeropoint(spark.createDataFrame(pd.concat([a, b])), ["unit"]).orderBy("unit").toPandas()
    mad = 0.1 * robust.MAD_TO_SIGMA
    assert got["n_stars"].tolist() == [80, 5] and abs(got["zp_ab"][0] - 20) < 0.02 and 0.02 < got["zp_scatter"][0] < 0.08
    assert np.allclose([got["zp_ab"][1], got["zp_scatter"][1], got["e_zp_ab"][1]], [20.2, mad, mad / np.sqrt(5)])
