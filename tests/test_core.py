import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import skew
from skyloom.operators.components import connected_components, density_groups, number_labels
from skyloom.operators.spatial import any_within, nearest_within


def _naive_dbscan(x, eps, ms):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= ms
    lab = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and lab[i] < 0:
            stack = [i]
            lab[i] = c
            while stack:
                j = stack.pop()
                for k in np.where(near[j] & core & (lab < 0))[0]:
                    lab[k] = c
                    stack.append(k)
            c += 1
    border = ~core & (near & core[None, :]).any(1)
    return lab, core, border, near


@pytest.mark.parametrize("dims,ms,n,box", [(2, 1, 300, 10), (2, 2, 300, 14), (3, 1, 300, 5), (2, 4, 400, 8), (3, 3, 250, 6), (1, 2, 100, 80)])
def test_density_groups_match_brute_force(spark, dims, ms, n, box):
    rng = np.random.default_rng(dims * 100 + ms)
    x = rng.uniform(0, box, (n, dims))
    x[: n // 3] = x[0] + rng.normal(0, 0.02, (n // 3, dims))  # one dense spot with a third of the rows
    x[5] = x[6]
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(dims)])
    pdf["id"] = np.arange(n)
    got = density_groups(spark.createDataFrame(pdf), "id", list(pdf.columns[:dims]), 0.5, ms).toPandas().sort_values("id")
    lab, core, border, near = _naive_dbscan(x, 0.5, ms)
    label = got["label"].to_numpy(dtype=float)
    assert np.array_equal(np.isnan(label), ~(core | border))
    for i in np.where(core)[0]:
        same = core & (lab == lab[i])
        assert len(set(label[same])) == 1
    for i, j in [(a, b) for a in np.where(core)[0][:40] for b in np.where(core)[0][::7]]:
        assert (lab[i] == lab[j]) == (label[i] == label[j])
    for i in np.where(border)[0]:
        assert label[i] in set(label[near[i] & core])


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7000, 7000 + i) for i in range(1, 40)]
    out = connected_components(spark.createDataFrame(path, "u long, v long")).toPandas()
    groups = out.groupby("root")["node"].apply(lambda s: (s.min(), len(s)))
    assert sorted(groups) == [(0, 201), (1000, 51), (7000, 40)]


def test_exact_percentiles_hot_and_cold(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3, 4], 20000), "v": rng.normal(size=20000).round(2)})
    pdf.loc[pdf.index % 997 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    wanted = {"q1": ("v", 0.1), "med": ("v", 0.5), "q9": ("v", 0.977), "lo": ("v", 0.0), "hi": ("v", 1.0)}
    got = skew.exact_percentiles(df, ["k"], wanted, hot_rows=4000, accuracy=300).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        for name, (_, p) in wanted.items():
            assert got.loc[k, name] == pytest.approx(np.percentile(g["v"], 100 * p), abs=1e-9)


@pytest.mark.parametrize("chunk", [7, 10**6])
def test_ordered_scan_across_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": [1] * 90 + [2] * 10, "t": rng.permutation(100), "v": rng.integers(0, 9, 100)})
    scan = skew.OrderedScan(spark.createDataFrame(pdf), ["k"], ["t"], chunk_rows=chunk)
    scan.lag({"pt": "t"}).lead({"nt": "t"}).running_sum("cs", F.col("v")).row_number("rn")
    got = scan.done().toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    exp = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = exp.groupby("k")
    assert np.array_equal(got["cs"], g["v"].cumsum())
    assert np.array_equal(got["rn"], g.cumcount() + 1)
    assert got["pt"].fillna(-1).tolist() == g["t"].shift().fillna(-1).tolist()
    assert got["nt"].fillna(-1).tolist() == g["t"].shift(-1).fillna(-1).tolist()


@pytest.mark.parametrize("lead", ["crowded", "equal", "text", "null"])
def test_ordered_scan_divides_crowded_and_equal_leads(spark, lead):
    rng = np.random.default_rng(8)
    n = 6000
    t = np.where(rng.random(n) < 0.99, rng.uniform(0, 1e-6, n), rng.uniform(0, 1e6, n))
    lead_of = {"crowded": t, "equal": np.zeros(n), "text": [f"{x:.9f}" for x in t], "null": np.where(rng.random(n) < 0.9, np.nan, t)}[lead]
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.95, 1, 2), "t": lead_of, "i": rng.permutation(n), "v": rng.integers(1, 9, n)})
    kind = "string" if lead == "text" else "double"
    df = spark.createDataFrame(pdf, f"k long, t {kind}, i long, v long").withColumn("t", F.col("t") if lead == "text" else F.nanvl("t", F.lit(None).cast("double")))
    scan = skew.OrderedScan(df, ["k"], ["t"], chunk_rows=300)
    sizes = scan.df.groupBy("k", "_chunk").count().toPandas()
    assert sizes["count"].sum() == n and sizes["count"].max() < 900 and len(sizes) > 12
    got = scan.lag({"pv": "v", "pi": "i"}).running_sum("cs", F.col("v")).row_number("rn").fill({"lv": "v"}).done().toPandas()
    assert "_tie" not in got and len(got) == n
    for _, g in got.groupby("k"):
        g = g.sort_values("rn").reset_index(drop=True)
        assert g["rn"].tolist() == list(range(1, len(g) + 1))
        assert g["cs"].tolist() == g["v"].cumsum().tolist()
        assert g["pi"].fillna(-1).tolist() == g["i"].shift().fillna(-1).tolist() and g["pv"].fillna(-1).tolist() == g["v"].shift().fillna(-1).tolist()
        t = g["t"].dropna()
        assert t.is_monotonic_increasing and g["t"].isna().sum() == (t.index.min() if len(t) else len(g))


def test_nearest_within_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 10, (300, 2)), rng.uniform(0, 10, (200, 2))
    a[:100] = a[0]
    b[:60] = a[0] + rng.normal(0, 0.01, (60, 2))
    left = spark.createDataFrame(pd.DataFrame({"lid": range(300), "x": a[:, 0], "y": a[:, 1]}))
    right = spark.createDataFrame(pd.DataFrame({"rid": range(200), "u": b[:, 0], "w": b[:, 1]}))
    got = nearest_within(left, right, ["x", "y"], ["u", "w"], "rid", 0.7).toPandas().sort_values("lid")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    exp = np.where(d.min(1) <= 0.7, d.argmin(1), -1)
    assert np.array_equal(got["rid"].fillna(-1).astype(int), exp)
    assert any_within(left, right, ["x", "y"], ["u", "w"], 0.7, negate=True).count() == (exp < 0).sum()


def test_number_labels(spark):
    df = spark.createDataFrame([(1, 40), (2, 7), (3, None), (4, 40)], "id long, label long")
    out = number_labels(df, "label", "n").orderBy("id").toPandas()
    assert out["n"].tolist() == [2, 1, 0, 2]
