"""Queries: light-curve features and classification."""

from pyspark.sql import functions as F

from skyloom.operators import features as C
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_robust import rounded
from skyloom.plans.registry import query


def _lc(spark, sf):
    return D.series(spark, sf).select("series", "pt", "t", "flux")


def _periods(spark, sf):
    return D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("series"), (3 + F.col("s_suppkey") % 40 + F.lit(0.37)).alias("period"))


PERIOD_SQL = "pd AS (SELECT s_suppkey AS series, 3 + s_suppkey % 40 + 37e-2 AS period FROM supplier)"
LC_SQL = f"s AS (SELECT series, pt, t, flux FROM ({D.SERIES_SQL}))"


@query("C1_scale_and_trim", f"""WITH {LC_SQL}, m AS (SELECT series, avg(flux) AS m, stddev_pop(flux) AS sd FROM s GROUP BY series), z AS (SELECT series, pt, (flux - m) / sd AS z FROM s JOIN m USING (series)),
q AS (SELECT series, quantile_cont(z, 25e-3) AS lo, quantile_cont(z, 975e-3) AS hi FROM z GROUP BY series) SELECT series, pt, {R('z')} AS flux FROM z JOIN q USING (series) WHERE z > lo AND z < hi""")
def c1(spark, sf):
    return rounded(C.scale_and_trim(_lc(spark, sf), "series").select("series", "pt", "flux"), "flux")


@query("C2_shape_features", f"""WITH {LC_SQL}, m AS (SELECT series, count(*) AS n, avg(flux) AS mu, stddev_pop(flux) AS sd, median(flux) AS med, max(flux) AS mx, quantile_cont(flux, 25e-2) AS q25, quantile_cont(flux, 75e-2) AS q75, quantile_cont(flux, 95e-2) AS q95 FROM s GROUP BY series),
d AS (SELECT series, median(abs(flux - med)) AS mad, sum(abs(flux - med) / sd) AS r1, sum(pow((flux - med) / sd, 2)) AS r2, avg(pow((flux - mu) / sd, 3)) AS skewness, avg(pow((flux - mu) / sd, 4)) - 3 AS kurtosis,
 avg(pow(flux - mu, 2)) FILTER (flux > mu) AS hi2, avg(pow(flux - mu, 2)) FILTER (flux <= mu) AS lo2 FROM s JOIN m USING (series) GROUP BY series),
w AS (SELECT s.series, pow(flux - lag(flux) OVER v, 2) AS st, sum(flux - mu) OVER v AS cs FROM s JOIN m USING (series) WINDOW v AS (PARTITION BY s.series ORDER BY t, pt)), x AS (SELECT series, sum(st) AS s2, max(cs) - min(cs) AS rg FROM w GROUP BY series)
SELECT series, {R('skewness')} AS skewness, {R('kurtosis')} AS kurtosis, {R('mad')} AS mean_abs_deviation, {R('r1 / sqrt(r2) / sqrt(n)')} AS stetson_k, {R('q75 - q25', 8)} AS quartile31, {R('s2 / (n - 1) / (sd * sd)')} AS mean_variance, {R('rg / n / sd')} AS mm_cusum,
{R('1 - q95 / mx')} AS max_95_gap, {R('sqrt(hi2 / lo2)')} AS hl_amp_ratio FROM m JOIN d USING (series) JOIN x USING (series)""")
def c2(spark, sf):
    out = C.non_periodic_features(_lc(spark, sf), "series", ["t", "pt"]).drop("n", "weighted_mean", "weighted_std")
    return rounded(rounded(out, *[c for c in out.columns if c not in ("series", "quartile31")]), "quartile31", n=8)


@query("W14_sequence_stats", f"""WITH {LC_SQL}, m AS (SELECT series, avg(flux) AS mu FROM s GROUP BY series), w AS (SELECT s.series, pow(flux - lag(flux) OVER v, 2) AS st, sum(flux - mu) OVER v AS cs FROM s JOIN m USING (series) WINDOW v AS (PARTITION BY s.series ORDER BY t, pt))
SELECT series, {R('sum(st)', 4)} AS step2, {R('max(cs) - min(cs)', 4)} AS cusum_range FROM w GROUP BY series""")
def w14(spark, sf):
    lc = _lc(spark, sf)
    mean = lc.groupBy("series").agg(F.avg("flux").alias("_centre"))
    return rounded(C.sequence_stats(lc, "series", ["t", "pt"], "flux", mean), "step2", "cusum_range", n=4)


@query("W15_phase_fold", f"""WITH {LC_SQL}, {PERIOD_SQL}, f AS (SELECT series, pt, flux, t % period AS ph FROM s JOIN pd USING (series)) SELECT series, pt, {R('ph')} AS phase, {R('flux - lag(flux) OVER (PARTITION BY series ORDER BY ph, pt)')} AS step FROM f""")
def w15(spark, sf):
    from skyloom.operators.skew import OrderedScan, attach

    rows = attach(_lc(spark, sf), _periods(spark, sf), ["series"]).withColumn("phase", F.pmod("t", "period"))
    scan = OrderedScan(rows, ["series"], ["phase", "pt"]).lag({"_p": "flux"}).done()
    return scan.select("series", "pt", r6("phase").alias("phase"), r6(F.col("flux") - F.col("_p")).alias("step"))


@query("C3_shapiro_w")
def c3(spark, sf):
    return rounded(C.shapiro_w(_lc(spark, sf), "series"), "shapiro_w")


# The given series are sparse noise: peaks of a tenth of the production prominence are looked for.
PEAKS = dict(prominence=0.3, distance=5, wlen=60)
GRID_SQL = """u AS (SELECT DISTINCT series, t FROM s), gp AS (SELECT series, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS g FROM u), md AS (SELECT series, median(g) AS g FROM gp WHERE g > 0 GROUP BY series),
sp AS (SELECT series, max(t) - min(t) AS w, min(t) AS t0 FROM s GROUP BY series), mu AS (SELECT series, avg(flux) AS m FROM s GROUP BY series),
gr AS (SELECT series, t0, m, 1 / (5 * w) AS df, CAST(greatest(0, ceil(1 / (2 * g) / (1 / (5 * w))) - 1) AS BIGINT) AS n FROM sp JOIN md USING (series) JOIN mu USING (series) WHERE w > 0)"""


@query("C4_frequency_grid", f"WITH {LC_SQL}, {GRID_SQL} SELECT series, {R('df', 9)} AS df, n AS n_freq FROM gr")
def c4g(spark, sf):
    return rounded(C.frequency_grid(_lc(spark, sf), "series", "t"), "df", n=9)


POWER_SQL = f"""WITH {LC_SQL}, {GRID_SQL},
fr AS (SELECT series, t0, m, j, (j + 1) * df AS frequency FROM gr, LATERAL (SELECT unnest(range(n)) AS j)),
tr AS (SELECT fr.series, j, frequency, flux - m AS f, cos(2 * pi() * frequency * (t - t0)) AS c, sin(2 * pi() * frequency * (t - t0)) AS z FROM fr JOIN s ON s.series = fr.series),
su AS (SELECT series, j, max(frequency) AS frequency, sum(c * c) AS cc, sum(z * z) AS ss, sum(c * z) AS cs, sum(f * c) AS fc, sum(f * z) AS fs FROM tr GROUP BY series, j),
am AS (SELECT *, CASE WHEN cc * ss - cs * cs > 1e-9 * cc * ss THEN cc * ss - cs * cs END AS det FROM su),
pw AS (SELECT series, j, frequency, sqrt(pow((fc * ss - fs * cs) / det, 2) + pow((fs * cc - fc * cs) / det, 2)) AS power FROM am)"""
# Lists per series: heights, their strict local maxima by falling height, those of them that no kept one is near, and their prominences.
PEAK_SQL = POWER_SQL + """,
ls AS (SELECT series, list(coalesce(power / mu, 0) ORDER BY j) AS p, list(power ORDER BY j) AS raw, list(frequency ORDER BY j) AS fq, max(j) AS last, (max(frequency) - min(frequency)) / nullif(max(j), 0) AS step
    FROM pw JOIN (SELECT series, avg(power) AS mu FROM pw GROUP BY series) USING (series) GROUP BY series),
mx AS (SELECT series, i, p[i] AS h FROM (SELECT series, p, unnest(range(2, len(p))) AS i FROM ls) WHERE p[i] > p[i - 1] AND p[i] > p[i + 1]),
kp AS (SELECT series, unnest(list_reduce(list([i] ORDER BY h DESC, i), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < 5)) > 0 THEN a ELSE a || x END)) AS i FROM mx GROUP BY series),
wn AS (SELECT series, i, p, raw, fq, step, coalesce(list_max(list_filter(range(greatest(1, i - 30), i), lambda k: p[k] > p[i])) + 1, greatest(1, i - 30)) AS lo,
    coalesce(list_min(list_filter(range(i + 1, least(len(p), i + 30) + 1), lambda k: p[k] > p[i])) - 1, least(len(p), i + 30)) AS hi FROM kp JOIN ls USING (series)),
pr AS (SELECT series, i, fq[i] AS peak_freq, raw[i] AS peak_power, step, p[i] - greatest(list_min(p[lo:i]), list_min(p[i:hi])) AS prominence FROM wn),
pk AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY prominence DESC, i) AS peak, peak_freq, peak_power, prominence, step FROM pr WHERE prominence >= 3e-1)"""


@query("C4_periodogram", f"{POWER_SQL} SELECT series, j, {R('frequency')} AS frequency, {R('power', 4)} AS power FROM pw")
def c4(spark, sf):
    return rounded(rounded(C.periodogram(_lc(spark, sf), "series", "t", "flux"), "frequency"), "power", n=4)


@query("C4_best_period", f"{PEAK_SQL} SELECT series, {R('1 / peak_freq')} AS period FROM pk WHERE peak = 1")
def c4b(spark, sf):
    return rounded(C.best_peak(C.series_peaks(_lc(spark, sf), "series", "t", "flux", **PEAKS), "series"), "period")


@query("C4_periodogram_peaks", f"""{PEAK_SQL},
fz AS (SELECT series, list_reduce(list([peak_freq] ORDER BY peak), lambda a, x: CASE WHEN len(list_filter(a, lambda y: round_even(x[1] / y, 1) - floor(x[1] / y) <= 3 * step)) > 0 THEN a ELSE a || x END) AS leads
    FROM (SELECT * FROM pk) GROUP BY series, step),
nm AS (SELECT pk.*, leads, list_position(list_transform(leads, lambda y: round_even(peak_freq / y, 1) - floor(peak_freq / y) <= 3 * step), true) AS signal FROM pk JOIN fz USING (series))
SELECT series, peak, {R('peak_freq')} AS peak_freq, {R('peak_power')} AS peak_power, {R('prominence')} AS prominence, CAST(signal AS BIGINT) AS signal_num, CAST(floor(peak_freq / leads[signal]) AS BIGINT) AS harmonic FROM nm""")
def c4p(spark, sf):
    p = C.series_peaks(_lc(spark, sf), "series", "t", "flux", **PEAKS)
    return rounded(C.signals(p, "series"), "peak_freq", "peak_power", "prominence")


@query("C5_fourier_features")
def c5(spark, sf):
    out = C.fourier_features(_lc(spark, sf), "series", _periods(spark, sf))
    return rounded(out, "amplitude", "r21", "r31", "phi21", "phi31", n=4)


@query("C6_folded_features", f"""WITH {LC_SQL}, {PERIOD_SQL}, f AS (SELECT series, pt, flux, t % period AS ph FROM s JOIN pd USING (series)), m AS (SELECT series, avg(flux) AS mu, stddev_pop(flux) AS sd, count(*) AS n FROM s GROUP BY series),
w AS (SELECT f.series, flux - lag(flux) OVER v AS st, ph - lag(ph) OVER v AS dp, sum(flux - mu) OVER v AS cs FROM f JOIN m USING (series) WINDOW v AS (PARTITION BY f.series ORDER BY ph, pt)),
g AS (SELECT series, sum(st * st) AS s2, max(cs) - min(cs) AS rg, quantile_cont(dp / nullif(st, 0), 1e-1) AS p10, quantile_cont(dp / nullif(st, 0), 9e-1) AS p90 FROM w GROUP BY series)
SELECT series, {R('s2 / (n - 1) / (sd * sd)')} AS phase_mean_variance, {R('rg / n / sd')} AS phase_cusum, {R('p10')} AS slope_per10, {R('p90')} AS slope_per90 FROM g JOIN m USING (series)""")
def c6(spark, sf):
    return rounded(C.folded_features(_lc(spark, sf), "series", _periods(spark, sf), "pt"), "phase_mean_variance", "phase_cusum", "slope_per10", "slope_per90")


@query("C9_feature_table")
def c9(spark, sf):
    out = C.feature_table(_lc(spark, sf), "series", "pt", prominence=0.3)
    return rounded(out, *C.FEATURE_NAMES, n=3)


def _labelled(spark, sf):
    """Orders described by four numbers, labelled by status."""
    o = D.table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1000).alias("a"), (F.col("o_custkey") % 97).cast("double").alias("b"), (D.seconds("o_orderdate") / 86400).alias("c"), F.substring("o_orderpriority", 1, 1).cast("double").alias("d"))


@query("C7_random_forest")
def c7(spark, sf):
    data = _labelled(spark, sf)
    train = data.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) < 85)
    model = C.random_forest(train, ["a", "b", "c", "d"], "o_orderstatus", trees=200)
    return C.predict(data, model).select("o_orderkey", "predicted", r6("class_prob", 3).alias("class_prob"))


@query("C7_holdout_report")  # the trees have no SQL twin; tests fit planted classes
def c7h(spark, sf):
    data = _labelled(spark, sf)
    learned = F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) < 85
    model = C.random_forest(data.filter(learned), ["a", "b", "c", "d"], "o_orderstatus", trees=200)
    return rounded(C.class_report(C.predict(data.filter(~learned), model), "o_orderstatus"), "precision", "recall", "f1", "accuracy", n=3)


@query("A26_confusion_matrix", """WITH p AS (SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'P' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS predicted FROM orders), c AS (SELECT o_orderstatus, predicted, count(*) AS n FROM p GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) + 0e0 AS share FROM c""")
def a26(spark, sf):
    p = _guess(spark, sf)
    return rounded(C.confusion(p, "o_orderstatus"), "share")


def _guess(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "P").when(F.col("o_custkey") % 2 == 0, "F").otherwise("O").alias("predicted"))


@query("A26_class_report", """WITH p AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 200000 THEN 'P' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS g FROM orders), r AS (SELECT y AS class, count(*) AS support, count(*) FILTER (y = g) AS hit FROM p GROUP BY y),
q AS (SELECT g AS class, count(*) AS said FROM p GROUP BY g) SELECT class, support, round(hit / said, 6) + 0e0 AS "precision", round(hit / support, 6) + 0e0 AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 6) + 0e0 AS f1,
round((SELECT avg(CASE WHEN y = g THEN 1e0 ELSE 0e0 END) FROM p), 6) + 0e0 AS accuracy FROM r JOIN q USING (class)""")
def a26r(spark, sf):
    return rounded(C.class_report(_guess(spark, sf), "o_orderstatus"), "precision", "recall", "f1", "accuracy")


@query("C8_neighbour_separation", f"""WITH s AS (SELECT source, ra, dec FROM ({D.STARS_SQL})) SELECT source, {R('least(3e0, (SELECT min(sqrt((a.ra - b.ra) * (a.ra - b.ra) + (a.dec - b.dec) * (a.dec - b.dec))) FROM s b WHERE b.source <> a.source))')} AS nn_dist FROM s a""")
def c8(spark, sf):
    return rounded(C.neighbour_separation(D.stars(spark, sf).select("source", "ra", "dec"), "source", ["ra", "dec"], 3.0).select("source", "nn_dist"), "nn_dist")


@query("C8_psf_quality")
def c8q(spark, sf):
    s = C.neighbour_separation(D.stars(spark, sf).select("source", "ra", "dec", "gmag"), "source", ["ra", "dec"], 3.0)
    s = s.withColumns({"log_sep": F.log10(F.col("nn_dist") + 1), "good": F.when((F.col("gmag") < 14) & (F.col("nn_dist") > 1), "good").otherwise("poor")})
    model = C.random_forest(s, ["gmag", "log_sep"], "good", trees=20)
    return C.predict(s, model).select("source", "predicted", r6("class_prob", 3).alias("class_prob"))
