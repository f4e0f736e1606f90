"""Queries: coarse field prediction and the user-function surface."""

import pandas as pd
from pyspark.sql import functions as F

from skyloom.functions import numeric as N
from skyloom.functions import orbits as O
from skyloom.functions import photometry as P
from skyloom.functions import wcs as Wc
from skyloom.operators import robust as Rb
from skyloom.plans import fixtures as D
from skyloom.plans.fixtures import R, r6
from skyloom.plans.q_functions import orbit_table
from skyloom.plans.registry import query


@query("P19_field_candidates")
def p19(spark, sf):
    epochs = D.table(spark, sf, "region").select((F.lit(60000.0) + F.col("r_regionkey") * 7).alias("mjd")).withColumns({"ox": F.cos(F.col("mjd") / 58.13), "oy": F.sin(F.col("mjd") / 58.13), "oz": F.lit(0.0)})
    return O.field_candidates(orbit_table(spark, sf), epochs, (1.0, 0.0, 0.0), 20.0, 5.0, 2.0)


@query("P20_expected_magnitude_trails", f"""WITH t AS (SELECT designation, t, x * 40e0 AS px, y * 60e0 AS py, 15e0 + designation % 5 AS h FROM ({D.TRACKS_SQL})),
g AS (SELECT *, floor((px - 44) * 4 / 2048) AS cx, floor(py * 4 / 2048) AS cy, h + 5 * log10(2e0 * 12e-1) - 25e-1 * log10(greatest(1e-10, 85e-2 * exp(-333e-2 * pow(tan(radians(12e0) / 2), 63e-2)) + 15e-2 * exp(-187e-2 * pow(tan(radians(12e0) / 2), 122e-2)))) AS mag FROM t)
SELECT designation, CAST(cy * 4 + cx + 1 AS BIGINT) AS tile, count(*) AS n, {R('min(t)')} AS t_first, {R('max(t)')} AS t_last, {R('avg(mag)')} AS mag_expected FROM g WHERE cx BETWEEN 0 AND 3 AND cy BETWEEN 0 AND 3 GROUP BY 1, 2""")
def p20(spark, sf):
    t = D.tracks(spark, sf).select("designation", "t", (F.col("x") * 40).alias("px"), (F.col("y") * 60).alias("py"), (15 + F.col("designation") % 5).alias("h"))
    mag = P.hg_magnitude("h", F.lit(None).cast("double"), F.lit(2.0), F.lit(1.2), F.lit(12.0))
    t = t.withColumns({"tile": Wc.tile_of("px", "py", 4), "mag": mag}).filter("tile IS NOT NULL")
    return t.groupBy("designation", "tile").agg(F.count(F.lit(1)).alias("n"), r6(F.min("t")).alias("t_first"), r6(F.max("t")).alias("t_last"), r6(F.avg("mag")).alias("mag_expected"))


@query("U1_group_worker", f"SELECT vec_id, {R('max(v) - min(v)')} AS span FROM ({D.PIXELS_SQL}) GROUP BY vec_id")
def u1(spark, sf):
    def worker(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], float(pdf["v"].max() - pdf["v"].min())]])

    # A stamp's 64 pixels are one group.
    out = D.pixels(spark, sf).select("vec_id", "v").groupBy("vec_id").applyInPandas(worker, "vec_id long, span double")
    return out.withColumn("span", r6("span"))


@query("U2_curve_function", f"SELECT pt, {R('sqrt(pow(5e-1 * pow(qty, -3e-1), 2) + 1e-2)')} AS err FROM ({D.SERIES_SQL})")
def u2(spark, sf):
    # Curves are plain functions from columns to a column, passed as parameters.
    curve = lambda snr: N.snr_error(snr, 0.5, 0.3, 0.1)
    return D.series(spark, sf).select("pt", r6(curve("qty")).alias("err"))


@query("U3_weighted_group_stats", f"SELECT series, {R('sum(qty * flux) / sum(qty)')} AS flux FROM ({D.SERIES_SQL}) GROUP BY series")
def u3(spark, sf):
    out = Rb.weighted_stats(D.series(spark, sf).select("series", "qty", "flux"), "series", "qty", ["flux"])
    return out.select("series", r6("flux").alias("flux"))


@query("U4_one_to_many", f"SELECT eventkey, unnest(generate_series(CAST(floor(mjd_start) AS BIGINT), CAST(floor(mjd_end) AS BIGINT))) AS day FROM ({D.DETECTIONS_SQL})")
def u4(spark, sf):
    d = D.detections(spark, sf)
    return d.select("eventkey", F.explode(F.sequence(F.floor("mjd_start"), F.floor("mjd_end"))).alias("day"))
