"""Two-body sky positions and reachability of orbits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.angles import _c

NEWTON_STEPS = 10


def latitude_reachable(inclination, target_latitude, margin: float = 1.0) -> Column:
    """An orbit never leaves its inclination band."""
    return _c(inclination) + margin >= F.abs(_c(target_latitude))


def brightness_reachable(a, e, h, limit: float = 20.8) -> Column:
    """Best-case magnitude at perihelion; unknown H stays in."""
    q = _c(a) * (1 - _c(e))
    best = _c(h) + 5 * F.log10(q * F.greatest(q - 1.0, F.lit(0.1)))
    return _c(h).isNull() | (best <= limit)


def ecliptic_directions(df: DataFrame, mjd: str, epoch: str, observer: tuple[str, str, str], a: str, e: str, inc: str,
                        node: str, peri: str, anomaly: str, motion: str) -> DataFrame:
    """Unit vectors (ux, uy, uz) from the observer to each orbit at ``mjd``.

    The fixed number of Newton steps for Kepler's equation runs inside ``aggregate``, whose
    bound variables keep the expression small wherever the optimizer moves it.
    """
    two_pi = 2 * math.pi
    ecc_col = F.col(e)
    mean = F.pmod(F.radians(F.col(anomaly)) + F.radians(F.col(motion)) * (F.col(mjd) - F.col(epoch)), F.lit(two_pi))

    def step(acc: Column, m: Column) -> Column:
        return acc - (acc - ecc_col * F.sin(acc) - m) / (1 - ecc_col * F.cos(acc))

    def position(x: Column) -> Column:
        arg = F.radians(F.col(peri)) + 2 * F.atan2(F.sqrt(1 + ecc_col) * F.sin(x / 2), F.sqrt(1 - ecc_col) * F.cos(x / 2))
        lon, tilt = F.radians(F.col(node)), F.radians(F.col(inc))
        r = F.col(a) * (1 - ecc_col * F.cos(x))
        return F.struct(
            (r * (F.cos(lon) * F.cos(arg) - F.sin(lon) * F.sin(arg) * F.cos(tilt)) - F.col(observer[0])).alias("x"),
            (r * (F.sin(lon) * F.cos(arg) + F.cos(lon) * F.sin(arg) * F.cos(tilt)) - F.col(observer[1])).alias("y"),
            (r * F.sin(arg) * F.sin(tilt) - F.col(observer[2])).alias("z"))

    solved = F.aggregate(F.array_repeat(mean, NEWTON_STEPS), mean, step, position)
    unit = F.transform(F.array(solved), lambda v: F.struct(*[
        (v[c] / F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])).alias("u" + c) for c in "xyz"]))
    out = df.withColumn("_dir", F.element_at(unit, 1))
    return out.withColumns({c: F.col("_dir")[c] for c in ("ux", "uy", "uz")}).drop("_dir")


def field_candidates(orbits: DataFrame, epochs: DataFrame, field: tuple[float, float, float], radius_deg: float, motion_deg: float, latitude_deg: float, limit: float = 20.8) -> DataFrame:
    """Orbits that can reach a field: cheap orbit tests first, then any sample epoch within radius + motion.

    ``epochs`` holds the few sample times with the observer's position (mjd, ox, oy, oz); they are
    read as one array, so each surviving orbit is expanded to its own samples.
    """
    cheap = orbits.filter(latitude_reachable("inc", latitude_deg) & brightness_reachable("a", "e", "h", limit))
    samples = epochs.agg(F.collect_list(F.struct("mjd", "ox", "oy", "oz")).alias("_s"))  # sampling step bounds the list
    each = cheap.crossJoin(F.broadcast(samples)).withColumn("_e", F.explode("_s")).select(*cheap.columns, "_e.*")
    v = ecliptic_directions(each, "mjd", "epoch", ("ox", "oy", "oz"), "a", "e", "inc", "node", "peri", "anomaly", "motion")
    cosine = F.col("ux") * field[0] + F.col("uy") * field[1] + F.col("uz") * field[2]
    return v.filter(cosine >= math.cos(math.radians(radius_deg + motion_deg))).groupBy("orbit").agg(F.count(F.lit(1)).alias("n_epochs"))
