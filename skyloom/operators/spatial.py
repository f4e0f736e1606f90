"""Grid-bucket joins: distance joins as equi-joins on cells plus a residual predicate."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.skew import attach, best_per_key

# Refinement factors of the nearest-neighbour search: a dense cell is first searched on a
# grid 32 and 8 times finer, so that only still unmatched positions reach the coarse grid.
NEAREST_LEVELS = (32, 8, 1)


def cell(col: Column | str, size: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(float(size))).cast("long")


def with_cells(df: DataFrame, coords: Sequence[str], size: float, prefix: str = "_k") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": cell(c, size) for i, c in enumerate(coords)})


def with_neighbour_cells(df: DataFrame, coords: Sequence[str], size: float, reach: int = 1, prefix: str = "_k",
                         offsets: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """One row per cell within ``reach`` of the row's own cell."""
    dims = len(coords)
    offs = list(offsets) if offsets is not None else list(itertools.product(range(-reach, reach + 1), repeat=dims))
    table = F.array(*[F.array(*[F.lit(int(o)) for o in off]) for off in offs])
    out = df.withColumn("_off", F.explode(table))
    return out.withColumns(
        {f"{prefix}{i}": cell(c, size) + F.col("_off")[i] for i, c in enumerate(coords)}).drop("_off")


def euclid(pairs: Sequence[tuple[Column, Column]]) -> Column:
    total = None
    for a, b in pairs:
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return F.sqrt(total)


def unit_vector(ra: Column | str, dec: Column | str) -> dict[str, Column]:
    """Cartesian direction of (ra, dec) in degrees; has no seam at RA 0/360 or the poles."""
    r, d = F.radians(ra), F.radians(dec)
    return {"_ux": F.cos(d) * F.cos(r), "_uy": F.cos(d) * F.sin(r), "_uz": F.sin(d)}


def chord(arcsec: float) -> float:
    import math

    return 2 * math.sin(math.radians(arcsec / 3600.0) / 2)


def pairs_within(left: DataFrame, right: DataFrame, left_coords: Sequence[str], right_coords: Sequence[str],
                 radius: float, keys: Sequence[str] = (), dist: str = "dist", strict: bool = False) -> DataFrame:
    """All (left, right) pairs at most ``radius`` apart; columns must not collide except ``keys``.

    The right side is copied to its 3^d neighbour cells, so the left side, assumed larger,
    is shuffled once and never multiplied.
    """
    dims = [f"_k{i}" for i in range(len(left_coords))]
    lhs = with_cells(left, left_coords, radius)
    rhs = with_neighbour_cells(right, right_coords, radius)
    # The planner takes exploded rows for as few as they came from and would broadcast them.
    joined = lhs.join(rhs.hint("merge"), [*keys, *dims])
    d = euclid([(F.col(a), F.col(b)) for a, b in zip(left_coords, right_coords)])
    out = joined.withColumn(dist, d)
    near = F.col(dist) < radius if strict else F.col(dist) <= radius
    return out.filter(near).drop(*dims)


def nearest_within(left: DataFrame, right: DataFrame, left_coords: Sequence[str], right_coords: Sequence[str],
                   right_id: str, radius: float, keys: Sequence[str] = (), dist: str = "dist",
                   levels: Sequence[int] = NEAREST_LEVELS) -> DataFrame:
    """Left rows with the id and distance of their nearest right row, NULL when none.

    Ties go to the smallest id.  Copies of a position on either side are one row while
    searching, and dense areas are resolved on fine grids where few candidates share a cell.
    """
    keys = list(keys)
    lc = [f"_l{i}" for i in range(len(left_coords))]
    rc = [f"_r{i}" for i in range(len(right_coords))]
    base = left.withColumns({n: F.col(c).cast("double") for n, c in zip(lc, left_coords)})
    rpos = (
        right.select(*keys, F.col(right_id).alias("_rid"), *[F.col(c).cast("double").alias(n) for n, c in zip(rc, right_coords)])
        .groupBy(*keys, *rc).agg(F.min("_rid").alias("_rid"))
    )
    sizes = base.groupBy(*keys, *lc).agg(F.count(F.lit(1)).alias("_n"))
    todo = sizes.select(*keys, *lc)
    found = None
    for factor in levels:
        hit = (
            pairs_within(todo, rpos, lc, rc, radius / factor, keys, dist="_d")
            .groupBy(*keys, *lc).agg(F.min(F.struct("_d", "_rid")).alias("_m"))
        )
        found = hit if found is None else found.unionByName(hit)
        if factor != levels[-1]:
            todo = todo.join(hit, [*keys, *lc], "left_anti")
    matched = sizes.join(found, [*keys, *lc], "left").select(
        *keys, *lc, "_n", F.col("_m._rid").alias(right_id), F.col("_m._d").alias(dist))
    return attach(base, matched, [*keys, *lc]).drop(*lc, "_n")


def any_within(left: DataFrame, right: DataFrame, left_coords: Sequence[str], right_coords: Sequence[str],
               radius: float, keys: Sequence[str] = (), negate: bool = False) -> DataFrame:
    """Left rows that have (or, negated, lack) a right row within ``radius``."""
    flagged = nearest_within(left, right.withColumn("_one", F.lit(1)), left_coords, right_coords, "_one", radius,
                             keys, dist="_nd", levels=(4, 1))
    cond = F.col("_one").isNull() if negate else F.col("_one").isNotNull()
    return flagged.filter(cond).drop("_one", "_nd")


def box_candidates(events: DataFrame, points: DataFrame, half: Sequence[tuple[str, Column]],
                   point_coords: Sequence[str], size: float, wrap: dict[int, int] | None = None) -> DataFrame:
    """Pairs whose point lies in a cell touched by the event's box.

    ``half`` lists (event coordinate, half width) per axis; boxes may differ per event, so
    each event is copied to the cells it covers.  ``wrap`` gives the number of cells of a
    periodic axis.  The caller applies its exact predicate to the candidates.
    """
    wrap = wrap or {}
    out = events
    for i, (c, h) in enumerate(half):
        low, high = cell(F.col(c) - h, size), cell(F.col(c) + h, size)
        cells = F.sequence(low, high)
        if i in wrap:
            n = wrap[i]
            cells = F.when(high - low >= n, F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(
                F.array_distinct(F.transform(cells, lambda x: F.pmod(x, F.lit(n).cast("long")))))
        out = out.withColumn(f"_k{i}", F.explode(cells))
    pts = points
    for i, c in enumerate(point_coords):
        k = cell(c, size)
        pts = pts.withColumn(f"_k{i}", F.pmod(k, F.lit(wrap[i]).cast("long")) if i in wrap else k)
    dims = [f"_k{i}" for i in range(len(half))]
    # The planner takes exploded rows for as few as they came from and would broadcast them.
    return out.hint("merge").join(pts, dims).drop(*dims)


__all__ = ["any_within", "best_per_key", "box_candidates", "cell", "chord", "euclid", "nearest_within", "pairs_within",
           "unit_vector", "with_cells", "with_neighbour_cells"]
