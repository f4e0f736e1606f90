"""Greedy thinning of close sources and space-time grouping."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.components import _half_offsets, connected_components, density_groups
from skyloom.operators.skew import attach, group_stats, median_by
from skyloom.operators.spatial import euclid, with_cells, with_neighbour_cells
from skyloom.session import cut_lineage


def dedupe_close(df: DataFrame, row: str, coords: Sequence[str], flux: str, radius: float, keys: Sequence[str] = (), settle_rows: int = 50_000, thin_rounds: int = 4) -> DataFrame:
    """In order of falling flux keep a source unless a kept one lies within ``radius``.

    The sequential rule is settled in rounds.  Cells are so small that each keeps at most one
    source; in a round the brightest open source of a cell is kept when no open source within
    the radius is brighter, and its neighbours drop out.  Only one source per cell is
    compared with the neighbourhood, so dense cells cost a linear scan.  After ``thin_rounds``
    rounds the open cells are grouped into connected neighbourhoods: those of at most
    ``settle_rows`` counted sources are settled in brightness order by one task each, however
    long their chains are; rounds go on for larger ones until none is left.
    """
    keys, dims = list(keys), len(coords)
    cs = [f"_c{i}" for i in range(dims)]
    ks = [f"_k{i}" for i in range(dims)]
    side = radius / math.sqrt(dims) * (1 - 1e-12)
    half = _half_offsets(dims, math.ceil(math.sqrt(dims)) + 1, side, radius)
    every = [tuple([0] * dims), *half, *[tuple(-o for o in off) for off in half]]
    pts = df.select(*keys, F.col(row).alias("_id"), F.struct((-F.col(flux)).alias("f"), F.col(row).alias("r")).alias("_rank"), *[F.col(c).cast("double").alias(n) for n, c in zip(cs, coords)])
    alive = cut_lineage(with_cells(pts, cs, side))
    kept = None
    near = euclid([(F.col(f"_p{i}"), F.col(c)) for i, c in enumerate(cs)]) <= radius
    spread = lambda d: with_neighbour_cells(
        d.select(*keys, F.col("_rank").alias("_prank"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(cs)]), [f"_p{i}" for i in range(dims)], side, offsets=every)
    for turn in itertools.count():
        if alive.isEmpty():
            break
        if turn and turn % thin_rounds == 0:
            alive, settled = _settle_small(alive, keys, ks, cs, every, radius, settle_rows)
            ids = settled.select(F.col("_rank.r").alias(row))
            kept = ids if kept is None else kept.unionByName(ids)
            if alive.isEmpty():
                break
        heads = alive.groupBy(*keys, *ks).agg(F.min(F.struct("_rank", *cs)).alias("_h")).select(*keys, "_h.*")
        rivals = spread(heads).join(alive, [*keys, *ks]).filter(near & (F.col("_rank") < F.col("_prank"))).select("_prank").distinct()
        won = cut_lineage(heads.join(rivals.withColumnRenamed("_prank", "_rank"), "_rank", "left_anti"))
        gone = spread(won).join(alive, [*keys, *ks]).filter(near).select("_id").distinct()
        alive = cut_lineage(alive.join(gone, "_id", "left_anti"))
        ids = won.select(F.col("_rank.r").alias(row))
        kept = ids if kept is None else kept.unionByName(ids)
    return df.join(kept, row, "left_semi") if kept is not None else df


def _settle_small(alive: DataFrame, keys: list[str], ks: list[str], cs: list[str], every: list[tuple[int, ...]], radius: float, settle_rows: int) -> tuple[DataFrame, DataFrame]:
    """(sources of larger neighbourhoods, kept sources of the others)."""
    cells = cut_lineage(alive.groupBy(*keys, *ks).agg(F.min("_id").alias("_cell"), F.count(F.lit(1)).alias("_n")))
    table = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in every if off > tuple([0] * len(ks))])
    moved = cells.withColumn("_off", F.explode(table)).select(*keys, *[(F.col(k) + F.col("_off")[i]).alias(k) for i, k in enumerate(ks)], F.col("_cell").alias("u"))
    links = moved.join(cells.select(*keys, *ks, F.col("_cell").alias("v")), [*keys, *ks]).select("u", "v")
    roots = connected_components(links)
    named = cells.join(roots.select(F.col("node").alias("_cell"), F.col("root").alias("_root")), "_cell", "left").withColumn("_root", F.coalesce("_root", "_cell"))
    sizes = named.groupBy("_root").agg(F.sum("_n").alias("_total"))
    named = named.join(sizes, "_root").select(*keys, *ks, "_root", "_total")
    rows = cut_lineage(alive.join(named, [*keys, *ks]))
    small = rows.filter(F.col("_total") <= settle_rows)
    fields = small.select("_root", "_rank", *cs)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf[cs].to_numpy(float)
        order = sorted(range(len(pdf)), key=lambda i: (pdf["_rank"].iat[i]["f"], pdf["_rank"].iat[i]["r"]))
        taken: dict[tuple, list[int]] = {}
        keep = []
        for i in order:
            home = tuple(np.floor(points[i] / radius).astype(int))
            rivals = [j for off in itertools.product((-1, 0, 1), repeat=len(cs)) for j in taken.get(tuple(h + o for h, o in zip(home, off)), ())]
            if not rivals or (np.sqrt(((points[rivals] - points[i]) ** 2).sum(1)) > radius).all():
                taken.setdefault(home, []).append(i)
                keep.append(i)
        return pdf.iloc[keep][["_root", "_rank"]]

    kept = cut_lineage(fields.groupBy("_root").applyInPandas(settle, fields.select("_root", "_rank").schema))
    return cut_lineage(rows.filter(F.col("_total") > settle_rows).drop("_root", "_total")), kept


def group_space_time(df: DataFrame, row: str, coords: Sequence[str], frame: str | None, eps: float, gap: float, keys: Sequence[str] = (), out: str = "group") -> DataFrame:
    """Group in space and scaled time (single points stand alone), then group the groups' medians in space."""
    if frame is None:
        return density_groups(df, row, coords, eps, 1, keys, out)
    scaled = df.withColumn("_ft", F.col(frame) * (eps / gap))
    first = density_groups(scaled, row, [*coords, "_ft"], eps, 1, keys, "_g").drop("_ft")
    first = cut_lineage(first)
    med = median_by(first, [*keys, "_g"], *coords)
    second = density_groups(med, "_g", coords, eps, 1, keys, "_gg").select("_g", "_gg")
    named = attach(first, second, ["_g"])
    return group_stats(named, ["_gg"], F.min(row).alias(out)).drop("_g", "_gg")
