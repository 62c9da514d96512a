"""Regions of label maps and surfaces: distances inside, watersheds, merging and splitting, pruning.

A region may hold a third of all pixels, so none is ever one task's work: distances are found by
tiles with a margin, basins by pointers that jump, merges by the components of a region graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.lineage import cut, discard
from loamgrid.operators.components import components
from loamgrid.operators.graphs import graph_components
from loamgrid.operators.stencil import LAPLACE, box, grid_size, spread

_EIGHT = [k for k in box(3) if k[:2] != (0, 0)]
_SHIFT = 31


def place(row: str = "row", col: str = "col") -> Column:
    """A pixel's number: its row and column in one long."""
    return F.shiftleft(F.col(row).cast("long"), _SHIFT).bitwiseOR(F.col(col).cast("long"))


def _distances(region: np.ndarray, reach: int) -> np.ndarray:
    """Distance of every place to the nearest of another region, at most ``reach``."""
    up = np.full(region.shape, reach, float)
    for d in range(reach, 0, -1):
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            up[a] = np.where(region[a] != region[b], d, up[a])
    best = np.minimum(up * up, float(reach * reach))
    for d in range(1, reach + 1):
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            side = np.where(region[:, a] == region[:, b], up[:, b] ** 2, 0.0) + d * d
            best[:, a] = np.minimum(best[:, a], side)
    return np.sqrt(best)


def inner_distance(regions: DataFrame, reach: int = 16, tile: int = 256) -> DataFrame:
    """row, col, region, d: distance of each pixel to the nearest pixel of another region (or outside
    the map's pixels, where the map has gaps), at most ``reach``; the map's own edge is no border."""
    size = grid_size(regions)
    span = lambda x: F.sequence(F.floor((F.col(x) - reach) / tile), F.floor((F.col(x) + reach) / tile))
    sent = regions.select("row", "col", "region").withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col"))).join(F.broadcast(size))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = max(0, key[0] * tile - reach), max(0, key[1] * tile - reach)
        r1, c1 = min(int(pdf["h"].iloc[0]), (key[0] + 1) * tile + reach), min(int(pdf["w"].iloc[0]), (key[1] + 1) * tile + reach)
        a = np.full((r1 - r0, c1 - c0), np.iinfo(np.int64).min)
        at = ((pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy())
        a[at] = pdf["region"]
        own = (pdf["row"] // tile == key[0]) & (pdf["col"] // tile == key[1])
        return pdf.loc[own, ["row", "col", "region"]].assign(d=_distances(a, reach)[at][own.to_numpy()])

    return sent.groupBy("tr", "tc").applyInPandas(run, "row long, col long, region long, d double")


def basins(surface: DataFrame) -> DataFrame:
    """row, col, basin of a surface (row, col, region, v): each pixel runs to its highest neighbour of
    the region until none is higher (ties to the smaller place); basin is the place where it ends.

    Pointers jump to their pointer's pointer, so rounds grow with the logarithm of the longest run.
    """
    me = cut(surface.select("row", "col", "region", "v", place().alias("at")))
    near = spread(me.select("row", "col", F.col("region").alias("r"), F.col("v").alias("u"), F.col("at").alias("to")), _EIGHT, reflect=False, size=grid_size(me))
    best = near.join(me, ["row", "col"]).where("r = region and (u > v or (u = v and to < at))").groupBy("at").agg(F.min(F.struct((-F.col("u")).alias("u"), "to")).alias("x"))
    runs = cut(me.join(best, "at", "left").select("at", F.coalesce("x.to", "at").alias("to")))
    while True:
        jumped = cut(runs.join(runs.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to"), F.col("to").alias("was")))
        moved = jumped.where("to <> was").limit(1).count()
        discard(runs)
        runs = jumped
        if not moved:
            return me.join(runs.select("at", F.col("to").alias("basin")), "at").select("row", "col", "basin")


def watershed_features(grid: DataFrame, size: int = 5) -> DataFrame:
    """row, col, density, mean_size, boundary of the basins of low gradient of (row, col, v): basins for
    each pixel, pixels for each basin, and the share of boundary pixels in a window."""
    from loamgrid.operators.stencil import local, sobel

    slope = sobel(grid).select("row", "col", F.lit(0).cast("long").alias("region"), (-F.round("magnitude", 9)).alias("v"))
    b = cut(basins(slope))
    s = b.agg(F.countDistinct("basin").alias("k"), F.count(F.lit(1)).alias("n"))
    around = spread(b.withColumnRenamed("basin", "other"), [(r, c, 1.0) for r, c, _ in LAPLACE if (r, c) != (0, 0)], reflect=False, size=grid_size(b))
    edge = around.join(b, ["row", "col"]).groupBy("row", "col").agg(F.max((F.col("other") != F.col("basin")).cast("double")).alias("v"))
    return local(edge, box(size), F.avg("v").alias("boundary")).join(F.broadcast(s)).select("row", "col", (F.col("k") / F.col("n")).alias("density"), (F.col("n") / F.col("k")).alias("mean_size"), "boundary")


def class_means(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """cls, n, mean, std of a feature (row, col, v) over each class."""
    return labels.join(grid, ["row", "col"]).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def region_table(parts: DataFrame, grid: DataFrame) -> DataFrame:
    """patch, cls, n, mean, std of a feature over each patch."""
    return parts.join(grid, ["row", "col"]).groupBy("patch", "cls").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def region_graph(parts: DataFrame) -> DataFrame:
    """a, b, length: patches that share sides, a < b, and how many."""
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    next_to = lambda w, axis: F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead("patch").over(w))
    near = parts.select("patch", next_to(by_row, "col").alias("r"), next_to(by_col, "row").alias("d"))
    pairs = near.select("patch", F.explode(F.array_compact(F.array("r", "d"))).alias("o")).where("patch <> o")
    return pairs.groupBy(F.least("patch", "o").alias("a"), F.greatest("patch", "o").alias("b")).agg(F.count(F.lit(1)).alias("length"))


def merge_similar(labels: DataFrame, grid: DataFrame, limit: float, tile: int = 256) -> DataFrame:
    """Touching patches whose means of a feature differ by at most ``limit`` become one region, which
    takes the class of its largest patch (ties: the smallest patch); chains merge as a whole."""
    parts = cut(components(labels, eight=False, tile=tile))
    table = cut(region_table(parts, grid))
    mean = lambda c: table.select(F.col("patch").alias(c), F.col("mean").alias(f"m{c}"))
    links = region_graph(parts).join(mean("a"), "a").join(mean("b"), "b").where(F.abs(F.col("ma") - F.col("mb")) <= limit).select("a", "b")
    comp = graph_components(links)
    named = table.join(comp.select(F.col("node").alias("patch"), "comp"), "patch", "left").withColumn("comp", F.coalesce("comp", "patch"))
    top = named.groupBy("comp").agg(F.min(F.struct((-F.col("n")).alias("o"), "patch", "cls")).alias("x")).select("comp", F.col("x.cls").alias("new"))
    chosen = named.join(top, "comp").select("patch", "new")
    return parts.join(chosen, "patch", "left").select("row", "col", F.coalesce("new", "cls").alias("cls"))


def split_uneven(labels: DataFrame, grid: DataFrame, limit: float, reach: int = 16, tile: int = 256) -> DataFrame:
    """row, col, cls, region: patches whose feature spreads by more than ``limit`` fall apart along
    the waists of their shape (basins of the distance inside); others stay whole."""
    parts = cut(components(labels, eight=False, tile=tile))
    uneven = region_table(parts, grid).where(F.col("std") > limit).select("patch")
    inside = inner_distance(parts.select("row", "col", F.col("patch").alias("region")), reach, tile).withColumnRenamed("d", "v")
    b = basins(inside.join(uneven.withColumnRenamed("patch", "region"), "region", "left_semi"))
    return parts.join(b, ["row", "col"], "left").select("row", "col", "cls", F.coalesce("basin", "patch").alias("region"))


def prune(skeleton: DataFrame, least: int) -> DataFrame:
    """A skeleton (row, col, v) without branches of fewer than ``least`` pixels: ends are worn off
    ``least`` times, and what is left grows back along the pixels its ends lost."""
    size = grid_size(skeleton)
    on = cut(skeleton.where("v = 1").select("row", "col"))
    whole = on

    def ends(points: DataFrame) -> DataFrame:
        n = spread(points, _EIGHT, reflect=False, size=size).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
        return points.join(n, ["row", "col"], "left").where("coalesce(n, 0) <= 1").select("row", "col")

    for _ in range(least):
        on = cut(on.join(ends(on), ["row", "col"], "left_anti"))
    front = cut(ends(on))
    for _ in range(least):
        grown = spread(front, _EIGHT, reflect=False, size=size).select("row", "col").distinct()
        front = cut(grown.join(whole, ["row", "col"], "left_semi").join(on, ["row", "col"], "left_anti"))
        on = cut(on.unionByName(front))
    return skeleton.join(on.withColumn("k", F.lit(1)), ["row", "col"], "left").select("row", "col", F.coalesce("k", F.lit(0)).cast("long").alias("v"))


def nearest_class(values: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, col, v) to the class (cls) nearest in value, the lower on ties; classes are a row each."""
    ordered = classes.agg(F.array_sort(F.collect_set("cls")).alias("k"))
    best = F.array_min(F.transform("k", lambda c: F.struct(F.round(F.abs(F.col("v") - c), 9).alias("d"), c.alias("c"))))["c"]
    return values.join(F.broadcast(ordered)).select("row", "col", best.alias("cls"))


def bilateral_filter(labels: DataFrame, sigma_color: float = 0.1, sigma_space: float = 1.0, size: int = 5) -> DataFrame:
    """Labels scaled to 0..1 and averaged over a window by nearness in space and in value, then set
    back to the nearest class."""
    s = labels.agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    scaled = labels.join(F.broadcast(s)).select("row", "col", F.when(F.col("hi") > F.col("lo"), (F.col("cls") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("v"))
    kernel = [(r, c, float(np.exp(-(r * r + c * c) / (2 * sigma_space**2)))) for r, c, _ in box(size)]
    around = spread(scaled.withColumnRenamed("v", "u"), kernel, reflect=False, size=grid_size(labels)).join(scaled, ["row", "col"])
    w = F.col("k") * F.exp(-(F.col("u") - F.col("v")) * (F.col("u") - F.col("v")) / (2 * sigma_color**2))
    smooth = around.groupBy("row", "col").agg((F.sum(w * F.col("u")) / F.sum(w)).alias("v")).join(F.broadcast(s)).select("row", "col", (F.col("lo") + F.col("v") * (F.col("hi") - F.col("lo"))).alias("v"))
    return nearest_class(smooth, labels.select("cls").distinct())


def edge_resistance(resistance: DataFrame, labels: DataFrame, habitat: tuple[int, ...], reach: int = 3, factor: float = 1.5) -> DataFrame:
    """(row, col, r) with habitat pixels raised by ``factor`` that lie within ``reach`` of another class."""
    near = [(r, c, 1.0) for r, c, _ in box(2 * reach + 1) if 0 < r * r + c * c <= reach * reach]
    mine = labels.where(F.col("cls").isin(*habitat))
    around = spread(labels.withColumnRenamed("cls", "o"), near, reflect=False, size=grid_size(labels)).join(mine, ["row", "col"])
    edge = around.where("o <> cls").select("row", "col").distinct().withColumn("e", F.lit(factor))
    return resistance.join(edge, ["row", "col"], "left").select("row", "col", (F.col("r") * F.coalesce("e", F.lit(1.0))).alias("r"))


def smooth_resistance(resistance: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(row, col, r) under a Gaussian with mirrored edges."""
    from loamgrid.operators.stencil import gaussian, local

    return local(resistance.withColumnRenamed("r", "v"), gaussian(sigma), F.sum(F.col("k") * F.col("v")).alias("r"))
