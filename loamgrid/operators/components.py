"""Connected components and patches of label maps.

Tiles are labelled on their own by a numpy kernel, so whatever a component's diameter no round of
joins is spent inside a tile; pixels on tile borders then link tile components across tiles, and
only that small graph is iterated to its components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import cut, discard
from loamgrid.operators.graphs import graph_components
from loamgrid.operators.stencil import diamond, disk, grid_size, spread

_SHIFT = 31
FOUR, EIGHT = [(0, 1), (1, 0)], [(0, 1), (1, 0), (1, 1), (1, -1)]


def _label_tile(pdf: pd.DataFrame, eight: bool) -> np.ndarray:
    """The least pixel id reached within the tile, for each row."""
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    r0, c0 = r.min(), c.min()
    shape = (r.max() - r0 + 3, c.max() - c0 + 3)
    cls, lab = np.full(shape, np.iinfo(np.int64).min), np.full(shape, np.iinfo(np.int64).max)
    at = (r - r0 + 1, c - c0 + 1)
    cls[at] = pdf["cls"].to_numpy()
    lab[at] = (r << _SHIFT) | c
    there = np.zeros(shape, bool)
    there[at] = True
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    inner = (slice(1, -1), slice(1, -1))
    while True:
        before = lab[inner].copy()
        for dr, dc in steps:
            near = (slice(1 + dr, shape[0] - 1 + dr), slice(1 + dc, shape[1] - 1 + dc))
            join = (cls[inner] == cls[near]) & there[near] & there[inner]
            lab[inner] = np.where(join, np.minimum(lab[inner], lab[near]), lab[inner])
        if (before == lab[inner]).all():
            return lab[at]


def components(labels: DataFrame, eight: bool = True, tile: int = 256) -> DataFrame:
    """row, col, cls, patch: patch is the least (row, col) of its component as one long."""
    keyed = labels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("cls").cast("long").alias("cls"))
    keyed = keyed.where("row is not null and col is not null and cls is not null").withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["row", "col", "cls"]].assign(local=_label_tile(pdf, eight))

    local = cut(keyed.groupBy("tr", "tc").applyInPandas(run, "row long, col long, cls long, local long"))
    edge = local.where((F.col("row") % tile == 0) | (F.col("row") % tile == tile - 1) | (F.col("col") % tile == 0) | (F.col("col") % tile == tile - 1))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in (EIGHT if eight else FOUR)))
    sent = edge.select("row", "col", F.col("cls").alias("k"), F.col("local").alias("a"), F.explode(steps).alias("s")).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "k", "a")
    links = sent.join(edge, ["row", "col"]).where("k = cls and a <> local").select("a", F.col("local").alias("b")).distinct()
    comp = graph_components(links)
    return local.join(comp, local["local"] == comp["node"], "left").select("row", "col", "cls", F.coalesce("comp", "local").alias("patch"))


def patches(parts: DataFrame, pixel: float = 1.0) -> DataFrame:
    """One row for each patch: area, perimeter (sides of pixels that face another patch or the
    outside), core (all four neighbours in the patch, outside counting as inside), centroid,
    bounding box, gyration, shape and fractal dimension."""
    size = grid_size(parts)
    four = [k for k in diamond(1) if k[:2] != (0, 0)]
    faced = spread(parts.select("row", "col", F.col("patch").alias("other")), four, reflect=False, size=size)
    same = faced.join(parts, ["row", "col"]).groupBy("row", "col").agg(F.sum((F.col("other") == F.col("patch")).cast("long")).alias("same"), F.count(F.lit(1)).alias("n"))
    p = parts.join(same, ["row", "col"], "left").withColumn("same", F.coalesce("same", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    s = p.groupBy("cls", "patch").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum(4 - F.col("same")).alias("sides"),
        F.sum((F.col("same") == F.col("n")).cast("long")).alias("core_pixels"),
        F.avg("row").alias("row"), F.avg("col").alias("col"),
        F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"),
        F.sqrt(F.var_pop("row") + F.var_pop("col")).alias("gyrate"),
    )
    area, per = F.col("pixels") * pixel * pixel, F.col("sides") * pixel
    return s.select("cls", "patch", "pixels", area.alias("area"), per.alias("perimeter"), (F.col("core_pixels") * pixel * pixel).alias("core"), "row", "col", "top", "bottom", "left", "right", "gyrate", (per / (2 * F.sqrt(F.lit(3.141592653589793) * area))).alias("shape"), F.when(F.col("pixels") > 1, 2 * F.log(F.col("sides") / 4) / F.log(F.col("pixels").cast("double"))).otherwise(0.0).alias("fractal"))


def small_patch_removal(labels: DataFrame, least: int = 9, most: int | None = None, tile: int = 256) -> DataFrame:
    """Pixels of patches outside [least, most] take the class of the nearest pixel that stays
    (ties: the first by row, then column); pixels that find none look in a disk twice as wide."""
    parts = cut(components(labels, True, tile))
    sizes = parts.groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    good = sizes.where((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most)).select("patch")
    kept = cut(parts.join(good, "patch", "left_semi").select("row", "col", "cls"))
    todo = cut(parts.join(good, "patch", "left_anti").select("row", "col", F.col("cls").alias("was")))
    done, reach = kept, 2
    limit = sum(x or 0 for x in (grid_size(parts).first() or (0, 0)))
    while todo.limit(1).count() and kept.limit(1).count():
        # Only pixels without a class look around; most are done with the smallest disk.
        at = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(r * r + c * c).alias("d")) for r, c, _ in disk(reach))))
        asks = todo.select(F.col("row").alias("tr"), F.col("col").alias("tc"), at.alias("o")).select("tr", "tc", (F.col("tr") + F.col("o.r")).alias("row"), (F.col("tc") + F.col("o.c")).alias("col"), "o.d")
        near = asks.join(kept, ["row", "col"]).groupBy("tr", "tc").agg(F.min(F.struct("d", "row", "col", "cls")).alias("x"))
        near = cut(near.select(F.col("tr").alias("row"), F.col("tc").alias("col"), F.col("x.cls").alias("cls")))
        done = done.unionByName(near)
        before, todo = todo, cut(todo.join(near, ["row", "col"], "left_anti"))
        discard(before)
        if reach > limit:
            break
        reach *= 2
    return done.unionByName(todo.select("row", "col", F.col("was").alias("cls")))


def fill_holes(labels: DataFrame, cls: int, most: int = 5, tile: int = 256) -> DataFrame:
    """Holes of a class (4-connected parts of its complement off the border, up to ``most`` pixels)
    take the class."""
    size = grid_size(labels)
    rest = labels.select("row", "col", F.when(F.col("cls") == cls, F.lit(1)).otherwise(F.lit(0)).alias("cls"))
    parts = components(rest.where("cls = 0"), eight=False, tile=tile).join(F.broadcast(size))
    hole = parts.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("h") - 1) | (F.col("col") == F.col("w") - 1)).alias("edge")).where((F.col("n") <= most) & ~F.col("edge"))
    filled = parts.join(hole, "patch", "left_semi").select("row", "col", F.lit(1).alias("hole"))
    return labels.join(filled, ["row", "col"], "left").select("row", "col", F.when(F.col("hole") == 1, F.lit(cls)).otherwise(F.col("cls")).cast("long").alias("cls"))
