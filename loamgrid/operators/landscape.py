"""Landscape metrics from a patch table and adjacent pixel pairs; class 0 is background."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.lineage import cut, small


def _real(patches: DataFrame) -> DataFrame:
    return patches.where("cls <> 0")


def adjacent_pairs(labels: DataFrame) -> DataFrame:
    """a, b, n: counts of right and down neighbour pairs by their two classes."""
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    near = labels.select("row", "col", F.col("cls").alias("a"), F.lead("cls").over(by_row).alias("r"), F.lead("cls").over(by_col).alias("d"))
    return near.select("a", F.explode(F.array_compact(F.array("r", "d"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def aggregation_index(labels: DataFrame) -> DataFrame:
    """cls, ai: pairs with both pixels of the class, of those with either, in percent."""
    p = adjacent_pairs(labels)
    sides = p.select(F.col("a").alias("cls"), "n", (F.col("a") == F.col("b")).alias("both")).unionByName(p.where("a <> b").select(F.col("b").alias("cls"), "n", F.lit(False).alias("both")))
    return sides.groupBy("cls").agg((100.0 * F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ai"))


def interspersion(labels: DataFrame) -> DataFrame:
    """Observed kinds of adjacency (own class included) of those possible, in percent."""
    m = labels.where("cls <> 0").agg(F.countDistinct("cls").alias("m"))
    kinds = adjacent_pairs(labels.where("cls <> 0")).agg(F.countDistinct(F.least("a", "b"), F.greatest("a", "b")).alias("k"))
    return kinds.join(F.broadcast(m)).select(F.when(F.col("m") > 1, 100.0 * F.col("k") / (F.col("m") * (F.col("m") + 1) / 2)).otherwise(0.0).alias("iji"))


def diversity(labels: DataFrame) -> DataFrame:
    """Richness, Shannon and Simpson indices and evenness; shares are of all pixels."""
    c = labels.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    s = c.where("cls <> 0").agg(F.count(F.lit(1)).alias("richness"), (-F.sum(F.col("p") * F.log("p"))).alias("shdi"), (1 - F.sum(F.col("p") * F.col("p"))).alias("sidi"))
    many = F.col("richness") > 1
    return s.select("richness", "shdi", "sidi", F.when(many, F.col("shdi") / F.log(F.col("richness").cast("double"))).otherwise(0.0).alias("shei"), F.when(many, F.col("sidi") / (1 - 1 / F.col("richness"))).otherwise(0.0).alias("siei"))


def class_metrics(patches: DataFrame, total_area: DataFrame) -> DataFrame:
    """Per class: NP, CA, PLAND, LPI, TE, ED, LSI, MSI, AWMSI, MPS, PSSD, PSCOV, TCA, CPLAND, DCAD,
    COHESION, DIVISION, SPLIT.  total_area: one row (ta), background included."""
    p = _real(patches).join(F.broadcast(total_area))
    a, ta = F.col("area"), F.max("ta")
    g = p.groupBy("cls").agg(
        F.count(F.lit(1)).alias("np"), F.sum("area").alias("ca"), (100 * F.sum("area") / ta).alias("pland"), (100 * F.max("area") / ta).alias("lpi"),
        F.sum("perimeter").alias("te"), (F.sum("perimeter") / ta).alias("ed"), (F.sum("perimeter") / (2 * F.sqrt(F.lit(math.pi) * F.sum("area")))).alias("lsi"),
        F.avg("shape").alias("msi"), (F.sum(a * F.col("shape")) / F.sum("area")).alias("awmsi"), F.avg("area").alias("mps"), F.stddev_pop("area").alias("pssd"),
        F.sum("core").alias("tca"), (100 * F.sum("core") / ta).alias("cpland"), (F.sum((F.col("core") > 0).cast("long")) / ta).alias("dcad"),
        (1 - F.sum(F.col("perimeter")) / F.sum(F.col("perimeter") * F.sqrt("area"))).alias("z"), F.sum(a * a).alias("a2"), ta.alias("ta"),
    )
    cohesion = F.when(F.col("ta") > 1, 100 * F.col("z") / (1 - 1 / F.sqrt("ta"))).otherwise(0.0)
    return g.select(*(c for c in g.columns if c not in ("z", "a2", "ta")), (100 * F.col("pssd") / F.col("mps")).alias("pscov"), cohesion.alias("cohesion"), (1 - F.col("a2") / (F.col("ta") * F.col("ta"))).alias("division"), (F.col("ta") * F.col("ta") / F.col("a2")).alias("split"))


def landscape_metrics(patches: DataFrame, total_area: DataFrame) -> DataFrame:
    """One row: TA, NP, PD, LPI, TE, ED, MPS, PSSD, PSCOV, PR, PRD, LSI, MSI, AWMSI."""
    p = _real(patches).join(F.broadcast(total_area))
    ta = F.max("ta")
    g = p.agg(
        ta.alias("ta"), F.count(F.lit(1)).alias("np"), (F.count(F.lit(1)) / ta).alias("pd"), (100 * F.max("area") / ta).alias("lpi"), F.sum("perimeter").alias("te"),
        (F.sum("perimeter") / ta).alias("ed"), F.avg("area").alias("mps"), F.stddev_pop("area").alias("pssd"), F.countDistinct("cls").alias("pr"),
        (F.sum("perimeter") / (2 * F.sqrt(F.lit(math.pi) * ta))).alias("lsi"), F.avg("shape").alias("msi"), (F.sum(F.col("area") * F.col("shape")) / F.sum("area")).alias("awmsi"),
    )
    return g.withColumn("pscov", 100 * F.col("pssd") / F.col("mps")).withColumn("prd", F.col("pr") / F.col("ta"))


def near_patches(patches: DataFrame, radius: float, pixel: float = 1.0, same_class: bool = True) -> DataFrame:
    """i, j, d: ordered pairs of patches whose centroids lie within the radius, by grid cells."""
    p = _real(patches).select("patch", "cls", "area", "shape", (F.col("row") * pixel).alias("y"), (F.col("col") * pixel).alias("x"))
    p = p.withColumn("a", F.floor(F.col("y") / radius)).withColumn("b", F.floor(F.col("x") / radius))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = F.explode(F.flatten(F.transform(three, lambda i: F.transform(three, lambda j: F.struct((F.col("a") + i).alias("a"), (F.col("b") + j).alias("b"))))))
    left = p.select(*(F.col(c).alias(f"{c}_i") for c in ("patch", "cls", "area", "shape", "y", "x")), around.alias("k")).select("*", "k.a", "k.b").drop("k")
    d = F.sqrt((F.col("y") - F.col("y_i")) * (F.col("y") - F.col("y_i")) + (F.col("x") - F.col("x_i")) * (F.col("x") - F.col("x_i")))
    met = left.join(p, ["a", "b"]).where("patch <> patch_i").withColumn("d", d).where((F.col("d") <= radius) & (F.col("d") > 0))
    met = met.where("cls = cls_i") if same_class else met
    return met.select(F.col("patch_i").alias("i"), F.col("patch").alias("j"), "d", F.col("area_i"), F.col("area").alias("area_j"), F.col("shape_i"), F.col("shape").alias("shape_j"))


def proximity(patches: DataFrame, radius: float = 1000.0, pixel: float = 1.0) -> DataFrame:
    """patch, prox: sum of area / d2 over patches of the class within the radius."""
    return near_patches(patches, radius, pixel).groupBy(F.col("i").alias("patch")).agg(F.sum(F.col("area_j") / (F.col("d") * F.col("d"))).alias("prox"))


def similarity(patches: DataFrame, block: int = 2048) -> DataFrame:
    """patch, simi: mean over the class's other patches of (area ratio + 1 / (1 + |shape difference|)) / 2.

    Patches of a class that share area and shape are counted, not paired; what differs meets block
    by block, and a block gives one row for each of its kinds, not for each pair.
    """
    kinds = cut(_real(patches).groupBy("cls", "area", "shape").agg(F.count(F.lit(1)).alias("n")))
    sizes = kinds.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"), F.sum("n").alias("all"))
    dealt = kinds.join(F.broadcast(sizes), "cls").withColumn("at", F.pmod(F.xxhash64("area", "shape"), F.col("k")).cast("int"))  # a row for each class
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = dealt.withColumnRenamed("at", "i").withColumn("j", every)
    right = dealt.select(*((F.col(c) + 0).alias(c) for c in ("cls", "area", "shape", "n", "k")), (F.col("at") + 0).alias("j")).withColumn("i", every)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"cls": [], "area": [], "shape": [], "s": []})
        out = np.zeros(len(x))
        a, s, n = (y[c].to_numpy(np.float64) for c in ("area", "shape", "n"))
        for at in range(0, len(x), 256):
            b, t = (x[c].to_numpy(np.float64)[at : at + 256, None] for c in ("area", "shape"))
            one = (np.minimum(a, b) / np.maximum(a, b) + 1 / (1 + np.abs(s - t))) / 2
            out[at : at + 256] = (one * (n - ((a == b) & (s == t)))).sum(1)
        return x[["cls", "area", "shape"]].assign(s=out)

    schema = ", ".join(f"{c} {kinds.schema[c].dataType.simpleString()}" for c in ("cls", "area", "shape")) + ", s double"
    met = left.groupBy("cls", "i", "j").cogroup(right.groupBy("cls", "i", "j")).applyInPandas(run, schema)
    s = met.groupBy("cls", "area", "shape").agg(F.sum("s").alias("s")).join(F.broadcast(sizes.select("cls", (F.col("all") - 1).alias("m"))), "cls")
    return _real(patches).join(s, ["cls", "area", "shape"]).select("patch", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("simi"))


def nearest_distance(patches: DataFrame, radius: float, pixel: float = 1.0) -> DataFrame:
    return near_patches(patches, radius, pixel, same_class=False).groupBy(F.col("i").alias("patch")).agg(F.min("d").alias("nn"))


def structural_edges(patches: DataFrame, limit: float, pixel: float = 1.0, least: float = 0.5) -> DataFrame:
    """a, b, w: patch pairs within ``limit`` with (1 - d / limit) sqrt(ai aj) / max(ai, aj) > least."""
    e = near_patches(patches, limit, pixel, same_class=False).where("i < j")
    w = (1 - F.col("d") / limit) * F.sqrt(F.col("area_i") * F.col("area_j")) / F.greatest("area_i", "area_j")
    return e.select(F.col("i").alias("a"), F.col("j").alias("b"), w.alias("w")).where(F.col("w") > least)


def node_strength(patches: DataFrame, edges: DataFrame) -> DataFrame:
    """patch, degree, strength, importance: mean of the shares of area and strength and the degree
    over possible neighbours."""
    ends = edges.select(F.col("a").alias("patch"), "w").unionByName(edges.select(F.col("b").alias("patch"), "w")).groupBy("patch").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    p = _real(patches).select("patch", "area").join(ends, "patch", "left").select("patch", "area", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    t = p.agg(F.sum("area").alias("ta"), F.sum("strength").alias("ts"), F.count(F.lit(1)).alias("n"))
    imp = (F.col("area") / F.col("ta") + F.when(F.col("ts") > 0, F.col("strength") / F.col("ts")).otherwise(0.0) + F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0)) / 3
    return p.join(F.broadcast(t)).select("patch", "degree", "strength", imp.alias("importance"))


def resistance(labels: DataFrame, classes: DataFrame, default: float = 5.0) -> DataFrame:
    """row, col, r: the class's resistance (class_id, resistance), a default elsewhere."""
    return labels.join(small(classes), labels["cls"] == classes["class_id"], "left").select("row", "col", F.coalesce("resistance", F.lit(default)).alias("r"))


# Wetland metrics. Class ids by role.
WATER, VEGETATION, MUD, DRY = (1, 2), (3,), (4,), (5, 6)


def wetland_summary(labels: DataFrame) -> DataFrame:
    """Water, vegetation and mudflat areas, their share, and the number of wetland types present."""
    role = lambda ids: F.sum(F.col("cls").isin(*ids).cast("long"))
    s = labels.agg(role(WATER).alias("water"), role(VEGETATION).alias("vegetation"), role(MUD).alias("mudflat"), F.count(F.lit(1)).alias("n"))
    kinds = (F.col("water") > 0).cast("long") + (F.col("vegetation") > 0).cast("long") + (F.col("mudflat") > 0).cast("long")
    return s.withColumn("wetland_share", (F.col("water") + F.col("vegetation") + F.col("mudflat")) / F.col("n")).withColumn("types", kinds)


def wetland_patches(labels: DataFrame, tile: int = 256) -> DataFrame:
    """Largest water component over water area (connectivity), and 1 - (largest / total)^2 of
    wetland components (fragmentation)."""
    from loamgrid.operators.components import components

    def sizes(ids: tuple[int, ...]) -> DataFrame:
        m = labels.where(F.col("cls").isin(*ids)).select("row", "col", F.lit(1).alias("cls"))
        return components(m, True, tile).groupBy("patch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("t"))

    w = sizes(WATER).select(F.coalesce(F.col("m") / F.col("t"), F.lit(0.0)).alias("water_connectivity"))
    f = sizes(WATER + VEGETATION + MUD).select(F.coalesce(1 - F.pow(F.col("m") / F.col("t"), F.lit(2.0)), F.lit(1.0)).alias("fragmentation"))
    return w.join(F.broadcast(f))


def rim(labels: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    """Pixels outside the classes with a four-neighbour inside."""
    from loamgrid.operators.stencil import diamond, grid_size, present, spread

    inside = labels.where(F.col("cls").isin(*ids)).select("row", "col")
    near = spread(inside, [k for k in diamond(1) if k[:2] != (0, 0)], reflect=False, size=grid_size(labels)).select("row", "col").distinct()
    return present(near, labels).join(inside, ["row", "col"], "left_anti")


def ecotone_index(labels: DataFrame) -> DataFrame:
    """Pixels on the rims of both water and dry land over the sum of both rims."""
    a, b = rim(labels, WATER), rim(labels, DRY)
    counts = a.agg(F.count(F.lit(1)).alias("na")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("nb")))).join(F.broadcast(a.intersect(b).agg(F.count(F.lit(1)).alias("nc"))))
    return counts.select(F.when(F.col("na") + F.col("nb") > 0, F.col("nc") / (F.col("na") + F.col("nb"))).otherwise(0.0).alias("ecotone"))
