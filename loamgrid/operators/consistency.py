"""Spatial consistency of label maps against ecological rules, given as tables by class id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import small
from loamgrid.operators import components as K
from loamgrid.operators import stencil as S


def adjacency_violations(labels: DataFrame, allowed: DataFrame) -> DataFrame:
    """row, col, cls, other: four-neighbour pairs that the table (cls, other) doesn't allow.

    Only classes that have rules are checked; a class is always allowed beside itself.
    """
    four = [k for k in S.diamond(1) if k[:2] != (0, 0)]
    near = S.spread(labels.withColumnRenamed("cls", "other"), four, reflect=False, size=S.grid_size(labels)).join(labels, ["row", "col"]).where("cls <> other")
    ruled = near.join(small(allowed.select("cls").distinct()), "cls", "left_semi")
    return ruled.join(small(allowed), ["cls", "other"], "left_anti").select("row", "col", "cls", "other")


def isolated_clusters(labels: DataFrame, least: DataFrame, tile: int = 256) -> DataFrame:
    """patch, cls, n: four-connected clusters under their class's minimum (cls, least)."""
    n = K.components(labels, eight=False, tile=tile).groupBy("patch", "cls").agg(F.count(F.lit(1)).alias("n"))
    return n.join(small(least), "cls").where("n < least").select("patch", "cls", "n")


def terrain_violations(labels: DataFrame, terrain: DataFrame, limits: DataFrame) -> DataFrame:
    """row, col, cls, kind: pixels whose slope or elevation is beyond their class's limits
    (cls, max_slope, min_dem, max_dem; null: no limit)."""
    j = labels.join(terrain, ["row", "col"]).join(small(limits), "cls")
    kind = F.when(F.col("slope") > F.col("max_slope"), "slope").when(F.col("dem") < F.col("min_dem"), "low").when(F.col("dem") > F.col("max_dem"), "high")
    return j.withColumn("kind", kind).where("kind is not null").select("row", "col", "cls", "kind")


def score(labels: DataFrame, adjacency: DataFrame, isolated: DataFrame, size: int = 3) -> DataFrame:
    """Mean homogeneity times the shares of pixels without adjacency and isolation findings."""
    h = S.homogeneity(labels, size).agg(F.avg("homogeneity").alias("homogeneity"), F.count(F.lit(1)).alias("n"))
    a, i = adjacency.agg(F.count(F.lit(1)).alias("a")), isolated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("i"))
    return h.join(F.broadcast(a)).join(F.broadcast(i)).withColumn("score", F.col("homogeneity") * (1 - F.col("a") / F.col("n")) * (1 - F.col("i") / F.col("n")))


def neighbourhood_majority(labels: DataFrame, size: int = 3, homogeneous: float = 0.5, share: float = 0.6) -> DataFrame:
    """Pixels of little homogeneity take the window's majority where its share is large enough."""
    low = S.homogeneity(labels, size).where(F.col("homogeneity") < homogeneous).select("row", "col")
    voted = S.majority_filter(labels, size, share).join(low, ["row", "col"], "left_semi").withColumnRenamed("cls", "new")
    return labels.join(voted, ["row", "col"], "left").select("row", "col", F.coalesce("new", "cls").alias("cls"))


def quality(before: DataFrame, after: DataFrame, tile: int = 256) -> DataFrame:
    """One row: changed share, and patches and boundary pairs before and after a clean-up."""
    from loamgrid.operators.landscape import adjacent_pairs
    from loamgrid.plans.analysis import change_statistics

    n = lambda m, name: K.components(m, eight=False, tile=tile).agg(F.countDistinct("patch").alias(name))
    b = lambda m, name: adjacent_pairs(m).agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))), F.lit(0)).alias(name))
    out = change_statistics(before, after)
    for part in (n(before, "patches_before"), n(after, "patches_after"), b(before, "boundary_before"), b(after, "boundary_after")):
        out = out.join(F.broadcast(part))
    return out


def grade(value: Column, names: tuple[str, ...] = ("excellent", "good", "fair", "poor", "very poor")) -> Column:
    """Five bands of a 0..1 score at .8, .6, .4 and .2."""
    out = F.when(value >= 0.8, names[0])
    for limit, name in zip((0.6, 0.4, 0.2), names[1:4], strict=True):
        out = out.when(value >= limit, name)
    return out.otherwise(names[4])


def health(indicators: DataFrame) -> DataFrame:
    """(name, value) indicators to one row: their mean, its grade, names under .5, and the three
    lowest under .6 to improve first."""
    low = F.array_sort(F.collect_list(F.when(F.col("value") < 0.6, F.struct("value", "name"))))
    s = indicators.agg(F.avg("value").alias("health"), F.array_sort(F.collect_list(F.when(F.col("value") < 0.5, F.col("name")))).alias("issues"), low.alias("low"))
    return s.select("health", grade(F.col("health")).alias("grade"), "issues", F.transform(F.slice("low", 1, 3), lambda x: x["name"]).alias("first"))
