"""Landscapes judged and compared over dates: scores from metrics, trends, drivers of change, advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import cut
from loamgrid.operators import landscape as L
from loamgrid.operators.components import components, patches
from loamgrid.operators.consistency import grade
from loamgrid.operators.temporal import trend

#: What the five bands of a score mean, from .8 down.
INTEGRITY = ("structure is sound", "slightly fragmented", "moderately fragmented", "severely fragmented", "highly fragmented")
CONNECTIVITY = ("corridors are open", "mostly connected", "some barriers", "high resistance", "isolated")
HEALTH = ("healthy", "nearly healthy", "fair", "unhealthy", "very unhealthy")
#: The issue of an indicator under .5, and the advice for one under .6.
ISSUES = {"structural_health": "fragmented landscape structure", "functional_health": "lacking functional connectivity", "water_connectivity": "poor water connectivity", "fragmentation_resistance": "fragmented wetlands"}
PRIORITIES = {"structural_health": "restore the landscape's structure", "functional_health": "build corridors", "water_connectivity": "reconnect the water system", "fragmentation_resistance": "join habitats that are cut apart"}


def metrics_of(labels: DataFrame, pixel: float = 1.0, tile: int = 256) -> DataFrame:
    """One row of landscape metrics with diversity and the wetland's shares of one map (row, col, cls)."""
    m = cut(labels.select("row", "col", "cls"))
    area = m.agg((F.count(F.lit(1)) * pixel * pixel).alias("ta"))
    out = L.landscape_metrics(patches(components(m, tile=tile), pixel), area)
    for part in (L.diversity(m).select("shdi"), L.wetland_summary(m).drop("n"), L.wetland_patches(m, tile)):
        out = out.join(F.broadcast(part))
    return out


def integrity(metrics: DataFrame) -> DataFrame:
    """Adds the parts of the integrity score and its mean: patch density, largest patch, shape, diversity."""
    parts = {
        "patch_density_score": 1 - F.least(F.col("pd") / 10, F.lit(1.0)),
        "largest_patch_score": F.col("lpi") / 100,
        "shape_score": 1 - F.col("lsi"),
        "diversity_score": F.least(F.col("shdi") / 2, F.lit(1.0)),
    }
    m = metrics.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()})
    return m.withColumn("integrity_score", sum((F.col(k) for k in parts), F.lit(0.0)) / len(parts))


def connectance(patch_table: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: joined pairs of patches over all pairs."""
    n = patch_table.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("e"))))
    return n.select(F.when(F.col("n") > 1, 2.0 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("connectance"))


def mean_functional(edges: DataFrame) -> DataFrame:
    """One row: the mean weight of functional edges (w), 0 without any."""
    return edges.agg(F.coalesce(F.avg("w"), F.lit(0.0)).alias("functional"))


def synthesis(metrics: DataFrame, connect: DataFrame | None = None) -> DataFrame:
    """Integrity, connectivity (of connectance and functional, where given) and health with their words."""
    m = integrity(metrics)
    if connect is not None:
        m = m.join(F.broadcast(connect)).withColumn("connectivity_score", (F.col("connectance") + F.col("functional")) / 2)
        m = m.withColumn("connectivity_words", grade(F.col("connectivity_score"), CONNECTIVITY)).withColumn("health_score", (F.col("integrity_score") + F.col("connectivity_score")) / 2)
    else:
        m = m.withColumn("health_score", F.col("integrity_score"))
    return m.withColumn("integrity_words", grade(F.col("integrity_score"), INTEGRITY)).withColumn("health_words", grade(F.col("health_score"), HEALTH))


def advice(row: DataFrame, keystones: int = 0) -> DataFrame:
    """Adds ``advice`` to a synthesis."""
    low = lambda c, limit: F.col(c) < limit if c in row.columns else F.lit(False)
    found = F.array_compact(F.array(
        F.when(low("health_score", 0.6), "protect the ecosystem"), F.when(low("health_score", 0.6), "restore degraded wetlands"),
        F.when(low("connectivity_score", 0.5), "build corridors"), F.when(low("connectivity_score", 0.5), "reduce barriers"),
        F.when(F.lit(keystones > 0), f"protect {keystones} keystone patches"),
    ))
    return row.withColumn("advice", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("keep the present state"), F.lit("monitor in the long term"))))


def wetland_functions(labels: DataFrame, shdi: DataFrame | None = None, connectivity: Column | None = None) -> DataFrame:
    """One row: six functions of a wetland as capped shares; climate by connectivity where known."""
    share = lambda *ids: F.avg(F.col("cls").isin(*ids).cast("double"))
    s = labels.agg(share(*L.WATER).alias("water"), share(*L.VEGETATION).alias("vegetation"), share(*L.WATER, *L.VEGETATION, *L.MUD).alias("wetland"))
    s = s.join(F.broadcast(L.diversity(labels).select("shdi") if shdi is None else shdi))
    cap = lambda c: F.least(c, F.lit(1.0))
    s = s.withColumn("biodiversity_support", cap(F.col("shdi") / 2))
    return s.select(
        cap(F.col("water") * 2).alias("water_conservation"), cap(F.col("vegetation") * 3).alias("water_purification"), "biodiversity_support", cap(F.col("wetland") * 1.5).alias("flood_control"),
        (F.col("wetland") if connectivity is None else connectivity).alias("climate_regulation"), cap(F.col("vegetation") * F.col("biodiversity_support") * 2).alias("carbon_storage"),
    )


def health_indicators(row: DataFrame) -> DataFrame:
    """(name, value): the five indicators of a row with scores and wetland metrics; missing ones are 0."""
    get = lambda c: F.col(c) if c in row.columns else F.lit(0.0)
    pairs = {
        "structural_health": get("integrity_score"), "functional_health": get("connectivity_score"), "wetland_integrity": get("wetland_integrity"),
        "water_connectivity": get("water_connectivity"), "fragmentation_resistance": 1 - (F.col("fragmentation") if "fragmentation" in row.columns else F.lit(1.0)),
    }
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in pairs.items()))))


def wetland_health(indicators: DataFrame) -> DataFrame:
    """One row: mean of the indicators, its grade, issues of those under .5, and advice for the three
    lowest where they are under .6."""
    lookup = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    lowest = F.slice(F.array_sort(F.collect_list(F.struct("value", "name"))), 1, 3)
    s = indicators.agg(F.avg("value").alias("health"), F.array_sort(F.collect_list(F.when(F.col("value") < 0.5, F.col("name")))).alias("low"), lowest.alias("lowest"))
    issues = F.array_compact(F.transform("low", lambda n: F.try_element_at(lookup(ISSUES), n)))
    first = F.array_compact(F.transform("lowest", lambda x: F.when(x["value"] < 0.6, F.try_element_at(lookup(PRIORITIES), x["name"]))))
    or_else = lambda c, text: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(text)))
    return s.select("health", grade(F.col("health")).alias("grade"), or_else(issues, "in good health").alias("issues"), or_else(first, "keep and monitor").alias("priorities"))


def compare_landscapes(maps: dict[str, DataFrame], pixel: float = 1.0, tile: int = 256) -> DataFrame:
    """date and a wide row of metrics and scores for each map; ``maps`` is by date, as few as a caller names."""
    rows = [synthesis(metrics_of(m, pixel, tile)).select(F.lit(date).alias("date"), "*") for date, m in sorted(maps.items())]
    return reduce(lambda a, b: a.unionByName(b), rows)


def long_metrics(wide: DataFrame) -> DataFrame:
    """date, metric, value of the numeric columns of a wide table."""
    names = [f.name for f in wide.schema if f.name != "date" and f.dataType.typeName() in ("double", "long", "integer", "float")]
    return wide.select("date", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))))


def trends(metrics: DataFrame) -> DataFrame:
    """metric, first, last, change_rate, magnitude, direction of (date, metric, value) with two dates or more."""
    known = metrics.where("value is not null").withColumnRenamed("date", "t")
    several = known.groupBy("metric").agg(F.countDistinct("t").alias("n")).where("n > 1")
    t = trend(known.join(several, "metric", "left_semi"))
    return t.select("metric", "first", "last", F.col("rate").alias("change_rate"), F.abs("rate").alias("magnitude"), F.col("trend").alias("direction"))


def change_drivers(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: changed share, and the classes that changed pixels had and have."""
    j = before.select("row", "col", F.col("cls").alias("a")).join(after.select("row", "col", F.col("cls").alias("b")), ["row", "col"])
    moved = F.col("a") != F.col("b")
    return j.agg(F.avg(moved.cast("double")).alias("change_ratio"), F.array_sort(F.collect_set(F.when(moved, F.col("a")))).alias("source_classes"), F.array_sort(F.collect_set(F.when(moved, F.col("b")))).alias("target_classes"))


def trend_summary(found: DataFrame, metrics: tuple[str, ...] = ("integrity_score", "connectivity_score", "health_score")) -> DataFrame:
    """metric and a sentence for the key metrics."""
    return found.where(F.col("metric").isin(*metrics)).select("metric", F.format_string("%s (change %.2f%%)", "direction", F.col("change_rate") * 100).alias("summary"))


def temporal_changes(maps: dict[str, DataFrame], pixel: float = 1.0, tile: int = 256) -> dict[str, DataFrame]:
    """metrics, trends, drivers (first against last) and summary of maps by date."""
    wide = cut(compare_landscapes(maps, pixel, tile))
    found = trends(long_metrics(wide))
    dates = sorted(maps)
    return {"metrics": wide, "trends": found, "drivers": change_drivers(maps[dates[0]], maps[dates[-1]]), "summary": trend_summary(found)}
