"""The whole analysis of a scene as one plan: calibrate, correct, smooth, features, classify, clean
up, measure.  Stages only build plans; the caller's sinks act."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A
from loamgrid.functions import indices as I
from loamgrid.lineage import cut
from loamgrid.operators import accuracy, calibration, components, landscape, models, noise, sampling, stencil
from loamgrid.plans.config import Config
from loamgrid.scene import Bands


@dataclass
class Analysis:
    features: DataFrame
    labels: DataFrame
    confidence: DataFrame
    accuracy: DataFrame
    landscape: DataFrame


def preprocess(cube: DataFrame, waves: list[float], meta: dict, c: Config) -> DataFrame:
    p = c.get("preprocessing", {})
    if p.get("radiometric", {}).get("enabled", True):
        cube = calibration.calibrate(cube, waves, meta, p.get("radiometric", {}).get("method", "TOA"))
    if p.get("atmospheric", {}).get("enabled", True):
        cube = calibration.correct_atmosphere(cube, waves, meta, p.get("atmospheric", {}).get("method", "DOS"))
    n = p.get("noise_reduction", {})
    return noise.smooth_spectra(cube, n.get("method", "savgol"), n.get("window_size", 5), n.get("polynomial_order", 2)) if n.get("enabled", True) else cube


def features(cube: DataFrame, waves: list[float], c: Config) -> DataFrame:
    """Adds features: the spectrum, its derivative and the chosen indices in one array."""
    parts = [F.col("spec")]
    if c.get("features.derivative", True):
        parts.append(A.first_derivative(F.col("spec"), waves))
    bands = Bands(tuple(waves))
    names = [n for n in c.get("features.indices", []) if n in I.INDICES]
    if names:
        parts.append(F.array(*(F.coalesce(I.INDICES[n](bands), F.lit(0.0)) for n in names)))
    return cube.withColumn("features", F.concat(*parts))


PRESETS = {
    "standard": lambda m: components.small_patch_removal(stencil.median_filter(m, 3), 5),
    "conservative": lambda m: stencil.median_filter(m, 3),
    "wetland": lambda m: stencil.majority_filter(stencil.close_classes(stencil.median_filter(m, 3), stencil.disk(1)), 5, 0.6),
    "aggressive": lambda m: components.small_patch_removal(stencil.gaussian_filter(stencil.median_filter(m, 5), 1.5), 20),
}


def postprocess(labels: DataFrame, method: str = "standard") -> DataFrame:
    if method not in PRESETS:
        raise ValueError(f"unknown method {method}; known: {', '.join(PRESETS)}")
    return PRESETS[method](labels)


def change_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """changed, total, ratio of two maps of the same pixels."""
    j = before.join(after.withColumnRenamed("cls", "new"), ["row", "col"])
    return j.agg(F.sum((F.col("cls") != F.col("new")).cast("long")).alias("changed"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.try_divide("changed", "total"))


def analyse(cube: DataFrame, waves: list[float], meta: dict, c: Config | None = None) -> Analysis:
    """cube: id, row, col, label (null where unknown), spec."""
    c = c or Config()
    rows = cut(models.vectors(features(preprocess(cube, waves, meta, c), waves, c)))
    s = c.get("data.samples")
    split = cut(sampling.stratified_split(rows.where("label is not null").select("id", "label", "x"), s["train_ratio"], s["val_ratio"], s["test_ratio"], seed=c.get("runtime.random_seed", 42)))
    model = models.estimator(c.get("classification.type", "rf")).fit(split.where("part = 'train'"))
    n = 1 + int(rows.agg(F.max("label")).first()[0])
    p = cut(models.probabilities(model, rows.select("id", "x"), n).withColumn("cls", models.argmax(F.col("p"))))
    raw = rows.select("id", "row", "col").join(p, "id")
    test = split.where("part = 'test'").join(p, "id").select(F.col("label").alias("y_true"), F.col("cls").alias("y_pred"))
    clean = cut(postprocess(raw.select("row", "col", "cls"), c.get("postprocessing.method", "standard")))
    size = c.get("landscape.pixel_size", 1.0)
    area = clean.agg((F.count(F.lit(1)) * size * size).alias("ta"))
    patches = components.patches(components.components(clean), size)
    return Analysis(rows.drop("x"), clean, raw.select("row", "col", F.array_max("p").alias("confidence")), accuracy.overall(accuracy.confusion(test)), landscape.landscape_metrics(patches, area))
