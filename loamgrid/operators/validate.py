"""Validation of scenes, samples and their fit: one aggregation for each group of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.calibration import by_band


def _issues(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in checks)))


def scene_summary(cube: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """One row: size, range, shares of bad values, and counts of bands that stand out."""
    per_band = by_band(cube, "row", "col").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("m"),
        F.stddev_pop("x").alias("sd"),
        F.sum((F.col("x") < 0).cast("long")).alias("neg"),
        F.sum(F.isnan("x").cast("long")).alias("nan"),
        F.sum((F.abs("x") == float("inf")).cast("long")).alias("inf"),
        F.sum((F.col("x") == nodata).cast("long")).alias("nodata"),
        F.max("row").alias("row"),
        F.max("col").alias("col"),
    )
    centre = per_band.agg(F.percentile("m", F.lit(0.5)).alias("mid"), F.stddev_pop("m").alias("spread"), F.avg("sd").alias("mean_sd"))
    share = lambda c: F.sum(c) / F.sum("n")
    return per_band.join(F.broadcast(centre)).agg(
        (F.max("row") + 1).alias("height"),
        (F.max("col") + 1).alias("width"),
        F.count(F.lit(1)).alias("bands"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        share("neg").alias("negative_share"),
        share("nan").alias("nan_share"),
        F.sum("inf").alias("infinite"),
        share("nodata").alias("nodata_share"),
        F.sum((F.abs(F.col("m") - F.col("mid")) > 3 * F.col("spread")).cast("long")).alias("odd_mean_bands"),
        F.sum((F.col("sd") < 0.01 * F.col("mean_sd")).cast("long")).alias("flat_bands"),
    )


def validate_scene(cube: DataFrame, expected_bands: int = 400, nodata: float = -9999.0) -> DataFrame:
    """The summary with issues and a PASS or FAIL status."""
    checks = _issues(
        (F.col("height") < 10, "height under 10 rows"),
        (F.col("width") < 10, "width under 10 columns"),
        (F.abs(F.col("bands") - expected_bands) > 50, "unexpected number of bands"),
        (F.col("min") < -1, "values below -1"),
        (F.col("max") > 20000, "values above 20000"),
        (F.col("min") == F.col("max"), "constant values"),
        (F.col("negative_share") > 0.01, "over 1% negative values"),
        (F.col("nan_share") > 0.05, "over 5% NaN"),
        (F.col("infinite") > 0, "infinite values"),
        (F.col("nodata_share") > 0.05, "over 5% nodata"),
        (F.col("odd_mean_bands") > 0, "bands with unusual means"),
        (F.col("flat_bands") > 0, "bands with almost no variation"),
    )
    return scene_summary(cube, nodata).withColumn("issues", checks).withColumn("status", F.when(F.size("issues") == 0, "PASS").otherwise("FAIL"))


def metadata_issues(summary: DataFrame, meta: dict) -> DataFrame:
    """Disagreements between a scene summary and its metadata."""
    waves = meta.get("wavelengths")
    return summary.select(
        _issues(
            *((F.col(col) != F.lit(meta[key]), f"{key} differs") for key, col in (("height", "height"), ("width", "width"), ("bands", "bands")) if meta.get(key) is not None),
            *([(F.col("bands") != F.lit(len(waves)), "number of wavelengths differs")] if waves else []),
        ).alias("issues")
    )


def border_contrast(cube: DataFrame) -> DataFrame:
    """Relative difference of the border ring's mean from the centre's (corners count twice)."""
    size = cube.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    rows = by_band(cube, "row", "col").join(F.broadcast(size))
    edge = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("h") / 10), F.floor(F.col("w") / 10)))
    weight = ((F.col("row") < edge) | (F.col("row") >= F.col("h") - edge)).cast("int") + ((F.col("col") < edge) | (F.col("col") >= F.col("w") - edge)).cast("int")
    w = rows.withColumn("k", weight)
    out = w.agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("border"), F.avg(F.when(F.col("k") == 0, F.col("x"))).alias("centre"))
    return out.withColumn("contrast", F.abs(F.try_divide(F.col("border") - F.col("centre"), F.col("centre"))))


def stripes(cube: DataFrame) -> DataFrame:
    """axis, place and mean of columns and rows whose mean is beyond three standard deviations."""
    x = by_band(cube, "row", "col")
    parts = [x.groupBy(F.lit(a).alias("axis"), F.col(a).alias("place")).agg(F.avg("x").alias("m")) for a in ("col", "row")]
    means = reduce(DataFrame.unionByName, parts)
    centre = means.groupBy("axis").agg(F.avg("m").alias("mid"), F.stddev_pop("m").alias("sd"))
    return means.join(F.broadcast(centre), "axis").where(F.abs(F.col("m") - F.col("mid")) > 3 * F.col("sd")).select("axis", "place", F.col("m").alias("mean"))


def spectral_jumps(cube: DataFrame) -> DataFrame:
    """Share of band-to-band jumps beyond three standard deviations, and whether it is over 1%."""
    from loamgrid.functions.arrays import diff

    d = cube.select(F.explode(diff(F.col("spec"))).alias("d"))
    sd = d.agg(F.stddev_pop("d").alias("sd"))
    out = d.join(F.broadcast(sd)).agg(F.avg((F.abs("d") > 3 * F.col("sd")).cast("double")).alias("jump_share"))
    return out.withColumn("discontinuous", F.col("jump_share") > 0.01)


def signal_to_noise(cube: DataFrame) -> DataFrame:
    """Mean over bands of mean / (std + 1e-10) in the middle half of the scene."""
    size = cube.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    mid = cube.join(F.broadcast(size)).where("row >= floor(h / 4) and row < floor(3 * h / 4) and col >= floor(w / 4) and col < floor(3 * w / 4)")
    per_band = by_band(mid).groupBy("band").agg((F.avg("x") / (F.stddev_pop("x") + 1e-10)).alias("snr"))
    return per_band.agg(F.avg("snr").alias("snr")).withColumn("low", F.col("snr") < 10)


def validate_samples(samples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One row of sample checks: labels, balance, completeness."""
    per_class = samples.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        unknown = per_class.agg(F.lit(0).cast("long").alias("undefined"))
    else:
        unknown = per_class.join(classes, "class_id", "left_anti").agg(F.count(F.lit(1)).alias("undefined"))
    stat = per_class.agg(F.count(F.lit(1)).alias("n_classes"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.min("class_id"), F.lit(1)).alias("low_id"))
    nulls = samples.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("class_id").isNull().cast("long")), F.lit(0)).alias("null_labels"))
    one = stat.join(F.broadcast(unknown)).join(F.broadcast(nulls))
    return one.withColumn(
        "issues",
        _issues(
            (F.col("rows") == 0, "no samples"),
            (F.col("null_labels") > 0, "missing labels"),
            (F.col("n_classes") < 2, "fewer than two classes"),
            (F.col("low_id") < 0, "negative class ids"),
            (F.col("undefined") > 0, "undefined classes"),
            (F.col("least") < 10, "a class with under 10 samples"),
            (F.col("most") > 100 * F.col("least"), "classes out of balance"),
        ),
    )


def class_differences(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id and kind: undefined (in the samples only) or unused (in the dictionary only)."""
    used = samples.select("class_id").where("class_id is not null").distinct()
    undefined = used.join(classes, "class_id", "left_anti").withColumn("kind", F.lit("undefined"))
    unused = classes.select("class_id").join(used, "class_id", "left_anti").withColumn("kind", F.lit("unused"))
    return undefined.unionByName(unused)


def outside_samples(samples: DataFrame, height: int, width: int) -> DataFrame:
    """Samples that lie on no pixel."""
    return samples.where(~(F.col("x").between(0, width - 1e-9) & F.col("y").between(0, height - 1e-9)))


Box = tuple[float, float, float, float]


def boxes_meet(a: Box, b: Box) -> bool:
    """Whether (left, bottom, right, top) boxes overlap, edges included."""
    return not (a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1])


def overlap_area(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def compatible(scene: Box, samples: Box, scene_crs: str | None, sample_crs: str | None) -> list[str]:
    """Issues of extent and coordinate system between a scene and its samples."""
    area = max((samples[2] - samples[0]) * (samples[3] - samples[1]), 1e-12)
    out = [] if boxes_meet(scene, samples) else ["samples lie outside the scene"]
    if not out and overlap_area(scene, samples) / area < 0.9:
        out.append("under 90% of the sample extent is in the scene")
    if scene_crs and sample_crs and scene_crs != sample_crs:
        out.append("coordinate systems differ")
    return out


#: Advice by a word of an issue.
ADVICE = {"nan": "interpolate missing values", "nodata": "mask nodata pixels", "negative": "check the calibration", "band": "remove bad bands", "class": "check the class dictionary", "balance": "balance the classes", "constant": "check the reader"}


def recommendations(report: DataFrame) -> DataFrame:
    """issue and advice: a row for each issue whose text names something known."""
    x = report.select(F.explode("issues").alias("issue"))
    advice = reduce(lambda a, kv: a.when(F.lower("issue").contains(kv[0]), kv[1]), ADVICE.items(), F.when(F.lit(False), ""))
    return x.select("issue", advice.alias("advice")).where("advice is not null")
