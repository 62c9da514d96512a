"""Checks of results: calibration, correction, denoising, feature tables, parameters, label maps.

Each check of data is one aggregation that gives a row with statistics, ``issues`` and ``quality``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.operators.calibration import by_band


def _issues(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in checks)))


def _graded(row: DataFrame, *checks: tuple[Column, str], names: tuple[str, ...] = ("Good", "Acceptable", "Poor"), most: int = 2) -> DataFrame:
    n = F.size("issues")
    last = F.when(n <= most, names[1]).otherwise(names[2]) if len(names) == 3 else F.lit(names[1])
    return row.withColumn("issues", _issues(*checks)).withColumn("quality", F.when(n == 0, names[0]).otherwise(last))


def _statistics(cube: DataFrame, prefix: str) -> DataFrame:
    finite = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    share = lambda c: F.avg(c.cast("double"))
    return by_band(cube).agg(
        F.min(finite).alias(f"{prefix}_min"), F.max(finite).alias(f"{prefix}_max"), F.avg(finite).alias(f"{prefix}_mean"), F.stddev_pop(finite).alias(f"{prefix}_std"),
        share(F.col("x") < 0).alias(f"{prefix}_negative"), share(F.col("x") > 1.0).alias(f"{prefix}_above_1"), share((F.col("x") > 1.5) & (F.abs("x") != float("inf")) & ~F.isnan("x")).alias(f"{prefix}_above_1_5"),
        share(F.isnan("x")).alias(f"{prefix}_nan"), share(F.abs("x") == float("inf")).alias(f"{prefix}_infinite"),
    )


def check_calibration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranges of both cubes; negative, unusually high, NaN and infinite values of the calibrated one."""
    row = _statistics(before, "in").join(F.broadcast(_statistics(after, "out")))
    return _graded(row, (F.col("out_negative") > 0, "negative values"), (F.col("out_above_1_5") > 0, "unusually high values"), (F.col("out_nan") > 0, "NaN values"), (F.col("out_infinite") > 0, "infinite values"))


def check_correction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Statistics of a cube before and after an atmospheric correction, and its change of the mean."""
    row = _statistics(before, "in").join(F.broadcast(_statistics(after, "out"))).withColumn("mean_change", F.col("out_mean") - F.col("in_mean"))
    return _graded(row, (F.abs("mean_change") > 0.1, "large change of the mean"), (F.col("out_negative") > 0, "negative values"), (F.col("out_above_1") > 0, "values above 1"), names=("Good", "Needs Review"))


def check_geometry(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of size and range by a geometric correction."""
    size = lambda c, name: c.agg(F.sum(F.size("spec")).alias(name))
    row = _statistics(before, "in").join(F.broadcast(_statistics(after, "out"))).join(F.broadcast(size(before, "in_size"))).join(F.broadcast(size(after, "out_size")))
    row = row.withColumn("size_change", F.col("out_size") / F.col("in_size"))
    return _graded(row, (F.abs(1 - F.col("size_change")) > 0.5, "large size change"), (F.col("out_nan") > 0, "NaN values introduced"), (F.abs(F.col("in_min") - F.col("out_min")) / F.col("in_max") > 0.1, "significant range change"), names=("Good", "Needs Review"))


def has_geometry(meta: dict) -> bool:
    return any(k in meta for k in ("transform", "crs", "gcps", "rpc", "bounds"))


def mean_noise(cube: DataFrame) -> DataFrame:
    """One row: the mean over bands of the Laplacian's deviation over 6 in the middle half of the scene."""
    from loamgrid.operators.stencil import LAPLACE, grid_size, spread

    size = grid_size(cube)
    cells = by_band(cube, "row", "col").select("row", "col", "band", "x")
    l = spread(cells, LAPLACE, True, size).groupBy("row", "col", "band").agg(F.sum(F.col("k") * F.col("x")).alias("l"))
    mid = l.join(F.broadcast(size)).where("row >= floor(h / 4) and row < floor(3 * h / 4) and col >= floor(w / 4) and col < floor(3 * w / 4)")
    return mid.groupBy("band").agg((F.stddev_pop("l") / 6).alias("noise")).agg(F.avg("noise").alias("noise"))


def check_denoising(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of range, reduction of noise and correlation of the cubes (id, row, col, spec)."""
    both = before.select("id", F.col("spec").alias("a")).join(after.select("id", F.col("spec").alias("b")), "id").select(F.inline(F.arrays_zip("a", "b")))
    row = both.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.corr("a", "b").alias("correlation"))
    noise = mean_noise(before).select(F.col("noise").alias("in_noise")).join(F.broadcast(mean_noise(after).select(F.col("noise").alias("out_noise"))))
    row = row.withColumn("range_change", F.abs((F.col("b1") - F.col("b0")) - (F.col("a1") - F.col("a0"))) / (F.col("a1") - F.col("a0"))).join(F.broadcast(noise))
    row = row.withColumn("noise_reduction", F.when(F.col("in_noise") > 0, 1 - F.col("out_noise") / F.col("in_noise")).otherwise(0.0)).drop("a0", "a1", "b0", "b1")
    return _graded(row, (F.col("range_change") > 0.2, "significant range change"), (F.col("correlation") < 0.9, "low signal preservation"), (F.col("noise_reduction") < 0.1, "limited noise reduction"), names=("Excellent", "Good", "Needs Review"), most=1)


def continuity(features: DataFrame, first: int = 10) -> DataFrame:
    """One row: mean correlation of horizontal and vertical neighbours over the first features."""
    x = features.select("row", "col", F.posexplode(F.slice("spec", 1, first)).alias("f", "x"))
    moves = []
    for axis, other in (("col", "row"), ("row", "col")):
        near = F.lead("x").over(Window.partitionBy("f", other).orderBy(axis))
        pairs = x.withColumn("y", near).where("y is not null")
        moves.append(pairs.groupBy("f").agg(F.corr("x", "y").alias("c")))
    return reduce(DataFrame.unionByName, moves).where("c is not null and not isnan(c)").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("continuity"))


def check_features(features: DataFrame, kind: str, input_bands: int) -> DataFrame:
    """Checks of a feature table (row, col, spec): kind is spectral, texture or spatial."""
    low = {"spectral": None, "texture": 0.5, "spatial": 0.3}
    if kind not in low:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(low)}")
    per = by_band(features).groupBy("band").agg((F.var_pop("x") < 1e-6).alias("low"))
    shape = per.agg(F.count(F.lit(1)).alias("n_features"), F.coalesce(F.sum(F.col("low").cast("long")), F.lit(0)).alias("low_variance"))
    row = _statistics(features, "out").join(F.broadcast(shape)).withColumn("expansion", F.col("n_features") / input_bands)
    checks = [(F.col("out_nan") > 0.01, "high NaN share"), (F.col("out_infinite") > 0, "infinite values")]
    if kind == "spectral":
        checks.append((F.col("expansion") < 1, "fewer features than bands"))
    else:
        checks += [(F.col("n_features") == 0, f"no {kind} features"), (F.col("low_variance") > F.col("n_features") * low[kind], "many features of very low variance")]
    if kind == "spatial":
        row = row.join(F.broadcast(continuity(features)))
        checks.append((F.col("continuity") < 0.7, "low spatial continuity"))
    return _graded(row, *checks)


def representative_bands(bands: int) -> list[int]:
    """Bands that stand for a cube in space: all up to 10, even steps up to 50, else six places."""
    if bands <= 10:
        return list(range(bands))
    if bands <= 50:
        return list(range(0, bands, bands // 10))
    return [0, bands // 8, bands // 4, bands // 2, 3 * bands // 4, bands - 1]


def texture_bands(bands: int) -> list[int]:
    """Bands that texture is measured on: all up to 20, a third up to 50, else twenty."""
    n = 20 if bands > 50 else bands // 3 if bands > 20 else bands
    return [int(i * (bands - 1) / (n - 1)) for i in range(n)] if n > 1 else list(range(n))


def texture_names(distances: tuple[int, ...] = (1, 2), angles: tuple[int, ...] = (0, 45, 90, 135)) -> list[str]:
    """Names of texture features in order, for one band."""
    glcm = [f"glcm_{p}_d{d}_a{a}" for d in distances for a in angles for p in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")]
    runs = [f"run_{p}_a{a}" for a in angles for p in ("sre", "lre", "gln", "rln", "rp")]
    return [*glcm, "lbp", *runs, *(f"gabor_{a}" for a in angles), *(f"stat_{p}" for p in ("variance", "skewness", "kurtosis", "range", "mad"))]


def spatial_names(sizes: tuple[int, ...] = (3, 5, 7)) -> list[str]:
    """Names of spatial features in order, for one band."""
    morph = [f"morph_{o}_{s}" for s in sizes for o in ("opening", "closing", "gradient", "tophat", "blackhat")]
    edges, slopes = [f"edge_{o}" for o in ("sobel", "laplace", "roberts", "prewitt")], [f"grad_{o}" for o in ("magnitude", "direction", "divergence", "curl")]
    return [*morph, *edges, *slopes, *(f"struct_{f}_{s}" for s in (3, 5, 7) for f in ("variance", "contrast")), *(f"local_{f}" for f in ("mean", "std", "min", "max", "median", "range"))]


def parameter_issues(params: dict, required: list[str], types: dict | None = None, ranges: dict | None = None) -> list[str]:
    """What is missing, of another type or out of its (low, high) range."""
    out = [f"{k} is missing" for k in required if k not in params]
    out += [f"{k} isn't {t.__name__ if isinstance(t, type) else t}" for k, t in (types or {}).items() if k in params and not isinstance(params[k], t)]
    wrong = lambda k, lo, hi: k in params and isinstance(params[k], (int, float)) and ((lo is not None and params[k] < lo) or (hi is not None and params[k] > hi))
    return out + [f"{k} is out of range" for k, (lo, hi) in (ranges or {}).items() if wrong(k, lo, hi)]


def consistency_issues(cube: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: issues of an empty cube, and of labels that don't cover its pixels."""
    row = cube.agg(F.count(F.lit(1)).alias("pixels"))
    if labels is None:
        return row.select(_issues((F.col("pixels") == 0, "no data")).alias("issues"))
    both = cube.select("row", "col", F.lit(1).alias("a")).join(labels.select("row", "col", F.lit(1).alias("b")), ["row", "col"], "full")
    lone = both.agg(F.count(F.when(F.col("b").isNull(), 1)).alias("unlabelled"), F.count(F.when(F.col("a").isNull(), 1)).alias("outside"))
    return row.join(F.broadcast(lone)).select(_issues((F.col("pixels") == 0, "no data"), (F.col("unlabelled") > 0, "pixels without label"), (F.col("outside") > 0, "labels without pixel")).alias("issues"))


def model_issues(model, features: int, classes: int) -> list[str]:
    """Whether a fitted pipeline takes that many features and knows that many classes."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    n, k = getattr(last, "numFeatures", features), getattr(last, "numClasses", classes)
    return [text for bad, text in ((n != features, f"the model takes {n} features"), (k != classes, f"the model knows {k} classes")) if bad]


def labelmap_issues(labels: DataFrame) -> DataFrame:
    """One row: pixels, classes, issues (missing columns, empty, repeated places) and warnings (negatives)."""
    missing = [c for c in ("row", "col", "cls") if c not in labels.columns]
    if missing:
        return labels.agg(F.count(F.lit(1)).alias("pixels")).select("pixels", F.lit(0).cast("long").alias("classes"), F.array(*(F.lit(f"no column {c}") for c in missing)).alias("issues"), F.array().cast("array<string>").alias("warnings"))
    places = labels.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    row = labels.agg(F.count(F.lit(1)).alias("pixels"), F.countDistinct("cls").alias("classes"), F.min("cls").alias("low")).join(F.broadcast(places))
    return row.select("pixels", "classes", _issues((F.col("pixels") == 0, "no pixels"), (F.col("repeated") > 0, "repeated pixels")).alias("issues"), _issues((F.col("low") < 0, "negative classes")).alias("warnings"))


def sample_structure_issues(samples: DataFrame) -> DataFrame:
    """One row of checks of a sample table's columns, geometry, spread and completeness."""
    missing = [c for c in ("x", "y", "class_id") if c not in samples.columns]
    if missing:
        return samples.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.array(*(F.lit(f"no column {c}") for c in missing)).alias("issues"))
    s = samples.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("no_place"), F.count(F.when(F.col("class_id").isNull(), 1)).alias("no_label"),
        F.countDistinct("x", "y").alias("places"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.countDistinct("class_id").alias("classes"),
    )
    clash = samples.where("x is not null and y is not null and class_id is not null").groupBy("x", "y").agg(F.countDistinct("class_id").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("clashes"))
    placed = F.col("rows") - F.col("no_place")
    return s.join(F.broadcast(clash)).withColumn("issues", _issues(
        (F.col("rows") == 0, "no samples"), (F.col("no_place") > 0, "samples without place"), (F.col("no_label") > 0, "samples without label"), (F.col("places") < placed, "repeated places"),
        (F.col("clashes") > 0, "places with several classes"), ((placed > 1) & (F.col("sx") == 0) & (F.col("sy") == 0), "all samples in one place"), (F.col("classes") < 2, "fewer than two classes"),
    ))
