"""Geometric correction: output pixels look up source pixels by joins on whole coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.stencil import grid_size


def output_grid(spark, height: int, width: int) -> DataFrame:
    """row, col of every output pixel."""
    return spark.range(height * width).select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))


def _mirrored(x: Column, n: Column) -> Column:
    return F.when(x < 0, -x - 1).when(x >= n, 2 * n - 1 - x).otherwise(x)


def remap(cube: DataFrame, targets: DataFrame, method: str = "bilinear") -> DataFrame:
    """row, col, spec: targets (row, col, y, x) take the source at (y, x), mirrored at the edges.

    Bilinear targets join their up to four source pixels and sum them by weight in one aggregation.
    """
    t = targets.join(F.broadcast(grid_size(cube)))
    src = cube.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "spec")
    if method == "nearest":
        at = t.select("row", "col", _mirrored(F.rint("y").cast("long"), F.col("h")).alias("sr"), _mirrored(F.rint("x").cast("long"), F.col("w")).alias("sc"))
        return at.join(src, ["sr", "sc"]).select("row", "col", "spec")
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    four = [(dy, dx, (fy if dy else 1 - fy) * (fx if dx else 1 - fx)) for dy in (0, 1) for dx in (0, 1)]
    corner = F.explode(F.array(*(F.struct((F.floor("y") + dy).alias("r"), (F.floor("x") + dx).alias("c"), k.alias("k")) for dy, dx, k in four)))
    at = t.select("row", "col", "h", "w", corner.alias("p")).where("p.k > 0").select("row", "col", _mirrored(F.col("p.r"), F.col("h")).alias("sr"), _mirrored(F.col("p.c"), F.col("w")).alias("sc"), F.col("p.k").alias("k"))
    part = at.join(src, ["sr", "sc"]).select("row", "col", "sr", "sc", F.transform("spec", lambda v: v * F.col("k")).alias("v"))
    # At most four rows for each target.
    rows = part.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("sr", "sc", "v"))).alias("l"))
    zero = F.transform(F.col("l")[0]["v"], lambda _: F.lit(0.0))
    return rows.select("row", "col", F.aggregate("l", zero, lambda a, e: F.zip_with(a, e["v"], lambda p, q: p + q)).alias("spec"))


def resample(cube: DataFrame, height: int, width: int, method: str = "bilinear") -> DataFrame:
    """The cube on a grid of another size, corners on corners."""
    size = grid_size(cube)
    t = output_grid(cube.sparkSession, height, width).join(F.broadcast(size))
    # Whole numbers are multiplied before the one division, so that the last place is the last pixel exactly.
    at = lambda x, n, m: F.col(x) * (F.col(n) - 1) / (m - 1) if m > 1 else F.lit(0.0)
    return remap(cube, t.select("row", "col", at("row", "h", height).alias("y"), at("col", "w", width).alias("x")), method)


def affine(cube: DataFrame, height: int, width: int, matrix: list[list[float]], method: str = "bilinear") -> DataFrame:
    """Output (row, col) takes source matrix @ (row, col, 1)."""
    (a, b, c), (d, e, f) = matrix
    t = output_grid(cube.sparkSession, height, width)
    return remap(cube, t.select("row", "col", (a * F.col("row") + b * F.col("col") + c).alias("y"), (d * F.col("row") + e * F.col("col") + f).alias("x")), method)


def terms(x: Column, y: Column) -> list[Column]:
    return [F.lit(1.0), x, y, x * x, x * y, y * y]


def polynomial(x: Column, y: Column, k: list[float]) -> Column:
    """The second-order polynomial 1, x, y, x2, xy, y2."""
    return sum((t * c for t, c in zip(terms(x, y), k, strict=True)), F.lit(0.0))


def fit_polynomial(points: DataFrame, value: str) -> list[float]:
    """Least-squares coefficients over (x, y, value): the normal equations are one aggregation."""
    t = terms(F.col("x"), F.col("y"))
    sums = points.agg(*(F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(t) for j, b in enumerate(t)), *(F.sum(a * F.col(value)).alias(f"b{i}") for i, a in enumerate(t))).first()
    m = np.array([[sums[f"a{i}_{j}"] for j in range(6)] for i in range(6)], float)
    return np.linalg.lstsq(m, np.array([sums[f"b{i}"] for i in range(6)], float), rcond=None)[0].tolist()


def correct_by_points(cube: DataFrame, points: DataFrame, height: int, width: int, method: str = "bilinear") -> DataFrame:
    """Ground control points (x, y output; sx, sy source) fit a polynomial; every pixel is looked up."""
    kx, ky = fit_polynomial(points, "sx"), fit_polynomial(points, "sy")
    t = output_grid(cube.sparkSession, height, width)
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    return remap(cube, t.select("row", "col", polynomial(x, y, ky).alias("y"), polynomial(x, y, kx).alias("x")), method)


def accuracy(reference: DataFrame) -> DataFrame:
    """One row over (x, y, x2, y2): errors by axis, total, mean and largest, and the number."""
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d2 = dx * dx + dy * dy
    return reference.agg(F.sqrt(F.avg(dx * dx)).alias("rmse_x"), F.sqrt(F.avg(dy * dy)).alias("rmse_y"), F.sqrt(F.avg(d2)).alias("rmse"), F.avg(F.sqrt(d2)).alias("mean_error"), F.max(F.sqrt(d2)).alias("max_error"), F.count(F.lit(1)).alias("n"))


def transform_patch(patch: DataFrame, operation: str, size: int) -> DataFrame:
    """Rotations by quarters, flips of a square patch by new coordinates."""
    r, c, m = F.col("row"), F.col("col"), size - 1
    moves = {"rot90": (m - c, r), "rot180": (m - r, m - c), "rot270": (c, m - r), "flip_rows": (m - r, c), "flip_cols": (r, m - c)}
    a, b = moves[operation]
    return patch.withColumn("_r", a).withColumn("_c", b).drop("row", "col").withColumnRenamed("_r", "row").withColumnRenamed("_c", "col")


def distance(metric: str, *pairs: tuple[Column, Column]) -> Column:
    d = [F.abs(a - b) for a, b in pairs]
    if metric == "euclidean":
        return F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    if metric == "manhattan":
        return sum(d, F.lit(0.0))
    if metric == "chebyshev":
        return F.greatest(*d) if len(d) > 1 else d[0]
    raise ValueError(f"unknown metric {metric}")


def rpc_points(height: int, width: int, spark, scale: tuple[float, float], offset: tuple[float, float], n: int = 10) -> DataFrame:
    """An n x n grid of control points by the affine part of a rational model."""
    g = spark.range(n * n).select((F.col("id") % n * ((width - 1) / (n - 1))).alias("x"), (F.expr(f"id div {n}") * ((height - 1) / (n - 1))).alias("y"))
    return g.select("x", "y", (F.col("x") * scale[0] + offset[0]).alias("sx"), (F.col("y") * scale[1] + offset[1]).alias("sy"))


def to_pixel_size(cube: DataFrame, pixel: tuple[float, float], target: tuple[float, float], method: str = "bilinear") -> DataFrame:
    """The cube on pixels of another size, where that is over a tenth away."""
    sx, sy = pixel[0] / target[0], pixel[1] / target[1]
    if abs(sx - 1) <= 0.1 and abs(sy - 1) <= 0.1:
        return cube
    size = grid_size(cube).first()
    if size is None or size["h"] is None:
        return cube
    return resample(cube, max(1, round(size["h"] * sy)), max(1, round(size["w"] * sx)), method)


def correct(cube: DataFrame, meta: dict, target: tuple[float, float] = (30.0, 30.0), points: DataFrame | None = None, crs: str | None = None, method: str = "bilinear") -> DataFrame:
    """Geometric correction by what is known: control points, else a rational model (``rpc``: scale and
    offset), else the pixel size.  Another coordinate system than the scene's is refused: projections
    need a library of them."""
    if crs and meta.get("crs") and crs != meta["crs"]:
        raise NotImplementedError(f"reprojecting {meta['crs']} to {crs} needs a projection library, which isn't installed")
    size = grid_size(cube).first()
    if size is None or size["h"] is None:
        return cube
    if points is not None:
        return correct_by_points(cube, points, size["h"], size["w"], method)
    if "rpc" in meta:
        p = rpc_points(size["h"], size["w"], cube.sparkSession, tuple(meta["rpc"]["scale"]), tuple(meta["rpc"]["offset"]))
        return correct_by_points(cube, p, size["h"], size["w"], method)
    transform = meta.get("transform")
    pixel = tuple(meta["pixel_size"][:2]) if meta.get("pixel_size") else (abs(transform[0]), abs(transform[4])) if transform else None
    return to_pixel_size(cube, pixel, target, method) if pixel else cube
