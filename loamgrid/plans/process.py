"""Chains of label-map processors, presets compared, and whole sets of spatial and texture features."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import cut
from loamgrid.operators import accuracy as A
from loamgrid.operators import components as K
from loamgrid.operators import consistency as Q
from loamgrid.operators import regions as R
from loamgrid.operators import stencil as S
from loamgrid.operators import texture as X
from loamgrid.plans.analysis import PRESETS, change_statistics, postprocess

#: Processors by name: a function of a label map and parameters.
PROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "median": lambda m, size=3, iterations=1: S.median_filter(m, size, iterations),
    "gaussian": lambda m, sigma=1.0: S.gaussian_filter(m, sigma),
    "majority": lambda m, size=5, threshold=0.6: S.majority_filter(m, size, threshold),
    "bilateral": lambda m, sigma_color=0.1, sigma_space=1.0, size=5: R.bilateral_filter(m, sigma_color, sigma_space, size),
    "closing": lambda m, shape="disk", size=1: S.close_classes(m, S.structuring_element(shape, size)),
    "small_patches": lambda m, least=9, most=None, tile=256: K.small_patch_removal(m, least, most, tile),
    "holes": lambda m, cls=1, most=5, tile=256: K.fill_holes(m, cls, most, tile),
    "neighbourhood": lambda m, size=3, homogeneous=0.5, share=0.6: Q.neighbourhood_majority(m, size, homogeneous, share),
}
#: Named chains of processors.
SUITES: dict[str, list[tuple[str, dict]]] = {
    "wetland_filters": [("median", {"size": 3}), ("majority", {"size": 5, "threshold": 0.6})],
    "morphology": [("closing", {"shape": "disk", "size": 1}), ("small_patches", {"least": 9})],
    "consistency": [("neighbourhood", {"size": 3})],
    "wetland": [("median", {"size": 3}), ("closing", {"shape": "disk", "size": 1}), ("neighbourhood", {"size": 3}), ("small_patches", {"least": 5})],
}


def check_labelmap(labels: DataFrame) -> DataFrame:
    """The map itself, if it has row, col and cls."""
    missing = {"row", "col", "cls"} - set(labels.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return labels


def processor(name: str, **parameters) -> Callable[[DataFrame], DataFrame]:
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor {name}; known: {', '.join(PROCESSORS)}")
    return lambda m: PROCESSORS[name](check_labelmap(m), **parameters)


class Pipeline:
    """Processors applied one after another; each result is written, so plans don't pile up."""

    def __init__(self, steps: list[tuple[str, dict]] | str = ()) -> None:
        if isinstance(steps, str) and steps not in SUITES:
            raise ValueError(f"unknown suite {steps}; known: {', '.join(SUITES)}")
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        for name, parameters in SUITES[steps] if isinstance(steps, str) else steps:
            self.add(name, **parameters)

    def add(self, name: str, **parameters) -> Pipeline:
        self.steps.append((name, processor(name, **parameters)))
        return self

    def maps(self, labels: DataFrame) -> list[DataFrame]:
        """The map before and after every step."""
        out = [check_labelmap(labels).select("row", "col", "cls")]
        for _, step in self.steps:
            out.append(cut(step(out[-1]).select("row", "col", F.col("cls").cast("long").alias("cls"))))
        return out

    def process(self, labels: DataFrame) -> DataFrame:
        return self.maps(labels)[-1]

    def history(self, labels: DataFrame) -> DataFrame:
        """step, name, changed, total, ratio of every step."""
        maps = self.maps(labels)
        rows = [change_statistics(a, b).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "*") for i, ((name, _), a, b) in enumerate(zip(self.steps, maps, maps[1:], strict=False), 1)]
        if not rows:
            raise ValueError("no steps")
        return reduce(DataFrame.unionByName, rows)

    def quality(self, labels: DataFrame, tile: int = 256) -> DataFrame:
        return Q.quality(labels.select("row", "col", "cls"), self.process(labels), tile)


def consistency_check(labels: DataFrame, allowed: DataFrame | None = None, least: DataFrame | None = None, terrain: DataFrame | None = None, limits: DataFrame | None = None, tile: int = 256) -> dict[str, DataFrame]:
    """What rules a label map breaks, by kind, and its score: allowed neighbours (cls, other), least
    clusters (cls, least), terrain limits; rules that aren't given aren't checked."""
    none = lambda schema: labels.sparkSession.createDataFrame([], schema)
    kind = labels.schema["cls"].dataType.simpleString()
    adjacency = Q.adjacency_violations(labels, allowed) if allowed is not None else none(f"row long, col long, cls {kind}, other {kind}")
    isolated = Q.isolated_clusters(labels, least, tile) if least is not None else none(f"patch long, cls {kind}, n long")
    out = {"adjacency": cut(adjacency), "isolated": cut(isolated)}
    if terrain is not None and limits is not None:
        out["terrain"] = Q.terrain_violations(labels, terrain, limits)
    return out | {"score": Q.score(labels, out["adjacency"], out["isolated"])}


def apply_consistency(labels: DataFrame, least: int = 5, size: int = 3, tile: int = 256) -> DataFrame:
    """A label map with its small clusters dissolved and its restless pixels voted over."""
    return Q.neighbourhood_majority(K.small_patch_removal(check_labelmap(labels), least, tile=tile), size)


def compare_methods(labels: DataFrame, methods: tuple[str, ...] = tuple(PRESETS), truth: DataFrame | None = None, tile: int = 256) -> DataFrame:
    """method, changed share, patches and boundaries before and after, and accuracy against a truth
    (row, col, cls) where given."""
    rows = []
    for name in methods:
        after = cut(postprocess(labels, name).select("row", "col", F.col("cls").cast("long").alias("cls")))
        row = Q.quality(labels, after, tile).select(F.lit(name).alias("method"), "*")
        if truth is not None:
            pred = after.withColumnRenamed("cls", "y_pred").join(truth.select("row", "col", F.col("cls").alias("y_true")), ["row", "col"])
            row = row.join(F.broadcast(A.overall(A.confusion(pred)).select("accuracy", "kappa")))
        rows.append(row)
    return reduce(DataFrame.unionByName, rows)


def _joined(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, ["row", "col"]), tables)


def _renamed(table: DataFrame, prefix: str) -> DataFrame:
    return table.select("row", "col", *(F.col(c).cast("double").alias(f"{prefix}_{c}") for c in table.columns if c not in ("row", "col")))


def grey_morphology(grid: DataFrame, size: int) -> DataFrame:
    """opening, closing, gradient, tophat and blackhat of (row, col, v) over a square, edges mirrored."""
    low = lambda g: S.local(g, S.box(size), F.min("v").alias("v"))
    high = lambda g: S.local(g, S.box(size), F.max("v").alias("v"))
    eroded, dilated = cut(low(grid)), cut(high(grid))
    parts = {"v": grid, "e": eroded, "d": dilated, "opening": high(eroded), "closing": low(dilated)}
    j = _joined([t.select("row", "col", F.col("v").alias(k)) for k, t in parts.items()])
    return j.select("row", "col", "opening", "closing", (F.col("d") - F.col("e")).alias("gradient"), (F.col("v") - F.col("opening")).alias("tophat"), (F.col("closing") - F.col("v")).alias("blackhat"))


def spatial_features(grid: DataFrame, sizes: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """row, col and the spatial features of one band: morphology, edges, gradients, structure, local statistics."""
    parts = [_renamed(grey_morphology(grid, s), f"morph{s}") for s in sizes]
    edges = {"sobel": S.sobel, "roberts": S.roberts, "prewitt": S.prewitt}
    parts += [f(grid).select("row", "col", F.col("magnitude").alias(f"edge_{k}")) for k, f in edges.items()]
    parts += [S.laplace(grid).withColumnRenamed("laplace", "edge_laplace"), _renamed(S.gradient(grid).select("row", "col", "magnitude", "direction"), "grad"), _renamed(S.divergence_curl(grid), "grad")]
    parts += [S.local(grid, S.box(s), F.var_pop("v").alias(f"struct{s}_variance"), (F.max("v") - F.min("v")).alias(f"struct{s}_contrast")) for s in (3, 5, 7)]
    parts.append(_renamed(S.local_statistics(grid, 5), "local"))
    return _joined([cut(p) for p in parts])


def _gabor(frequency: float, theta: float) -> Callable[[np.ndarray], np.ndarray]:
    even, odd = X.gabor(frequency, theta)
    return lambda img: np.hypot(X.convolution(even)(img), X.convolution(odd)(img))


def texture_features(grid: DataFrame, methods: tuple[str, ...] = ("glcm", "lbp", "runs", "gabor", "statistical"), size: int = 7) -> DataFrame:
    """row, col and the texture features of one band by the methods named."""
    made: dict[str, Callable[[], list[DataFrame]]] = {
        "glcm": lambda: [_renamed(S.glcm_features(grid, r, c, 16, size), f"glcm{i}") for i, (r, c) in enumerate(((0, 1), (-1, 1), (-1, 0), (-1, -1)))],
        "lbp": lambda: [X.by_tile(grid, X.lbp_kernel(), 4).withColumnRenamed("v", "lbp")],
        "runs": lambda: [X.by_tile(S.quantise(grid, 16).withColumn("v", F.col("v").cast("double")), X.run_kernel(f, a, size), size // 2).withColumnRenamed("v", f"run_{f}_{a}") for f in X.RUN_FEATURES for a in (0, 45, 90, 135)],
        "gabor": lambda: [X.by_tile(grid, _gabor(0.1, i * math.pi / 4), 16).withColumnRenamed("v", f"gabor_{i}") for i in range(4)],
        "statistical": lambda: [_renamed(S.texture_statistics(grid, size), "stat")],
    }
    unknown = set(methods) - set(made)
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    return _joined([cut(t) for m in methods for t in made[m]()])
