"""Uncertainty of class probabilities: array expressions per pixel, kNN and range joins in space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.functions.arrays import total, variance
from loamgrid.lineage import cut


def entropy(p: Column, classes: int) -> Column:
    """Normalised entropy, probabilities clipped to 1e-8."""
    safe = F.transform(p, lambda x: F.greatest(F.lit(1e-8), F.least(F.lit(1.0), x)))
    return -total(F.transform(safe, lambda x: x * F.log(x))) / math.log(classes)


def confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def margin(p: Column) -> Column:
    s = F.array_sort(p)
    return 1 - (F.element_at(s, -1) - F.element_at(s, -2))


def class_variance(p: Column) -> Column:
    return variance(p)


def _mean_of(rows: Column, classes: int) -> Column:
    zero = F.array(*(F.lit(0.0) for _ in range(classes)))
    return F.transform(F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y)), lambda x: x / F.size(rows))


def by_model(ensemble: DataFrame) -> DataFrame:
    """One row for each id with all models' probability arrays (a bounded number of models)."""
    return ensemble.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "p"))), lambda x: x["p"]).alias("rows"))


def bayesian(ensemble: DataFrame, classes: int) -> DataFrame:
    """Epistemic (entropy of the mean less mean entropy) and aleatoric parts, and their sum."""
    g = by_model(ensemble)
    mean = entropy(_mean_of(F.col("rows"), classes), classes)
    each = total(F.transform("rows", lambda r: entropy(r, classes))) / F.size("rows")
    return g.select("id", (mean - each).alias("epistemic"), each.alias("aleatoric"), mean.alias("total"))


def ensemble_spread(ensemble: DataFrame, classes: int) -> DataFrame:
    """Entropy of the mean plus the mean over classes of the variance over models."""
    g = by_model(ensemble)
    across = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda k: variance(F.transform("rows", lambda r: F.element_at(r, k))))
    return g.select("id", (entropy(_mean_of(F.col("rows"), classes), classes) + total(across) / classes).alias("uncertainty"))


def votes(ensemble: DataFrame) -> DataFrame:
    """id, model, vote: each model's class, the smallest on ties."""
    return ensemble.select("id", "model", (F.array_position("p", F.array_max("p")) - 1).alias("vote"))


def vote_entropy(ensemble: DataFrame, models: int) -> DataFrame:
    """Disagreement (distinct votes by models) and the entropy of vote shares over ln M."""
    c = votes(ensemble).groupBy("id", "vote").agg((F.count(F.lit(1)) / F.lit(models)).alias("q"))
    return c.groupBy("id").agg((F.count(F.lit(1)) / F.lit(models)).alias("disagreement"), (-F.sum(F.col("q") * F.log(F.col("q") + 1e-8)) / math.log(models)).alias("vote_entropy"))


def model_divergence(ensemble: DataFrame, classes: int) -> DataFrame:
    """Mean over models of the divergence of a model's probabilities from the mean's."""
    g = by_model(ensemble).withColumn("m", _mean_of(F.col("rows"), classes))
    kl = F.transform("rows", lambda r: total(F.zip_with(r, F.col("m"), lambda x, y: x * F.log((x + 1e-8) / (y + 1e-8)))))
    return g.select("id", (total(kl) / F.size("rows")).alias("divergence"))


def total_uncertainty(parts: dict[str, Column]) -> Column:
    """Weights .5 predictive, .3 model, .2 spatial, renormalised over those present."""
    weights = {"predictive": 0.5, "model": 0.3, "spatial": 0.2}
    known = {k: v for k, v in parts.items() if k in weights}
    norm = sum(weights[k] for k in known)
    return sum((v * (weights[k] / norm) for k, v in known.items()), F.lit(0.0))


def threshold_curve(scored: DataFrame, thresholds: tuple[float, ...] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """threshold, kept share, accuracy of rows (u, ok) at most that uncertain: one conditional pass."""
    sums = scored.agg(F.count(F.lit(1)).alias("n"), *(x for i, t in enumerate(thresholds) for x in (F.sum((F.col("u") <= t).cast("long")).alias(f"k{i}"), F.sum(((F.col("u") <= t) & F.col("ok")).cast("long")).alias(f"h{i}"))))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), F.col(f"h{i}").alias("hit"), F.col("n")) for i, t in enumerate(thresholds)))
    return sums.select(F.inline(rows)).where("kept > 0").select("threshold", (F.col("kept") / F.col("n")).alias("kept_share"), (F.col("hit") / F.col("kept")).alias("accuracy"))


def bootstrap_spread(rounds: DataFrame, level: float = 0.95) -> DataFrame:
    """id, mean, std, variance, range, low, high of predictions (id, round, value) over the rounds."""
    tail = (1 - level) / 2
    # A row has one value for each round, a bounded number.
    g = rounds.groupBy("id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("variance"), (F.max("value") - F.min("value")).alias("range"), F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return g.select("id", "mean", "std", "variance", "range", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def fold_spread(folds: DataFrame) -> DataFrame:
    """One row: mean, std and coefficient of variation of accuracy over folds of (fold, y_true, y_pred)."""
    a = folds.groupBy("fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"))
    return a.agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"), F.try_divide(F.stddev_pop("a"), F.avg("a")).alias("cv"))


def analyse(pred: DataFrame, ensemble: DataFrame | None, classes: int, neighbours_: int = 5, cell: float = 4.0) -> DataFrame:
    """id, predictive, model, spatial, total: uncertainties of (id, row, col, cls, p), and of the
    models' probabilities (id, model, p) where given; total weighs those present."""
    out = pred.select("id", entropy(F.col("p"), classes).alias("predictive")).join(spatial_disagreement(pred.select("id", "row", "col", "cls"), neighbours_, cell).withColumnRenamed("u", "spatial"), "id", "left")
    parts = {"predictive": F.col("predictive"), "spatial": F.coalesce("spatial", F.lit(0.0))}
    if ensemble is not None:
        out = out.join(ensemble_spread(ensemble, classes).withColumnRenamed("uncertainty", "model"), "id", "left")
        parts["model"] = F.coalesce("model", F.lit(0.0))
    return out.withColumn("total", total_uncertainty(parts))


def uncertainty_report(scored: DataFrame, column: str = "total") -> DataFrame:
    """One row: mean, std, min, max, shares of low (under .3), middle and high (over .7) uncertainty, and a word."""
    u = F.col(column)
    s = scored.agg(F.count(u).alias("n"), F.avg(u).alias("mean"), F.stddev_pop(u).alias("std"), F.min(u).alias("min"), F.max(u).alias("max"), F.avg((u < 0.3).cast("double")).alias("low"), F.avg((u > 0.7).cast("double")).alias("high"))
    word = F.when(F.col("mean") < 0.3, "reliable").when(F.col("mean") < 0.6, "check uncertain places").otherwise("collect more samples")
    return s.withColumn("middle", 1 - F.col("low") - F.col("high")).withColumn("advice", word)


def neighbours(points: DataFrame, k: int, cell: float) -> DataFrame:
    """id, other, d2, r: the k nearest others of each point (row, col), ties to the smaller id.

    Points meet only within a ring of grid cells of side ``cell``; the ring grows until every
    point's k-th neighbour is nearer than the ring's edge, so results are exact.
    """
    base = points.select("id", F.col("row").cast("double").alias("r0"), F.col("col").cast("double").alias("c0"))
    n = base.count()
    near = Window.partitionBy("id").orderBy("d2", "other")
    rings, done = 1, None
    todo = base
    while True:
        cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(-rings), F.lit(rings)), lambda i: F.transform(F.sequence(F.lit(-rings), F.lit(rings)), lambda j: F.struct((F.floor(F.col("r0") / cell) + i).alias("a"), (F.floor(F.col("c0") / cell) + j).alias("b"))))))
        left = todo.select("id", "r0", "c0", cells.alias("x")).select("id", "r0", "c0", "x.a", "x.b")
        right = base.select(F.col("id").alias("other"), F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.floor(F.col("r0") / cell).alias("a"), F.floor(F.col("c0") / cell).alias("b"))
        d2 = (F.col("r0") - F.col("r1")) * (F.col("r0") - F.col("r1")) + (F.col("c0") - F.col("c1")) * (F.col("c0") - F.col("c1"))
        met = left.join(right, ["a", "b"]).where("id <> other").select("id", "other", d2.alias("d2")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
        full = met.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("d2").alias("far")).where((F.col("m") == min(k, n - 1)) & (F.col("far") <= F.lit((rings * cell) ** 2))).select("id")
        found = cut(met.join(full, "id", "left_semi"))
        done = found if done is None else done.unionByName(found)
        todo = cut(todo.join(found.select("id"), "id", "left_anti"))
        if n <= 1 or todo.limit(1).count() == 0:
            return done
        rings *= 2


def spatial_disagreement(pred: DataFrame, k: int = 5, cell: float = 4.0) -> DataFrame:
    """id, u: share of the k nearest neighbours with another label."""
    pairs = neighbours(pred, k, cell)
    label = pred.select(F.col("id").alias("other"), F.col("cls").alias("other_cls"))
    return pairs.join(label, "other").join(pred.select("id", "cls"), "id").groupBy("id").agg(F.avg((F.col("cls") != F.col("other_cls")).cast("double")).alias("u"))


def boundary_uncertainty(pred: DataFrame, k: int = 8, cell: float = 4.0) -> DataFrame:
    """id, u: u times the share of distinct neighbour labels where these are mixed, else half u."""
    pairs = neighbours(pred, k, cell)
    label = pred.select(F.col("id").alias("other"), F.col("cls").alias("other_cls"))
    kinds = pairs.join(label, "other").groupBy("id").agg(F.countDistinct("other_cls").alias("kinds"))
    return pred.join(kinds, "id").select("id", F.when(F.col("kinds") > 1, F.col("u") * F.col("kinds") / k).otherwise(F.col("u") * 0.5).alias("u"))


def _disk_sums(grid: np.ndarray, radius: float) -> np.ndarray:
    """Sums over the disk around each inner place of a grid with a margin of floor(radius)."""
    h = int(radius)
    sums = np.pad(np.cumsum(grid, axis=1), ((0, 0), (1, 0)))
    rows, cols = grid.shape[0] - 2 * h, grid.shape[1] - 2 * h
    out = np.zeros((rows, cols))
    for dr in range(-h, h + 1):
        w = math.isqrt(int(radius * radius - dr * dr))
        line = sums[h + dr : h + dr + rows]
        out += line[:, h + w + 1 : h + w + 1 + cols] - line[:, h - w : h - w + cols]
    return out


def morans_i(points: DataFrame, radius: float = 100.0, tile: int = 256) -> DataFrame:
    """Moran's I of pixels (row, col, u) with row-normalised weights within the radius.

    Tiles get a margin of the radius; a pixel's neighbours are summed by running sums along the
    rows of its disk, so the work for a pixel grows with the radius, not with its square.
    """
    mean = points.agg(F.avg("u").alias("mean"))
    z = points.join(F.broadcast(mean)).groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    z = cut(z.agg(F.sum(F.col("u") - F.col("mean")).alias("z"), F.sum((F.col("u") - F.col("mean")) * (F.col("u") - F.col("mean"))).alias("zz"), F.count("u").alias("n")).where("n > 0"))
    h = int(radius)
    span = lambda x: F.sequence(F.floor((F.col(x) - h) / tile), F.floor((F.col(x) + h) / tile))
    sent = z.withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - h, key[1] * tile - h
        at = ((pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy())
        value, count, square = (np.zeros((tile + 2 * h, tile + 2 * h)) for _ in range(3))
        value[at], count[at], square[at] = pdf["z"], pdf["n"], pdf["zz"]
        inner = (slice(h, h + tile), slice(h, h + tile))
        s, m = _disk_sums(value, radius), _disk_sums(count, radius)
        here = (count[inner] > 0) & (m > 1)
        # Each point's neighbours are the disk without the point itself; z * (S - z) sums to z * S - z * z.
        num = (value[inner][here] * s[here] - square[inner][here]) / (m[here] - 1)
        return pd.DataFrame({"num": [num.sum()], "w": [int(count[inner][here].sum())]})

    sums = sent.groupBy("tr", "tc").applyInPandas(run, "num double, w long").agg(F.sum("num").alias("num"), F.sum("w").alias("w"))
    den = z.agg(F.sum("n").alias("n"), F.sum("zz").alias("den"))
    return sums.join(F.broadcast(den)).select((F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("morans_i"))


def nearest_of(points: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """id, d: distance of each point to the nearest of the others, by growing rings of grid cells."""
    if not others.limit(1).count():
        return points.select("id", F.lit(None).cast("double").alias("d"))
    base = others.select(F.col("row").cast("double").alias("r1"), F.col("col").cast("double").alias("c1"), F.floor(F.col("row") / cell).alias("a"), F.floor(F.col("col") / cell).alias("b"))
    todo, done, rings = points.select("id", F.col("row").cast("double").alias("r0"), F.col("col").cast("double").alias("c0")), None, 1
    while True:
        ring = F.sequence(F.lit(-rings), F.lit(rings))
        cells = F.explode(F.flatten(F.transform(ring, lambda i: F.transform(ring, lambda j: F.struct((F.floor(F.col("r0") / cell) + i).alias("a"), (F.floor(F.col("c0") / cell) + j).alias("b"))))))
        d = F.sqrt((F.col("r0") - F.col("r1")) * (F.col("r0") - F.col("r1")) + (F.col("c0") - F.col("c1")) * (F.col("c0") - F.col("c1")))
        near = todo.select("id", "r0", "c0", cells.alias("x")).select("id", "r0", "c0", "x.a", "x.b").join(base, ["a", "b"]).groupBy("id").agg(F.min(d).alias("d")).where(F.col("d") <= rings * cell)
        near = cut(near)
        done = near if done is None else done.unionByName(near)
        todo = cut(todo.join(near, "id", "left_anti"))
        if not todo.limit(1).count():
            return done
        rings *= 2
