"""Resampling strategies around a classifier: folds are columns, metrics one table over all folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.quantiles import percentiles
from loamgrid.operators import accuracy, sampling


def evaluate_folds(rows: DataFrame, make: Callable[[], Estimator]) -> DataFrame:
    """fold, accuracy, kappa, f1_macro of (id, label, x, fold): fit without a fold, test on it."""
    out = None
    for (fold,) in sorted(rows.select("fold").distinct().collect()):  # as many as there are folds
        pred = make().fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold))
        m = accuracy.overall(accuracy.confusion(pred.select(F.col("label").alias("y_true"), F.col("prediction").cast("long").alias("y_pred"))))
        m = m.select(F.lit(fold).alias("fold"), "accuracy", "kappa", "f1_macro")
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise ValueError("no folds")
    return out


def summarise(folds: DataFrame, metric: str = "accuracy") -> DataFrame:
    """mean, std (population), min, max of a metric, and words for its level and stability."""
    s = folds.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    level = F.when(F.col("mean") >= 0.9, "excellent").when(F.col("mean") >= 0.8, "good").when(F.col("mean") >= 0.7, "fair").otherwise("poor")
    stable = F.when(F.col("std") <= 0.02, "very stable").when(F.col("std") <= 0.05, "stable").otherwise("unstable")
    return s.withColumn("level", level).withColumn("stability", stable)


STRATEGIES = {
    "kfold": lambda rows, k: sampling.folds(rows, k, label=None),
    "stratified_kfold": lambda rows, k: sampling.folds(rows, k),
    "distance": lambda rows, k: sampling.distance_folds(rows, k),
    "spatial_block": lambda rows, k: sampling.spatial_block_folds(rows, max(2, k), k),
}


def cross_validate(rows: DataFrame, make: Callable[[], Estimator], strategy: str = "stratified_kfold", k: int = 5) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    return evaluate_folds(STRATEGIES[strategy](rows, k), make)


def compare(rows: DataFrame, make: Callable[[], Estimator], k: int = 5) -> DataFrame:
    """strategy with its summary, the most optimistic first."""
    out = None
    for name in STRATEGIES:
        s = summarise(cross_validate(rows, make, name, k)).select(F.lit(name).alias("strategy"), "*")
        out = s if out is None else out.unionByName(s)
    return out.orderBy(F.desc("mean"), "strategy")


def separation(train: DataFrame, test: DataFrame, cell: float = 4.0) -> DataFrame:
    """min, mean, max, median distance of test pixels (id, row, col) to the nearest training pixel."""
    from loamgrid.operators.uncertainty import nearest_of

    d = nearest_of(test, train, cell)
    mid = percentiles(d, [], "d", [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    return d.agg(F.min("d").alias("min"), F.avg("d").alias("mean"), F.max("d").alias("max")).join(F.broadcast(mid))


def time_split_scores(rows: DataFrame, parts: DataFrame, make: Callable[[], Estimator]) -> DataFrame:
    """fold, accuracy, kappa, f1_macro of rows (id, label, x) under a table of (id, fold, part)."""
    out = None
    for (fold,) in sorted(parts.select("fold").distinct().collect()):  # as many as there are folds
        side = lambda part, fold=fold: rows.join(parts.where((F.col("fold") == fold) & (F.col("part") == part)).select("id"), "id", "left_semi")
        pred = make().fit(side("train")).transform(side("test"))
        m = accuracy.overall(accuracy.confusion(pred.select(F.col("label").alias("y_true"), F.col("prediction").cast("long").alias("y_pred"))))
        m = m.select(F.lit(fold).alias("fold"), "accuracy", "kappa", "f1_macro")
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise ValueError("no folds")
    return out


def advise(compared: DataFrame) -> DataFrame:
    """One row: the most optimistic and most careful strategies, their gap, and what follows from it."""
    s = compared.agg(F.max_by("strategy", "mean").alias("most_optimistic"), F.min_by("strategy", "mean").alias("most_careful"), (F.max("mean") - F.min("mean")).alias("gap"), F.min_by("strategy", "std").alias("most_stable"))
    word = F.when(F.col("gap") > 0.1, "places are alike: report the careful strategy").when(F.col("gap") > 0.05, "report several strategies").otherwise("strategies agree")
    return s.withColumn("advice", word)


def bootstrap(rows: DataFrame, make: Callable[[], Estimator], rounds: int = 10, seed: int = 42) -> DataFrame:
    """round, in_bag, out_of_bag accuracy and the .632 estimate."""
    counts = sampling.bootstrap_counts(rows, rounds, seed)
    out = None
    for i in range(rounds):
        c = rows.join(counts.where(F.col("round") == i), "id")
        bag = c.where("times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        model = make().fit(bag)
        hit = lambda df, name, model=model: model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias(name))
        m = hit(bag, "in_bag").join(F.broadcast(hit(c.where("times = 0"), "out_of_bag"))).select(F.lit(i).alias("round"), "in_bag", "out_of_bag")
        out = m if out is None else out.unionByName(m)
    return out.withColumn("estimate", sampling.estimate_632(F.col("in_bag"), F.col("out_of_bag")))
