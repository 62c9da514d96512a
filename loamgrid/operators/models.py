"""Classifiers over (id, label, features array<double>) tables.

Distances and densities that SQL can express are plain expressions or blocked kernels; trees,
margins and logistic models are ``pyspark.ml`` estimators behind one registry.  Neighbours are
exact: test and training rows meet in blocks, each block gives its k best, and these are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.functions.arrays import total
from loamgrid.operators.networks import NETWORKS


def vectors(rows: DataFrame, features: str = "features") -> DataFrame:
    """The features as an ML vector column ``x``."""
    return rows.withColumn("x", array_to_vector(F.col(features)))


def _nearest_rows(x: np.ndarray, y: np.ndarray, k: int, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Places in y of each x's k nearest rows, and their squared distances; ties to the first.

    A product of matrices gives distances up to rounding; the nearest by it, and some more, are
    measured exactly.  A row that could have a nearer one beyond these is measured in full.
    """
    k = min(k, len(y))
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    rough = xx + yy - 2 * (x @ y.T)
    near = np.argpartition(rough, min(k + spare, len(y)) - 1, axis=1)[:, : k + spare]
    near.sort(axis=1)
    exact = ((x[:, None, :] - y[near]) ** 2).sum(2)
    first = np.argsort(exact, axis=1, kind="stable")[:, :k]
    at, d2 = np.take_along_axis(near, first, 1), np.take_along_axis(exact, first, 1)
    if near.shape[1] < len(y):
        np.put_along_axis(rough, near, np.inf, 1)
        for i in np.flatnonzero(rough.min(1) <= d2[:, -1] + 1e-9 * (xx[:, 0] + yy.max())):
            full = ((x[i] - y) ** 2).sum(1)
            at[i] = np.argsort(full, kind="stable")[:k]
            d2[i] = full[at[i]]
    return at, d2


#: Rows of one block of either side at most: a group holds a block of each, 64 features taking 0.5 KB a row.
MOST_ROWS = 131_072


def _blocks(rows: int, block: int, cores: int) -> int:
    """Blocks of a side: enough for all cores, and no more than that while blocks stay below MOST_ROWS,
    since every block is sent once for each block of the other side."""
    return max(1, min(-(-rows // block), math.ceil((4 * cores) ** 0.5)), -(-rows // MOST_ROWS))


def nearest(test: DataFrame, train: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """id, other, label, d2, r: the k nearest training rows of each test row, ties to smaller ids.

    Rows are shuffled once for each block of the other side.  The number of blocks follows the
    cores, not the rows, so what is shuffled grows with the rows.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    n_train, n_test = (_blocks(t.count(), block // 4, cores) for t in (train, test))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = test.select("id", "features").withColumn("tb", F.pmod(F.xxhash64("id"), F.lit(n_test)).cast("int")).withColumn("rb", every(n_train))
    right = train.select(F.col("id").alias("oid"), F.col("label").cast("long").alias("label"), F.col("features").alias("f")).withColumn("rb", F.pmod(F.xxhash64("oid"), F.lit(n_train)).cast("int")).withColumn("tb", every(n_test))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "other", "label", "d2"]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "d2" else "int64") for c in names})
        b = b.sort_values("oid", ignore_index=True)
        x, y = np.stack(a["features"].to_numpy()), np.stack(b["f"].to_numpy())
        out = []
        for i in range(0, len(x), 256):
            # Parts of the training rows in the order of their ids, so that ties stay with the smaller ones.
            some = [_nearest_rows(x[i : i + 256], y[j : j + block], k) for j in range(0, len(y), block)]
            at, d2 = np.hstack([at + j * block for j, (at, _) in enumerate(some)]), np.hstack([d2 for _, d2 in some])
            first = np.argsort(d2, axis=1, kind="stable")[:, :k]
            at, d2 = np.take_along_axis(at, first, 1), np.take_along_axis(d2, first, 1)
            out.append(pd.DataFrame({"id": np.repeat(a["id"].to_numpy()[i : i + 256], at.shape[1]), "other": b["oid"].to_numpy()[at].ravel(), "label": b["label"].to_numpy()[at].ravel(), "d2": d2.ravel()}))
        return pd.concat(out)

    met = left.groupBy("tb", "rb").cogroup(right.groupBy("tb", "rb")).applyInPandas(best, "id long, other long, label long, d2 double")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))).where(F.col("r") <= k)


def knn_predict(test: DataFrame, train: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """id, prediction, share: the label with the most (distance-weighted) votes, smallest on ties."""
    w = F.lit(1.0) if weights == "uniform" else 1 / (F.sqrt("d2") + 1e-12)
    v = nearest(test, train, k).groupBy("id", "label").agg(F.round(F.sum(w), 12).alias("v"))
    return v.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("o"), "label")).alias("x"), (F.max("v") / F.sum("v")).alias("share")).select("id", F.col("x.label").alias("prediction"), "share")


def gaussian_nb(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """id, prediction, p: Gaussian naive Bayes from one aggregation of moments by class and feature."""
    long = lambda t, *keep: t.select(*keep, F.posexplode("features").alias("f", "x"))
    moments = long(train, "label").groupBy("label", "f").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    most = long(train).groupBy("f").agg(F.var_pop("x").alias("v")).agg((F.max("v") * smoothing).alias("eps"))
    m = moments.join(F.broadcast(most)).withColumn("v", F.col("v") + F.col("eps"))
    by_class = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m", "v"))), lambda s: F.struct(s["m"].alias("m"), s["v"].alias("v"))).alias("g"), F.max("n").alias("n"))
    prior = by_class.withColumn("prior", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())))
    ll = F.col("prior") + total(F.zip_with("features", "g", lambda x, g: -0.5 * F.log(6.283185307179586 * g["v"]) - (x - g["m"]) * (x - g["m"]) / (2 * g["v"])))
    # The model has a row for each class, and that is what is broadcast.
    scored = test.select("id", "features").join(F.broadcast(prior.select("label", "g", "prior"))).select("id", "label", ll.alias("ll"))
    best = scored.groupBy("id").agg(F.max_by("label", F.struct("ll", -F.col("label"))).alias("prediction"), F.max("ll").alias("top"))
    return scored.join(best, "id").groupBy("id", "prediction").agg((1 / F.sum(F.exp(F.col("ll") - F.col("top")))).alias("p"))


def fourier_features(dim: int, count: int = 256, gamma: float | None = None, seed: int = 42) -> Callable[[Column], Column]:
    """Random Fourier features of an RBF kernel, as one array expression with literal weights."""
    rng = np.random.default_rng(seed)
    g = gamma or 1.0 / dim
    w, b = rng.normal(scale=(2 * g) ** 0.5, size=(count, dim)), rng.uniform(0, 2 * np.pi, count)
    rows = F.array(*(F.struct(F.array(*map(F.lit, map(float, r))).alias("w"), F.lit(float(c)).alias("b")) for r, c in zip(w, b, strict=True)))
    return lambda x: F.transform(rows, lambda r: F.cos(total(F.zip_with(x, r["w"], lambda p, q: p * q)) + r["b"]) * (2.0 / count) ** 0.5)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel as a pipeline stage: column z to column rbf."""

    dim = Param(Params._dummy(), "dim", "features in", TypeConverters.toInt)
    count = Param(Params._dummy(), "count", "features out", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel; 0: one over dim", TypeConverters.toFloat)

    def __init__(self, dim: int = 1, count: int = 256, gamma: float | None = None) -> None:
        super().__init__()
        self._setDefault(inputCol="z", outputCol="rbf", count=256, gamma=0.0)
        self._set(dim=dim, count=count, gamma=float(gamma or 0.0))

    def _transform(self, rows: DataFrame) -> DataFrame:
        f = fourier_features(self.getOrDefault(self.dim), self.getOrDefault(self.count), self.getOrDefault(self.gamma) or None)
        return rows.withColumn(self.getOutputCol(), array_to_vector(f(vector_to_array(self.getInputCol()))))


def estimator(kind: str, **kw) -> Estimator:
    """An untrained pipeline by name: svm, rbf_svm (needs dim), rf, xgb, nb, logreg, mlp.  Columns: x, label."""
    scale = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
    if kind == "svm":
        chosen = UnivariateFeatureSelector(featuresCol="z", outputCol="k", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(kw.pop("top", 50))
        return Pipeline(stages=[scale, chosen, OneVsRest(classifier=LinearSVC(**{"maxIter": 50, **kw}), featuresCol="k", labelCol="label")])
    if kind == "rbf_svm":
        dim, gamma, count = kw.pop("dim"), kw.pop("gamma", None), kw.pop("count", 256)
        return Pipeline(stages=[scale, FourierFeatures(dim, count, gamma), OneVsRest(classifier=LinearSVC(**{"maxIter": 50, **kw}), featuresCol="rbf", labelCol="label")])
    if kind == "rf":
        return Pipeline(stages=[RandomForestClassifier(featuresCol="x", labelCol="label", seed=42, **kw)])
    if kind == "xgb":
        return Pipeline(stages=[OneVsRest(classifier=GBTClassifier(**{"maxIter": 20, "seed": 42, **kw}), featuresCol="x", labelCol="label")])
    if kind == "nb":
        return Pipeline(stages=[NaiveBayes(featuresCol="x", labelCol="label", modelType="gaussian", **kw)])
    if kind == "logreg":
        return Pipeline(stages=[scale, LogisticRegression(featuresCol="z", labelCol="label", **kw)])
    if kind == "mlp":
        return Pipeline(stages=[scale, MultilayerPerceptronClassifier(featuresCol="z", labelCol="label", seed=42, **kw)])
    raise ValueError(f"unknown classifier {kind}; known: {', '.join(KINDS)}")


KINDS = ("svm", "rbf_svm", "rf", "xgb", "nb", "logreg", "mlp")
DEEP = tuple(NETWORKS)
ENSEMBLES = ("voting", "stacking", "dynamic")


def available() -> dict[str, tuple[str, ...]]:
    """Names by group; deep networks are in :mod:`loamgrid.operators.networks`."""
    return {"traditional": (*KINDS, "knn"), "deep": DEEP, "ensemble": ENSEMBLES}


def probabilities(model, rows: DataFrame, classes: int) -> DataFrame:
    """id, p array<double>: a model's class probabilities; margins go through a softmax."""
    out = model.transform(rows)
    if "probability" in out.columns:
        return out.select("id", vector_to_array("probability").alias("p"))
    raw = vector_to_array("rawPrediction")
    e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    return out.select("id", e.alias("e")).select("id", F.transform("e", lambda x: x / total(F.col("e"))).alias("p"))


def argmax(p: Column) -> Column:
    """Index of the largest probability, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def soft_vote(ensemble: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """id, prediction, p from (id, model, p): weighted sums of class probabilities."""
    pairs = [F.lit(x) for kv in (weights or {}).items() for x in (int(kv[0]), float(kv[1]))]
    w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model").cast("int")), F.lit(0.0)) if weights else F.lit(1.0)
    s = ensemble.withColumn("w", w).select("id", "w", F.posexplode("p").alias("k", "q")).groupBy("id", "k").agg((F.sum(F.col("q") * F.col("w")) / F.sum("w")).alias("s"))
    return s.groupBy("id").agg(F.min(F.struct((-F.round("s", 12)).alias("o"), F.col("k").cast("long").alias("k"))).alias("x"), F.max("s").alias("p")).select("id", F.col("x.k").alias("prediction"), "p")


def hard_vote(ensemble: DataFrame) -> DataFrame:
    v = ensemble.select("id", argmax(F.col("p")).alias("vote")).groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("o"), "vote")).alias("x")).select("id", F.col("x.vote").alias("prediction"))


def stack(rows: DataFrame, kinds: list[str], classes: int, k: int = 5) -> tuple[list, object]:
    """Base models on all rows, and a logistic model on their out-of-fold probabilities.

    rows: id, label, x.  Returns (base models, meta model).
    """
    from loamgrid.operators.sampling import folds

    f = folds(rows, k)
    metas = []
    for i, kind in enumerate(kinds):
        parts = [probabilities(estimator(kind).fit(f.where(f"fold <> {j}")), f.where(f"fold = {j}"), classes) for j in range(k)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        metas.append(out.withColumnRenamed("p", f"p{i}"))
    meta = rows.select("id", "label")
    for m in metas:
        meta = meta.join(m, "id")
    meta = meta.select("id", "label", array_to_vector(F.concat(*(f"p{i}" for i in range(len(kinds))))).alias("x"))
    return [estimator(kind).fit(rows) for kind in kinds], estimator("logreg").fit(meta)


def stack_predict(models: tuple[list, object], rows: DataFrame, classes: int) -> DataFrame:
    base, meta = models
    out = rows.select("id")
    for i, m in enumerate(base):
        out = out.join(probabilities(m, rows, classes).withColumnRenamed("p", f"p{i}"), "id")
    return meta.transform(out.select("id", array_to_vector(F.concat(*(f"p{i}" for i in range(len(base))))).alias("x"))).select("id", F.col("prediction").cast("long").alias("prediction"))


def dynamic_select(test: DataFrame, train: DataFrame, competence: DataFrame, ensemble: DataFrame, k: int = 5) -> DataFrame:
    """id, model, prediction: of each test row the model that was best on its k nearest training
    rows (competence: id, model, c), the first on ties, and that model's class."""
    near = nearest(test, train, k).select("id", F.col("other").alias("n"))
    c = near.join(competence.withColumnRenamed("id", "n"), "n").groupBy("id", "model").agg(F.round(F.avg("c"), 12).alias("c"))
    best = c.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("o"), "model")).alias("x")).select("id", F.col("x.model").alias("model"))
    return best.join(ensemble, ["id", "model"]).select("id", "model", argmax(F.col("p")).alias("prediction"))


def importance(model, names: list[str], top: int = 20) -> list[tuple[str, float]]:
    """The most important features of a fitted tree or logistic pipeline."""
    last = model.stages[-1]
    v = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficientMatrix.toArray()).mean(0)
    return sorted(zip(names, map(float, v), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


#: Settings that a search tries, by classifier.
GRIDS: dict[str, dict[str, list]] = {
    "svm": {"regParam": [0.001, 0.01, 0.1], "top": [20, 50]},
    "rbf_svm": {"regParam": [0.001, 0.01, 0.1], "gamma": [0.01, 0.1]},
    "rf": {"numTrees": [50, 100], "maxDepth": [5, 10], "featureSubsetStrategy": ["sqrt", "log2"]},
    "xgb": {"maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.2]},
    "nb": {"smoothing": [1e-9, 1e-6, 1e-3]},
    "logreg": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "knn": {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"]},
}


def settings_of(grid: dict[str, list], most: int | None = None, seed: int = 42) -> list[dict]:
    """All settings of a grid in order, or ``most`` of them drawn without repeats."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    if most is None or most >= len(every):
        return every
    return [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), most, replace=False))]


def search(rows: DataFrame, kind: str, grid: dict[str, list] | None = None, k: int = 3, most: int | None = None, seed: int = 42, **fixed) -> tuple[dict, DataFrame]:
    """The best settings by accuracy over k stratified folds (ties: the first tried), and the table
    (n, settings, accuracy, std) of all tried.  rows: id, label, x, and features for knn."""
    from loamgrid.lineage import cut
    from loamgrid.operators.sampling import folds

    f = cut(folds(rows, k, seed=seed))
    tried = settings_of(grid or GRIDS[kind], most, seed)
    scored = []
    for n, s in enumerate(tried):
        hits = []
        for j in range(k):
            train, test = f.where(f"fold <> {j}"), f.where(f"fold = {j}")
            if kind == "knn":
                pred = knn_predict(test, train, **s).join(test.select("id", "label"), "id")
            else:
                pred = estimator(kind, **s, **fixed).fit(train).transform(test)
            hits.append(pred.agg(F.avg((F.col("prediction").cast("long") == F.col("label").cast("long")).cast("double"))).first()[0] or 0.0)
        scored.append((n, str(s), float(np.mean(hits)), float(np.std(hits))))
    best = min(scored, key=lambda x: (-x[2], x[0]))[0]
    return tried[best], rows.sparkSession.createDataFrame(scored, "n long, settings string, accuracy double, std double")


def search_weights(ensemble: DataFrame, labels: DataFrame, models: int, draws: int = 50, seed: int = 42) -> tuple[dict[int, float], float]:
    """Weights of models (id, model, p) that give the best soft vote against (id, label), and its
    accuracy: equal weights, each model alone, and drawn ones are tried in one pass."""
    rng = np.random.default_rng(seed)
    tried = np.concatenate([np.full((1, models), 1 / models), np.eye(models), rng.dirichlet(np.ones(models), draws)])
    # One row for each id with all models' probabilities, models in order.
    g = ensemble.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "p"))), lambda x: x["p"]).alias("rows")).where(F.size("rows") == models).join(labels.select("id", "label"), "id")
    w = F.array(*(F.array(*map(F.lit, map(float, r))) for r in tried))
    zero = F.transform(F.col("rows")[0], lambda _: F.lit(0.0))
    vote = lambda r: argmax(F.transform(F.aggregate(F.zip_with("rows", r, lambda p, x: F.transform(p, lambda q: q * x)), zero, lambda a, p: F.zip_with(a, p, lambda s, t: s + t)), lambda v: F.round(v, 12)))
    hits = g.select(F.posexplode(F.transform(w, lambda r: (vote(r) == F.col("label")).cast("double"))).alias("n", "ok")).groupBy("n").agg(F.avg("ok").alias("a"))
    best = hits.orderBy(F.desc("a"), "n").first()
    if best is None:
        raise ValueError("no rows with all models")
    return {i: float(x) for i, x in enumerate(tried[best["n"]])}, best["a"]


class ModelSet:
    """Several classifiers trained on the same rows (id, label, x) and compared on others."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[[], Estimator]] = {}
        self.models: dict = {}

    def add(self, name: str, make: Callable[[], Estimator]) -> None:
        self.makers[name] = make

    def train(self, rows: DataFrame) -> None:
        self.models = {name: make().fit(rows) for name, make in self.makers.items()}

    def predict(self, rows: DataFrame) -> DataFrame:
        """id, model, y_true, y_pred of every model."""
        if not self.models:
            raise ValueError("no model is trained")
        parts = [m.transform(rows).select("id", F.lit(name).alias("model"), F.col("label").cast("long").alias("y_true"), F.col("prediction").cast("long").alias("y_pred")) for name, m in self.models.items()]
        return reduce(DataFrame.unionByName, parts)

    def evaluate(self, rows: DataFrame, metric: str = "accuracy") -> DataFrame:
        from loamgrid.operators.accuracy import compare_models

        return compare_models(self.predict(rows), metric)

    def best(self, rows: DataFrame, metric: str = "accuracy") -> str:
        return self.evaluate(rows, metric).first()["model"]
