"""Queries of classifiers, noise reduction, connectivity, streams and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import arrays as A
from loamgrid.operators import components as K
from loamgrid.operators import connectivity as G
from loamgrid.operators import landscape as L
from loamgrid.operators import models as M
from loamgrid.operators import noise as N
from loamgrid.operators.calibration import by_band
from loamgrid.plans.registry import query
from loamgrid.scene import CUBE_SQL, ENSEMBLE_SQL, LABELMAP_SQL, fixture_cube, fixture_ensemble, fixture_labelmap, r6
from loamgrid.streaming import windows as W


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and rows to predict (id, label, features): the whole labelled scene, all bands."""
    c = fixture_cube(spark, sf_dir).select("id", "label", F.col("spec").alias("features"))
    return c, c.select((F.col("id") + 0).alias("id"), "label", "features")


_D2 = " + ".join(f"pow(a.spec[{i}] - b.spec[{i}], 2)" for i in range(1, 65))
_KNN = f"n AS (SELECT a.id, b.id AS other, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM cube a, cube b)"


@query(f"WITH {CUBE_SQL}, {_KNN}, v AS (SELECT id, label, count(*) AS v FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT id, min_by(label, (-v, label)) AS prediction, round(max(v) / 5.0, 6) + 0.0 AS share FROM v GROUP BY id")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    return M.knn_predict(test, train, 5).select("id", "prediction", r6(F.col("share")).alias("share"))


@query(
    f"""WITH {CUBE_SQL}, l AS (SELECT id, label, i, spec[i] AS x FROM cube, range(1, 65) q(i)), e AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(x) AS v FROM l GROUP BY i)),
    m AS (SELECT label, i, avg(x) AS m, var_pop(x) + any_value(eps) AS v, count(*) AS n FROM l, e GROUP BY 1, 2), pr AS (SELECT label, ln(max(n) / (SELECT count(*) FROM cube)) AS pr FROM m GROUP BY 1),
    s AS (SELECT l.id, m.label, any_value(pr) + sum(-0.5 * ln(2 * pi() * v) - pow(x - m, 2) / (2 * v)) AS ll FROM l JOIN m ON l.i = m.i JOIN pr ON pr.label = m.label GROUP BY 1, 2)
    SELECT id, arg_max(label, ll) AS prediction, round(1 / sum(exp(ll - top)), 6) + 0.0 AS p FROM (SELECT *, max(ll) OVER (PARTITION BY id) AS top FROM s) GROUP BY id"""
)
def gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    return M.gaussian_nb(train, test).select("id", "prediction", r6(F.col("p")).alias("p"))


@query(
    f"""WITH {CUBE_SQL}, {ENSEMBLE_SQL}, s AS (SELECT id, k - 1 AS k, avg(p[k]) AS s FROM ensemble, range(1, 11) r(k) GROUP BY 1, 2)
    SELECT id, min_by(k, (-round(s, 12), k))::BIGINT AS prediction, round(max(s), 6) + 0.0 AS p FROM s GROUP BY id"""
)
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.soft_vote(fixture_ensemble(spark, sf_dir)).select("id", "prediction", r6(F.col("p")).alias("p"))


@query(f"WITH {CUBE_SQL}, {ENSEMBLE_SQL}, v AS (SELECT id, list_position(p, list_max(p)) - 1 AS vote, count(*) AS n FROM ensemble GROUP BY 1, 2) SELECT id, min_by(vote, (-n, vote))::BIGINT AS prediction FROM v GROUP BY id")
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hard_vote(fixture_ensemble(spark, sf_dir))


_ENS = ENSEMBLE_SQL


@query(
    f"""WITH {CUBE_SQL}, {_ENS}, {_KNN}, c AS (SELECT n.id, model, round(avg(p[e.label + 1]), 12) AS c FROM n JOIN ensemble e ON n.other = e.id WHERE r <= 5 GROUP BY 1, 2),
    b AS (SELECT id, min_by(model, (-c, model)) AS model FROM c GROUP BY 1) SELECT id, model, (list_position(p, list_max(p)) - 1)::BIGINT AS prediction FROM b JOIN ensemble USING (id, model)"""
)
def dynamic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _parts(spark, sf_dir)
    e = fixture_ensemble(spark, sf_dir)
    competence = e.select("id", "model", F.element_at("p", F.col("label").cast("int") + 1).alias("c"))
    return M.dynamic_select(test, train, competence, e.select("id", "model", "p"), 5)


def _ml(kind: str, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = (M.vectors(p) for p in _parts(spark, sf_dir))
        return M.estimator(kind, **kw).fit(train).transform(test).select("id", "label", F.col("prediction").cast("long").alias("prediction"))

    return run


query(name="rf_predict")(_ml("rf", numTrees=20))
query(name="svm_predict")(_ml("svm", top=50, maxIter=10))
query(name="logreg_predict")(_ml("logreg", maxIter=20))


@query()
def stacked_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (M.vectors(p) for p in _parts(spark, sf_dir))
    return M.stack_predict(M.stack(train, ["nb", "logreg"], 10, k=3), test, 10)


# Noise.

_STRIPE = """{n} AS (SELECT b, {a}, m, avg(m) OVER (PARTITION BY b) AS mid, stddev_pop(m) OVER (PARTITION BY b) AS sd, [x for x in [lag(m, 1) OVER w, lag(m, 2) OVER w, lead(m, 1) OVER w, lead(m, 2) OVER w] if x IS NOT NULL] AS near
    FROM (SELECT b, {a}, avg(x) AS m FROM {src} GROUP BY 1, 2) WINDOW w AS (PARTITION BY b ORDER BY {a})),
    {n}x AS (SELECT s.b, s.row, s.col, CASE WHEN abs(m - mid) > 2 * sd AND len(near) > 0 THEN x * list_avg(near) / m ELSE x END AS x FROM {src} s JOIN {n} USING (b, {a}))"""


@query(f"WITH {CUBE_SQL}, l AS (SELECT b, row, col, spec[b + 1] AS x FROM cube, range(64) r(b)), {_STRIPE.format(n='c', a='col', src='l')}, {_STRIPE.format(n='d', a='row', src='cx')} SELECT row, col, b::BIGINT AS band, round(x, 6) + 0.0 AS x FROM dx")
def destripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = by_band(fixture_cube(spark, sf_dir), "row", "col")
    return N.destripe(x).select("row", "col", F.col("band").cast("long").alias("band"), r6(F.col("x")).alias("x"))


@query()
def pca_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pca_denoise(fixture_cube(spark, sf_dir), 8, 64).select("id", A.mean(F.col("spec")).alias("mean"))


@query()
def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.noise_level(fixture_cube(spark, sf_dir).select("row", "col", F.element_at("spec", 1).alias("v")))


# Graphs.


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.patches(K.components(fixture_labelmap(spark, sf_dir), tile=8))
    return L.structural_edges(p, 3.0, least=0.6)


@query()
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spanning_tree(_edges(spark, sf_dir).select("a", "b", (1 - F.col("w")).alias("w")))


@query()
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustering(_edges(spark, sf_dir))


@query()
def keystone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keystones(_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LABELMAP_SQL}, res AS (SELECT row, col, (1 + cls % 3)::DOUBLE AS r FROM labelmap), st AS (SELECT a.row AS ar, a.col AS ac, b.row AS br, b.col AS bc, sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) * (a.r + b.r) / 2 AS c FROM res a JOIN res b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)),
    go AS (SELECT 0 AS step, row, col, 0.0::DOUBLE AS cost FROM res WHERE row = 0 AND col = 0 UNION ALL SELECT step + 1, br, bc, min(cost) FROM (SELECT step, br, bc, cost + c AS cost FROM go JOIN st ON row = ar AND col = ac WHERE step < 40) GROUP BY 1, 2, 3)
    SELECT row, col, 1::BIGINT AS source, round(min(cost), 6) + 0.0 AS cost FROM go GROUP BY 1, 2"""
)
def cost_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixture_labelmap(spark, sf_dir).select("row", "col", (1 + F.col("cls") % 3).cast("double").alias("r"))
    seeds = spark.createDataFrame([(0, 0, 1)], "row long, col long, source long")
    return G.cost_distance(r, seeds).select("row", "col", "source", r6(F.col("cost")).alias("cost"))


# Streams: the file stream is drained by an available-now trigger into a table that is returned.


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.drain(W.tumbling(W.events(spark, sf_dir), "1 hour"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.sessions(e, "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
