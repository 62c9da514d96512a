"""Queries of accuracy assessment and uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import accuracy as A
from loamgrid.operators import uncertainty as U
from loamgrid.plans.registry import query
from loamgrid.scene import CUBE_SQL, ENSEMBLE_SQL, PRED_SQL, PROBA_SQL, fixture_cube, fixture_ensemble, fixture_predictions, fixture_proba, r6


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in df.columns if c not in keys))


_T = f"""WITH {PRED_SQL}, t AS (SELECT y_true, y_pred, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2)"""
_C = """, k AS (SELECT DISTINCT cls FROM (SELECT y_true AS cls FROM t UNION SELECT y_pred FROM t)),
    s AS (SELECT cls, coalesce((SELECT sum(n) FROM t WHERE y_true = cls), 0) AS r, coalesce((SELECT sum(n) FROM t WHERE y_pred = cls), 0) AS c,
          coalesce((SELECT sum(n) FROM t WHERE y_true = cls AND y_pred = cls), 0) AS tp, (SELECT sum(n) FROM t) AS total FROM k),
    p AS (SELECT *, CASE WHEN c <> 0 THEN tp / c ELSE 0 END AS pr, CASE WHEN r <> 0 THEN tp / r ELSE 0 END AS re FROM s),
    m AS (SELECT *, CASE WHEN pr + re <> 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM p)"""


@query(f"{_T} SELECT y_true, y_pred, n FROM t")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(fixture_predictions(spark, sf_dir))


@query(f"WITH {PRED_SQL} SELECT y_true, " + ", ".join(f"count(*) FILTER (y_pred = {c}) AS p_{c}" for c in range(10)) + " FROM pred GROUP BY y_true")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion_matrix(fixture_predictions(spark, sf_dir), list(range(10)))


@query(
    f"""{_T}{_C} SELECT cls, tp, c - tp AS fp, r - tp AS fn, total - r - c + tp AS tn, {_r('pr', 'precision')}, {_r('re', 'recall')},
    {_r('(total - r - c + tp) / (total - r)', 'specificity')}, {_r('f1', 'f1')}, {_r('re', 'producer_accuracy')}, {_r('pr', 'user_accuracy')}, {_r('1 - re', 'omission')}, {_r('1 - pr', 'commission')}, r AS support FROM m"""
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.class_table(A.confusion(fixture_predictions(spark, sf_dir))))


_OVERALL = f"""SELECT sum(r) AS n, {_r('avg(re) FILTER (r > 0)', 'balanced_accuracy')}, {_r('avg(pr)', 'precision_macro')}, {_r('avg(re)', 'recall_macro')}, {_r('avg(f1)', 'f1_macro')},
    {_r('sum(pr * r) / sum(r)', 'precision_weighted')}, {_r('sum(re * r) / sum(r)', 'recall_weighted')}, {_r('sum(f1 * r) / sum(r)', 'f1_weighted')},
    {_r('exp(avg(ln(re)) FILTER (re > 0))', 'geometric_mean')}, {_r('1 / avg(1 / f1) FILTER (f1 > 0)', 'harmonic_f1')}, {_r('sum(tp) / sum(r)', 'accuracy')},
    {_r('(sum(tp) / sum(r) - sum(r * c) / pow(sum(r), 2)) / (1 - sum(r * c) / pow(sum(r), 2))', 'kappa')}, {_r('sum(tp) / sum(r)', 'f1_micro')},
    {_r('(sum(tp) * sum(r) - sum(r * c)) / sqrt((pow(sum(r), 2) - sum(c * c)) * (pow(sum(r), 2) - sum(r * r)))', 'mcc')} FROM m"""


@query(f"{_T}{_C} {_OVERALL}")
def basic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.overall(A.confusion(fixture_predictions(spark, sf_dir))))


@query(f"WITH {PRED_SQL}, t AS (SELECT y_true, y_pred, sum(w) AS n FROM pred GROUP BY 1, 2){_C} {_OVERALL}")
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.overall(A.confusion(fixture_predictions(spark, sf_dir), "w")))


@query(f"{_T} SELECT y_true, y_pred, n, {_r('rate', 'rate')} FROM (SELECT *, n / sum(n) OVER (PARTITION BY y_true) AS rate FROM t) WHERE y_true <> y_pred ORDER BY n DESC, y_true, y_pred LIMIT 5")
def confused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.confused_pairs(A.confusion(fixture_predictions(spark, sf_dir))))


@query(f"{_T} SELECT y_true, CASE WHEN y_pred <> y_true THEN y_pred END AS main_confusion, n FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY n DESC, y_pred) AS r FROM t) WHERE r = 1")
def main_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.main_confusions(A.confusion(fixture_predictions(spark, sf_dir)))


@query(f"WITH {PRED_SQL} SELECT y_true, count(*) FILTER (y_true <> y_pred) AS errors, count(*) AS rows, {_r('avg((y_true <> y_pred)::INT)', 'error_rate')} FROM pred GROUP BY y_true")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.error_rates(fixture_predictions(spark, sf_dir)))


@query(
    f"""{_T}{_C}, o AS (SELECT sum(r) AS n, sum(tp) / sum(r) AS a, (sum(tp) / sum(r) - sum(r * c) / pow(sum(r), 2)) / (1 - sum(r * c) / pow(sum(r), 2)) AS k FROM m)
    SELECT {_r('a', 'accuracy')}, {_r('greatest(0, a - 1.959964 * sqrt(a * (1 - a) / n))', 'accuracy_low')}, {_r('least(1, a + 1.959964 * sqrt(a * (1 - a) / n))', 'accuracy_high')},
    {_r('k', 'kappa')}, {_r('greatest(-1, k - 1.959964 * sqrt(a / (n * (1 - a))))', 'kappa_low')}, {_r('least(1, k + 1.959964 * sqrt(a / (n * (1 - a))))', 'kappa_high')} FROM o"""
)
def accuracy_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.intervals(A.confusion(fixture_predictions(spark, sf_dir))))


@query(
    f"""{_T}, e AS (SELECT a.y_true, b.y_pred, r * c / (SELECT sum(n) FROM t) AS e FROM (SELECT y_true, sum(n) AS r FROM t GROUP BY 1) a, (SELECT y_pred, sum(n) AS c FROM t GROUP BY 1) b)
    SELECT {_r('sum(pow(coalesce(n, 0) - e, 2) / e)', 'chi_square')}, ((count(DISTINCT e.y_true) - 1) * (count(DISTINCT e.y_pred) - 1))::BIGINT AS dof FROM e LEFT JOIN t ON e.y_true = t.y_true AND e.y_pred = t.y_pred"""
)
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.chi_square(A.confusion(fixture_predictions(spark, sf_dir))))


@query(f"WITH {CUBE_SQL}, c AS (SELECT label, count(*) AS n FROM cube GROUP BY 1) SELECT label, n, {_r('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.class_weights(fixture_cube(spark, sf_dir)))


@query(
    f"""{_T}{_C}, o AS (SELECT sum(tp) / sum(r) AS a, (sum(tp) / sum(r) - sum(r * c) / pow(sum(r), 2)) / (1 - sum(r * c) / pow(sum(r), 2)) AS k, stddev_samp(f1) AS sp FROM m)
    SELECT {_r('a', 'accuracy')}, {_r('k', 'kappa')}, CASE WHEN a >= .9 AND k >= .8 THEN 'excellent' WHEN a >= .8 AND k >= .6 THEN 'good' WHEN a >= .7 AND k >= .4 THEN 'fair' WHEN a >= .6 AND k >= .2 THEN 'moderate' ELSE 'poor' END AS grade,
    (SELECT cls FROM m ORDER BY f1 DESC, cls LIMIT 1) AS best, (SELECT cls FROM m ORDER BY f1, cls LIMIT 1) AS worst, {_r('sp', 'f1_spread')} FROM o"""
)
def assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.summary(A.confusion(fixture_predictions(spark, sf_dir))))


@query(
    f"""WITH {CUBE_SQL}, s AS (SELECT (label >= 5)::INT AS y, spec[1] AS s FROM cube),
    k AS (SELECT y, (count(*) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) + 1 + count(*) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY s)) / 2.0::DOUBLE AS rk FROM s)
    SELECT {_r('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))', 'auc')} FROM k"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture_cube(spark, sf_dir).select((F.col("label") >= 5).cast("int").alias("label"), F.element_at("spec", 1).alias("score"))
    return _rounded(A.roc_auc(s))


# Uncertainty.

_ENT = "-list_sum([greatest(1e-8, least(1, x)) * ln(greatest(1e-8, least(1, x))) for x in {p}]) / ln(10)"


@query(
    f"""WITH {CUBE_SQL}, {PROBA_SQL} SELECT id, {_r(_ENT.format(p='p'), 'entropy')}, {_r('1 - list_max(p)', 'confidence')},
    {_r("1 - (list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2])", 'margin')}, {_r('list_var_pop(p)', 'class_variance')} FROM proba"""
)
def predictive_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    out = {"entropy": U.entropy(p, 10), "confidence": U.confidence(p), "margin": U.margin(p), "class_variance": U.class_variance(p)}
    return fixture_proba(spark, sf_dir).select("id", *(r6(c).alias(n) for n, c in out.items()))


_M = f"WITH {CUBE_SQL}, {ENSEMBLE_SQL}, l AS (SELECT id, model, k, p[k] AS v FROM ensemble, range(1, 11) r(k)), mean AS (SELECT id, k, avg(v) AS v, var_pop(v) AS va FROM l GROUP BY 1, 2)"
_E1 = "-sum(greatest(1e-8, least(1, v)) * ln(greatest(1e-8, least(1, v)))) / ln(10)"


@query(
    f"""{_M}, t AS (SELECT id, {_E1} AS t FROM mean GROUP BY 1), a AS (SELECT id, avg(e) AS a FROM (SELECT id, model, {_E1} AS e FROM l GROUP BY 1, 2) GROUP BY 1)
    SELECT id, {_r('t - a', 'epistemic')}, {_r('a', 'aleatoric')}, {_r('t', 'total')} FROM t JOIN a USING (id)"""
)
def bayesian_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.bayesian(fixture_ensemble(spark, sf_dir), 10), "id")


@query(f"{_M} SELECT id, {_r(f'{_E1} + avg(va)', 'uncertainty')} FROM mean GROUP BY id")
def ensemble_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.ensemble_spread(fixture_ensemble(spark, sf_dir), 10), "id")


@query(
    f"""WITH {CUBE_SQL}, {ENSEMBLE_SQL}, v AS (SELECT id, list_position(p, list_max(p)) AS vote, count(*) / 5.0::DOUBLE AS q FROM ensemble GROUP BY 1, 2)
    SELECT id, {_r('count(*) / 5.0::DOUBLE', 'disagreement')}, {_r('-sum(q * ln(q + 1e-8)) / ln(5)', 'vote_entropy')} FROM v GROUP BY id"""
)
def vote_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.vote_entropy(fixture_ensemble(spark, sf_dir), 5), "id")


@query(f"{_M} SELECT id, {_r('sum(l.v * ln((l.v + 1e-8) / (mean.v + 1e-8))) / 5', 'divergence')} FROM l JOIN mean USING (id, k) GROUP BY id")
def model_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.model_divergence(fixture_ensemble(spark, sf_dir), 10), "id")


@query(
    f"""WITH {CUBE_SQL}, {PROBA_SQL}, s AS (SELECT 1 - list_max(p) AS u, list_position(p, list_max(p)) - 1 = label AS ok FROM proba), t AS (SELECT x / 10.0::DOUBLE AS threshold FROM (SELECT x0 / 10.0::DOUBLE AS x FROM range(85, 94) r(x0)))
    SELECT threshold, {_r('count(*) FILTER (u <= threshold) / count(*)', 'kept_share')}, {_r('count(*) FILTER (u <= threshold AND ok) / count(*) FILTER (u <= threshold)', 'accuracy')} FROM s, t GROUP BY threshold HAVING count(*) FILTER (u <= threshold) > 0"""
)
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture_proba(spark, sf_dir).select(U.confidence(F.col("p")).alias("u"), ((F.array_position("p", F.array_max("p")) - 1) == F.col("label")).alias("ok"))
    return _rounded(U.threshold_curve(p, tuple(x / 10.0 / 10.0 for x in range(85, 94))), "threshold")


_KNN = """, d AS (SELECT a.id, b.id AS other, b.label AS ol, a.label AS l, row_number() OVER (PARTITION BY a.id ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.id) AS r FROM cube a JOIN cube b ON a.id <> b.id)"""


@query(f"WITH {CUBE_SQL}{_KNN} SELECT id, {_r('avg((l <> ol)::INT)', 'u')} FROM d WHERE r <= 5 GROUP BY id")
def knn_spatial_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.spatial_disagreement(fixture_cube(spark, sf_dir).withColumnRenamed("label", "cls")), "id")


@query(f"WITH {CUBE_SQL}{_KNN}, k AS (SELECT id, count(DISTINCT ol) AS k FROM d WHERE r <= 8 GROUP BY id) SELECT id, {_r('CASE WHEN k > 1 THEN spec[1] * k / 8 ELSE spec[1] * 0.5 END', 'u')} FROM k JOIN cube USING (id)")
def boundary_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.boundary_uncertainty(fixture_cube(spark, sf_dir).withColumnRenamed("label", "cls").withColumn("u", F.element_at("spec", 1))), "id")


@query(
    f"""WITH {CUBE_SQL}, z AS (SELECT id, row, col, spec[1] - avg(spec[1]) OVER () AS z FROM cube), g AS (SELECT a.id, any_value(a.z) AS zi, avg(b.z) AS lag FROM z a JOIN z b ON a.id <> b.id AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY a.id)
    SELECT {_r('(SELECT count(*) FROM z) / count(*) * sum(zi * lag) / (SELECT sum(z * z) FROM z)', 'morans_i')} FROM g"""
)
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.morans_i(fixture_cube(spark, sf_dir).withColumn("u", F.element_at("spec", 1)), 3.0))
