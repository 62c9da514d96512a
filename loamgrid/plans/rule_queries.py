"""Queries of dispatch, rules, augmentation, band filters, splits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import accuracy as A
from loamgrid.operators import calibration as C
from loamgrid.operators import consistency as Q
from loamgrid.operators import noise as N
from loamgrid.operators import sampling as S
from loamgrid.operators import stencil as G
from loamgrid.operators import temporal as T
from loamgrid.operators import texture as X
from loamgrid.operators import uncertainty as U
from loamgrid.operators import validate as V
from loamgrid.operators import validation as W
from loamgrid.plans.analysis import change_statistics
from loamgrid.plans.grid_queries import _GRID, _near, _round
from loamgrid.plans.pixel_queries import META, WAVES, _long
from loamgrid.plans.registry import ORACLES, query
from loamgrid.plans.result_queries import _later, _path, _r
from loamgrid.scene import CUBE_SQL, ENSEMBLE_SQL, LABELMAP_SQL, PRED_SQL, PROBA_SQL, SERIES_SQL, fixture_cube, fixture_ensemble, fixture_labelmap, fixture_predictions, fixture_proba, fixture_series, r6
from loamgrid.sources import writers

# Dispatch by method: the rows of the methods' own queries.

query(ORACLES["toa_reflectance"], name="radiometric_correction")(lambda s, d: _long(C.calibrate(fixture_cube(s, d), WAVES, META, "TOA")))
query(ORACLES["radiance"], name="radiometric_correction_radiance")(lambda s, d: _long(C.calibrate(fixture_cube(s, d), WAVES, META, "RAD")))
query(ORACLES["quac_stretch"], name="atmospheric_correction")(lambda s, d: _long(C.correct_atmosphere(fixture_cube(s, d), WAVES, META, "QUAC")))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_band(fixture_cube(spark, sf_dir), "row", "col").select("row", "col", F.col("band").cast("long").alias("band"), "x")


query(ORACLES["destripe"], name="wavelet_destripe")(lambda s, d: N.remove_stripes(_bands(s, d), "wavelet").select("row", "col", F.col("band").cast("long").alias("band"), r6(F.col("x")).alias("x")))


@query(f"WITH {CUBE_SQL} SELECT row, col, b::BIGINT AS band, {_r('2 * spec[b + 1] - row / 100', 'x')} FROM cube, range(64) r(b)")
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(img):
        import numpy as np

        return 2 * img - np.arange(len(img))[:, None] / 100

    return _round(N.apply_band_filter(_bands(spark, sf_dir), f))


@query(f"WITH {CUBE_SQL} SELECT count(*) * 64 AS n, 64::BIGINT AS bands FROM cube")
def fourier_destripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.fourier_destripe(_bands(spark, sf_dir))
    return out.agg(F.count(F.when(~F.isnan("x"), 1)).alias("n"), F.countDistinct("band").alias("bands"))


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_cube(spark, sf_dir).select("row", "col", F.element_at("spec", 1).alias("v"))


query(f"WITH {_GRID}, {_near(G.box(3))} SELECT row, col, {_r('avg(v)', 'v')} FROM near GROUP BY 1, 2", name="smooth_uniform")(lambda s, d: _round(N.smooth_band(_first(s, d), "uniform")))
query(f"WITH {_GRID}, {_near(G.gaussian(1.0))} SELECT row, col, {_r('sum(k * v)', 'v')} FROM near GROUP BY 1, 2", name="smooth_gaussian")(lambda s, d: _round(N.smooth_band(_first(s, d), "gaussian")))
query(f"WITH {_GRID}, {_near(G.box(3))} SELECT row, col, {_r('quantile_cont(v, .5)', 'v')} FROM near GROUP BY 1, 2", name="smooth_median")(lambda s, d: _round(N.smooth_band(_first(s, d), "median")))
query(
    f"""WITH {_GRID}, {_near(G.box(3))}, w AS (SELECT row, col, avg(v) AS m, var_pop(v) AS s2 FROM near GROUP BY 1, 2), z AS (SELECT avg(s2) AS z FROM w)
    SELECT row, col, {_r('m + CASE WHEN s2 > z THEN (s2 - z) / s2 ELSE 0 END * (v - m)', 'v')} FROM w JOIN grid USING (row, col), z""",
    name="smooth_wiener",
)(lambda s, d: _round(N.smooth_band(_first(s, d), "wiener")))


@query(
    f"""WITH {_GRID}, {_near([(r, c, 1.0) for r, c, _ in G.box(3)])}, g AS (SELECT row, col, sqrt(pow(sum(v * dr * (2 - abs(dc))), 2) + pow(sum(v * dc * (2 - abs(dr))), 2)) AS g FROM near GROUP BY 1, 2)
    SELECT row, col, CASE WHEN g >= 1.0 THEN 1.0 WHEN g >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM g"""
)
def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(X.by_tile(_first(spark, sf_dir), X.canny_like(0.5, 1.0), 2))


# Scenes and samples.


@query(f"WITH {CUBE_SQL} SELECT max(row) + 1 AS height, count(DISTINCT b) AS bands, 'FAIL' AS status, list_contains(list(DISTINCT b), 63) AS whole FROM cube, range(64) r(b)")
def scene_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.validate_scene(fixture_cube(spark, sf_dir)).select("height", "bands", "status", (F.col("bands") == 64).alias("whole")))


@query(f"WITH {CUBE_SQL} SELECT unnest(['height differs', 'number of wavelengths differs']) AS issue FROM (SELECT max(row) FROM cube)")
def metadata_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scene_summary(fixture_cube(spark, sf_dir))
    return V.metadata_issues(s, {"height": -1, "bands": 64, "wavelengths": [1.0]}).select(F.explode("issues").alias("issue"))


@query("SELECT 'under 90% of the sample extent is in the scene' AS issue UNION ALL SELECT 'coordinate systems differ'")
def compatibility_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in V.compatible((0, 0, 20, 50), (10, 10, 25, 40), "EPSG:4326", "EPSG:32650")], "issue string")


@query("SELECT * FROM (VALUES ('over 5% NaN', 'interpolate missing values'), ('unexpected number of bands', 'remove bad bands'), ('classes out of balance', 'check the class dictionary')) t(issue, advice)")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = spark.createDataFrame([(["over 5% NaN", "unexpected number of bands", "classes out of balance", "something else"],)], "issues array<string>")
    return V.recommendations(issues)


# Rules of label maps.

_ALLOWED = "allowed AS (SELECT a AS cls, b AS other FROM range(10) x(a), range(10) y(b) WHERE a < 5 AND abs(a - b) <= 4)"


def _allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in range(5) for b in range(10) if abs(a - b) <= 4], "cls long, other long")


@query(f"WITH {LABELMAP_SQL}, {_ALLOWED} SELECT a.row, a.col, a.cls, b.cls AS other FROM labelmap a JOIN labelmap b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.cls <> b.cls WHERE a.cls IN (SELECT cls FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed r WHERE r.cls = a.cls AND r.other = b.cls)")
def adjacency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.adjacency_violations(fixture_labelmap(spark, sf_dir), _allowed(spark))


@query(
    f"""WITH RECURSIVE {LABELMAP_SQL}, nb AS (SELECT a.row * 1048576 + a.col AS i, b.row * 1048576 + b.col AS j FROM labelmap a JOIN labelmap b ON a.cls = b.cls AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    reach AS (SELECT row * 1048576 + col AS i, row * 1048576 + col AS p FROM labelmap UNION SELECT j, p FROM reach JOIN nb USING (i)), part AS (SELECT i, min(p) AS patch FROM reach GROUP BY i)
    SELECT cls, n, count(*) AS clusters FROM (SELECT patch, any_value(cls) AS cls, count(*) AS n FROM part JOIN labelmap ON i = row * 1048576 + col GROUP BY patch) WHERE n < cls GROUP BY 1, 2"""
)
def isolated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = spark.createDataFrame([(k, k) for k in range(10)], "cls long, least long")
    return Q.isolated_clusters(fixture_labelmap(spark, sf_dir), least, 16).groupBy("cls", "n").agg(F.count(F.lit(1)).alias("clusters"))


@query(f"WITH {CUBE_SQL} SELECT row, col, label AS cls, CASE WHEN spec[2] > .6 THEN 'slope' WHEN spec[3] < .2 THEN 'low' ELSE 'high' END AS kind FROM cube WHERE label < 6 AND (spec[2] > .6 OR spec[3] < .2 OR (label < 3 AND spec[3] > .8))")
def terrain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    terrain = c.select("row", "col", F.element_at("spec", 2).alias("slope"), F.element_at("spec", 3).alias("dem"))
    limits = spark.createDataFrame([(k, 0.6, 0.2, 0.8 if k < 3 else None) for k in range(6)], "cls long, max_slope double, min_dem double, max_dem double")
    return Q.terrain_violations(fixture_labelmap(spark, sf_dir), terrain, limits)


_WIN = "o AS (SELECT r AS dr, c AS dc FROM range(-1, 2) a(r), range(-1, 2) b(c))"
_HOM = "h AS (SELECT a.row, a.col, any_value(a.cls) AS cls, CASE WHEN count(*) = 9 THEN avg((a.cls = b.cls)::INT) ELSE 0 END AS h FROM labelmap a, o, labelmap b WHERE b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2)"


@query(
    f"""WITH {LABELMAP_SQL}, {_WIN}, {_HOM}, c AS (SELECT a.row, a.col, b.cls, count(*) AS n FROM labelmap a, o, labelmap b WHERE b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3), m AS (SELECT row, col, min_by(cls, (-n, cls)) AS top, max(n) AS n, sum(n) AS total FROM c GROUP BY 1, 2)
    SELECT row, col, CASE WHEN h < .5 AND total = 9 AND n / 9 >= .3 THEN top ELSE cls END AS cls FROM h JOIN m USING (row, col)"""
)
def neighbourhood_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.neighbourhood_majority(fixture_labelmap(spark, sf_dir), share=0.3)


@query(
    f"""WITH {LABELMAP_SQL}, {_WIN}, {_HOM}, {_ALLOWED}, v AS (SELECT count(*) AS v FROM labelmap a JOIN labelmap b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.cls <> b.cls WHERE a.cls IN (SELECT cls FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed r WHERE r.cls = a.cls AND r.other = b.cls))
    SELECT {_r('avg(h)', 'homogeneity')}, {_r('avg(h) * (1 - any_value(v) / count(*))', 'score')} FROM h, v"""
)
def consistency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture_labelmap(spark, sf_dir)
    none = spark.createDataFrame([], "patch long, cls long, n long")
    return _round(Q.score(m, Q.adjacency_violations(m, _allowed(spark)), none).select("homogeneity", "score"))


@query(f"WITH {LABELMAP_SQL}, later AS (SELECT row, col, CASE WHEN (row + col) % 7 = 0 THEN (cls + 1) % 10 ELSE cls END AS cls FROM labelmap) SELECT sum((a.cls <> b.cls)::INT)::BIGINT AS changed, count(*) AS total, {_r('avg((a.cls <> b.cls)::INT)', 'ratio')} FROM labelmap a JOIN later b USING (row, col)")
def map_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(change_statistics(fixture_labelmap(spark, sf_dir), _later(spark, sf_dir)))


@query(
    f"""WITH {SERIES_SQL}, w AS (SELECT unit, t, cls, lag(cls) OVER o AS was, lead(cls, 1) OVER o AS n1, lead(cls, 2) OVER o AS n2, lead(cls, 3) OVER o AS n3 FROM series WINDOW o AS (PARTITION BY unit ORDER BY t)),
    f AS (SELECT unit, count(*) AS d, sum((was <> cls)::INT) AS c FROM w GROUP BY 1) SELECT unit, 'frequent' AS kind FROM f WHERE d > 1 AND c / (d - 1) > .3 UNION ALL SELECT DISTINCT unit, 'oscillation' FROM w WHERE cls = n2 AND n1 = n3 AND cls <> n1"""
)
def temporal_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.anomalies(fixture_series(spark, sf_dir))


# Augmentation.


@query(f"WITH {CUBE_SQL} SELECT a.id, label AS la, {_r('0.3 * spec[1] + 0.7 * spec[64]', 'first')} FROM cube a")
def mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir).select("id", "spec", "label")
    out = S.mixup(c, c.select((F.col("id") + 0).alias("id"), F.reverse("spec").alias("spec"), "label"), F.lit(0.3))
    return _round(out.select("id", "la", F.element_at("spec", 1).alias("first")))


@query(f"WITH {CUBE_SQL}, m AS (SELECT id, spec, list_avg(spec) * 1.2 AS m FROM cube) SELECT id, {_r('(1.2 * spec[1] - m) * 0.8 + m', 'bright')}, {_r('spec[1] - 2 * (spec[2] - spec[1])', 'first')}, {_r('spec[1]', 'third')} FROM m")
def augmented_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spec")
    out = fixture_cube(spark, sf_dir).select("id", S.augment_spectrum(s, brightness=1.2, contrast=0.8).alias("b"), S.augment_spectrum(s, shift=2).alias("m"))
    return out.select("id", r6(F.element_at("b", 1)).alias("bright"), r6(F.element_at("m", 1)).alias("first"), r6(F.element_at("m", 3)).alias("third"))


# Splits and summaries.


@query(f"WITH {CUBE_SQL} SELECT t.id AS test_id, p.id FROM cube t, cube p WHERE t.id <> p.id AND pow(t.row - p.row, 2) + pow(t.col - p.col, 2) > 9")
def buffered_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    return S.buffered_loo(c, c.select((F.col("id") + 0).alias("id"), "row", "col"), 3.0)


@query(
    f"""WITH {CUBE_SQL}, d AS (SELECT min(sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS d FROM cube a, cube b WHERE a.label < 3 AND b.label >= 3 GROUP BY a.id)
    SELECT {_r('min(d)', 'min')}, {_r('avg(d)', 'mean')}, {_r('max(d)', 'max')}, {_r('quantile_cont(d, .5)', 'median')} FROM d"""
)
def spatial_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    return _round(W.separation(c.where("label >= 3"), c.where("label < 3")))


@query(
    f"""WITH {CUBE_SQL}, {PRED_SQL}, f AS (SELECT y_true AS fold, avg((y_true = y_pred)::INT) AS a FROM pred GROUP BY 1), s AS (SELECT avg(a) AS m, stddev_pop(a) AS sd, min(a) AS lo, max(a) AS hi FROM f)
    SELECT {_r('m', 'mean')}, {_r('sd', 'std')}, {_r('lo', 'min')}, {_r('hi', 'max')}, CASE WHEN m >= .9 THEN 'excellent' WHEN m >= .8 THEN 'good' WHEN m >= .7 THEN 'fair' ELSE 'poor' END AS level, CASE WHEN sd <= .02 THEN 'very stable' WHEN sd <= .05 THEN 'stable' ELSE 'unstable' END AS stability FROM s"""
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture_predictions(spark, sf_dir)
    return _round(W.summarise(p.groupBy(F.col("y_true").alias("fold")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))))


_ENT = "-list_sum([greatest(1e-8, least(1, x)) * ln(greatest(1e-8, least(1, x))) for x in {p}]) / ln(10)"


@query(
    f"""WITH {CUBE_SQL}, {PROBA_SQL}, {ENSEMBLE_SQL}, k AS (SELECT id, k, avg(p[k]) AS m, var_pop(p[k]) AS v FROM ensemble, range(1, 11) r(k) GROUP BY 1, 2), e AS (SELECT id, list(m ORDER BY k) AS m, avg(v) AS v FROM k GROUP BY 1),
    a AS (SELECT id, {_ENT.format(p='p')} AS pr, ({_ENT.format(p='m')}) + v AS mo FROM proba JOIN e USING (id)) SELECT id, {_r('pr', 'predictive')}, {_r('mo', 'model')}, {_r('(0.5 * pr + 0.3 * mo) / 0.8', 'total')} FROM a"""
)
def total_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = U.ensemble_spread(fixture_ensemble(spark, sf_dir), 10).withColumnRenamed("uncertainty", "model")
    out = fixture_proba(spark, sf_dir).select("id", U.entropy(F.col("p"), 10).alias("predictive")).join(e, "id")
    return _round(out.withColumn("total", U.total_uncertainty({"predictive": F.col("predictive"), "model": F.col("model")})))


# Sinks: what is written is read back.

query(ORACLES["basic_metrics"], name="metrics_json")(lambda s, d: _read_metrics(s, d, "json"))
query(ORACLES["basic_metrics"], name="metrics_csv")(lambda s, d: _read_metrics(s, d, "csv"))


def _read_metrics(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    from loamgrid.plans.registry import QUERIES

    table = QUERIES["basic_metrics"](spark, sf_dir)
    path = _path(spark, kind)
    writers.save_metrics(table, path, kind)
    read = spark.read.schema(table.schema)
    return read.json(path) if kind == "json" else read.option("header", True).csv(path)


@query(f"WITH {CUBE_SQL}, {PRED_SQL} SELECT count(DISTINCT y_true) + 4 AS lines, '# Accuracy assessment' AS first FROM (SELECT y_true FROM pred UNION SELECT y_pred FROM pred)")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "report")
    writers.save_lines(A.report(A.confusion(fixture_predictions(spark, sf_dir))), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.max(F.when(F.col("value").startswith("#"), F.col("value"))).alias("first"))
