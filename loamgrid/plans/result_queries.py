"""Queries of geometry, checks, files, comparisons, model tests and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.lineage import shared_folder
from loamgrid.operators import accuracy as A
from loamgrid.operators import checks as C
from loamgrid.operators import comparison as P
from loamgrid.operators import components as K
from loamgrid.operators import geometry as G
from loamgrid.operators import landscape as L
from loamgrid.operators import noise as N
from loamgrid.operators import regions as R
from loamgrid.operators import sampling as S
from loamgrid.operators import stencil as T
from loamgrid.operators import uncertainty as U
from loamgrid.operators import validate as V
from loamgrid.plans import process as O
from loamgrid.plans.registry import query
from loamgrid.scene import CUBE_SQL, ENSEMBLE_SQL, LABELMAP_SQL, PRED_SQL, WIDTH, fixture_cube, fixture_ensemble, fixture_labelmap, fixture_predictions, r6
from loamgrid.sources import formats, readers, writers


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _round(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*(r6(F.col(c)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("integer", "long", "short") else F.col(c) for c, k in kinds.items()))


def _band(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    return fixture_cube(spark, sf_dir).select("row", "col", F.element_at("spec", k).alias("v"))


_BAND = "grid AS (SELECT row, col, spec[1] AS v FROM cube), dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM cube)"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loamgrid/{uuid.uuid4().hex}/{name}"


# Geometry: output pixels are laid over half the rows of the scene.

_HALF = "t AS (SELECT r AS row, c AS col, h, w FROM dim, range((SELECT h // 2 FROM dim)) a(r), range(10) b(c))"


def _half(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    cube = fixture_cube(spark, sf_dir).select("row", "col", "spec")
    h = cube.agg(F.max("row") + 1).first()[0] or 0
    return G.resample(cube, h // 2, WIDTH // 2, method).select("row", "col", r6(F.element_at("spec", 1)).alias("first"), r6(F.element_at("spec", -1)).alias("last"))


_AT = "row * (h - 1) / (h // 2 - 1)::DOUBLE AS y, col * (w - 1) / 9::DOUBLE AS x"
query(
    f"""WITH {CUBE_SQL}, {_BAND}, {_HALF}, p AS (SELECT row, col, {_AT} FROM t)
    SELECT p.row, p.col, {_r('spec[1]', 'first')}, {_r('spec[64]', 'last')} FROM p JOIN cube ON cube.row = round_even(y, 0)::BIGINT AND cube.col = round_even(x, 0)::BIGINT""",
    name="resample_nearest",
)(lambda s, d: _half(s, d, "nearest"))
query(
    f"""WITH {CUBE_SQL}, {_BAND}, {_HALF}, p AS (SELECT row, col, h, w, {_AT} FROM t),
    q AS (SELECT p.row, p.col, floor(y)::BIGINT + dy AS r, floor(x)::BIGINT + dx AS c, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS k FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
    SELECT q.row, q.col, {_r('sum(k * spec[1])', 'first')}, {_r('sum(k * spec[64])', 'last')} FROM q JOIN cube ON cube.row = r AND cube.col = c WHERE k > 0 GROUP BY 1, 2""",
    name="resample_bilinear",
)(lambda s, d: _half(s, d, "bilinear"))


@query(f"WITH {CUBE_SQL} SELECT col AS row, row AS col, {_r('spec[1]', 'first')} FROM cube WHERE row < 20")
def affine_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = fixture_cube(spark, sf_dir).select("row", "col", "spec")
    h = min(20, cube.agg(F.max("row") + 1).first()[0] or 0)
    return G.affine(cube, WIDTH, h, [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]], "nearest").select("row", "col", r6(F.element_at("spec", 1)).alias("first"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("col").cast("double"), F.col("row") / 100
    return fixture_cube(spark, sf_dir).select(x.alias("x"), y.alias("y"), (1.5 + 2 * x - y + 0.01 * x * y).alias("sx"), (x - 0.5 * y * y).alias("sy"))


@query("SELECT * FROM (VALUES (0, 1.5, 0.0), (1, 2.0, 1.0), (2, -1.0, 0.0), (3, 0.0, 0.0), (4, 0.01, 0.0), (5, 0.0, -0.5)) t(term, kx, ky)")
def polynomial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    rows = [(i, round(a, 6) + 0.0, round(b, 6) + 0.0) for i, (a, b) in enumerate(zip(G.fit_polynomial(p, "sx"), G.fit_polynomial(p, "sy"), strict=True))]
    return spark.createDataFrame(rows, "term int, kx double, ky double")


@query(
    f"""WITH {CUBE_SQL}, e AS (SELECT spec[1] - spec[2] AS dx, spec[3] - spec[4] AS dy FROM cube)
    SELECT {_r('sqrt(avg(dx * dx))', 'rmse_x')}, {_r('sqrt(avg(dy * dy))', 'rmse_y')}, {_r('sqrt(avg(dx * dx + dy * dy))', 'rmse')}, {_r('avg(sqrt(dx * dx + dy * dy))', 'mean_error')}, {_r('max(sqrt(dx * dx + dy * dy))', 'max_error')}, count(*) AS n FROM e"""
)
def geometric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("spec", i)
    return _round(G.accuracy(fixture_cube(spark, sf_dir).select(e(1).alias("x"), e(2).alias("x2"), e(3).alias("y"), e(4).alias("y2"))))


_DIST = {"euclidean": "sqrt(pow(spec[1] - spec[2], 2) + pow(spec[3] - spec[4], 2))", "manhattan": "abs(spec[1] - spec[2]) + abs(spec[3] - spec[4])", "chebyshev": "greatest(abs(spec[1] - spec[2]), abs(spec[3] - spec[4]))"}


@query(f"WITH {CUBE_SQL} SELECT id, {', '.join(_r(x, k) for k, x in _DIST.items())} FROM cube")
def spatial_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("spec", i)
    return fixture_cube(spark, sf_dir).select("id", *(r6(G.distance(k, (e(1), e(2)), (e(3), e(4)))).alias(k) for k in _DIST))


@query("WITH g AS (SELECT (i % 10) * 19 / 9::DOUBLE AS x, (i // 10) * 49 / 9::DOUBLE AS y FROM range(100) r(i)) SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(x * 2 + 1, 6) + 0.0 AS sx, round(y * 3 - 1, 6) + 0.0 AS sy FROM g")
def rpc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.rpc_points(50, 20, spark, (2.0, 3.0), (1.0, -1.0)))


# Noise and checks of scenes.


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT b, row, col, spec[b + 1] AS x FROM cube, range(64) r(b)), s AS (SELECT b, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS sd, sum((x < 0)::INT) AS neg, max(row) AS r, max(col) AS c FROM x GROUP BY 1),
    z AS (SELECT quantile_cont(m, .5) AS mid, stddev_pop(m) AS sp, avg(sd) AS ms FROM s)
    SELECT max(r) + 1 AS height, max(c) + 1 AS width, count(*) AS bands, {_r('min(lo)', 'min')}, {_r('max(hi)', 'max')}, {_r('sum(neg) / sum(n)', 'negative_share')}, 0.0::DOUBLE AS nan_share, 0::BIGINT AS infinite, 0.0::DOUBLE AS nodata_share,
    sum((abs(m - mid) > 3 * sp)::INT)::BIGINT AS odd_mean_bands, sum((sd < 0.01 * ms)::INT)::BIGINT AS flat_bands FROM s, z"""
)
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.scene_summary(fixture_cube(spark, sf_dir)))


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT row, col, spec[b + 1] AS x FROM cube, range(64) r(b)), e AS (SELECT greatest(1, least(5, (max(row) + 1) // 10, (max(col) + 1) // 10)) AS e, max(row) + 1 AS h, max(col) + 1 AS w FROM cube),
    k AS (SELECT x, (row < e OR row >= h - e)::INT + (col < e OR col >= w - e)::INT AS k FROM x, e), s AS (SELECT sum(x * k) / sum(k) AS border, avg(x) FILTER (k = 0) AS centre FROM k)
    SELECT {_r('border', 'border')}, {_r('centre', 'centre')}, {_r('abs((border - centre) / centre)', 'contrast')} FROM s"""
)
def border_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.border_contrast(fixture_cube(spark, sf_dir)))


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT row, col, spec[b + 1] AS x FROM cube, range(64) r(b)), m AS (SELECT 'col' AS axis, col AS place, avg(x) AS m FROM x GROUP BY 2 UNION ALL SELECT 'row', row, avg(x) FROM x GROUP BY 2),
    z AS (SELECT axis, avg(m) AS mid, stddev_pop(m) AS sd FROM m GROUP BY 1) SELECT axis, place, {_r('m', 'mean')} FROM m JOIN z USING (axis) WHERE abs(m - mid) > 3 * sd"""
)
def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.stripes(fixture_cube(spark, sf_dir)))


@query(
    f"""WITH {CUBE_SQL}, d AS (SELECT spec[b + 1] - spec[b] AS d FROM cube, range(1, 64) r(b)), z AS (SELECT stddev_pop(d) AS sd FROM d)
    SELECT {_r('avg((abs(d) > 3 * sd)::INT)', 'jump_share')}, avg((abs(d) > 3 * sd)::INT) > 0.01 AS discontinuous FROM d, z"""
)
def spectral_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.spectral_jumps(fixture_cube(spark, sf_dir)))


_MID = "row >= floor(h / 4) AND row < floor(3 * h / 4) AND col >= floor(w / 4) AND col < floor(3 * w / 4)"


@query(
    f"""WITH {CUBE_SQL}, {_BAND}, s AS (SELECT avg(spec[b + 1]) / (stddev_pop(spec[b + 1]) + 1e-10) AS snr FROM cube, dim, range(64) r(b) WHERE {_MID} GROUP BY b)
    SELECT {_r('avg(snr)', 'snr')}, avg(snr) < 10 AS low FROM s"""
)
def signal_to_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.signal_to_noise(fixture_cube(spark, sf_dir)))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_cube(spark, sf_dir).select((F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), F.col("label").cast("int").alias("class_id"))


@query(
    f"""WITH {CUBE_SQL}, c AS (SELECT label, count(*) AS n FROM cube GROUP BY 1), s AS (SELECT count(*) AS n_classes, min(n) AS least, max(n) AS most, min(label) AS low_id FROM c)
    SELECT n_classes, least, most, low_id, (SELECT count(*) FROM c WHERE label NOT IN (1, 2, 3)) AS undefined, (SELECT count(*) FROM cube) AS rows, 0::BIGINT AS null_labels,
    len(list_filter([CASE WHEN low_id < 0 THEN 1 END, CASE WHEN (SELECT count(*) FROM c WHERE label NOT IN (1, 2, 3)) > 0 THEN 1 END, CASE WHEN least < 10 THEN 1 END, CASE WHEN most > 100 * least THEN 1 END], lambda x: x IS NOT NULL))::BIGINT AS n_issues FROM s"""
)
def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(1,), (2,), (3,)], "class_id int")
    return _round(V.validate_samples(_samples(spark, sf_dir), known).withColumn("n_issues", F.size("issues")).drop("issues"))


@query(f"WITH {CUBE_SQL} SELECT DISTINCT label AS class_id, 'undefined' AS kind FROM cube WHERE label NOT IN (1, 2, 77) UNION ALL SELECT c::BIGINT, 'unused' FROM (VALUES (1), (2), (77)) t(c) WHERE c NOT IN (SELECT label FROM cube)")
def class_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.class_differences(_samples(spark, sf_dir), spark.createDataFrame([(1,), (2,), (77,)], "class_id int")))


@query(f"WITH {CUBE_SQL} SELECT col + 0.5::DOUBLE AS x, row + 0.5::DOUBLE AS y, label AS class_id FROM cube WHERE NOT (col + 0.5 < 11 AND row + 0.5 < 17)")
def outside_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(V.outside_samples(_samples(spark, sf_dir), 17, 11))


_STAT = "min(x) AS {p}_min, max(x) AS {p}_max, avg(x) AS {p}_mean, stddev_pop(x) AS {p}_std, avg((x < 0)::INT) AS {p}_neg, avg((x > 1)::INT) AS {p}_a1, avg((x > 1.5)::INT) AS {p}_a15"


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT spec[b + 1] AS x FROM cube, range(64) r(b)), a AS (SELECT {_STAT.format(p='i')} FROM x), o AS (SELECT {_STAT.format(p='o')} FROM (SELECT 2 * x - 0.3 AS x FROM x))
    SELECT {_r('i_mean', 'in_mean')}, {_r('o_mean', 'out_mean')}, {_r('o_std', 'out_std')}, {_r('o_neg', 'out_negative')}, {_r('o_a15', 'out_above_1_5')}, (o_neg > 0)::INT + (o_a15 > 0)::INT::BIGINT AS n_issues, CASE WHEN (o_neg > 0)::INT + (o_a15 > 0)::INT = 0 THEN 'Good' ELSE 'Acceptable' END AS quality FROM a, o"""
)
def calibration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    after = c.withColumn("spec", F.transform("spec", lambda x: 2 * x - 0.3))
    return _round(C.check_calibration(c, after).select("in_mean", "out_mean", "out_std", "out_negative", "out_above_1_5", F.size("issues").cast("long").alias("n_issues"), "quality"))


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT spec[b + 1] AS x FROM cube, range(64) r(b)), s AS (SELECT avg(x) AS m, avg(2 * x - 0.3) - avg(x) AS d, max(((2 * x - 0.3) < 0)::INT) AS neg, max(((2 * x - 0.3) > 1)::INT) AS hi FROM x)
    SELECT {_r('d', 'mean_change')}, ((abs(d) > 0.1)::INT + neg + hi)::BIGINT AS n_issues, CASE WHEN (abs(d) > 0.1)::INT + neg + hi = 0 THEN 'Good' ELSE 'Needs Review' END AS quality FROM s"""
)
def correction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    after = c.withColumn("spec", F.transform("spec", lambda x: 2 * x - 0.3))
    return _round(C.check_correction(c, after).select("mean_change", F.size("issues").cast("long").alias("n_issues"), "quality"))


_LAP = """l AS (SELECT c.id, b, -4 * c.spec[b + 1] + sum(n.spec[b + 1]) AS l, any_value(c.row) AS row, any_value(c.col) AS col FROM {src} c, dim, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc), {src} n, range(64) r(b)
    WHERE n.row = CASE WHEN c.row + dr < 0 THEN 0 WHEN c.row + dr >= h THEN h - 1 ELSE c.row + dr END AND n.col = CASE WHEN c.col + dc < 0 THEN 0 WHEN c.col + dc >= w THEN w - 1 ELSE c.col + dc END GROUP BY c.id, b, c.spec[b + 1])"""


@query(f"WITH {CUBE_SQL}, {_BAND}, {_LAP.format(src='cube')} SELECT {_r('avg(s)', 'noise')} FROM (SELECT stddev_pop(l) / 6 AS s FROM l, dim WHERE {_MID} GROUP BY b)")
def mean_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(C.mean_noise(fixture_cube(spark, sf_dir)))


@query(
    f"""WITH {CUBE_SQL}, x AS (SELECT spec[b + 1] AS a, (spec[greatest(b, 1)] + spec[b + 1] + spec[least(b + 2, 64)]) / 3 AS b FROM cube, range(64) r(b))
    SELECT {_r('corr(a, b)', 'correlation')}, {_r('abs((max(b) - min(b)) - (max(a) - min(a))) / (max(a) - min(a))', 'range_change')} FROM x"""
)
def denoising_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    at = lambda i: F.element_at("spec", F.least(F.greatest(i, F.lit(0)), F.lit(63)) + 1)
    after = c.withColumn("spec", F.transform("spec", lambda x, i: (at(i - 1) + x + at(i + 1)) / 3))
    return _round(C.check_denoising(c, after).select("correlation", "range_change"))


@query(
    f"""WITH {CUBE_SQL}, p AS (SELECT b, 'c' AS k, a.spec[b] AS x, n.spec[b] AS y FROM cube a JOIN cube n ON n.row = a.row AND n.col = a.col + 1, range(1, 11) r(b) UNION ALL SELECT b, 'r', a.spec[b], n.spec[b] FROM cube a JOIN cube n ON n.row = a.row + 1 AND n.col = a.col, range(1, 11) r(b))
    SELECT {_r('avg(c)', 'continuity')} FROM (SELECT corr(x, y) AS c FROM p GROUP BY b, k)"""
)
def spatial_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(C.continuity(fixture_cube(spark, sf_dir)))


for _kind, _sql in (
    ("spectral", "0"),
    ("texture", "(SELECT (sum((v < 1e-6)::INT) > 0.5 * count(*))::INT FROM (SELECT var_pop(spec[b + 1]) AS v FROM cube, range(64) r(b) GROUP BY b))"),
):
    query(f"WITH {CUBE_SQL}, s AS (SELECT {_sql} AS i) SELECT 64::BIGINT AS n_features, {_r('avg(spec[b + 1])', 'out_mean')}, any_value(i)::BIGINT AS n_issues, CASE WHEN any_value(i) = 0 THEN 'Good' ELSE 'Acceptable' END AS quality FROM cube, s, range(64) r(b)", name=f"{_kind}_feature_check")(
        lambda s, d, k=_kind: _round(C.check_features(fixture_cube(s, d), k, 64).select("n_features", "out_mean", F.size("issues").cast("long").alias("n_issues"), "quality"))
    )


@query(f"WITH {LABELMAP_SQL} SELECT count(*) AS pixels, count(DISTINCT cls) AS classes, 0::BIGINT AS n_issues, (min(cls) < 0)::INT::BIGINT AS n_warnings FROM labelmap")
def labelmap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(C.labelmap_issues(fixture_labelmap(spark, sf_dir)).select("pixels", "classes", F.size("issues").cast("long").alias("n_issues"), F.size("warnings").cast("long").alias("n_warnings")))


@query(f"WITH {CUBE_SQL} SELECT count(*) AS rows, count(DISTINCT (col, row)) AS places, count(DISTINCT label) AS classes, 0::BIGINT AS clashes, (count(DISTINCT label) < 2)::INT::BIGINT AS n_issues FROM cube")
def sample_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(C.sample_structure_issues(_samples(spark, sf_dir)).select("rows", "places", "classes", "clashes", F.size("issues").cast("long").alias("n_issues")))


# Files: a table is written in the shared folder and read back by the engine's reader.


@query(f"WITH {LABELMAP_SQL} SELECT row, col, cls FROM labelmap")
def labelmap_geotiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "labels.tif")
    writers.save_geotiff(fixture_labelmap(spark, sf_dir), path, [30.0, 0.0, 1000.0, 0.0, -30.0, 2000.0], 32650)
    return _grown(formats.scene_pixels(spark, path), spark, sf_dir)


@query(f"WITH {LABELMAP_SQL} SELECT row, col, cls FROM labelmap")
def labelmap_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "labels")
    writers.save_labelmap(fixture_labelmap(spark, sf_dir), path)
    return spark.read.parquet(path).select("row", "col", "cls")


def _grown(pixels: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of an image file as a label map, without the places beyond the map's last pixel."""
    there = fixture_labelmap(spark, sf_dir).select("row", "col")
    return pixels.join(there, ["row", "col"], "left_semi").select("row", "col", F.element_at("spec", 1).cast("long").alias("cls"))


@query(f"WITH {CUBE_SQL} SELECT round(col + 0.5, 6) AS x, round(row + 0.25, 6) AS y, label AS class_id, 'c' || label AS class_name FROM cube")
def samples_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "samples.csv")
    s = fixture_cube(spark, sf_dir).select((F.col("col") + 0.5).alias("x"), (F.col("row") + 0.25).alias("y"), F.col("label").alias("class_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"))
    s.write.option("header", True).csv(path)
    return _round(readers.load_samples(spark, path))


@query(f"WITH {CUBE_SQL} SELECT round(col + 0.5, 6) AS x, round(row + 0.25, 6) AS y, label AS class_id, 'c' || label AS class_name FROM cube")
def samples_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "samples.geojson")
    c = fixture_cube(spark, sf_dir)
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col("col") + 0.5, F.col("row") + 0.25).alias("coordinates"))
    one = F.struct(shape.alias("geometry"), F.struct(F.col("label").cast("string").alias("class"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name")).alias("properties"))
    # One collection for each scene line: a file of collections, as many as lines.
    c.groupBy("row").agg(F.collect_list(one).alias("features")).select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    return _round(readers.load_geojson(spark, f"{path}/*", lines=True))


# Accuracy and uncertainty.


@query(f"WITH {CUBE_SQL}, {PRED_SQL}, t AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2) SELECT y_true, y_pred, {_r('n', 'n')}, {_r('n / sum(n) OVER (PARTITION BY y_true)', 'of_row')}, {_r('n / sum(n) OVER (PARTITION BY y_pred)', 'of_column')}, {_r('n * sum(n) OVER () / (sum(n) OVER (PARTITION BY y_true) * sum(n) OVER (PARTITION BY y_pred))', 'intensity')} FROM t")
def confusion_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.confusion_shares(A.confusion(fixture_predictions(spark, sf_dir))))


@query(
    f"""WITH {CUBE_SQL}, {PRED_SQL}, t AS (SELECT y_true AS a, y_pred AS b, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2),
    o AS (SELECT coalesce(sum(abs(coalesce(t.n, 0) - coalesce(u.n, 0))) / 2, 0) AS z FROM t FULL JOIN t u ON t.a = u.b AND t.b = u.a WHERE coalesce(t.a, u.b) <> coalesce(t.b, u.a))
    SELECT (SELECT count(DISTINCT c) FROM (SELECT a AS c FROM t UNION SELECT b FROM t)) AS classes, {_r('sum(n)', 'total')}, {_r('sum(n) FILTER (a = b)', 'trace')}, {_r('sum(n) FILTER (a = b) / sum(n)', 'diagonal_share')}, count(*) FILTER (a <> b) AS off_diagonal, {_r('any_value(z)', 'asymmetry')} FROM t, o"""
)
def matrix_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.matrix_properties(A.confusion(fixture_predictions(spark, sf_dir))))


@query(f"WITH {CUBE_SQL}, {PRED_SQL} SELECT c AS cls, (SELECT count(*) FROM pred) AS n, (SELECT count(*) FROM pred WHERE (y_true = c) = (y_pred = c)) AS hits FROM (SELECT y_true AS c FROM pred UNION SELECT y_pred FROM pred)")
def class_hit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.class_hit_tests(fixture_predictions(spark, sf_dir)).drop("p"))


_VOTES = f"{ENSEMBLE_SQL}, votes AS (SELECT e.id, model, label AS y_true, list_position(p, list_max(p)) - 1 AS y_pred FROM ensemble e)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture_ensemble(spark, sf_dir)
    return e.select("id", "model", F.col("label").alias("y_true"), (F.array_position("p", F.array_max("p")) - 1).alias("y_pred"))


@query(
    f"""WITH {CUBE_SQL}, {_VOTES}, c AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS only_a, count(*) FILTER (a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS only_b FROM votes a JOIN votes b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2)
    SELECT *, {_r('CASE WHEN only_a + only_b > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) ELSE 0 END', 'statistic')} FROM c"""
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.mcnemar(_votes(spark, sf_dir)).drop("p"))


@query(
    f"""WITH {CUBE_SQL}, {_VOTES}, c AS (SELECT model, k, count(*) FILTER (y_true = k) AS r, count(*) FILTER (y_pred = k) AS c, count(*) FILTER (y_true = k AND y_pred = k) AS tp FROM votes, range(10) q(k) GROUP BY 1, 2), f AS (SELECT *, CASE WHEN r + c > 0 THEN 2.0 * tp / (r + c) ELSE 0 END AS f FROM c WHERE r + c > 0)
    SELECT model, {_r('sum(r)', 'n')}, {_r('sum(tp) / sum(r)', 'accuracy')}, {_r('(sum(tp) / sum(r) - sum(r * c) / pow(sum(r), 2)) / (1 - sum(r * c) / pow(sum(r), 2))', 'kappa')}, {_r('avg(f)', 'f1_macro')}, {_r('sum(f * r) / sum(r)', 'f1_weighted')} FROM f GROUP BY 1"""
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.compare_models(_votes(spark, sf_dir)))


@query(
    f"""WITH {CUBE_SQL}, {_VOTES} SELECT id, {_r('avg(y_pred)', 'mean')}, {_r('stddev_pop(y_pred)', 'std')}, {_r('var_pop(y_pred)', 'variance')}, {_r('(max(y_pred) - min(y_pred))::DOUBLE', 'range')}, {_r('quantile_cont(y_pred::DOUBLE, 0.025)', 'low')}, {_r('quantile_cont(y_pred::DOUBLE, 0.975)', 'high')} FROM votes GROUP BY id"""
)
def bootstrap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(U.bootstrap_spread(_votes(spark, sf_dir).select("id", F.col("model").alias("round"), F.col("y_pred").cast("double").alias("value"))))


@query(f"WITH {CUBE_SQL}, {_VOTES}, a AS (SELECT avg((y_true = y_pred)::INT) AS a FROM votes GROUP BY model) SELECT {_r('avg(a)', 'mean')}, {_r('stddev_pop(a)', 'std')}, {_r('stddev_pop(a) / avg(a)', 'cv')} FROM a")
def fold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(U.fold_spread(_votes(spark, sf_dir).withColumnRenamed("model", "fold")))


@query(f"WITH {CUBE_SQL}, s AS (SELECT spec[1] AS u FROM cube), r AS (SELECT count(*) AS n, avg(u) AS m, stddev_pop(u) AS sd, min(u) AS lo, max(u) AS hi, avg((u < .3)::INT) AS l, avg((u > .7)::INT) AS h FROM s) SELECT n, {_r('m', 'mean')}, {_r('sd', 'std')}, {_r('lo', 'min')}, {_r('hi', 'max')}, {_r('l', 'low')}, {_r('h', 'high')}, {_r('1 - l - h', 'middle')}, CASE WHEN m < .3 THEN 'reliable' WHEN m < .6 THEN 'check uncertain places' ELSE 'collect more samples' END AS advice FROM r")
def uncertainty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(U.uncertainty_report(fixture_cube(spark, sf_dir).select(F.element_at("spec", 1).alias("total"))))


@query(
    f"""WITH {CUBE_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM cube), f AS (SELECT id, r, n, n // 6 AS size, k FROM r, range(5) q(k))
    SELECT id, k::BIGINT AS fold, CASE WHEN r >= k * size AND r < k * size + size THEN 'train' ELSE 'test' END AS part FROM f WHERE (r >= k * size AND r < k * size + size) OR (r >= k * size + size + 3 AND r < least(k * size + 2 * size + 3, n))"""
)
def sliding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_folds(fixture_cube(spark, sf_dir).select("id", F.col("id").alias("t")), 5, 3)


@query(f"WITH {CUBE_SQL} SELECT t.id AS test_id, p.id FROM cube t, cube p WHERE t.id <> p.id AND pow(t.row - p.row, 2) + pow(t.col - p.col, 2) <= 9")
def buffered_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir)
    return S.buffered_out(c, c.select((F.col("id") + 0).alias("id"), "row", "col"), 3.0)


@query(
    f"""WITH {CUBE_SQL}, a AS (SELECT unnest(spec) AS x FROM cube), b AS (SELECT x FROM a UNION ALL SELECT x * 1.1 FROM a)
    SELECT (SELECT count(*) FROM cube) AS n_before, 2 * (SELECT count(*) FROM cube) AS n_after, 2.0::DOUBLE AS ratio, {_r('(SELECT avg(x) FROM b) - (SELECT avg(x) FROM a)', 'mean_change')}, {_r('(SELECT stddev_pop(x) FROM b) - (SELECT stddev_pop(x) FROM a)', 'std_change')}"""
)
def augmentation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture_cube(spark, sf_dir).select("id", "spec")
    return _round(S.augmentation_statistics(c, S.augment(c, [{"brightness": 1.1}])))


# Label maps, regions, landscapes.

_WINDOW = "o AS (SELECT r AS dr, c AS dc FROM range(-{h}, {h} + 1) a(r), range(-{h}, {h} + 1) b(c))"


@query(
    f"""WITH {LABELMAP_SQL}, {_WINDOW.format(h=2)}, s AS (SELECT min(cls) AS lo, max(cls) AS hi FROM labelmap), n AS (SELECT row, col, (cls - lo) / (hi - lo)::DOUBLE AS v FROM labelmap, s),
    w AS (SELECT a.row, a.col, b.v, exp(-(dr * dr + dc * dc) / 2.0) * exp(-pow(b.v - a.v, 2) / 0.02) AS w FROM n a, o, n b WHERE b.row = a.row + dr AND b.col = a.col + dc), f AS (SELECT row, col, lo + sum(w * v) / sum(w) * (hi - lo) AS v FROM w, s GROUP BY row, col, lo, hi)
    SELECT row, col, min_by(cls, (round(abs(v - cls), 9), cls)) AS cls FROM f, (SELECT DISTINCT cls FROM labelmap) GROUP BY 1, 2"""
)
def bilateral_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bilateral_filter(fixture_labelmap(spark, sf_dir))


@query(f"WITH {CUBE_SQL} SELECT label AS cls, count(*) AS n, {_r('avg(spec[1])', 'mean')}, {_r('stddev_pop(spec[1])', 'std')} FROM cube GROUP BY 1")
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.class_means(fixture_labelmap(spark, sf_dir), _band(spark, sf_dir)))


#: Four-connected patches by their least place, as recursive SQL.
_PATCH = """RECURSIVE {cte}, nb AS (SELECT a.row * 1048576 + a.col AS i, b.row * 1048576 + b.col AS j FROM labelmap a JOIN labelmap b ON a.cls = b.cls AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    reach AS (SELECT row * 1048576 + col AS i, row * 1048576 + col AS p FROM labelmap UNION SELECT j, p FROM reach JOIN nb USING (i)), part AS (SELECT i // 1048576 AS row, i % 1048576 AS col, min(p) AS patch FROM reach GROUP BY i)"""


@query(
    f"WITH {_PATCH.format(cte=LABELMAP_SQL)}, side AS (SELECT a.patch AS a, b.patch AS b FROM part a JOIN part b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col) WHERE a.patch <> b.patch) SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS length FROM side GROUP BY 1, 2"
)
def region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.region_graph(K.components(fixture_labelmap(spark, sf_dir), eight=False, tile=64))
    near = lambda c: (F.shiftright(c, 31) * 1048576 + F.col(c) % (1 << 31)).alias(c)
    return g.select(near("a"), near("b"), "length")


@query()
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_similar(fixture_labelmap(spark, sf_dir), _band(spark, sf_dir), 0.05)


@query()
def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_uneven(fixture_labelmap(spark, sf_dir), _band(spark, sf_dir), 0.05)


@query()
def watershed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.watershed_features(_band(spark, sf_dir)))


@query(
    f"""WITH {LABELMAP_SQL}, {_WINDOW.format(h=3)}, e AS (SELECT DISTINCT a.row, a.col FROM labelmap a, o, labelmap b WHERE a.cls IN (1, 2, 3) AND b.row = a.row + dr AND b.col = a.col + dc AND dr * dr + dc * dc <= 9 AND b.cls <> a.cls)
    SELECT row, col, {_r('(1 + cls % 3) * CASE WHEN e.row IS NULL THEN 1.0 ELSE 1.5 END', 'r')} FROM labelmap LEFT JOIN e USING (row, col)"""
)
def edge_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture_labelmap(spark, sf_dir)
    return _round(R.edge_resistance(m.select("row", "col", (1 + F.col("cls") % 3).cast("double").alias("r")), m, (1, 2, 3)))


_G1 = T.gaussian(1.0)


@query(
    f"""WITH {CUBE_SQL}, {_BAND}, k AS (SELECT * FROM (VALUES {", ".join(f"({r}, {c}, {w!r}::DOUBLE)" for r, c, w in _G1)}) t(dr, dc, k))
    SELECT a.row, a.col, {_r('sum(k * b.v)', 'r')} FROM grid a, dim, k, grid b WHERE b.row = CASE WHEN a.row + dr < 0 THEN -(a.row + dr) - 1 WHEN a.row + dr >= h THEN 2 * h - 1 - (a.row + dr) ELSE a.row + dr END
    AND b.col = CASE WHEN a.col + dc < 0 THEN -(a.col + dc) - 1 WHEN a.col + dc >= w THEN 2 * w - 1 - (a.col + dc) ELSE a.col + dc END GROUP BY 1, 2"""
)
def smooth_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.smooth_resistance(_band(spark, sf_dir).withColumnRenamed("v", "r")))


_MAPS = f"{LABELMAP_SQL}, later AS (SELECT row, col, CASE WHEN (row + col) % 7 = 0 THEN (cls + 1) % 10 ELSE cls END AS cls FROM labelmap)"


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_labelmap(spark, sf_dir).withColumn("cls", F.when((F.col("row") + F.col("col")) % 7 == 0, (F.col("cls") + 1) % 10).otherwise(F.col("cls")))


@query(f"WITH {_MAPS}, m AS (SELECT a.cls AS a, b.cls AS b FROM labelmap a JOIN later b USING (row, col)) SELECT {_r('avg((a <> b)::INT)', 'change_ratio')}, list_sort(list(DISTINCT a) FILTER (a <> b)) AS source_classes, list_sort(list(DISTINCT b) FILTER (a <> b)) AS target_classes FROM m")
def change_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.change_drivers(fixture_labelmap(spark, sf_dir), _later(spark, sf_dir)))


@query(
    f"""WITH {LABELMAP_SQL}, s AS (SELECT avg((cls IN (1, 2))::INT) AS w, avg((cls = 3)::INT) AS v, avg((cls IN (1, 2, 3, 4))::INT) AS a FROM labelmap), p AS (SELECT cls, count(*) / (SELECT count(*) FROM labelmap) AS p FROM labelmap GROUP BY 1), h AS (SELECT least(-sum(p * ln(p)) / 2, 1) AS b FROM p WHERE cls <> 0)
    SELECT {_r('least(w * 2, 1)', 'water_conservation')}, {_r('least(v * 3, 1)', 'water_purification')}, {_r('b', 'biodiversity_support')}, {_r('least(a * 1.5, 1)', 'flood_control')}, {_r('a', 'climate_regulation')}, {_r('least(v * b * 2, 1)', 'carbon_storage')} FROM s, h"""
)
def wetland_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.wetland_functions(fixture_labelmap(spark, sf_dir)))


@query()
def landscape_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.compare_landscapes({"2020": fixture_labelmap(spark, sf_dir), "2021": _later(spark, sf_dir)}))


@query()
def landscape_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.temporal_changes({"2020": fixture_labelmap(spark, sf_dir), "2021": _later(spark, sf_dir)})["trends"])


@query(
    f"""WITH {LABELMAP_SQL}, dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM labelmap), {_WINDOW.format(h=1)}, m AS (SELECT a.row, a.col, any_value(a.cls) AS was, quantile_cont(b.cls, .5)::BIGINT AS cls FROM labelmap a, dim, o, labelmap b WHERE b.row = CASE WHEN a.row + dr < 0 THEN -(a.row + dr) - 1 WHEN a.row + dr >= h THEN 2 * h - 1 - (a.row + dr) ELSE a.row + dr END
    AND b.col = CASE WHEN a.col + dc < 0 THEN -(a.col + dc) - 1 WHEN a.col + dc >= w THEN 2 * w - 1 - (a.col + dc) ELSE a.col + dc END GROUP BY 1, 2)
    SELECT 1::BIGINT AS step, 'median' AS name, sum((was <> cls)::INT)::BIGINT AS changed, count(*) AS total, {_r('avg((was <> cls)::INT)', 'ratio')} FROM m"""
)
def postprocessing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(O.Pipeline([("median", {"size": 3})]).history(fixture_labelmap(spark, sf_dir)))


@query()
def postprocessing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture_labelmap(spark, sf_dir)
    return _round(O.compare_methods(m, ("conservative", "wetland"), truth=m))


@query()
def spatial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(O.spatial_features(_band(spark, sf_dir), sizes=(3,)))


@query()
def texture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(O.texture_features(_band(spark, sf_dir), methods=("lbp", "statistical")))


@query()
def structural_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture_labelmap(spark, sf_dir)
    table = K.patches(K.components(m))
    edges = L.structural_edges(table, 3.0, least=0.6)
    connect = P.connectance(table.where("cls <> 0"), edges).join(F.broadcast(P.mean_functional(edges)))
    return _round(P.advice(P.synthesis(P.metrics_of(m), connect)).drop("advice"))


@query(f"WITH {CUBE_SQL}, {_BAND}, {_LAP.format(src='cube')} SELECT {_r('stddev_pop(l) / 6', 'noise')} FROM l, dim WHERE b = 0 AND {_MID}")
def band_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(N.noise_level(_band(spark, sf_dir)).select("noise"))
