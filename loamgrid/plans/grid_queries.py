"""Queries of stencils, label maps, components, landscape, sequences and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import components as K
from loamgrid.operators import landscape as L
from loamgrid.operators import sampling as P
from loamgrid.operators import stencil as S
from loamgrid.operators import temporal as T
from loamgrid.plans.registry import query
from loamgrid.scene import CUBE_SQL, LABELMAP_SQL, SERIES_SQL, fixture_cube, fixture_labelmap, fixture_series, r6


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _round(df: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*(r6(F.col(c)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("integer", "long", "short") else F.col(c) for c, k in kinds.items()))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_cube(spark, sf_dir).select("row", "col", F.element_at("spec", 1).alias("v"))


_SIZE = "dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM grid)"
_GRID = f"{CUBE_SQL}, grid AS (SELECT row, col, spec[1] AS v, label AS cls FROM cube), {_SIZE}"
_MIRROR = "CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"


def _near(kernel: list[tuple[int, int, float]], reflect: bool = True, name: str = "near", source: str = "grid") -> str:
    """SQL of a window: (row, col, dr, dc, k, v, cls) of every target and offset."""
    rows = ", ".join(f"({r}, {c}, {w!r}::DOUBLE)" for r, c, w in kernel)
    at = (lambda x, n: _MIRROR.format(x=x, n=n)) if reflect else (lambda x, n: x)
    return f"""{name} AS (SELECT t.row, t.col, o.dr, o.dc, o.k, s.v, s.cls FROM {source} t, dim, (VALUES {rows}) o(dr, dc, k), {source} s
        WHERE s.row = {at('(t.row + o.dr)', 'h')} AND s.col = {at('(t.col + o.dc)', 'w')})"""


def _edge(kernel, other=None) -> str:
    a, b = kernel, other or S.transpose(kernel)
    w: dict[tuple[int, int], list[float]] = {}
    for r, c, x in a:
        w.setdefault((r, c), [0.0, 0.0])[0] = x
    for r, c, x in b:
        w.setdefault((r, c), [0.0, 0.0])[1] = x
    pick = lambda i: "CASE " + " ".join(f"WHEN dr = {r} AND dc = {c} THEN {x[i]}" for (r, c), x in w.items()) + " END * v"
    return f"""WITH {_GRID}, {_near([(r, c, 1.0) for r, c in w])}, g AS (SELECT row, col, sum({pick(0)}) AS gr, sum({pick(1)}) AS gc FROM near GROUP BY 1, 2)
        SELECT row, col, {_r('gr', 'gr')}, {_r('gc', 'gc')}, {_r('sqrt(gr * gr + gc * gc)', 'magnitude')} FROM g"""


query(_edge(S.SOBEL), name="sobel")(lambda s, d: _round(S.sobel(_grid(s, d))))
query(_edge(S.PREWITT), name="prewitt")(lambda s, d: _round(S.prewitt(_grid(s, d))))
query(_edge(*S.ROBERTS), name="roberts")(lambda s, d: _round(S.roberts(_grid(s, d))))
query(f"WITH {_GRID}, {_near(S.LAPLACE)} SELECT row, col, {_r('sum(k * v)', 'laplace')} FROM near GROUP BY 1, 2", name="laplace")(lambda s, d: _round(S.laplace(_grid(s, d))))

_D = "CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"


@query(
    f"""WITH {_GRID}, g AS (SELECT row, col, {_D.format(w='(PARTITION BY col ORDER BY row)')} AS gr, {_D.format(w='(PARTITION BY row ORDER BY col)')} AS gc FROM grid)
    SELECT row, col, {_r('gr', 'gr')}, {_r('gc', 'gc')}, {_r('sqrt(gr * gr + gc * gc)', 'magnitude')}, {_r('atan2(gr, gc)', 'direction')} FROM g"""
)
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.gradient(_grid(spark, sf_dir)))


@query(
    f"""WITH {_GRID}, {_near(S.box(5))} SELECT row, col, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'std')}, {_r('min(v)', 'min')}, {_r('max(v)', 'max')}, {_r('median(v)', 'median')}, {_r('max(v) - min(v)', 'range')} FROM near GROUP BY 1, 2"""
)
def local_stats5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.local_statistics(_grid(spark, sf_dir)))


@query(
    f"""WITH {_GRID}, {_near(S.box(7))}, m AS (SELECT row, col, avg(v) AS m, var_pop(v) AS va FROM near GROUP BY 1, 2)
    SELECT row, col, {_r('any_value(va)', 'variance')}, {_r('avg(pow(v - m, 3)) / pow(any_value(va), 1.5)', 'skewness')}, {_r('avg(pow(v - m, 4)) / pow(any_value(va), 2) - 3', 'kurtosis')},
    {_r('max(v) - min(v)', 'range')}, {_r('avg(abs(v - m))', 'mad')} FROM near JOIN m USING (row, col) GROUP BY 1, 2"""
)
def texture_stats7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.texture_statistics(_grid(spark, sf_dir)))


@query(f"WITH {_GRID}, {_near(S.box(7))}, c AS (SELECT row, col, round_even(v * 10, 0) AS b, count(*) / 49.0::DOUBLE AS p FROM near GROUP BY 1, 2, 3) SELECT row, col, {_r('-sum(p * log2(p + 1e-10))', 'entropy')} FROM c GROUP BY 1, 2")
def local_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.local_entropy(_grid(spark, sf_dir)))


_BITS = [(r, c, float(1 << i)) for i, (r, c) in enumerate(S.LBP)]


@query(f"WITH {_GRID}, {_near(_BITS, False)} SELECT n.row, n.col, (CASE WHEN count(*) = 8 THEN sum(CASE WHEN n.v >= g.v THEN k ELSE 0 END) ELSE 0 END)::BIGINT AS lbp FROM near n JOIN grid g ON n.row = g.row AND n.col = g.col GROUP BY 1, 2")
def simple_lbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.simple_lbp(_grid(spark, sf_dir)))


@query(
    f"""WITH {_GRID}, q AS (SELECT row, col, floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 7)::BIGINT AS v FROM grid),
    pr AS (SELECT a.row, a.col, a.v AS i, b.v AS j FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1),
    n AS (SELECT t.row, t.col, i, j, count(*) AS n FROM q t, dim, pr p WHERE t.row BETWEEN 3 AND h - 4 AND t.col BETWEEN 3 AND w - 4 AND p.row BETWEEN t.row - 3 AND t.row + 3 AND p.col BETWEEN t.col - 3 AND t.col + 2 GROUP BY 1, 2, 3, 4),
    y AS (SELECT row, col, i, j, n FROM n UNION ALL SELECT row, col, j, i, n FROM n), p AS (SELECT row, col, i, j, n / sum(n) OVER (PARTITION BY row, col) AS p FROM y),
    m AS (SELECT row, col, sum(p * i) AS m, sum(p * i * i) - pow(sum(p * i), 2) AS va FROM p GROUP BY 1, 2)
    SELECT row, col, {_r('sum(p * pow(i - j, 2))', 'contrast')}, {_r('sum(p * abs(i - j))', 'dissimilarity')}, {_r('sum(p / (1 + pow(i - j, 2)))', 'homogeneity')},
    {_r('(sum(p * i * j) - pow(any_value(m), 2)) / any_value(va)', 'correlation')} FROM p JOIN m USING (row, col) GROUP BY 1, 2"""
)
def glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(S.glcm_features(_grid(spark, sf_dir), 0, 1, levels=8).drop("energy", "asm"))


# Label maps.


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_labelmap(spark, sf_dir)


_MODE = "(SELECT row, col, cls, n, total FROM (SELECT row, col, cls, count(*) AS n, sum(count(*)) OVER (PARTITION BY row, col) AS total, row_number() OVER (PARTITION BY row, col ORDER BY count(*) DESC, cls) AS r FROM near GROUP BY 1, 2, 3) WHERE r = 1)"

query(f"WITH {_GRID}, {_near(S.box(3))} SELECT row, col, median(cls)::BIGINT AS cls FROM near GROUP BY 1, 2", name="median3")(lambda s, d: _round(S.median_filter(_labels(s, d), 3)))
query(
    f"WITH {_GRID}, {_near(S.box(5), False)} SELECT g.row, g.col, CASE WHEN total = 25 AND n / 25.0 >= 0.2 THEN m.cls ELSE g.cls END AS cls FROM grid g JOIN {_MODE} m ON g.row = m.row AND g.col = m.col",
    name="adaptive_filter",
)(lambda s, d: _round(S.majority_filter(_labels(s, d), 5, 0.2)))
query(
    f"WITH {_GRID}, {_near(S.gaussian(0.8))}, s AS (SELECT row, col, cls, round(sum(k), 12) AS s FROM near GROUP BY 1, 2, 3) SELECT row, col, cls FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY s DESC, cls) AS r FROM s) WHERE r = 1",
    name="gaussian_classes",
)(lambda s, d: _round(S.gaussian_filter(_labels(s, d), 0.8)))
query(
    f"WITH {_GRID}, {_near(S.box(3), False)} SELECT n.row, n.col, {_r('CASE WHEN count(*) = 9 THEN avg((n.cls = g.cls)::INT) ELSE 0 END', 'homogeneity')} FROM near n JOIN grid g ON n.row = g.row AND n.col = g.col GROUP BY 1, 2",
    name="homogeneity",
)(lambda s, d: _round(S.homogeneity(_labels(s, d), 3)))
query(
    f"WITH {_GRID}, {_near(S.box(5))}, c AS (SELECT row, col, cls, count(*) / 25.0::DOUBLE AS p FROM near GROUP BY 1, 2, 3) SELECT row, col, min_by(cls, (-p, cls)) AS dominant, {_r('max(p)', 'ratio')}, count(*) AS kinds, {_r('-sum(p * log2(p))', 'entropy')} FROM c GROUP BY 1, 2",
    name="window_diversity",
)(lambda s, d: _round(S.window_diversity(_labels(s, d), 5)))

_MASKED = f"{_GRID}, mask AS (SELECT row, col, (cls IN (1, 2, 3, 4))::BIGINT AS v, cls FROM grid)"


def _ero(source: str, name: str, fn: str = "min", flip: bool = False) -> str:
    e = [(-r, -c, w) if flip else (r, c, w) for r, c, w in S.disk(1)]
    return f"{_near(e, False, f'n_{name}', source)}, {name} AS (SELECT row, col, {fn}(v)::BIGINT AS v, 0 AS cls FROM n_{name} GROUP BY 1, 2)"


query(f"WITH {_MASKED}, {_ero('mask', 'a')}, {_ero('a', 'b', 'max', True)} SELECT row, col, v FROM b", name="binary_open")(lambda s, d: _round(S.opening(S.mask_of(_labels(s, d), 1, 2, 3, 4), S.disk(1))))
query(f"WITH {_MASKED}, {_ero('mask', 'a', 'max', True)}, {_ero('a', 'b')} SELECT row, col, v FROM b", name="binary_close")(lambda s, d: _round(S.closing(S.mask_of(_labels(s, d), 1, 2, 3, 4), S.disk(1))))
query(f"WITH {_MASKED}, {_ero('mask', 'a')}, {_ero('mask', 'b', 'max', True)} SELECT row, col, (b.v - a.v)::BIGINT AS v FROM a JOIN b USING (row, col)", name="binary_gradient")(lambda s, d: _round(S.morphology(S.mask_of(_labels(s, d), 1, 2, 3, 4), "gradient", S.disk(1))))

_NEXT = "(a.row = b.row AND a.col + 1 = b.col OR a.row + 1 = b.row AND a.col = b.col)"
query(
    f"WITH {LABELMAP_SQL}, p AS (SELECT a.cls AS a, b.cls AS b FROM labelmap a JOIN labelmap b ON {_NEXT}), k AS (SELECT DISTINCT cls FROM labelmap) SELECT cls, {_r('100.0 * count(*) FILTER (a = cls AND b = cls) / count(*)', 'ai')} FROM k JOIN p ON a = cls OR b = cls GROUP BY cls",
    name="aggregation_index",
)(lambda s, d: _round(L.aggregation_index(_labels(s, d))))
query(
    f"WITH {LABELMAP_SQL}, l AS (SELECT * FROM labelmap WHERE cls <> 0), m AS (SELECT count(DISTINCT cls) AS m FROM l) SELECT {_r('100.0 * count(DISTINCT (least(a.cls, b.cls), greatest(a.cls, b.cls))) / (any_value(m) * (any_value(m) + 1) / 2)', 'iji')} FROM l a JOIN l b ON {_NEXT}, m",
    name="iji",
)(lambda s, d: _round(L.interspersion(_labels(s, d))))
query(
    f"""WITH {LABELMAP_SQL}, c AS (SELECT cls, count(*) / sum(count(*)) OVER () AS p FROM labelmap GROUP BY 1), s AS (SELECT count(*) AS r, -sum(p * ln(p)) AS sh, 1 - sum(p * p) AS si FROM c WHERE cls <> 0)
    SELECT r AS richness, {_r('sh', 'shdi')}, {_r('si', 'sidi')}, {_r('sh / ln(r)', 'shei')}, {_r('si / (1 - 1 / r)', 'siei')} FROM s""",
    name="shannon_simpson",
)(lambda s, d: _round(L.diversity(_labels(s, d))))

_PATCH = f"""{LABELMAP_SQL}, px AS (SELECT row * 2147483648 + col AS id, row, col, cls FROM labelmap),
    adj AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON a.cls = b.cls AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
    reach AS (SELECT id AS a, id AS b FROM px UNION SELECT reach.a, adj.b FROM reach JOIN adj ON reach.b = adj.a),
    parts AS (SELECT px.row, px.col, px.cls, m.patch FROM px JOIN (SELECT a, min(b) AS patch FROM reach GROUP BY a) m ON px.id = m.a),
    dim AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM px),
    side AS (SELECT p.row, p.col, count(q.row) FILTER (q.patch = p.patch) AS same, count(q.row) AS n FROM parts p LEFT JOIN parts q ON abs(p.row - q.row) + abs(p.col - q.col) = 1 GROUP BY 1, 2),
    patch AS (SELECT cls, patch, count(*) AS pixels, sum(4 - same) AS sides, count(*) FILTER (same = n) AS core, avg(row) AS y, avg(col) AS x, sqrt(var_pop(row) + var_pop(col)) AS gyrate,
        count(*)::DOUBLE AS area, sum(4 - same) / (2 * sqrt(pi() * count(*))) AS shape FROM parts JOIN side USING (row, col) GROUP BY 1, 2)"""
_WR = f"WITH RECURSIVE {_PATCH}"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.components(_labels(spark, sf_dir), tile=8)


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.patches(_parts(spark, sf_dir))


def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).agg(F.count(F.lit(1)).cast("double").alias("ta"))


query(f"{_WR} SELECT row, col, cls, patch FROM parts", name="patches")(lambda s, d: _round(_parts(s, d)))
query(
    f"""{_WR} SELECT cls, patch, pixels, area, sides::DOUBLE AS perimeter, core::DOUBLE AS core, {_r('y', 'y')}, {_r('x', 'x')}, {_r('gyrate', 'gyrate')}, {_r('shape', 'shape')},
    {_r('CASE WHEN pixels > 1 THEN 2 * ln(sides / 4) / ln(pixels) ELSE 0 END', 'fractal')} FROM patch""",
    name="patch_metrics",
)(lambda s, d: _round(_patches(s, d).select("cls", "patch", "pixels", F.col("area").cast("double").alias("area"), F.col("perimeter").cast("double").alias("perimeter"), F.col("core").cast("double").alias("core"), F.col("row").alias("y"), F.col("col").alias("x"), "gyrate", "shape", "fractal")))

_CM = ["np", "ca", "pland", "lpi", "te", "ed", "lsi", "msi", "awmsi", "mps", "pssd", "tca", "cpland", "dcad", "pscov", "division", "split"]
query(
    f"""{_WR}, t AS (SELECT count(*)::DOUBLE AS ta FROM labelmap) SELECT cls, count(*) AS np, {_r('sum(area)', 'ca')}, {_r('100 * sum(area) / any_value(ta)', 'pland')}, {_r('100 * max(area) / any_value(ta)', 'lpi')}, {_r('sum(sides)::DOUBLE', 'te')},
    {_r('sum(sides) / any_value(ta)', 'ed')}, {_r('sum(sides) / (2 * sqrt(pi() * sum(area)))', 'lsi')}, {_r('avg(shape)', 'msi')}, {_r('sum(area * shape) / sum(area)', 'awmsi')}, {_r('avg(area)', 'mps')}, {_r('stddev_pop(area)', 'pssd')},
    {_r('sum(core)::DOUBLE', 'tca')}, {_r('100 * sum(core) / any_value(ta)', 'cpland')}, {_r('count(*) FILTER (core > 0) / any_value(ta)', 'dcad')}, {_r('100 * stddev_pop(area) / avg(area)', 'pscov')},
    {_r('1 - sum(area * area) / pow(any_value(ta), 2)', 'division')}, {_r('pow(any_value(ta), 2) / sum(area * area)', 'split')} FROM patch, t WHERE cls <> 0 GROUP BY cls""",
    name="class_metrics_landscape",
)(lambda s, d: _round(L.class_metrics(_patches(s, d), _area(s, d)).select("cls", *(F.col(c).cast("long" if c == "np" else "double").alias(c) for c in _CM))))
query(
    f"""{_WR}, t AS (SELECT count(*)::DOUBLE AS ta FROM labelmap) SELECT {_r('any_value(ta)', 'ta')}, count(*) AS np, {_r('count(*) / any_value(ta)', 'pd')}, {_r('100 * max(area) / any_value(ta)', 'lpi')}, {_r('sum(sides)::DOUBLE', 'te')}, {_r('sum(sides) / any_value(ta)', 'ed')},
    {_r('avg(area)', 'mps')}, {_r('stddev_pop(area)', 'pssd')}, count(DISTINCT cls) AS pr, {_r('sum(sides) / (2 * sqrt(pi() * any_value(ta)))', 'lsi')}, {_r('avg(shape)', 'msi')}, {_r('sum(area * shape) / sum(area)', 'awmsi')},
    {_r('100 * stddev_pop(area) / avg(area)', 'pscov')}, {_r('count(DISTINCT cls) / any_value(ta)', 'prd')} FROM patch, t WHERE cls <> 0""",
    name="landscape_metrics",
)(lambda s, d: _round(L.landscape_metrics(_patches(s, d), _area(s, d)).withColumn("te", F.col("te").cast("double"))))
_D2 = "sqrt(pow(p.y - q.y, 2) + pow(p.x - q.x, 2))"
query(f"{_WR} SELECT p.patch, {_r(f'sum(q.area / pow({_D2}, 2))', 'prox')} FROM patch p JOIN patch q ON p.cls = q.cls AND p.cls <> 0 AND p.patch <> q.patch AND {_D2} <= 6 AND {_D2} > 0 GROUP BY 1", name="proximity")(lambda s, d: _round(L.proximity(_patches(s, d), 6.0)))
query(
    f"{_WR} SELECT p.patch, {_r('coalesce(avg((least(p.area, q.area) / greatest(p.area, q.area) + 1 / (1 + abs(p.shape - q.shape))) / 2), 0)', 'simi')} FROM patch p LEFT JOIN patch q ON p.cls = q.cls AND p.patch <> q.patch WHERE p.cls <> 0 GROUP BY 1",
    name="similarity",
)(lambda s, d: _round(L.similarity(_patches(s, d))))
query(f"{_WR} SELECT p.patch, {_r(f'min({_D2})', 'nn')} FROM patch p JOIN patch q ON p.cls <> 0 AND q.cls <> 0 AND p.patch <> q.patch AND {_D2} <= 5 AND {_D2} > 0 GROUP BY 1", name="nn_distance")(lambda s, d: _round(L.nearest_distance(_patches(s, d), 5.0)))
_EDGE = f"e AS (SELECT p.patch AS a, q.patch AS b, (1 - {_D2} / 3) * sqrt(p.area * q.area) / greatest(p.area, q.area) AS w FROM patch p JOIN patch q ON p.cls <> 0 AND q.cls <> 0 AND p.patch < q.patch AND {_D2} <= 3 AND {_D2} > 0)"
query(f"{_WR}, {_EDGE} SELECT a, b, {_r('w', 'w')} FROM e WHERE w > 0.4", name="patch_edges")(lambda s, d: _round(L.structural_edges(_patches(s, d), 3.0, least=0.4)))
query(
    f"{_WR}, {_EDGE}, l AS (SELECT a, b FROM e WHERE w > 0.6 UNION SELECT b, a FROM e WHERE w > 0.6), gr AS (SELECT a, a AS b FROM l UNION SELECT gr.a, l.b FROM gr JOIN l ON gr.b = l.a) SELECT a AS node, min(b) AS comp FROM gr GROUP BY 1",
    name="graph_components",
)(lambda s, d: _round(K.graph_components(L.structural_edges(_patches(s, d), 3.0, least=0.6).select("a", "b"))))
query(
    f"""{_WR}, {_EDGE}, l AS (SELECT a AS patch, w FROM e WHERE w > 0.4 UNION ALL SELECT b, w FROM e WHERE w > 0.4), g AS (SELECT p.patch, any_value(area) AS area, count(w) AS degree, coalesce(sum(w), 0) AS strength FROM patch p LEFT JOIN l ON p.patch = l.patch WHERE cls <> 0 GROUP BY 1)
    SELECT patch, degree, {_r('strength', 'strength')}, {_r('(area / sum(area) OVER () + strength / sum(strength) OVER () + degree / (count(*) OVER () - 1)) / 3', 'importance')} FROM g""",
    name="structural_connectivity",
)(lambda s, d: _round(L.node_strength(p := _patches(s, d), L.structural_edges(p, 3.0, least=0.4))))
query(
    f"WITH {LABELMAP_SQL} SELECT row, col, (CASE cls WHEN 1 THEN 1 WHEN 2 THEN 2.5 WHEN 3 THEN 8 ELSE 5 END)::DOUBLE AS r FROM labelmap",
    name="resistance_map",
)(lambda s, d: L.resistance(_labels(s, d), s.createDataFrame([(1, 1.0), (2, 2.5), (3, 8.0)], "class_id long, resistance double")))
query(
    f"""WITH {LABELMAP_SQL} SELECT count(*) FILTER (cls IN (1, 2)) AS water, count(*) FILTER (cls = 3) AS vegetation, count(*) FILTER (cls = 4) AS mudflat, count(*) AS n,
    {_r('avg((cls IN (1, 2, 3, 4))::INT)', 'wetland_share')}, 3::BIGINT AS types FROM labelmap""",
    name="wetland_summary",
)(lambda s, d: _round(L.wetland_summary(_labels(s, d))))
_WC = """WITH RECURSIVE lm AS (SELECT vec_id // 20 AS row, vec_id % 20 AS col, label AS cls FROM embeddings), px AS (SELECT row * 2147483648 + col AS id, row, col, k FROM lm, (VALUES (1), (2)) t(k) WHERE (k = 1 AND cls IN (1, 2)) OR (k = 2 AND cls IN (1, 2, 3, 4))),
    adj AS (SELECT a.k, a.id AS a, b.id AS b FROM px a JOIN px b ON a.k = b.k AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
    reach AS (SELECT k, id AS a, id AS b FROM px UNION SELECT reach.k, reach.a, adj.b FROM reach JOIN adj ON reach.b = adj.a AND reach.k = adj.k),
    c AS (SELECT k, p, count(*) AS n FROM (SELECT k, a, min(b) AS p FROM reach GROUP BY 1, 2) GROUP BY 1, 2)"""
query(f"{_WC} SELECT {_r('max(n) FILTER (k = 1) / sum(n) FILTER (k = 1)', 'water_connectivity')}, {_r('1 - pow(max(n) FILTER (k = 2) / sum(n) FILTER (k = 2), 2)', 'fragmentation')} FROM c", name="wetland_patches")(lambda s, d: _round(L.wetland_patches(_labels(s, d), tile=8)))
_RIM = "(SELECT DISTINCT a.row, a.col FROM labelmap a JOIN labelmap b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.cls IN {ids} WHERE a.cls NOT IN {ids})"
query(f"WITH {LABELMAP_SQL}, a AS {_RIM.format(ids='(1, 2)')}, b AS {_RIM.format(ids='(5, 6)')} SELECT {_r('(SELECT count(*) FROM a JOIN b USING (row, col)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b))', 'ecotone')}", name="ecotone_index")(lambda s, d: _round(L.ecotone_index(_labels(s, d))))
query(
    f"""{_WR}, good AS (SELECT patch FROM patch WHERE pixels >= 3), k AS (SELECT row, col, cls FROM parts WHERE patch IN (SELECT patch FROM good)), t AS (SELECT row, col FROM parts WHERE patch NOT IN (SELECT patch FROM good))
    SELECT row, col, cls FROM k UNION ALL SELECT row, col, cls FROM (SELECT t.row, t.col, k.cls, row_number() OVER (PARTITION BY t.row, t.col ORDER BY pow(t.row - k.row, 2) + pow(t.col - k.col, 2), k.row, k.col) AS r FROM t, k) WHERE r = 1""",
    name="small_patch_removal",
)(lambda s, d: _round(K.small_patch_removal(_labels(s, d), 3, tile=8)))
query(
    """WITH RECURSIVE lm AS (SELECT vec_id // 20 AS row, vec_id % 20 AS col, (label < 7)::INT AS cls FROM embeddings), dim AS (SELECT max(row) AS h, max(col) AS w FROM lm), px AS (SELECT row * 2147483648 + col AS id, row, col FROM lm WHERE cls = 0),
    adj AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), reach AS (SELECT id AS a, id AS b FROM px UNION SELECT reach.a, adj.b FROM reach JOIN adj ON reach.b = adj.a),
    p AS (SELECT id, row, col, m.p FROM px JOIN (SELECT a, min(b) AS p FROM reach GROUP BY 1) m ON id = a), hole AS (SELECT p FROM p, dim GROUP BY p HAVING count(*) <= 5 AND NOT bool_or(row = 0 OR col = 0 OR row = h OR col = w))
    SELECT lm.row, lm.col, (CASE WHEN p.p IN (SELECT p FROM hole) THEN 1 ELSE cls END)::BIGINT AS cls FROM lm LEFT JOIN p ON lm.row = p.row AND lm.col = p.col""",
    name="hole_fill",
)(lambda s, d: _round(K.fill_holes(_labels(s, d).select("row", "col", (F.col("cls") < 7).cast("int").alias("cls")), 1, 5, tile=8)))

# Sequences.

_LAG = "SELECT *, lag(cls) OVER (PARTITION BY unit ORDER BY t) AS was FROM series"
_RULES = [("click", "purchase"), ("view", "error")]
query(f"WITH {SERIES_SQL}, l AS ({_LAG}) SELECT t, count(*) FILTER (was <> cls) AS changed, count(*) AS units, {_r('avg((was <> cls)::INT)', 'rate')} FROM l WHERE was IS NOT NULL GROUP BY t", name="change_rate")(lambda s, d: _round(T.change_rate(fixture_series(s, d))))
query(f"WITH {SERIES_SQL}, l AS ({_LAG}) SELECT was, cls, count(*) AS n FROM l WHERE was <> cls GROUP BY 1, 2", name="transition_matrix")(lambda s, d: _round(T.transitions(fixture_series(s, d))))
query(f"WITH {SERIES_SQL}, l AS ({_LAG}) SELECT was, cls, count(*) AS n FROM l WHERE was <> cls GROUP BY 1, 2 ORDER BY n DESC, was, cls LIMIT 10", name="top_transitions")(lambda s, d: _round(T.top_transitions(fixture_series(s, d))))
query(
    f"WITH {SERIES_SQL}, l AS ({_LAG}) SELECT unit, count(*) AS dates, count(*) FILTER (was <> cls) AS changes, {_r('CASE WHEN count(*) > 1 THEN count(*) FILTER (was <> cls) / (count(*) - 1) ELSE 0 END', 'frequency')} FROM l GROUP BY unit", name="stability"
)(lambda s, d: _round(T.stability(fixture_series(s, d))))
_OSC = "o AS (SELECT unit, min(t) AS t FROM (SELECT unit, t, cls, lead(cls, 1) OVER w AS n1, lead(cls, 2) OVER w AS n2, lead(cls, 3) OVER w AS n3 FROM series WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE cls = n2 AND n1 = n3 AND cls <> n1 GROUP BY unit)"
query(f"WITH {SERIES_SQL}, {_OSC} SELECT unit, t FROM o", name="oscillations")(lambda s, d: T.oscillations(fixture_series(s, d)))
_RSQL = "r(was, cls) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ")"
_rules = lambda s: s.createDataFrame(_RULES, "was string, cls string")
query(f"WITH {SERIES_SQL}, {_RSQL}, l AS ({_LAG}) SELECT unit, t, l.was, l.cls FROM l JOIN r ON l.was = r.was AND l.cls = r.cls", name="forbidden_transitions")(lambda s, d: T.forbidden_transitions(fixture_series(s, d), _rules(s)))
query(f"WITH {SERIES_SQL}, {_RSQL}, l AS ({_LAG}) SELECT {_r('avg((r.was IS NULL)::INT)', 'validity')} FROM l LEFT JOIN r ON l.was = r.was AND l.cls = r.cls WHERE l.was <> l.cls", name="transition_validity")(lambda s, d: _round(T.validity_rate(fixture_series(s, d), _rules(s))))
query(f"WITH {SERIES_SQL}, {_RSQL}, l AS ({_LAG}) SELECT unit, t, CASE WHEN r.was IS NOT NULL THEN l.was ELSE l.cls END AS cls FROM l LEFT JOIN r ON l.was = r.was AND l.cls = r.cls", name="rule_based_correction")(lambda s, d: T.carry_back(fixture_series(s, d), _rules(s)))
query(
    f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM series), c AS (SELECT a.unit, a.t, b.cls, row_number() OVER (PARTITION BY a.unit, a.t ORDER BY count(*) DESC, b.cls) AS r FROM n a JOIN n b ON a.unit = b.unit AND abs(a.i - b.i) <= 1 GROUP BY 1, 2, 3)
    SELECT unit, t, cls FROM c WHERE r = 1""",
    name="temporal_mode3",
)(lambda s, d: T.temporal_mode(fixture_series(s, d)))
query(
    f"""WITH {SERIES_SQL}, {_OSC}, l AS ({_LAG}), f AS (SELECT unit, count(*) FILTER (was <> cls) AS ch, CASE WHEN count(*) > 1 THEN count(*) FILTER (was <> cls) / (count(*) - 1) ELSE 0 END AS fr FROM l GROUP BY unit),
    a AS (SELECT count(*) AS units, avg(fr) AS m, avg((ch = 0)::INT) AS st, avg((fr > 0.3 OR unit IN (SELECT unit FROM o))::INT) AS odd FROM f)
    SELECT units, {_r('m', 'mean_rate')}, {_r('st', 'stable')}, {_r('odd', 'anomalous')}, {_r('(st + 1 - odd) / 2', 'score')} FROM a""",
    name="temporal_consistency",
)(lambda s, d: _round(T.consistency(fixture_series(s, d))))
query(
    f"""WITH {SERIES_SQL}, m AS (SELECT t, cls AS metric, count(*)::DOUBLE AS v FROM series GROUP BY 1, 2), g AS (SELECT metric, arg_min(v, t) AS f, arg_max(v, t) AS l FROM m GROUP BY 1), r AS (SELECT *, CASE WHEN f <> 0 THEN (l - f) / f ELSE 0 END AS rate FROM g)
    SELECT metric, f AS first, l AS last, {_r('rate', 'rate')}, CASE WHEN rate > 0.1 THEN 'increasing' WHEN rate < -0.1 THEN 'decreasing' WHEN abs(rate) <= 0.05 THEN 'stable' ELSE 'slight change' END AS trend FROM r""",
    name="trend_summary",
)(lambda s, d: _round(T.trend(fixture_series(s, d).groupBy("t", F.col("cls").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")))))

# Sampling.

_DRAW = "((({k} % 999983) + 42) * 7919 % 999983)"
_RANK = f"row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format(k='id')}, id)"
_rows = lambda s, d: fixture_cube(s, d).select("id", "row", "col", "label", F.element_at("spec", 1).alias("x"))
query(
    f"WITH {CUBE_SQL}, r AS (SELECT id, label, ({_RANK} - 0.5) / count(*) OVER (PARTITION BY label) AS pos FROM cube) SELECT id, label, CASE WHEN pos < 0.7 THEN 'train' WHEN pos < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS part FROM r", name="stratified_split"
)(lambda s, d: P.stratified_split(_rows(s, d)).select("id", "label", "part"))
query(f"WITH {CUBE_SQL} SELECT id, (({_RANK} - 1) % 5)::BIGINT AS fold FROM cube", name="stratified_folds")(lambda s, d: P.folds(_rows(s, d)).select("id", "fold"))
query(f"WITH {CUBE_SQL}, b AS (SELECT id, (row // 5) * 100003 + col // 5 AS b FROM cube) SELECT id, ({_DRAW.format(k='b')} % 5)::BIGINT AS fold FROM b", name="spatial_block_folds")(lambda s, d: P.spatial_block_folds(_rows(s, d), 5).select("id", "fold"))
query(
    f"""WITH {CUBE_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM cube), f AS (SELECT id, k::BIGINT AS fold, r, n - (5 - k) * (n // 6) AS st, n // 6 AS sz FROM r, range(5) q(k))
    SELECT id, fold, CASE WHEN r >= st AND r < st + sz THEN 'test' ELSE 'train' END AS part FROM f WHERE r < st + sz AND (r >= st OR r < st - 3)""",
    name="time_folds",
)(lambda s, d: P.time_folds(_rows(s, d).withColumn("t", F.col("id")), 5, 3))
query(f"WITH {CUBE_SQL}, r AS (SELECT id, label, {_RANK} AS r FROM cube), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM cube GROUP BY label)) SELECT id, label FROM r, m WHERE r <= m", name="balance_undersample")(lambda s, d: P.undersample(_rows(s, d)).select("id", "label"))
query(
    f"WITH {CUBE_SQL}, r AS (SELECT id, label, {_RANK} AS r, count(*) OVER (PARTITION BY label) AS n FROM cube), m AS (SELECT max(n) AS m FROM r) SELECT id, label, c::BIGINT AS copy FROM r, m, range(40) q(c) WHERE c < m // n + (r <= m % n)::INT", name="balance_oversample"
)(lambda s, d: P.oversample(_rows(s, d)).select("id", "label", "copy"))
query(
    f"""WITH {CUBE_SQL}, u AS (SELECT id, b::BIGINT AS round, (((id % 999983) + b * 104729 + 42) * 7919 % 999983) / 999983.0::DOUBLE AS u FROM cube, range(4) q(b))
    SELECT id, round, ((u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT)::BIGINT AS times FROM u""",
    name="bootstrap_oob",
)(lambda s, d: P.bootstrap_counts(_rows(s, d), 4))
for _m, _a, _b in (("minmax", "min(x)", "max(x) - min(x)"), ("zscore", "avg(x)", "stddev_pop(x)"), ("robust", "median(x)", "mad(x)")):
    query(f"WITH {CUBE_SQL}, s AS (SELECT id, spec[1] AS x FROM cube), p AS (SELECT {_a} AS a, {_b} AS b FROM s) SELECT id, {_r('(x - a) / b', 'y')} FROM s, p", name=f"normalize_{_m}")(lambda s, d, m=_m: _round(P.normalise(_rows(s, d), method=m).select("id", "y")))
query(f"WITH {CUBE_SQL}, s AS (SELECT spec[1] AS x FROM cube), p AS (SELECT min(x) AS lo, max(x) AS hi FROM s) SELECT least(floor((x - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS n FROM s, p GROUP BY 1", name="histogram")(lambda s, d: P.histogram(_rows(s, d)))
query(f"WITH {CUBE_SQL} SELECT row, col, label AS class_id, {_r('spec[1]', 'x')} FROM cube", name="extract_samples")(
    lambda s, d: _round(P.extract_samples(fixture_cube(s, d).select("row", "col", F.element_at("spec", 1).alias("x")), fixture_cube(s, d).select((F.col("col") + 0.5).alias("x"), (F.col("row") + 0.25).alias("y"), F.col("label").alias("class_id"))))
)
