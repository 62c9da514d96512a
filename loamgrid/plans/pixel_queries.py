"""Queries of pixel algebra: indices, calibration, spectra, on the 64-band stand-in cube."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.functions import arrays as A
from loamgrid.functions import indices as I
from loamgrid.operators import calibration as C
from loamgrid.operators import validate as V
from loamgrid.plans.registry import query
from loamgrid.scene import CUBE_SQL, Bands, fixture_cube, r6, wavelengths

BANDS = Bands.even(64)
WAVES = wavelengths(64)
META = {"sun_elevation": 52.5, "acquisition_date": "2024-07-15", "calibration": {"gains": [0.9 + 0.003 * i for i in range(64)], "offsets": [0.01 * (i % 5) - 0.02 for i in range(64)]}}

#: Bands of the stand-in cube as SQL (list places from 1).
_B = {
    "B": 3, "G": 5, "R": 9, "E": 11, "N": 14, "S1": 38, "S2": 53, "E705": 10, "E740": 11, "P531": 5, "P570": 6, "S445": 2, "S680": 9, "S800": 13,
}


def _sql(names: dict[str, str], table: str = "cube") -> str:
    bands = ", ".join(f"spec[{i}] AS {n}" for n, i in _B.items())
    cols = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in names.items())
    return f"WITH {CUBE_SQL}, b AS (SELECT id, spec, {bands} FROM {table}) SELECT id, {cols} FROM b"


def _nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} <> 0 THEN greatest(-1, least(1, ({a} - {b}) / ({a} + {b}))) ELSE 0 END"


def _q(a: str, b: str, k: str = "0") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) - {k} ELSE 0 END"


_NDVI, _PRI, _CI = _nd("N", "R"), _nd("P531", "P570"), _q("N", "R", "1")
_ETA = f"({_q('2 * (N * N - R * R) + 1.5 * N + 0.5 * R', 'N + R + 0.5')})"
INDEX_SQL = {
    "nd_indices": {"ndvi": _NDVI, "ndwi": _nd("G", "N"), "mndwi": _nd("G", "S1"), "ndmi": _nd("N", "S1"), "lswi": _nd("N", "S1"), "ndre": _nd("N", "E"), "mndre": _nd("E740", "E705"), "gndvi": _nd("N", "G"), "npci": _nd("R", "B"), "pri": _PRI},
    "ratio_indices": {"wbi": _q("R", "N"), "msi": _q("S1", "N"), "chl": _q("E", "R", "1"), "ci": _CI, "cig": _q("N", "G", "1"), "ci_red_edge": _q("N", "E", "1"), "rvi": _q("N", "R"), "ipvi": _q("N", "N + R")},
    "soil_indices": {
        "savi": f"({_q('N - R', 'N + R + 0.5')}) * 1.5", "gesavi": f"({_q('N - R', 'N + R + 0.5')}) * 1.5", "osavi": f"({_q('N - R', 'N + R + 0.16')}) * 1.16",
        "msavi": "(2 * N + 1 - sqrt(greatest((2 * N + 1) * (2 * N + 1) - 8 * (N - R), 0))) / 2", "tsavi": _q("N - R", "N + R + 0.16"), "atsavi": _q("N - R", "N + R + 0.16"),
    },
    "pigment_indices": {
        "mcari": f"((E - R) - 0.2 * (E - G)) * ({_q('E', 'R')})", "tcari": f"3 * ((E - R) - 0.2 * (E - G) * ({_q('E', 'R')}))", "mtci": _q("E740 - E705", "E705 - R"),
        "sipi": "(S800 - S445) / (S800 + S680)", "pri_ci": f"({_PRI}) * ({_CI})",
    },
    "atmos_indices": {
        "evi": "CASE WHEN N + 6 * R - 7.5 * B + 1 <> 0 THEN greatest(-1, least(1, 2.5 * (N - R) / (N + 6 * R - 7.5 * B + 1))) ELSE 0 END", "arvi": _nd("N", "(2 * R - B)"),
        "gemi": f"{_ETA} * (1 - 0.25 * {_ETA}) - ({_q('R - 0.125', '1 - R')})", "vari": _q("G - R", "G + R - B"),
    },
    "misc_indices": {"tndvi": f"sqrt(({_NDVI}) + 0.5)", "dvi": "N - R", "tvi": "0.5 * (120 * (N - G) - 200 * (R - G))"},
}


def _index_query(name: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = I.calculate(fixture_cube(spark, sf_dir), BANDS, columns, keep=("id",))
        return out.select("id", *(r6(F.col(c)).alias(c) for c in columns))

    query(_sql(INDEX_SQL[name]), name=name)(run)


for _name, _columns in INDEX_SQL.items():
    _index_query(_name, list(_columns))


@query(
    f"""WITH {CUBE_SQL}, d AS (SELECT id, list_transform(range(1, 5), lambda i: spec[8 + i + 1] - spec[8 + i]) AS rise FROM cube)
    SELECT id, round({WAVES[8]} + (list_position(rise, list_max(rise)) - 1) * {(WAVES[11] - WAVES[8]) / 4}, 6) + 0.0 AS rep FROM d"""
)
def red_edge_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.calculate(fixture_cube(spark, sf_dir), BANDS, ["rep"], keep=("id",)).select("id", r6(F.col("rep")).alias("rep"))


@query(
    f"""WITH {CUBE_SQL}, p AS (SELECT label, CASE WHEN spec[14] + spec[9] <> 0 THEN greatest(-1, least(1, (spec[14] - spec[9]) / (spec[14] + spec[9]))) ELSE 0 END AS v FROM cube)
    SELECT label, round(avg(v), 6) + 0.0 AS mean_ndvi, round(stddev_pop(v), 6) + 0.0 AS std_ndvi, count(*) AS n FROM p GROUP BY label"""
)
def ndvi_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture_cube(spark, sf_dir).select("label", I.INDICES["ndvi"](BANDS).alias("v"))
    return v.groupBy("label").agg(r6(F.avg("v")).alias("mean_ndvi"), r6(F.stddev_pop("v")).alias("std_ndvi"), F.count(F.lit(1)).alias("n"))


_COVER = "CASE WHEN {m} > 0 THEN 'water' WHEN {n} > 0 THEN 'vegetation' ELSE 'other' END"


@query(
    f"""WITH {CUBE_SQL}, m AS (SELECT {_COVER.format(m='(' + _nd('spec[5]', 'spec[38]') + ')', n='(' + _nd('spec[14]', 'spec[9]') + ')')} AS cover FROM cube),
    s AS (SELECT cover, count(*) AS area_px, count(*) / (sum(count(*)) OVER ()) AS share FROM m GROUP BY cover)
    SELECT cover, area_px, round(share, 6) + 0.0 AS share, round(-sum(share * ln(share)) OVER (), 6) + 0.0 AS shannon FROM s"""
)
def cover_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cube to reflectance, indices, threshold label map, class shares and diversity."""
    ix = I.calculate(fixture_cube(spark, sf_dir), BANDS, ["mndwi", "ndvi"], keep=())
    cover = F.when(F.col("mndwi") > 0, "water").when(F.col("ndvi") > 0, "vegetation").otherwise("other")
    everything = Window.partitionBy()  # a row for each class
    areas = ix.groupBy(cover.alias("cover")).agg(F.count(F.lit(1)).alias("area_px"))
    share = areas.withColumn("share", F.col("area_px") / F.sum("area_px").over(everything))
    return share.select("cover", "area_px", r6(F.col("share")).alias("share"), r6(-F.sum(F.col("share") * F.log("share")).over(everything)).alias("shannon"))


def _long(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("id", F.posexplode("spec").alias("band", "x")).select("id", F.col("band").cast("long").alias("band"), r6(F.col("x"), digits).alias("x"))


def _long_sql(expr: str, extra: str = "") -> str:
    """Rows (id, band, x) of an expression over v (the band's value) and b (the band from 0)."""
    return f"""WITH {CUBE_SQL}, l AS (SELECT id, b, spec[b + 1] AS v, 400 + b * 2100.0::DOUBLE / 63 AS w FROM cube, range(64) r(b)){extra}
    SELECT id, b::BIGINT AS band, round({expr}, 6) + 0.0 AS x FROM l"""


_GAIN, _OFF = "(0.9::DOUBLE + 0.003::DOUBLE * b)", "(0.01::DOUBLE * (b % 5) - 0.02::DOUBLE)"
_RAD = f"greatest(0, v * {_GAIN} + {_OFF})"
_KNOT = "greatest(0, least(41, floor((w - 400) / 50)))::BIGINT"
_SUN = f"""greatest(0.001, ({C.SOLAR}::DOUBLE[])[{_KNOT} + 1] + (({C.SOLAR}::DOUBLE[])[{_KNOT} + 2] - ({C.SOLAR}::DOUBLE[])[{_KNOT} + 1]) * (w - 400 - 50 * {_KNOT}) / 50)"""
_D2 = "pow(1 - 0.01672 * cos(2 * pi() * (dayofyear(DATE '2024-07-15') - 1) / 365.25), 2)"
_TOA = f"greatest(0, least(1.2, pi() * {_RAD} * {_D2} / ({_SUN} * cos(radians(90 - 52.5)))))"


@query(_long_sql(f"v * {_GAIN} + {_OFF}"))
def gain_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.gain_offset(fixture_cube(spark, sf_dir), META["calibration"]["gains"], META["calibration"]["offsets"]))


@query(_long_sql(_RAD))
def radiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.to_radiance(fixture_cube(spark, sf_dir), 64, META))


@query(_long_sql(_TOA))
def toa_reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.to_toa(fixture_cube(spark, sf_dir), WAVES, META))


@query(_long_sql(f"greatest(0, least(1, ({_TOA} - 0.05 * exp(-w / 1000)) / greatest(0.3, least(0.95, 0.8 + 0.15 * exp(-(w - 800) * (w - 800) / 80000)))))"))
def boa_reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.to_boa(fixture_cube(spark, sf_dir), WAVES, META))


@query(_long_sql("greatest(0, least(1, (v - lo) * 0.6 / (hi - lo)))", ", m AS (SELECT b AS mb, min(v) AS lo, max(v) AS hi FROM l GROUP BY b)").replace("AS x FROM l", "AS x FROM l JOIN m ON b = mb"))
def quac_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.quick_stretch(fixture_cube(spark, sf_dir)))


_WATER = " + ".join(f"CASE WHEN abs(w - {b}) < 50 THEN 0.1 * exp(-(w - {b}) * (w - {b}) / 800) ELSE 0 END" for b in C.WATER_BANDS)
_TRANS = f"greatest(0.3, 0.85 - ({_WATER}) - 0.05 * pow(400 / w, 4) - 0.02 * pow(550 / w, 1.3))"


@query(
    _long_sql(
        f"greatest(0, least(1, (v - greatest(dk, 0.001 * pow(550 / w, 4))) / {_TRANS}))",
        ", t AS (SELECT quantile_cont(spec[51], 0.01) AS lim FROM cube), m AS (SELECT b AS mb, avg(v) AS dk FROM l WHERE id IN (SELECT id FROM cube, t WHERE spec[51] <= lim) GROUP BY b)",
    ).replace("AS x FROM l", "AS x FROM l JOIN m ON b = mb")
)
def dos_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.dark_object(fixture_cube(spark, sf_dir), WAVES))


_PATH = "(1 / cos(radians(37.5)) + 1) / 2"
_VAPOUR = " + ".join(f"CASE WHEN abs(w - {b}) < 100 THEN {s} * 2.5 * exp(-(w - {b}) * (w - {b}) / 1800) ELSE 0 END" for b, s in C.WATER_BANDS.items())
_FT = f"greatest(0.1, 0.85 - {_PATH} * (({_VAPOUR}) + 3.91 / 40 * pow(550 / w, 1.5) + 0.05 * pow(400 / w, 4)))"
_FP = "greatest(0.001, (0.02 * pow(400 / w, 4) + 0.01 * pow(550 / w, 1.3) * (23.0::DOUBLE / 40)) * 0.5 / cos(radians(37.5)))"
_FS = "least(0.2, 0.05 + 0.02 * (23.0::DOUBLE / 40) * pow(550 / w, 0.5))"


@query(_long_sql(f"greatest(0, least(1, (v - {_FP}) / greatest(0.01, {_FT} + {_FS} * (v - {_FP}))))"))
def flaash_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.flaash(fixture_cube(spark, sf_dir), WAVES, META))


_AOD = "(3.91::DOUBLE / 40)"


@query(_long_sql(f"greatest(0, least(1, (v - 0.01 * {_AOD} * pow(550 / w, 1.3)) / greatest(0.01, exp(-{_AOD} / cos(radians(37.5))) * exp(-{_AOD}) + (0.05 + 0.02 * {_AOD}) / (1 - 0.05 - 0.02 * {_AOD}) * v)))"))
def sixs_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(C.sixs(fixture_cube(spark, sf_dir), WAVES, META))


@query(
    f"""WITH {CUBE_SQL}, l AS (SELECT id, b, spec[b + 1] AS v FROM cube, range(64) r(b)), p AS (SELECT b, v, v * (0.9 + b * 0.01) + 0.02 + (id % 7) * 0.001 AS r FROM l)
    SELECT b::BIGINT AS band, round(regr_slope(r, v), 6) + 0.0 AS gain, round(regr_intercept(r, v), 6) + 0.0 AS "offset" FROM p GROUP BY b"""
)
def estimate_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = fixture_cube(spark, sf_dir)
    ref = cube.withColumn("spec", F.transform("spec", lambda x, b: x * (0.9 + b * 0.01) + 0.02 + (F.col("id") % 7) * 0.001))
    return C.estimate_gains(cube, ref).select(F.col("band").cast("long").alias("band"), r6(F.col("gain")).alias("gain"), r6(F.col("offset")).alias("offset"))


@query(
    f"""WITH {CUBE_SQL}, l AS (SELECT b, spec[b + 1] AS v FROM cube, range(64) r(b))
    SELECT b::BIGINT AS band, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max,
    round(quantile_cont(v, 0.01), 6) + 0.0 AS p1, round(quantile_cont(v, 0.99), 6) + 0.0 AS p99 FROM l GROUP BY b"""
)
def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.scene_statistics(fixture_cube(spark, sf_dir))
    return s.select(F.col("band").cast("long").alias("band"), *(r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "p1", "p99")))


# Spectra.


def _spectral(f):
    return lambda spark, sf_dir: _long(fixture_cube(spark, sf_dir).withColumn("spec", f(F.col("spec"))))


def _list_sql(expr: str, length: int) -> str:
    """Rows (id, band, x) of an expression over spec and i (place from 1)."""
    return f"WITH {CUBE_SQL} SELECT id, (i - 1)::BIGINT AS band, round({expr}, 6) + 0.0 AS x FROM cube, range(1, {length + 1}) r(i)"


_DW = f"({WAVES[1] - WAVES[0]!r}::DOUBLE)"
query(_list_sql(f"(spec[i + 1] - spec[i]) / {_DW}", 63), name="first_derivative")(_spectral(lambda a: A.first_derivative(a, WAVES)))
query(_list_sql(f"((spec[i + 2] - spec[i + 1]) - (spec[i + 1] - spec[i])) / {_DW}", 62), name="second_derivative")(_spectral(lambda a: A.second_derivative(a, WAVES)))
query(_list_sql("spec[i] / greatest(1e-10, spec[1] + (spec[64] - spec[1]) * (i - 1) / 63)", 64), name="simple_continuum")(_spectral(A.end_line_continuum))
query(_list_sql("list_avg(spec[greatest(1, i - 2) : least(64, i + 2)])", 64), name="moving_average")(_spectral(lambda a: A.moving_average(a, 5)))
query(_list_sql("list_sort([CASE WHEN k < 1 OR k > 64 THEN 0 ELSE spec[k] END for k in range(i - 2, i + 3)])[3]", 64), name="median_smooth")(_spectral(lambda a: A.median_smooth(a, 5)))
query(
    f"""WITH {CUBE_SQL}, d AS (SELECT id, spec, list_transform(range(1, 64), lambda i: spec[i + 1] - spec[i]) AS d FROM cube),
    t AS (SELECT id, spec, d, 3 * list_stddev_pop(d) AS lim FROM d)
    SELECT id, (i - 1)::BIGINT AS band, round(CASE WHEN i > 1 AND i < 64 AND ((d[i - 1] > lim AND d[i] < -lim) OR (d[i - 1] < -lim AND d[i] > lim))
        THEN (spec[i - 1] + spec[i + 1]) / 2 ELSE spec[i] END, 6) + 0.0 AS x FROM t, range(1, 65) r(i)""",
    name="despike_spectrum",
)(_spectral(A.despike))
query(_list_sql("spec[i + 4]", 60), name="bad_band_filter")(_spectral(lambda a: A.drop_bands(a, A.default_bad_bands(64))))
query(
    _list_sql("list_dot_product(spec[greatest(0, least(i - 3, 59)) + 1 : greatest(0, least(i - 3, 59)) + 5], k[i - greatest(0, least(i - 3, 59))])", 64).replace(
        "FROM cube, range", f"FROM cube, (SELECT {A.savgol_kernel(5, 2)}::DOUBLE[][] AS k), range"
    ),
    name="savgol_smooth",
)(_spectral(lambda a: A.savgol(a, 5, 2)))
_G = A.gaussian_kernel(1.0)
query(
    _list_sql("list_sum([g[k + 5] * spec[CASE WHEN i + k < 1 THEN 1 - i - k WHEN i + k > 64 THEN 129 - i - k ELSE i + k END] for k in range(-4, 5)])", 64).replace("FROM cube, range", f"FROM cube, (SELECT {_G}::DOUBLE[] AS g), range"),
    name="gaussian_smooth",
)(_spectral(lambda a: A.convolve_reflect(a, _G)))


@query(
    f"""WITH {CUBE_SQL}, l AS (SELECT id, i, spec[i] AS v FROM cube, range(1, 65) r(i))
    SELECT id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(max(v) - min(v), 6) + 0.0 AS range,
    round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) + 0.0 AS iqr,
    round(stddev_pop(v) / (avg(v) + 1e-10), 6) + 0.0 AS cv, round(regr_slope(v, i), 6) + 0.0 AS slope FROM l GROUP BY id"""
)
def spectral_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = fixture_cube(spark, sf_dir)
    return cube.select("id", *(r6(c).alias(n) for n, c in A.statistics(F.col("spec")).items()))


_REF = A.reference_spectra(64)


@query(
    f"WITH {CUBE_SQL} SELECT id, "
    + ", ".join(f"round(acos(greatest(-1, least(1, list_dot_product(spec, {v}::DOUBLE[]) / (sqrt(list_dot_product(spec, spec)) * {math.sqrt(sum(x * x for x in v))!r})))), 6) + 0.0 AS {n}" for n, v in _REF.items())
    + " FROM cube"
)
def sam_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_cube(spark, sf_dir).select("id", *(r6(A.spectral_angle(F.col("spec"), v)).alias(n) for n, v in _REF.items()))


@query(
    f"""WITH {CUBE_SQL}, d AS (SELECT *, list_transform(range(1, 4), lambda i: spec[8 + i + 1] - spec[8 + i]) AS rise FROM cube)
    SELECT id, (list_position(rise, list_max(rise)) - 1 + 8)::DOUBLE AS red_edge_position, round((spec[9] - spec[5]) / 4, 6) + 0.0 AS green_red_slope,
    round(spec[13] - spec[37], 6) + 0.0 AS water_absorption_1600 FROM d"""
)
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.spectral_features(F.col("spec"), WAVES)
    return fixture_cube(spark, sf_dir).select("id", f["red_edge_position"].alias("red_edge_position"), *(r6(f[n]).alias(n) for n in ("green_red_slope", "water_absorption_1600")))


_ABS = [w for w in A.absorption_windows(WAVES) if w[1] - w[0] >= 2]


@query(
    f"WITH {CUBE_SQL}, "
    + ", ".join(f"a{i} AS (SELECT id, [1 - spec[{lo} + k] / greatest(1e-10, spec[{lo + 1}] + (spec[{hi + 1}] - spec[{lo + 1}]) * (k - 1) / {hi - lo}) for k in range(1, {hi - lo + 2})] AS d FROM cube)" for i, (lo, hi) in enumerate(_ABS))
    + " "
    + " UNION ALL ".join(f"SELECT id, {i}::BIGINT AS feature, round(list_max(d), 6) + 0.0 AS depth, len(list_filter(d, lambda x: x > 0.1))::DOUBLE AS width, round((list_position(d, list_max(d)) - 1) / {hi - lo + 1}.0, 6) + 0.0 AS position FROM a{i}" for i, (lo, hi) in enumerate(_ABS))
)
def absorption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = fixture_cube(spark, sf_dir)
    parts = [F.struct(F.lit(i).cast("long").alias("feature"), *(c.alias(n) for n, c in A.absorption(F.col("spec"), lo, hi).items())) for i, (lo, hi) in enumerate(_ABS)]
    rows = cube.select("id", F.explode(F.array(*parts)).alias("f"))
    return rows.select("id", F.col("f.feature").alias("feature"), r6(F.col("f.depth")).alias("depth"), F.col("f.width").alias("width"), r6(F.col("f.position")).alias("position"))


# Validation of a scene, one pass for each check group.


@query(
    f"""WITH {CUBE_SQL}, l AS (SELECT id, row, col, b, spec[b + 1] AS v FROM cube, range(64) r(b)),
    s AS (SELECT b, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY b)
    SELECT (SELECT max(row) + 1 FROM cube) AS height, (SELECT max(col) + 1 FROM cube) AS width, 64::BIGINT AS bands,
    round((SELECT min(v) FROM l), 6) + 0.0 AS min, round((SELECT max(v) FROM l), 6) + 0.0 AS max, round((SELECT avg((v < 0)::INT) FROM l), 6) + 0.0 AS negative_share,
    0.0::DOUBLE AS nan_share, 0.0::DOUBLE AS nodata_share,
    (SELECT count(*) FROM s WHERE abs(m - (SELECT median(m) FROM s)) > 3 * (SELECT stddev_pop(m) FROM s)) AS odd_mean_bands,
    (SELECT count(*) FROM s WHERE sd < 0.01 * (SELECT avg(sd) FROM s)) AS flat_bands"""
)
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scene_summary(fixture_cube(spark, sf_dir))
    return s.select(*(F.col(c).cast("long").alias(c) for c in ("height", "width", "bands")), *(r6(F.col(c)).alias(c) for c in ("min", "max", "negative_share", "nan_share", "nodata_share")), *(F.col(c).cast("long").alias(c) for c in ("odd_mean_bands", "flat_bands")))
