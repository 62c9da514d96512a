"""Data model: pixels, bands and label maps as DataFrames, and their stand-ins in the driver tables.

cube(scene_id, row, col, label, spec array<double>): one row for each pixel, the spectrum as an
array.  labelmap(row, col, cls): 0 is background.  Wavelengths travel with a plan as a plain list,
so dropping bands drops their wavelengths too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUBE = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("spec", T.ArrayType(T.DoubleType())),
    ]
)
LABELMAP = T.StructType([T.StructField("scene_id", T.StringType()), T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("cls", T.IntegerType())])
SAMPLES = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("date_collected", T.DateType()),
        T.StructField("source", T.StringType()),
    ]
)

#: Centre wavelengths (nm) of the named bands.
BAND_NM = {
    "blue": 470, "green": 550, "red": 670, "red_edge": 720, "nir": 850, "nir2": 1240, "swir1": 1640, "swir2": 2130,
    "coastal": 443, "violet": 410, "cyan": 490, "yellow": 570, "red_680": 680, "red_edge_705": 705, "red_edge_740": 740,
    "red_edge_783": 783, "nir_865": 865, "water_vapor": 945, "cirrus": 1375, "swir_1610": 1610, "swir_2200": 2200,
}
#: Centres that the spectral indices of the array features use instead.
FEATURE_NM = {"blue": 470, "green": 550, "red": 670, "nir": 800, "swir1": 1600, "swir2": 2200}

#: Land cover classes by id.
CLASSES = {
    1: "water body", 2: "emergent vegetation", 3: "floating vegetation", 4: "submerged vegetation", 5: "wet meadow",
    6: "organic soil", 7: "mineral soil", 8: "built-up", 9: "road", 10: "farmland",
}


def wavelengths(bands: int, low: float = 400.0, high: float = 2500.0) -> list[float]:
    """Evenly spaced wavelengths from low to high."""
    step = (high - low) / (bands - 1) if bands > 1 else 0.0
    return [low + i * step for i in range(bands)]


def nearest_band(waves: list[float], nm: float) -> int:
    """Index of the band nearest to ``nm``, the first on ties."""
    return min(range(len(waves)), key=lambda i: (abs(waves[i] - nm), i))


@dataclass(frozen=True)
class Bands:
    """Named bands of a cube, resolved against the wavelengths it carries."""

    waves: tuple[float, ...]

    @staticmethod
    def even(bands: int) -> Bands:
        return Bands(tuple(wavelengths(bands)))

    def index(self, name: str | float) -> int:
        nm = BAND_NM[name] if isinstance(name, str) else name
        return nearest_band(list(self.waves), nm)

    def col(self, name: str | float, spec: str = "spec") -> Column:
        return F.element_at(F.col(spec), self.index(name) + 1)


def class_dim(spark: SparkSession, classes: dict[int, str] | None = None) -> DataFrame:
    """class_id, name: the class dictionary is an explicit input, never global."""
    return spark.createDataFrame(list((classes or CLASSES).items()), "class_id int, name string")


# Stand-ins in the driver tables (row = vec_id div 20, col = vec_id mod 20).
WIDTH = 20


def fixture_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, row, col, label, spec: the embeddings table as a 64-band labelled cube."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("id"),
        F.expr(f"vec_id div {WIDTH}").alias("row"),
        (F.col("vec_id") % WIDTH).alias("col"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("spec"),
    )


#: The same in DuckDB, as the first common table expression of every oracle.
CUBE_SQL = """cube AS (SELECT vec_id AS id, vec_id // 20 AS row, vec_id % 20 AS col, label::BIGINT AS label,
    list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS spec FROM embeddings)"""


def fixture_labelmap(spark: SparkSession, sf_dir: str, background: bool = True) -> DataFrame:
    """row, col, cls from the cube's labels; with ``background`` label 0 is background."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shift = 0 if background else 1
    return e.select(F.expr(f"vec_id div {WIDTH}").alias("row"), (F.col("vec_id") % WIDTH).alias("col"), (F.col("label").cast("long") + shift).alias("cls"))


LABELMAP_SQL = "labelmap AS (SELECT vec_id // 20 AS row, vec_id % 20 AS col, label::BIGINT AS cls FROM embeddings)"


def fixture_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y_true, y_pred, w with deterministic errors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wrong = F.when(F.col("vec_id") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("y_true"), ((F.col("label").cast("long") + wrong) % 10).alias("y_pred"), (F.lit(1.0) + F.col("vec_id") % 4).cast("double").alias("w"))


PRED_SQL = """pred AS (SELECT vec_id AS id, label::BIGINT AS y_true, ((label + (vec_id % 3 = 0)::INT) % 10)::BIGINT AS y_pred,
    (1.0 + vec_id % 4)::DOUBLE AS w FROM embeddings)"""


def fixture_proba(spark: SparkSession, sf_dir: str, classes: int = 10) -> DataFrame:
    """id, label, p array<double>: normalised shifts of the first components."""
    c = fixture_cube(spark, sf_dir)
    head = F.slice("spec", 1, classes)
    total = F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    return c.select("id", "row", "col", "label", head.alias("h"), total.alias("t")).select("id", "row", "col", "label", F.transform("h", lambda x: x / F.col("t")).alias("p"))


PROBA_SQL = """proba AS (SELECT id, row, col, label, list_transform(spec[1:10], lambda x: x / list_sum(spec[1:10])) AS p FROM cube)"""


def fixture_ensemble(spark: SparkSession, sf_dir: str, models: int = 5, classes: int = 10) -> DataFrame:
    """id, model, p array<double>: disjoint slices of the spectrum, normalised."""
    c = fixture_cube(spark, sf_dir).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    part = c.select("id", "row", "col", "label", F.col("model").cast("long").alias("model"), F.slice(F.col("spec"), F.col("model") * classes + 1, F.lit(classes)).alias("h"))
    part = part.withColumn("t", F.aggregate("h", F.lit(0.0), lambda a, x: a + x))
    return part.select("id", "row", "col", "label", "model", F.transform("h", lambda x: x / F.col("t")).alias("p"))


ENSEMBLE_SQL = """ensemble AS (SELECT id, row, col, label, model::BIGINT AS model,
    list_transform(spec[model * 10 + 1 : model * 10 + 10], lambda x: x / list_sum(spec[model * 10 + 1 : model * 10 + 10])) AS p
    FROM cube, range(5) m(model))"""


def fixture_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, t (day), cls: each user's most frequent event of a day, ties to the smallest name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null and event_type is not null")
    daily = e.groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("t"), F.col("event_type").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("unit", "t").agg(F.min(F.struct((-F.col("n")).alias("n"), "cls")).alias("x")).select("unit", "t", F.col("x.cls").alias("cls"))


SERIES_SQL = """series AS (SELECT unit, t, cls FROM (SELECT user_id AS unit, ts::DATE AS t, event_type AS cls,
    row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY count(*) DESC, event_type) AS r
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1)"""


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)
