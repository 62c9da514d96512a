"""Cross-validation, consistency rules and spatial separation on small tables."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loamgrid.operators import consistency as C
from loamgrid.operators import models as M
from loamgrid.operators import validation as V
from tests.test_grids import CENTRE, back, grid


def rows(spark):
    r = spark.range(60).select("id", F.expr("id div 10").alias("row"), (F.col("id") % 10).alias("col"), (F.col("id") % 2).cast("long").alias("label"))
    return r.withColumn("x", array_to_vector(F.array(F.col("label") * 2.0 + F.col("id") % 7 * 0.01, F.lit(1.0) * (F.col("id") % 5))))


def test_cross_validation(spark):
    f = V.cross_validate(rows(spark), lambda: M.estimator("nb"), k=3)
    assert f.count() == 3 and V.summarise(f).first()["mean"] == 1.0


def test_bootstrap(spark):
    b = V.bootstrap(rows(spark), lambda: M.estimator("nb"), rounds=2).collect()
    assert [r["estimate"] for r in b] == [1.0, 1.0]


def test_separation(spark):
    r = rows(spark)
    s = V.separation(r.where("row < 2"), r.where("row >= 4")).first()
    assert (s["min"], s["max"]) == (3.0, 4.0)


def test_rules(spark):
    g = grid(spark, CENTRE)
    bad = C.adjacency_violations(g, spark.createDataFrame([(2, 3)], "cls long, other long"))
    assert bad.count() == 4
    iso = C.isolated_clusters(g, spark.createDataFrame([(2, 2)], "cls long, least long"), tile=2)
    assert [(r["cls"], r["n"]) for r in iso.collect()] == [(2, 1)]
    assert back(C.neighbourhood_majority(g, 3)) == [[1] * 5] * 5
    q = C.quality(g, C.neighbourhood_majority(g, 3), tile=4).first()
    assert (q["changed"], q["patches_before"], q["patches_after"], q["boundary_before"], q["boundary_after"]) == (1, 2, 1, 4, 0)
    h = C.health(spark.createDataFrame([("a", 0.3), ("b", 0.9), ("c", 0.55)], "name string, value double")).first()
    assert (h["grade"], h["issues"], h["first"]) == ("fair", ["a"], ["a", "c"])
