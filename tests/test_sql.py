"""The engine's views and functions in SQL, and broadcasts that look at the size first."""

from loamgrid.lineage import small
from loamgrid.plans import sql
from loamgrid.scene import Bands, fixture_cube, fixture_labelmap


def test_views_and_functions(spark, sf_dir):
    cube = fixture_cube(spark, sf_dir)
    sql.register(spark, cube, Bands.even(64), fixture_labelmap(spark, sf_dir), prefix="t_")
    rows = spark.sql("SELECT c.id, t_spectrum_mean(spec) AS m, t_spectrum_range(spec) AS r, cls FROM t_cube c JOIN t_labelmap USING (row, col)").collect()
    want = {r["id"]: r["spec"] for r in cube.collect()}
    assert len(rows) == len(want) and all(abs(r["m"] - sum(want[r["id"]]) / 64) < 1e-12 and r["r"] == max(want[r["id"]]) - min(want[r["id"]]) for r in rows)
    assert spark.sql("SELECT t_spectrum_mean(array()) AS m, t_spectrum_mean(NULL) AS n").first()[:] == (None, None)
    assert spark.sql("SELECT count(ndvi) FROM t_indices").first()[0] == len(rows)


def test_small_tables_are_marked(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(spark.range(5))) and not hinted(small(spark.range(50), most=10))
