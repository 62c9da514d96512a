"""The operators from SQL: temporary views of a scene and registered spectrum functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgrid.functions import indices as I
from loamgrid.scene import Bands


def register(spark: SparkSession, cube: DataFrame, bands: Bands, labels: DataFrame | None = None, prefix: str = "") -> None:
    """Views: cube, indices (all index columns by pixel), and labelmap where given."""
    cube.createOrReplaceTempView(f"{prefix}cube")
    I.calculate(cube, bands).createOrReplaceTempView(f"{prefix}indices")
    if labels is not None:
        labels.createOrReplaceTempView(f"{prefix}labelmap")

    # Functions in SQL itself, so they stay inside generated code.
    total = "aggregate(a, 0D, (s, x) -> s + x)"
    for name, body in {"spectrum_mean": f"{total} / nullif(size(a), 0)", "spectrum_range": "array_max(a) - array_min(a)"}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
