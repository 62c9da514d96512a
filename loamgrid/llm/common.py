"""Shared helpers of the corpus operators: session settings, lineage cuts, table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.lineage import cut, discard, shared_folder

__all__ = ["cut", "discard", "shared_folder", "shuffle_width", "spare", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def spare(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for helper columns, changed until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return names
