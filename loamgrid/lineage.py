"""Cuts the lineage of iterative plans through tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session whose executors live in this process (tests, bench) gets one made where none is
    set; on a cluster a local folder would lose tables, so there a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loamgrid-ckpt-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: its lineage is cut.

    Unlike a checkpoint, the table carries no size estimates of the plan it came from; in a loop
    these multiply with every join until planning takes longer than running.
    """
    path = f"{shared_folder(df.sparkSession)}/loamgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loamgrid_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._loamgrid_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """``table`` marked for broadcast if it has at most so many rows, else left to the optimiser."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
