"""Makes the package importable in Python workers of whatever cluster a session runs on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers once per session, so UDFs find it without a shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_loamgrid_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="loamgrid-"), "loamgrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._loamgrid_shipped = True
    return spark
