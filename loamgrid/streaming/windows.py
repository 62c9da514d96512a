"""Structured Streaming over event tables: tumbling, sliding and session windows, and sequences
of labels with state for each unit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.lineage import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream with event times."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, length: str, late: str = "1 day") -> DataFrame:
    return sliding(stream, length, length, late)


def sliding(stream: DataFrame, length: str, step: str, late: str = "1 day") -> DataFrame:
    """start, event_type, n, total of each window; rows later than ``late`` are left out."""
    w = F.window("ts", length, step) if step != length else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, n of each user's sessions."""
    if stream.isStreaming:
        stream = stream.withWatermark("ts", late)
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def label_changes(stream: DataFrame) -> DataFrame:
    """unit, t, was, cls: changes of class, with each unit's last class kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["t", "cls"])
            before = pd.Series([was, *pdf["cls"].iloc[:-1]], index=pdf.index)
            was = pdf["cls"].iloc[-1]
            changed = before.notna() & (before != pdf["cls"])
            yield pd.DataFrame({"unit": key[0], "t": pdf["t"][changed], "was": before[changed], "cls": pdf["cls"][changed]})
        state.update((was,))

    return stream.groupBy("unit").applyInPandasWithState(run, "unit long, t timestamp, was string, cls string", "was string", "append", "NoTimeout")


def drain(query: DataFrame, mode: str = "append") -> DataFrame:
    """All that is available, run to the end into a memory or file table, as a batch DataFrame."""
    spark, name = query.sparkSession, f"loamgrid_{uuid.uuid4().hex}"
    where = f"{shared_folder(spark)}/{name}"
    if mode == "complete":
        run = query.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{where}/out"))
    else:
        run = query.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out")
    run.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{where}/out")
