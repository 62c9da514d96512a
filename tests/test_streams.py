"""Streams drained to the end equal the same computation over the whole table."""

from pyspark.sql import functions as F

from loamgrid.streaming import windows as W


def test_label_changes_keep_state_over_batches(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 00:00:00", c) for d, c in enumerate("AABBA", 1)] + [(2, "2024-01-01 00:00:00", "A")]
    df = spark.createDataFrame(rows, "unit long, t string, cls string").withColumn("t", F.to_timestamp("t"))
    for i, part in enumerate(("t < '2024-01-03'", "t >= '2024-01-03'")):
        df.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    got = sorted((r["unit"], r["t"].day, r["was"], r["cls"]) for r in W.drain(W.label_changes(stream)).collect())
    assert got == [(1, 3, "A", "B"), (1, 5, "B", "A")]


def test_sliding_windows_overlap(spark, sf_dir):
    out = W.drain(W.sliding(W.events(spark, sf_dir), "2 hours", "1 hour"), "complete")
    whole = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null").count()
    assert out.agg(F.sum("n")).first()[0] == 2 * whole
