"""Exact percentiles and ranks of large groups without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.lineage import cut


def percentiles(rows: DataFrame, by: list[str], col: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """One row for each group: ``by`` and q, the percentiles at ``shares`` with linear interpolation.

    A histogram over the group's range finds the bins that hold the wanted ranks; only the values
    of these bins are counted by value and ordered.  Nulls take no part; without groups, an empty table
    gives one row with an empty q.  Groups are few (bands,
    one whole table): their ranges, a row each, are broadcast.
    """
    x = rows.select(*by, F.col(col).cast("double").alias("x")).where("x is not null")
    # A row for each group; written, so that the values are read three times in all.
    s = cut(x.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")))

    def binned(r: DataFrame) -> DataFrame:
        at = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        b = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).otherwise(0)
        r = r.join(F.broadcast(s), by) if by else r.join(F.broadcast(s))
        return r.withColumn("bin", b.cast("int"))

    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned(x).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("first", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))
    asked = s.select(*by, "n", F.inline(at)).withColumn("at", F.col("p") * (F.col("n") - 1))
    asked = asked.select(*by, "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c"))
    # Every group has a few ranks and at most ``bins`` counts.
    found = asked.join(counts, by).where(inside) if by else asked.join(counts, inside)
    found = cut(found.select(*by, "i", "at", "rank", "bin", "first"))
    wanted = found.select(*by, "bin", "first").distinct()
    values = binned(x).join(F.broadcast(wanted), [*by, "bin"]).groupBy(*by, "bin", "first", "x").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*by, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("from", F.col("first") + F.coalesce(F.sum("m").over(before), F.lit(0))).select(*by, "bin", "x", "from", "m")
    hit = found.join(values, [*by, "bin"]).where("rank >= from and rank < from + m")
    ends = hit.groupBy(*by, "i", "at").agg(F.min(F.struct("rank", "x")).alias("a"), F.max(F.struct("rank", "x")).alias("b"))
    q = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("at") - F.col("a.rank"))
    return ends.select(*by, "i", q.alias("v")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda t: t["v"]).alias("q"))


def ranked(rows: DataFrame, by: list[str], bucket: Column, *order: Column | str, rank: str = "r", size: str | None = None) -> DataFrame:
    """Adds ``rank``, the place from 1 within ``by`` in the given order, and the group's ``size``.

    ``bucket`` must not fall along the order.  Places are two-level sums, counts of buckets and
    then rows within one, so a group is spread over as many tasks as it has buckets.
    """
    keyed = rows.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"), F.sum("_c").over(whole).alias("_size"))
    keys = [*by, "_bucket"]
    starts = starts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first", "_size")
    inside = Window.partitionBy(*keys).orderBy(*order)
    met = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        met = same if met is None else met & same
    out = keyed.withColumn("_n", F.row_number().over(inside)).join(starts, met).withColumn(rank, F.col("_first") + F.col("_n"))
    if size is not None:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_bucket", "_n", "_first", "_size", *(f"_k{i}" for i in range(len(keys))))
