"""Label sequences (unit, t, cls): one window pass over each unit's dates gives every metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.lineage import small


def _by_time() -> Window:
    return Window.partitionBy("unit").orderBy("t")


def change_rate(series: DataFrame) -> DataFrame:
    """t, changed, units, rate: how many units changed since their last date."""
    s = series.withColumn("was", F.lag("cls").over(_by_time())).where("was is not null")
    c = (F.col("was") != F.col("cls")).cast("long")
    return s.groupBy("t").agg(F.sum(c).alias("changed"), F.count(F.lit(1)).alias("units"), F.avg(c.cast("double")).alias("rate"))


def transitions(series: DataFrame) -> DataFrame:
    """was, cls, n of all steps to another class."""
    s = series.withColumn("was", F.lag("cls").over(_by_time()))
    return s.where("was <> cls").groupBy("was", "cls").agg(F.count(F.lit(1)).alias("n"))


def top_transitions(series: DataFrame, k: int = 10) -> DataFrame:
    return transitions(series).orderBy(F.desc("n"), "was", "cls").limit(k)


def transition_matrix(series: DataFrame, classes: list) -> DataFrame:
    s = series.withColumn("was", F.lag("cls").over(_by_time())).where("was is not null")
    return s.groupBy("was").agg(*(F.sum((F.col("cls") == c).cast("long")).alias(f"to_{c}") for c in classes))


def stability(series: DataFrame) -> DataFrame:
    """unit, dates, changes, frequency: changes over possible ones."""
    s = series.withColumn("was", F.lag("cls").over(_by_time()))
    g = s.groupBy("unit").agg(F.count(F.lit(1)).alias("dates"), F.sum(F.coalesce((F.col("was") != F.col("cls")).cast("long"), F.lit(0))).alias("changes"))
    return g.withColumn("frequency", F.when(F.col("dates") > 1, F.col("changes") / (F.col("dates") - 1)).otherwise(0.0))


def oscillations(series: DataFrame) -> DataFrame:
    """unit, t: the first A B A B within four consecutive dates of a unit."""
    w = _by_time()
    s = series.select("unit", "t", "cls", *(F.lead("cls", i).over(w).alias(f"n{i}") for i in (1, 2, 3)))
    return s.where("cls = n2 and n1 = n3 and cls <> n1").groupBy("unit").agg(F.min("t").alias("t"))


def forbidden_transitions(series: DataFrame, rules: DataFrame) -> DataFrame:
    """unit, t, was, cls of steps that a rule table (was, cls) forbids."""
    s = series.withColumn("was", F.lag("cls").over(_by_time())).where("was <> cls")
    return s.join(small(rules), ["was", "cls"], "left_semi").select("unit", "t", "was", "cls")


def validity_rate(series: DataFrame, rules: DataFrame) -> DataFrame:
    s = series.withColumn("was", F.lag("cls").over(_by_time())).where("was <> cls").join(small(rules.withColumn("bad", F.lit(1))), ["was", "cls"], "left")
    return s.agg(F.coalesce(F.avg(F.col("bad").isNull().cast("double")), F.lit(1.0)).alias("validity"))


def _mode(a: Column) -> Column:
    """Most frequent element, the smallest on ties."""
    kinds = F.array_sort(F.array_distinct(a))
    best = F.array_min(F.transform(kinds, lambda k: F.struct((-F.size(F.filter(a, lambda x: x == k))).alias("n"), k.alias("k"))))
    return best["k"]


def temporal_mode(series: DataFrame, half: int = 1) -> DataFrame:
    """Each date's class replaced by the mode of the dates around it (original values)."""
    around = F.collect_list("cls").over(_by_time().rowsBetween(-half, half))
    return series.select("unit", "t", _mode(around).alias("cls"))


def carry_back(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Forbidden steps take the unit's last original class."""
    s = series.withColumn("was", F.lag("cls").over(_by_time()))
    bad = s.join(small(rules.withColumn("bad", F.lit(1))), ["was", "cls"], "left")
    return bad.select("unit", "t", F.when(F.col("bad") == 1, F.col("was")).otherwise(F.col("cls")).alias("cls"))


def anomalies(series: DataFrame, max_rate: float = 0.3) -> DataFrame:
    """unit, kind: units that change too often, and units that oscillate."""
    often = stability(series).where(F.col("frequency") > max_rate).select("unit", F.lit("frequent").alias("kind"))
    return often.unionByName(oscillations(series).select("unit", F.lit("oscillation").alias("kind")))


def consistency(series: DataFrame, max_rate: float = 0.3) -> DataFrame:
    """One row: mean change rate, stable share, anomalous share, and their score."""
    st = stability(series)
    base = st.agg(F.count(F.lit(1)).alias("units"), F.avg("frequency").alias("mean_rate"), F.avg((F.col("changes") == 0).cast("double")).alias("stable"))
    odd = anomalies(series, max_rate).agg(F.countDistinct("unit").alias("odd"))
    return base.join(F.broadcast(odd)).select("units", "mean_rate", "stable", (F.col("odd") / F.col("units")).alias("anomalous")).withColumn("score", (F.col("stable") + 1 - F.col("anomalous")) / 2)


def trend(metrics: DataFrame) -> DataFrame:
    """metric, first, last, rate, trend of (t, metric, value)."""
    g = metrics.groupBy("metric").agg(F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"))
    rate = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0)
    name = F.when(F.col("rate") > 0.1, "increasing").when(F.col("rate") < -0.1, "decreasing").when(F.abs("rate") <= 0.05, "stable").otherwise("slight change")
    return g.withColumn("rate", rate).withColumn("trend", name)
