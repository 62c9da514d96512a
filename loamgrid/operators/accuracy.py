"""Accuracy assessment: one confusion table, everything else small sums over it.

The confusion table is one partial-then-final aggregation over all pixels; its K x K rows feed the
rest, so no metric reads the pixels again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959964

def _all():
    return Window.partitionBy()  # over K x K rows at most



def confusion(pred: DataFrame, weight: str | None = None) -> DataFrame:
    """y_true, y_pred, n."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    return pred.groupBy("y_true", "y_pred").agg(n.alias("n"))


def confusion_matrix(pred: DataFrame, labels: list[int], normalise: bool = False) -> DataFrame:
    """One row for each true class, a column p_<label> for each predicted one."""
    wide = pred.groupBy("y_true").agg(*(F.sum((F.col("y_pred") == c).cast("long")).alias(f"p_{c}") for c in labels))
    if not normalise:
        return wide
    total = sum((F.col(f"p_{c}") for c in labels), F.lit(0))
    return wide.select("y_true", *(F.try_divide(F.col(f"p_{c}"), total).alias(f"p_{c}") for c in labels))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def class_table(table: DataFrame) -> DataFrame:
    """Per class of either side: tp, fp, fn, tn, precision, recall, specificity, f1, the accuracies
    of producer and user, omission, commission and support."""
    both = table.select(F.col("y_true").alias("cls"), F.col("n").alias("r"), F.lit(0.0).alias("c"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0).alias("d"))
    both = both.unionByName(table.select(F.col("y_pred").alias("cls"), F.lit(0.0).alias("r"), F.col("n").alias("c"), F.lit(0.0).alias("d")))
    s = both.groupBy("cls").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("tp")).withColumn("total", F.sum("r").over(_all()))
    s = s.withColumn("fp", F.col("c") - F.col("tp")).withColumn("fn", F.col("r") - F.col("tp")).withColumn("tn", F.col("total") - F.col("r") - F.col("c") + F.col("tp"))
    s = s.withColumn("precision", _ratio(F.col("tp"), F.col("c"))).withColumn("recall", _ratio(F.col("tp"), F.col("r"))).withColumn("specificity", _ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    s = s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return s.select("cls", "tp", "fp", "fn", "tn", "precision", "recall", "specificity", "f1", F.col("recall").alias("producer_accuracy"), F.col("precision").alias("user_accuracy"), (1 - F.col("recall")).alias("omission"), (1 - F.col("precision")).alias("commission"), F.col("r").alias("support"))


def overall(table: DataFrame) -> DataFrame:
    """One row: accuracy, kappa, balanced accuracy, macro, micro and weighted scores, MCC, the
    geometric mean of positive recalls and the harmonic mean of positive F1."""
    c = class_table(table)
    total, hit = F.sum("support"), F.sum("tp")
    col = F.col("tp") + F.col("fp")
    a = c.agg(
        total.alias("n"),
        hit.alias("hit"),
        F.sum(F.col("support") * col).alias("rc"),
        F.sum(F.col("support") * F.col("support")).alias("rr"),
        F.sum(col * col).alias("cc"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *(F.avg(x).alias(f"{x}_macro") for x in ("precision", "recall", "f1")),
        *((F.sum(F.col(x) * F.col("support")) / total).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")),
        F.exp(F.avg(F.when(F.col("recall") > 0, F.log("recall")))).alias("geometric_mean"),
        (1 / F.avg(F.when(F.col("f1") > 0, 1 / F.col("f1")))).alias("harmonic_f1"),
    )
    acc, pe = F.col("hit") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    spread = F.sqrt((F.col("n") * F.col("n") - F.col("cc")) * (F.col("n") * F.col("n") - F.col("rr")))
    keep = [x for x in a.columns if x not in ("hit", "rc", "rr", "cc")]
    return a.select(*keep, acc.alias("accuracy"), _ratio(acc - pe, 1 - pe).alias("kappa"), acc.alias("f1_micro"), _ratio(F.col("hit") * F.col("n") - F.col("rc"), spread).alias("mcc"))


def confused_pairs(table: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent confusions, with their share of the true class; ties by class."""
    share = table.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("y_true")))
    return share.where("y_true <> y_pred").orderBy(F.desc("n"), "y_true", "y_pred").limit(k)


def main_confusions(table: DataFrame) -> DataFrame:
    """Per true class the class it is most often taken for, null where that is itself."""
    best = F.row_number().over(Window.partitionBy("y_true").orderBy(F.desc("n"), "y_pred"))
    return table.withColumn("r", best).where("r = 1").select("y_true", F.when(F.col("y_pred") != F.col("y_true"), F.col("y_pred")).alias("main_confusion"), "n")


def error_rates(pred: DataFrame) -> DataFrame:
    """Per true class: its errors, its rows and the error rate."""
    wrong = (F.col("y_true") != F.col("y_pred")).cast("long")
    return pred.groupBy("y_true").agg(F.sum(wrong).alias("errors"), F.count(F.lit(1)).alias("rows"), F.avg(wrong.cast("double")).alias("error_rate"))


def intervals(table: DataFrame, z: float = Z95) -> DataFrame:
    """Normal intervals of accuracy and kappa, clipped to 0..1 and -1..1."""
    o = overall(table)
    half = z * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    k = F.when(F.col("accuracy") < 1, z * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / (F.col("n") * (1 - F.col("accuracy")) * (1 - F.col("accuracy")))))
    low = lambda x, h, b: F.greatest(F.lit(b), x - h)
    return o.select("accuracy", low(F.col("accuracy"), half, 0.0).alias("accuracy_low"), F.least(F.lit(1.0), F.col("accuracy") + half).alias("accuracy_high"), "kappa", low(F.col("kappa"), k, -1.0).alias("kappa_low"), F.least(F.lit(1.0), F.col("kappa") + k).alias("kappa_high"))


def chi_square(table: DataFrame) -> DataFrame:
    """Chi-square statistic and degrees of freedom of the whole table, empty cells included."""
    rows, cols = table.groupBy("y_true").agg(F.sum("n").alias("r")), table.groupBy("y_pred").agg(F.sum("n").alias("c"))
    # sum (n - e)^2 / e over all cells is sum n^2 / e - N, and empty cells add nothing to the sum.
    cells = table.join(F.broadcast(rows), "y_true").join(F.broadcast(cols), "y_pred").withColumn("total", F.sum("n").over(_all()))
    stat = F.sum(F.col("n") * F.col("n") * F.col("total") / (F.col("r") * F.col("c"))) - F.max("total")
    return cells.agg(stat.alias("chi_square"), ((F.countDistinct("y_true") - 1) * (F.countDistinct("y_pred") - 1)).alias("dof"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1.0 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 100_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            c = 1.0 + k / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_test(correct: int, n: int) -> float:
    """One-sided p-value of at least ``correct`` hits of n at one half, at any n."""
    return 1.0 if correct <= 0 else min(1.0, max(0.0, incomplete_beta(correct, n - correct + 1, 0.5)))


def hit_test(pred: DataFrame) -> DataFrame:
    """One row: n, hits and the one-sided p-value that hits are above one half."""
    return _tested(pred.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("hits")))


def class_hit_tests(pred: DataFrame) -> DataFrame:
    """The same for each class against the rest: cls, n, hits, p."""
    table = confusion(pred)
    total = table.agg(F.sum("n").cast("long").alias("n"))
    c = class_table(table).join(F.broadcast(total)).select("cls", F.col("n"), (F.col("tp") + F.col("tn")).cast("long").alias("hits"))
    return _tested(c)


def _tested(rows: DataFrame) -> DataFrame:
    """Adds p to a few rows of n and hits (one for each class)."""
    got = rows.collect()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", p double"
    return rows.sparkSession.createDataFrame([(*r, binomial_test(r["hits"] or 0, r["n"])) for r in got], schema)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """model_a, model_b, only_a, only_b, statistic, p of models' predictions (id, model, y_true, y_pred).

    Rows that just one of two models gets right are counted; the statistic is corrected for
    continuity and has one degree of freedom.  Models are few, so their pairs are.
    """
    right = pairs.select("id", "model", (F.col("y_true") == F.col("y_pred")).alias("ok"))
    a, b = (right.select("id", F.col("model").alias(f"model_{s}"), F.col("ok").alias(f"ok_{s}")) for s in "ab")
    met = a.join(b, "id").where("model_a < model_b")
    one = lambda x, y: F.sum((F.col(x) & ~F.col(y)).cast("long"))
    c = met.groupBy("model_a", "model_b").agg(one("ok_a", "ok_b").alias("only_a"), one("ok_b", "ok_a").alias("only_b"))
    away = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    c = c.withColumn("statistic", F.when(F.col("only_a") + F.col("only_b") > 0, away * away / (F.col("only_a") + F.col("only_b"))).otherwise(0.0).cast("double"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema) + ", p double"
    return pairs.sparkSession.createDataFrame([(*r, math.erfc(math.sqrt(r["statistic"] / 2))) for r in c.collect()], schema)


def compare_models(pairs: DataFrame, metric: str = "accuracy") -> DataFrame:
    """model, n, accuracy, kappa, f1_macro, f1_weighted of (model, y_true, y_pred), the best first."""
    if metric not in ("accuracy", "kappa", "f1_macro", "f1_weighted"):
        raise ValueError(f"unknown metric {metric}")
    t = pairs.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c, r, p: t.select("model", F.col(c).alias("cls"), F.lit(0.0 if p else 1.0).alias("_"), (F.col("n") if r else F.lit(0.0)).alias("r"), (F.col("n") if p else F.lit(0.0)).alias("c"), (F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0) if r else F.lit(0.0)).alias("tp")).drop("_")
    s = side("y_true", True, False).unionByName(side("y_pred", False, True)).groupBy("model", "cls").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("tp").alias("tp"))
    f1 = _ratio(2 * F.col("tp"), F.col("r") + F.col("c"))
    m = s.withColumn("f1", f1).groupBy("model").agg(F.sum("r").alias("n"), F.sum("tp").alias("hit"), F.sum(F.col("r") * F.col("c")).alias("rc"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("r")) / F.sum("r")).alias("f1_weighted"))
    acc, pe = F.col("hit") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    return m.select("model", "n", acc.alias("accuracy"), _ratio(acc - pe, 1 - pe).alias("kappa"), "f1_macro", "f1_weighted").orderBy(F.desc(metric), "model")


def confusion_shares(table: DataFrame) -> DataFrame:
    """y_true, y_pred, n, of_row, of_column, intensity: a confusion against what chance would give."""
    rows, cols = table.groupBy("y_true").agg(F.sum("n").alias("r")), table.groupBy("y_pred").agg(F.sum("n").alias("c"))
    t = table.join(F.broadcast(rows), "y_true").join(F.broadcast(cols), "y_pred").withColumn("total", F.sum("n").over(_all()))  # K x K rows
    return t.select("y_true", "y_pred", "n", (F.col("n") / F.col("r")).alias("of_row"), (F.col("n") / F.col("c")).alias("of_column"), (F.col("n") * F.col("total") / (F.col("r") * F.col("c"))).alias("intensity"))


def matrix_properties(table: DataFrame) -> DataFrame:
    """One row: classes, total, trace, share on the diagonal, filled cells off it, and asymmetry."""
    back = table.select(F.col("y_true").alias("y_pred"), F.col("y_pred").alias("y_true"), F.col("n").alias("m"))
    off = table.where("y_true <> y_pred").join(back, ["y_true", "y_pred"], "full").where("y_true <> y_pred").agg((F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("m", F.lit(0.0)))) / 2).alias("asymmetry"))
    kinds = table.select(F.col("y_true").alias("c")).union(table.select("y_pred")).agg(F.countDistinct("c").alias("classes"))
    s = table.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0)).alias("trace"), F.sum(((F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0)).cast("long")).alias("off_diagonal"))
    return s.join(F.broadcast(off)).join(F.broadcast(kinds)).select("classes", "total", "trace", (F.col("trace") / F.col("total")).alias("diagonal_share"), "off_diagonal", F.coalesce("asymmetry", F.lit(0.0)).alias("asymmetry"))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: N / (K n)."""
    c = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label, "n", (F.sum("n").over(_all()) / (F.count(F.lit(1)).over(_all()) * F.col("n"))).alias("weight"))


def grade(accuracy: Column, kappa: Column) -> Column:
    steps = ((0.9, 0.8, "excellent"), (0.8, 0.6, "good"), (0.7, 0.4, "fair"), (0.6, 0.2, "moderate"))
    out = F.when(F.lit(False), "")
    for a, k, name in steps:
        out = out.when((accuracy >= a) & (kappa >= k), name)
    return out.otherwise("poor")


def summary(table: DataFrame) -> DataFrame:
    """accuracy, kappa, grade, best and worst class by F1, spread of F1 (sample)."""
    c = class_table(table).agg(F.max_by("cls", F.struct("f1", -F.col("cls"))).alias("best"), F.min_by("cls", F.struct("f1", "cls")).alias("worst"), F.stddev_samp("f1").alias("f1_spread"))
    o = overall(table)
    return o.select("accuracy", "kappa", grade(F.col("accuracy"), F.col("kappa")).alias("grade")).join(F.broadcast(c))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 4096) -> DataFrame:
    """Binary area under the ROC curve by mean ranks.

    Ranks come from counts of equal scores and running sums of these, so no task sorts all rows
    unless all scores differ; then range buckets keep the running sums two-level.
    """
    s = scored.select(F.col(label).alias("y"), F.col(score).alias("s")).where("y is not null and s is not null")
    groups = s.groupBy("s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("s") * buckets))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each bucket of 0..1
    sums = groups.groupBy("b").agg(F.sum("n").alias("m")).select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.join(F.broadcast(sums), "b").withColumn("rank", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return ranked.agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def report(table: DataFrame) -> DataFrame:
    """The assessment as lines of Markdown, for ``write.text``."""
    head = overall(table).select(F.array(F.lit("# Accuracy assessment"), F.format_string("overall accuracy: %.4f", "accuracy"), F.format_string("kappa: %.4f", "kappa"), F.format_string("macro F1: %.4f", "f1_macro")).alias("lines"))
    rows = class_table(table).select(F.struct(F.lit(1).alias("o"), F.col("cls").cast("long").alias("c"), F.format_string("| %d | %.4f | %.4f | %.4f | %.0f |", F.col("cls").cast("long"), "precision", "recall", "f1", "support").alias("value")).alias("x"))
    first = head.select(F.posexplode("lines").alias("i", "value")).select(F.struct(F.lit(0).alias("o"), F.col("i").cast("long").alias("c"), "value").alias("x"))
    return first.unionByName(rows).orderBy("x.o", "x.c").select("x.value")
