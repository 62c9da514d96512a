"""Samples, splits, folds and scaling; every draw is a hash of the id and a seed, so it repeats.

``draw`` uses integer arithmetic that any SQL engine has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.quantiles import percentiles, ranked


def draw(key: str = "id", seed: int = 42) -> Column:
    """A whole number in 0..999982, spread evenly over ids."""
    return F.pmod((F.pmod(F.col(key), F.lit(999983)) + seed) * 7919, F.lit(999983))


def by_draw(rows: DataFrame, label: str, seed: int) -> DataFrame:
    """Adds _r, the rank of the draw within each label, and _m, the label's rows."""
    return ranked(rows, [label], F.floor(draw("id", seed) / 4096), draw("id", seed), "id", rank="_r", size="_m")


def stratified_split(rows: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, label: str = "label", seed: int = 42) -> DataFrame:
    """Adds part: train, val or test, by rank of the draw within each label."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the shares must sum to 1")
    at = (F.col("_r") - 0.5) / F.col("_m")
    return by_draw(rows, label, seed).withColumn("part", F.when(at < train, "train").when(at < train + val, "val").otherwise("test")).drop("_r", "_m")


def random_split(rows: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    at = draw("id", seed) / 999983
    return rows.withColumn("part", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))


def folds(rows: DataFrame, k: int = 5, label: str | None = "label", seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1; with a label each class is dealt out evenly."""
    if label is None:
        return rows.withColumn("fold", F.pmod(draw("id", seed), F.lit(k)).cast("long"))
    return by_draw(rows, label, seed).withColumn("fold", ((F.col("_r") - 1) % k).cast("long")).drop("_r", "_m")


def spatial_block_folds(rows: DataFrame, block: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: whole blocks of space are dealt to folds by the draw of their number."""
    b = rows.withColumn("block", F.floor(F.col("row") / block) * 100003 + F.floor(F.col("col") / block))
    return b.withColumn("fold", F.pmod(draw("block", seed), F.lit(k)).cast("long"))


def _in_blocks(points: DataFrame, block: int, of: str, parts: Callable[[int], int]) -> DataFrame:
    """Points (id, row, col) packed into rows of about ``block`` of them, sorted by id."""
    blocks = max(1, -(-points.count() // block))
    dealt = points.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.struct("id", "row", "col").alias("p")).repartition(parts(blocks), "b")
    return dealt.groupBy("b").agg(F.array_sort(F.collect_list("p")).alias("p")).select(*(F.col(f"p.{c}").alias(f"{of}_{c}") for c in ("id", "row", "col")))


def buffered_loo(points: DataFrame, test: DataFrame, buffer: float, block: int = 512) -> DataFrame:
    """test_id, id: for each test point the training points outside its buffer.

    The result itself has a row for every such pair; :func:`buffered_out` gives the few that are
    left out instead.  Blocks of points meet blocks of test points, so nothing is shuffled for each
    pair, and a task writes a block's ids over and over in one order, which files encode in a part
    of a pair's bytes.
    """
    tasks = 8 * points.sparkSession.sparkContext.defaultParallelism
    left = _in_blocks(points, block, "p", lambda n: min(n, tasks))
    right = _in_blocks(test, block, "t", lambda n: -(-n // 256))
    kinds = [test.schema["id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, t = ({c: batch.column(f"{s}_{c}")[i].values for c in ("id", "row", "col")} for s in ("p", "t"))
                d2 = sum(np.square(p[c].to_numpy(zero_copy_only=False) - t[c].to_numpy(zero_copy_only=False)[:, None]) for c in ("row", "col"))
                other = t["id"].to_numpy(zero_copy_only=False)[:, None] != p["id"].to_numpy(zero_copy_only=False)
                a, b = np.nonzero(other & (d2 > buffer * buffer))
                yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(a)), p["id"].take(pa.array(b))], names=["test_id", "id"])

    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(run, f"test_id {kinds[0]}, id {kinds[1]}")


def buffered_out(points: DataFrame, test: DataFrame, buffer: float) -> DataFrame:
    """test_id, id: the training points within each test point's buffer, met on cells of its size."""
    cell = lambda y, x: (F.floor(y / buffer).alias("a"), F.floor(x / buffer).alias("b"))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = F.explode(F.flatten(F.transform(three, lambda i: F.transform(three, lambda j: F.struct((F.col("a0") + i).alias("a"), (F.col("b0") + j).alias("b"))))))
    t = test.select(F.col("id").alias("test_id"), F.col("row").alias("tr"), F.col("col").alias("tc"), F.floor(F.col("row") / buffer).alias("a0"), F.floor(F.col("col") / buffer).alias("b0"))
    t = t.select("test_id", "tr", "tc", around.alias("k")).select("test_id", "tr", "tc", "k.a", "k.b")
    d2 = (F.col("row") - F.col("tr")) * (F.col("row") - F.col("tr")) + (F.col("col") - F.col("tc")) * (F.col("col") - F.col("tc"))
    met = points.select("id", "row", "col", *cell(F.col("row"), F.col("col"))).join(t, ["a", "b"])
    return met.where((F.col("id") != F.col("test_id")) & (d2 <= buffer * buffer)).select("test_id", "id")


def _by_time(rows: DataFrame, time: str) -> DataFrame:
    """id, r (place from 0 by time, then id) and n, by counts of spans of time."""
    kind = rows.schema[time].dataType.typeName()
    span = F.to_date(time) if kind.startswith("timestamp") else F.shiftright(F.col(time), 12) if kind in ("long", "integer", "short") else F.floor(time) if kind in ("double", "float") else F.col(time)
    return ranked(rows.select("id", time), [], span, time, "id", rank="r", size="n").select("id", (F.col("r") - 1).alias("r"), "n")


def sliding_folds(rows: DataFrame, k: int = 5, gap: int = 0, time: str = "t") -> DataFrame:
    """id, fold, part: fold i trains on the i-th of k + 1 equal spans and tests the next, ``gap`` rows later."""
    f = _by_time(rows, time).withColumn("size", F.floor(F.col("n") / (k + 1))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("fold") * F.col("size")
    first = start + F.col("size") + gap
    part = F.when((F.col("r") >= start) & (F.col("r") < start + F.col("size")), "train").when((F.col("r") >= first) & (F.col("r") < F.least(first + F.col("size"), F.col("n"))), "test")
    return f.withColumn("part", part).where("part is not null").select("id", F.col("fold").cast("long").alias("fold"), "part")


def distance_folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: the group of each point (row, col) under k-means, so folds are far from each other."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["row", "col"], outputCol="_xy").transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="_xy", predictionCol="_fold").fit(x).transform(x).withColumn("fold", F.col("_fold").cast("long")).drop("_xy", "_fold")


def time_folds(rows: DataFrame, k: int = 5, gap: int = 0, time: str = "t") -> DataFrame:
    """id, fold, part: fold i tests the i-th of k equal spans after the first, trains on all before it."""
    r = _by_time(rows, time)
    size = F.floor(F.col("n") / (k + 1))
    f = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("start", F.col("n") - (k - F.col("fold")) * size)
    part = F.when((F.col("r") >= F.col("start")) & (F.col("r") < F.col("start") + size), "test").when(F.col("r") < F.col("start") - gap, "train")
    return f.withColumn("part", part).where("part is not null").select("id", F.col("fold").cast("long").alias("fold"), "part")


def undersample(rows: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """The first draws of every class, as many as the smallest class has."""
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return by_draw(rows, label, seed).join(F.broadcast(least)).where("_r <= least").drop("_r", "_m", "least")


def oversample(rows: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """Rows of every class repeated, the first draws once more, up to the largest class; copy from 0."""
    most = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    r = by_draw(rows, label, seed).join(F.broadcast(most))
    times = F.floor(F.col("most") / F.col("_m")) + (F.col("_r") <= F.col("most") % F.col("_m")).cast("long")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_m", "most", "_r")


def bootstrap_counts(rows: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """id, round, times: each row's Poisson(1) multiplicity in each round, by inversion of a draw;
    rows with 0 are out of the bag."""
    u = F.pmod((F.pmod(F.col("id"), F.lit(999983)) + F.col("round") * 104729 + seed) * 7919, F.lit(999983)) / 999983
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)
    t = sum(((F.col("u") >= s).cast("long") for s in steps), F.lit(0).cast("long"))
    return rows.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("round")).withColumn("u", u).select("id", "round", t.alias("times"))


def estimate_632(boot: Column, oob: Column) -> Column:
    return 0.632 * oob + 0.368 * boot


def normalise(rows: DataFrame, col: str = "x", method: str = "minmax", clip: tuple[float, float] | None = None) -> DataFrame:
    """Adds y: (x - a) / b of the column; minmax, zscore (population) or robust (median, MAD); b 0 counts as 1."""
    if method == "minmax":
        p = rows.agg(F.min(col).alias("a"), (F.max(col) - F.min(col)).alias("b"))
    elif method == "zscore":
        p = rows.agg(F.avg(col).alias("a"), F.stddev_pop(col).alias("b"))
    elif method == "robust":
        mid = percentiles(rows, [], col, [0.5]).select(F.get("q", F.lit(0)).alias("a"))
        away = rows.join(F.broadcast(mid)).select(F.abs(F.col(col) - F.col("a")).alias("d"))
        p = mid.join(percentiles(away, [], "d", [0.5]).select(F.get("q", F.lit(0)).alias("b")))
    else:
        raise ValueError(f"unknown method {method}")
    y = (F.col(col) - F.col("a")) / F.when(F.col("b") == 0, 1.0).otherwise(F.col("b"))
    if clip:
        y = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), y))
    return rows.join(F.broadcast(p)).withColumn("y", y).drop("a", "b")


def histogram(rows: DataFrame, col: str = "x", bins: int = 50) -> DataFrame:
    """bin, n over equal bins of the range; the maximum falls in the last."""
    p = rows.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.join(F.broadcast(p)).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extract_samples(cube: DataFrame, samples: DataFrame) -> DataFrame:
    """Sample points (x, y, class_id) with the spectrum of the pixel they fall in."""
    at = samples.select(F.floor("y").alias("row"), F.floor("x").alias("col"), "class_id")
    return at.join(cube, ["row", "col"])


def mixup(a: DataFrame, b: DataFrame, lam: Column) -> DataFrame:
    """Blends of paired rows (id, spec, label): lam of a and the rest of b."""
    j = a.select("id", F.col("spec").alias("sa"), F.col("label").alias("la")).join(b.select("id", F.col("spec").alias("sb"), F.col("label").alias("lb")), "id").withColumn("lam", lam)
    return j.select("id", F.zip_with("sa", "sb", lambda x, y: x * F.col("lam") + y * (1 - F.col("lam"))).alias("spec"), "la", "lb", "lam")


def augment_spectrum(spec: Column, noise: float = 0.0, brightness: float = 1.0, contrast: float = 1.0, shift: int = 0) -> Column:
    """Brightness, contrast about the mean and a band shift with linear extrapolation at the ends;
    noise is left to :func:`add_noise`, which draws."""
    from loamgrid.functions.arrays import let, mean

    scaled = F.transform(spec, lambda x: x * brightness)
    spread = let(mean(scaled), lambda m: F.transform(scaled, lambda x: (x - m) * contrast + m))
    if not shift:
        return spread
    n = F.size(spec)

    def moved(s: Column) -> Column:
        first, last = F.element_at(s, 1), F.element_at(s, -1)
        lead, tail = F.element_at(s, 2) - first, last - F.element_at(s, -2)
        at = lambda i: F.when(i < 0, first + lead * i).when(i >= n, last + tail * (i - n + 1)).otherwise(F.element_at(s, F.greatest(F.lit(0), F.least(i, n - 1)) + 1))
        return F.transform(s, lambda x, i: at(i - shift))

    return let(spread, moved)


def add_noise(rows: DataFrame, level: float, seed: int = 42) -> DataFrame:
    """Gaussian noise of ``level`` times each spectrum's standard deviation, by hashed draws."""
    from loamgrid.functions.arrays import std

    u = lambda i, k: (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    s = rows.withColumn("_s", std(F.col("spec")) * level)
    normal = lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(6.283185307179586 * u(i, 1))
    return s.withColumn("spec", F.transform("spec", lambda x, i: x + F.col("_s") * normal(i))).drop("_s")


def cutmix(a: DataFrame, b: DataFrame, height: int, width: int, alpha: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Paired patches (id, row, col, spec) of a with a box of b pasted in, and (id, lam), the share of a.

    The box of an id has the area 1 - lam of a draw and a drawn centre, cut off at the edges, and lam
    is then set to what is left.  lam is uniform (``alpha`` 1) or a power of it.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed + k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cut_at = F.sqrt(1 - F.pow(u(0), F.lit(1.0 / alpha)))
    box = a.select("id").distinct().withColumn("h", F.floor(cut_at * height)).withColumn("w", F.floor(cut_at * width)).withColumn("cy", F.floor(u(1) * height)).withColumn("cx", F.floor(u(2) * width))
    clip = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n)))
    box = box.select("id", clip(F.col("cy") - F.expr("h div 2"), height).alias("top"), clip(F.col("cy") + F.expr("h div 2"), height).alias("bottom"), clip(F.col("cx") - F.expr("w div 2"), width).alias("left"), clip(F.col("cx") + F.expr("w div 2"), width).alias("right"))
    inside = (F.col("row") >= F.col("top")) & (F.col("row") < F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") < F.col("right"))
    j = a.join(b.select("id", "row", "col", F.col("spec").alias("other")), ["id", "row", "col"]).join(box, "id")
    lam = box.select("id", (1 - (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left")) / float(height * width)).alias("lam"))
    return j.select("id", "row", "col", F.when(inside, F.col("other")).otherwise(F.col("spec")).alias("spec")), lam


def augment(rows: DataFrame, steps: list[dict], seed: int = 42) -> DataFrame:
    """Rows (id, spec) and, for each step, a copy of all with step from 1: a step is a dict with
    ``noise`` or the parameters of :func:`augment_spectrum`."""
    out = rows.withColumn("step", F.lit(0))
    for i, step in enumerate(steps, 1):
        noise = step.get("noise", 0.0)
        copy = rows.withColumn("spec", augment_spectrum(F.col("spec"), **{k: v for k, v in step.items() if k != "noise"}))
        copy = add_noise(copy, noise, seed + i) if noise else copy
        out = out.unionByName(copy.withColumn("step", F.lit(i)))
    return out


def augmentation_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sizes of two tables of spectra, their ratio, and the changes of mean and deviation."""
    s = lambda t, k: t.select(F.explode("spec").alias("x")).agg(F.avg("x").alias(f"mean_{k}"), F.stddev_pop("x").alias(f"std_{k}")).join(F.broadcast(t.agg(F.count(F.lit(1)).alias(f"n_{k}"))))
    j = s(before, "before").join(F.broadcast(s(after, "after")))
    return j.select("n_before", "n_after", (F.col("n_after") / F.col("n_before")).alias("ratio"), (F.col("mean_after") - F.col("mean_before")).alias("mean_change"), (F.col("std_after") - F.col("std_before")).alias("std_change"))


def memory_megabytes(shape: tuple[int, ...], item_bytes: int, copies: int = 1) -> float:
    """What arrays of a shape take."""
    n = copies * item_bytes
    for k in shape:
        n *= k
    return n / (1 << 20)
