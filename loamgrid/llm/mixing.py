"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Each source's documents, in the order of a hash, are cut into blocks of ``block_chars`` characters.
A perfectly even mixture gives each source that has blocks left a share of every slot in proportion
to its exact target weight.  A source's j-th block is released at the slot in which the even mixture
starts it and due at the slot in which it ends it; while no source has run out these are
floor(j / w) and ceil((j + 1) / w).  In each slot the released block that is due first runs, so no
source is ever a block or more away from the even mixture, however long the input and however small
the weight.  When a source has run out the others go on in their proportions; nothing is dropped and
nothing repeats.

The slots are cut into windows of ``resolution`` that are laid out side by side.  A window needs only
each source's count at its start, and these are found without a walk over all slots: every window
starts from a guess (the whole blocks of the even mixture, and the blocks due first for the rest),
runs its slots, and hands its end to the next window; windows whose start was another one run
again, until every start is the end of the window before.  That is the one schedule that a walk
would give.  Two schedules that differ in a few blocks meet again soon, so the rounds are few.
Places within a source are two-level sums (hash buckets, then rows within a bucket), so a source
with a third of all rows is spread like any other.

Defined results: null text counts as empty; a document's size is its characters plus one; a null
source is a source of its own; rows that repeat doc_id, source and text share one place; sources
without a target get the smallest positive target given; sources with target 0 follow, evenly by
size, when all others have run out; negative, infinite or not-a-number targets are refused; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.llm.common import cut, discard, shuffle_width, spare, text_or_empty

BUCKET_BITS = 12


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _unit() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), _source(), text_or_empty())


def units(docs: DataFrame, seed: int) -> DataFrame:
    """key, src, size, h: one row for each distinct document of a source."""
    rows = docs.select(_unit().alias("key"), _source().alias("src"), (F.length(text_or_empty()) + 1).cast("long").alias("size"))
    rows = rows.groupBy("key", "src").agg(F.sum("size").alias("size"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "key")).withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))


def blocks(docs: DataFrame, block_chars: int, seed: int) -> DataFrame:
    """Each unit's block within its source, by two-level running sums of sizes."""
    u = units(docs, seed)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("src", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    sums = u.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    starts = sums.select("src", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    placed = u.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["src", "bucket"])
    return placed.select("key", "src", "size", "h", F.expr(f"(start + run) div {block_chars}").alias("block"))


def sources(docs: DataFrame, targets: dict[str | None, float] | None, block_chars: int, power: float) -> DataFrame:
    """src, n (blocks), w (share of the slots of its phase), phase (1: only after phase 0)."""
    rows = docs.select(_unit().alias("key"), _source().alias("src"), (F.length(text_or_empty()) + 1).cast("long").alias("size"))
    total = rows.groupBy("src").agg(F.sum("size").alias("total"))
    weight = F.pow(F.col("total").cast("double"), F.lit(power))
    if targets:
        if not all(math.isfinite(w) and w >= 0 for w in targets.values()):
            raise ValueError("targets must be finite and not negative")
        least = min((w for w in targets.values() if w > 0), default=0.0)
        pairs = [x for name, w in targets.items() for x in (F.lit("null" if name is None else f"={name}"), F.lit(float(w)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("src")), F.lit(float(least)))
    late = total.withColumn("w", weight).withColumn("phase", (F.col("w") <= 0).cast("int"))
    late = late.withColumn("w", F.when(F.col("phase") == 1, F.col("total").cast("double")).otherwise(F.col("w")))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("phase"))  # a row for each source
    return late.select("src", F.expr(f"(total - 1) div {block_chars} + 1").alias("n"), share.alias("w"), "phase")


def _head(srcs: Column, s: Column, d: Column) -> Column:
    """struct<d, rel, due>: block d of source s with its release and deadline on the slot line."""
    at = lambda time: F.aggregate(srcs, F.lit(0.0), lambda acc, o: acc + F.least(o["n"].cast("double"), o["w"] * time))
    # Rounding errors of the sums must not move a whole number to its neighbour.
    return F.struct(d.alias("d"), F.floor(at(d / s["w"]) + 1e-9).alias("rel"), F.ceil(at((d + 1) / s["w"]) - 1e-9).alias("due"))


def _heads(srcs: Column, done: Column) -> Column:
    return F.transform(done, lambda d, i: _head(srcs, F.get(srcs, i), d))


def _run_first(srcs: Column, heads: Column, t: Column, then) -> Column:
    """``then(first, heads after it)``, first being the struct<due, i, d> that runs in slot t."""
    one = lambda h, i: F.struct(h["due"].alias("due"), i.alias("i"), h["d"].alias("d"))
    left = lambda h, i: h["d"] < F.get(srcs, i)["n"]
    released = F.array_min(F.transform(heads, lambda h, i: F.when(left(h, i) & (h["rel"] <= t), one(h, i))))
    first = F.coalesce(released, F.array_min(F.transform(heads, lambda h, i: F.when(left(h, i), one(h, i)))))
    after = lambda f: F.transform(heads, lambda h, i: F.when(i == f["i"], _head(srcs, F.get(srcs, i), h["d"] + 1)).otherwise(h))
    return F.get(F.transform(F.array(first), lambda f: then(f, after(f))), F.lit(0))


def _zero(srcs: Column) -> Column:
    return F.transform(srcs, lambda _: F.lit(0).cast("long"))


def _guess(srcs: Column, slot: Column) -> Column:
    """Each source's count after ``slot`` slots: whole blocks of the even mixture, and for the rest
    the released blocks that are due first."""
    # The time of the even mixture: sources that run out by then give all they have, the others w a unit.
    ends = F.concat(F.array(F.lit(0.0)), F.transform(srcs, lambda o: o["n"] / o["w"]))
    spent = lambda end: F.aggregate(srcs, F.lit(0.0), lambda acc, o: acc + F.when(o["n"] / o["w"] <= end, o["n"].cast("double")).otherwise(0.0))
    rate = lambda end: F.aggregate(srcs, F.lit(0.0), lambda acc, o: acc + F.when(o["n"] / o["w"] <= end, 0.0).otherwise(o["w"]))
    time = F.array_max(F.transform(ends, lambda end: F.when(rate(end) > 0, (slot - spent(end)) / rate(end)).otherwise(0.0)))

    def fill(whole: Column) -> Column:
        left = slot - F.aggregate(whole, F.lit(0).cast("long"), lambda acc, d: acc + d)
        heads = F.transform(whole, lambda d, i: F.struct(_head(srcs, F.get(srcs, i), d).alias("h"), i.alias("i")))
        can = F.filter(heads, lambda x: (x["h"]["d"] < F.get(srcs, x["i"])["n"]) & (x["h"]["rel"] < slot))
        first = F.slice(F.array_sort(F.transform(can, lambda x: F.struct(x["h"]["due"].alias("due"), x["i"].alias("i")))), 1, F.greatest(left, F.lit(0)).cast("int"))
        return F.transform(whole, lambda d, i: d + F.exists(first, lambda f: f["i"] == i).cast("long"))

    whole = lambda t: F.transform(srcs, lambda o: F.least(o["n"], F.floor(o["w"] * t + 1e-9)))
    return F.get(F.transform(F.array(time), lambda t: F.get(F.transform(F.array(whole(t)), fill), F.lit(0))), F.lit(0))


def window_starts(windows: DataFrame, window: int) -> DataFrame:
    """phase, k, done: each source's count at the start of every window of (phase, k, srcs, total)."""
    slots = F.sequence(F.col("k") * window, F.least((F.col("k") + 1) * window, F.col("total")) - 1)

    def ends(starts: DataFrame) -> DataFrame:
        heads = F.aggregate(slots, _heads(F.col("srcs"), F.col("done")), lambda h, t: _run_first(F.col("srcs"), h, t, lambda _, after: after))
        ran = starts.join(windows, ["phase", "k"]).where(F.col("total") > (F.col("k") + 1) * window)
        return ran.select("phase", (F.col("k") + 1).alias("k"), F.transform(heads, lambda h: h["d"]).alias("end"))

    starts = cut(windows.select("phase", "k", F.when(F.col("k") == 0, _zero(F.col("srcs"))).otherwise(_guess(F.col("srcs"), F.col("k") * window)).alias("done")))
    changed = starts
    while True:
        moved = cut(ends(changed).join(starts, ["phase", "k"]).where("end <> done").select("phase", "k", F.col("end").alias("done")))
        if not moved.limit(1).count():
            discard(moved)
            return starts
        before, starts = starts, cut(starts.join(moved.select("phase", "k"), ["phase", "k"], "left_anti").unionByName(moved))
        discard(before)
        changed = moved


def schedule_targets(plan: DataFrame, window: int) -> DataFrame:
    """src, block, slot: the global slot of every block of a table of (src, n, w, phase)."""
    one = plan.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("src", F.col("n").cast("long").alias("n"), F.col("w").cast("double").alias("w")))).alias("srcs"), F.sum("n").alias("total"))
    before = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)  # two rows at most
    one = one.withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0)))
    width = shuffle_width(plan.sparkSession)
    windows = cut(one.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {window}")))).repartition(width, "phase", "k"))
    ready = windows.join(window_starts(windows, window), ["phase", "k"])
    begin = F.struct(_heads(F.col("srcs"), F.col("done")).alias("heads"), F.array().cast("array<struct<i:int,d:bigint>>").alias("out"))
    slots = F.sequence(F.col("k") * window, F.least((F.col("k") + 1) * window, F.col("total")) - 1)

    def lay(acc: Column, t: Column) -> Column:
        ran = lambda f: F.concat(acc["out"], F.array(F.struct(f["i"].alias("i"), f["d"].alias("d"))))
        return _run_first(F.col("srcs"), acc["heads"], t, lambda f, after: F.struct(after.alias("heads"), ran(f).alias("out")))

    laid = ready.select("srcs", "k", "first", F.posexplode(F.aggregate(slots, begin, lay, lambda acc: acc["out"])).alias("t", "x"))
    return laid.select(F.get("srcs", F.col("x.i"))["src"].alias("src"), F.col("x.d").alias("block"), (F.col("first") + F.col("k") * window + F.col("t")).alias("slot"))


def _placed(docs: DataFrame, targets, block_chars: int, resolution: int, power: float, seed: int) -> DataFrame:
    slots = schedule_targets(sources(docs, targets, block_chars, power), resolution)
    return blocks(docs, block_chars, seed).join(slots, ["src", "block"])


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, *, block_chars: int = 65_536, resolution: int = 256, power: float = 0.5, seed: int = 7) -> DataFrame:
    """doc_id, source, n_units (characters and one), block and slot of every row of ``docs``.

    targets: weights by source; none: each source's size to the ``power``.
    """
    placed = _placed(docs, targets, block_chars, resolution, power, seed).select("key", "block", "slot")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.length(text_or_empty()) + 1).cast("long").alias("n_units"), _unit().alias("key"))
    return rows.join(placed, "key").select("doc_id", "source", "n_units", "block", "slot")


def mixed_rows(docs: DataFrame, targets: dict[str | None, float] | None = None, *, block_chars: int = 65_536, resolution: int = 256, power: float = 0.5, seed: int = 7) -> DataFrame:
    """All rows and columns of ``docs`` in mixed order: partitions are ranges of slots, sorted."""
    key, slot, h = spare(docs, "__key", "__slot", "__h")
    placed = _placed(docs, targets, block_chars, resolution, power, seed).select(F.col("key").alias(key), F.col("slot").alias(slot), F.col("h").alias(h))
    rows = docs.withColumn(key, _unit()).join(placed, key)
    n = shuffle_width(docs.sparkSession)
    return rows.repartitionByRange(n, slot, h).sortWithinPartitions(slot, h).drop(key, slot, h)
