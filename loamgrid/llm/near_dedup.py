"""Near-duplicate detection with BagMinHash signatures of word-shingle multisets.

A text is the multiset of its five-word shingles (a text of one to four words has one shingle, all
of it); words are runs of letters and numbers in lower case.  Two texts are linked when the
weighted Jaccard similarity of their multisets is at least ``threshold``.

Signatures.  A shingle of weight w owns Poisson processes over the discretised weights 1..w, kept
in a dyadic hierarchy: level b covers weights 2**b .. 2**(b+1)-1 as one process of rate 2**b whose
points are split over its weights, and a point counts if its weight is at most w.  Each point falls
on one of m signature places; a place keeps its earliest point.  Points are drawn up to a time
beyond which no place can change, and anew with a later time for texts where a place stayed empty,
so the signature is that of the whole process: places agree with probability equal to the
similarity.

Classes.  Exact token copies are collapsed first: rows whose whole word sequences have one SHA-256 are
one node, numbered when the nodes are written.  Nodes that agree in a band meet in its
bucket, where each is paired with the bucket's leader, not with everyone; the leader is the member
that meets most others over all bands, the hub of a group of copies.  Pairs are verified by the
overlap of the whole multisets, and links give connected components.  A bucket may then still hold
outsiders, members of other components than the leader's.  In buckets of up to ``small`` members
each outsider is verified against every member of another component.  In larger ones, members
are first dealt to finer buckets, one for each two neighbouring bands that they share, and each
finer bucket gets two leaders of its own.  The outsiders that still remain meet all members of
other components block by block: a block's overlaps are counted as one matrix product, so all pairs
are compared but only links become rows.  So every two texts that share a band are in one class or
have been compared.

Defined results: null text counts as empty; a text without words is in a class of its own; a class
is named by its smallest doc_id (a null doc_id only if there is no other); rows that repeat a
doc_id each get a row, with the class of their own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import textkernel as tk
from loamgrid.llm.common import cut, discard, spare, text_or_empty
from loamgrid.operators.graphs import graph_components as components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    small: int = 64
    reach: int = 2
    block: int = 1024

    @property
    def places(self) -> int:
        return self.bands * self.rows


_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64(0x165667B19E3779F9)


def word_digests(batch: tk.Batch) -> list[bytes | None]:
    """SHA-256 of each text's lower-cased words, each followed by a blank; None without any."""
    points = tk.lower_table()[batch.points]
    inside = tk.word_table()[batch.points].astype(bool)
    inside[batch.seps] = False
    after = np.zeros(len(inside), bool)
    after[1:] = inside[:-1]
    points[~inside] = ord(" ")
    keep = inside | after  # a word and the one place behind it
    flat, upto = points[keep].astype("<u4"), np.concatenate([[0], np.cumsum(keep)])
    bounds = np.concatenate([[0], upto[batch.seps + 1]]).tolist()
    return [sha256(flat[a:b]).digest() if b > a else None for a, b in pairwise(bounds)]


def shingles(batch: tk.Batch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle) of every shingle of every text."""
    _, _, ids, owner = tk.words(batch)
    ends = np.cumsum(np.bincount(owner, minlength=len(batch.texts)))
    n = np.diff(ends, prepend=0)
    at = np.flatnonzero(np.arange(len(ids)) <= np.maximum(ends - words, ends - n)[owner])
    acc = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < ends[owner[at]]
        part = np.where(inside, ids[np.minimum(at + k, len(ids) - 1)] if len(ids) else 0, np.uint64(k + 1))
        acc = tk.mix(acc + _STEP) ^ part
    return owner[at], tk.mix(acc)


def multiset(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight), one row for each distinct shingle of a text."""
    order = np.lexsort((shingle, owner))
    o, s = owner[order], shingle[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(first)
    return o[at], s[at], np.diff(np.append(at, len(o)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, places: int) -> np.ndarray:
    """(texts, places) 32-bit BagMinHash signatures; texts without shingles get zeros."""
    earliest = np.full(texts * places, np.inf)
    value = np.zeros(texts * places, np.uint32)
    total = np.bincount(owner, weights=weight, minlength=texts)
    todo, reach = total > 0, np.log(places) + 4.5
    while todo.any():
        limit = np.where(todo, reach * places / np.maximum(total, 1), -1.0)
        rows = np.flatnonzero(todo[owner])
        level = 0
        while len(rows):
            _points(owner[rows], shingle[rows], weight[rows], level, limit, places, earliest, value)
            level += 1
            rows = rows[weight[rows] >= 1 << level]
        todo &= np.isinf(earliest.reshape(texts, places)).any(1)
        earliest.reshape(texts, places)[todo] = np.inf
        reach *= 2
    return value.reshape(texts, places)


def _points(owner, shingle, weight, level, limit, places, earliest, value) -> None:
    """Points of one level's processes up to each text's limit, kept where they are earliest."""
    key = tk.mix(shingle + np.uint64(int(_LEVEL) * (level + 1) & (1 << 64) - 1))
    time, rate, top = np.zeros(len(key)), float(1 << level), limit[owner]
    slots, times, marks = [], [], []
    while len(key):
        key = tk.mix(key + _STEP)
        time = time - np.log1p(-((key >> np.uint64(11)) * 2.0**-53)) / rate
        on = np.flatnonzero(time <= top)
        key, time, top, owner, weight = key[on], time[on], top[on], owner[on], weight[on]
        at = tk.mix(key ^ _PLACE)
        slot = owner * places + ((at >> np.uint64(40)) % np.uint64(places)).astype(np.int64)
        good = slice(None)
        if level:
            good = (1 << level) + (at & np.uint64((1 << level) - 1)).astype(np.int64) <= weight
        slots.append(slot[good])
        times.append(time[good])
        marks.append((key >> np.uint64(32)).astype(np.uint32)[good])
    slot, when, mark = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, times, marks))
    order = np.lexsort((mark, when, slot))
    slot, when, mark = slot[order], when[order], mark[order]
    lead = np.ones(len(slot), bool)
    lead[1:] = slot[1:] != slot[:-1]
    slot, when, mark = slot[lead], when[lead], mark[lead]
    better = when < earliest[slot]
    earliest[slot[better]], value[slot[better]] = when[better], mark[better]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(tk.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = tk.mix(out * _STEP + parts[:, :, k])
    return out.view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def signed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, a hash of the text, digest of all words (null without any) and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests, keys = _texts(batch), [], [pa.array([], pa.list_(pa.int64()))]
            for a, b in tk.slices(texts):
                points = tk.Batch(texts[a:b])
                found = word_digests(points)
                bag = multiset(*shingles(points, s.words))
                digests += found
                bands = band_keys(signatures(*bag, b - a, s.places), s.bands)
                keys.append(pa.array(list(bands), pa.list_(pa.int64()), mask=np.array([d is None for d in found])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.concat_arrays(keys)], names=["doc_id", "mark", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "text")
    return rows.mapInArrow(tk.released(run), "doc_id long, mark long, digest binary, bands array<bigint>")


def text_mark() -> Column:
    return F.xxhash64(text_or_empty())


def bags(docs: DataFrame, s: Settings) -> DataFrame:
    """node and bag: the multiset of a text as sorted 32-bit marks of (shingle, occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, flat = _texts(batch), [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
            for a, b in tk.slices(texts):
                who, what, weight = multiset(*shingles(tk.Batch(texts[a:b]), s.words))
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                marks = (tk.mix(np.repeat(what, weight) + _STEP * nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                key = np.unique(np.repeat(who, weight).astype(np.uint64) << np.uint64(32) | marks)
                sizes.append(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=b - a))
                flat.append(key.astype(np.uint32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(flat).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "bag"])

    return docs.select("node", "text").mapInArrow(tk.released(run), "node long, bag array<int>")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, offsets = np.asarray(column.values), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two arrays of distinct marks."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def verified(pairs: DataFrame, bag: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose whole multisets reach the threshold.

    Each pair is a row of its own with its two bags, so a leader with many members is many rows,
    not a group.
    """
    one = pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    two = one.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    # The smaller bag must hold at least threshold of the larger.
    small, large = F.least(F.size("bag_a"), F.size("bag_b")), F.greatest(F.size("bag_a"), F.size("bag_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_lists(batch.column("bag_a")), _lists(batch.column("bag_b")), strict=True):
                same = _common(x, y)
                keep.append(same >= s.threshold * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.where(small >= large * s.threshold).select("a", "b", "bag_a", "bag_b").mapInArrow(tk.released(run), "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id, class_size and n_links of every row of ``docs``.

    n_links counts the verified links of the text's distinct word sequence.
    """
    return classes(docs, settings or Settings()).select("doc_id", "class_id", "class_size", "n_links")


def classes(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, mark, node (null without words), class_id, class_size, n_links, and the class's first
    row (first_id, first_mark) by (doc_id, mark), null doc_ids last."""
    marked = cut(signed(docs, s))
    # Copies of a word sequence are one node.
    distinct = marked.where("digest is not null").groupBy("digest").agg(F.first("bands").alias("bands"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    rows = cut(marked.where("digest is not null").select("doc_id", "mark", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "mark", "node"))
    entries = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    sizes = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(entries.join(sizes, "band"))
    discard(nodes)
    # The leader of a bucket is its hub: the member with the most company over all bands.
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    hub = F.max(F.struct("company", F.xxhash64("node").alias("o"), F.col("node").alias("leader")))
    leaders = met.join(company, "node").groupBy("band").agg(hub.alias("x"), F.max("n").alias("n")).select("band", "n", F.col("x.leader").alias("leader"))
    members = cut(_in_parts(met, leaders, "inner"))
    discard(met)
    # One row stands for a node, and for a class: the first by (doc_id, mark).
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    sized = rows.groupBy("node").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    bag = cut(_participants(docs, sized, members, s))
    pairs = members.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = cut(verified(pairs, bag, s))
    comp = components(links)

    def joined(links: DataFrame, comp: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and components with more links, whose tables take the old ones' place."""
        if not more.limit(1).count():
            discard(more)
            return links, comp
        both = cut(links.union(more).distinct())
        discard(links, comp, more)
        return both, components(both)

    crowd = cut(_crowd(members.where("n > 2"), comp))
    links, comp = joined(links, comp, cut(verified(_close_pairs(crowd, s).union(_finer_pairs(crowd, s)).distinct(), bag, s)))
    links, comp = joined(links, comp, cut(_block_links(_crowd(members.where(F.col("n") > s.small), comp), bag, s)))
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    # The classes of nodes, then of rows.
    size = sized.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = size.groupBy("comp").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size"))
    named = cut(size.select("node", "comp").join(found, "comp").join(degree, "node", "left").select("node", F.col("first.doc_id").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")))
    discard(members, bag, crowd, links, comp)
    known = rows.join(named, "node").select("doc_id", "mark", "node", "class_id", "class_size", "n_links", "first_id", "first_mark")
    alone = marked.where("digest is null").select("doc_id", "mark", F.lit(None).cast("long"), "doc_id", F.lit(1).cast("long"), F.lit(0).cast("long"), "doc_id", "mark")
    return known.union(alone)


#: So many members of a bucket, about, are one part of it in a join.
PART = 1024


def _in_parts(members: DataFrame, buckets: DataFrame, how: str) -> DataFrame:
    """Members (band, n, node) joined to a table with a row for each bucket (band, n): a bucket's row is
    sent once for each part of its members, so a large bucket is no single task's work."""
    parts = F.ceil(F.col("n") / PART)
    left = members.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    right = buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    return left.join(right, ["band", "part"], how).drop("part")


def _crowd(members: DataFrame, comp: DataFrame) -> DataFrame:
    """band, place, node, n, comp, out of the members of buckets that hold several components."""
    of = comp.select(F.col("node").alias("node"), "comp")
    lead = comp.select(F.col("node").alias("leader"), F.col("comp").alias("lead_comp"))
    crowd = members.join(of, "node", "left").join(lead, "leader", "left").select("band", "place", "node", "leader", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("lead_comp", "leader").alias("lead_comp"))
    crowd = crowd.withColumn("out", F.col("comp") != F.col("lead_comp"))
    mixed = crowd.groupBy("band").agg(F.max("out").alias("any"), F.max("n").alias("n")).where("any").select("band", "n")
    return _in_parts(crowd, mixed, "left_semi").where("node <> leader").select("band", "place", "node", "n", "comp", "out")


def _close_pairs(crowd: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of an outsider and a member of another component in a small bucket."""
    few = crowd.where(F.col("n") <= s.small)
    x = few.where("out").select("band", F.col("node").alias("x"), F.col("comp").alias("x_comp"))
    y = few.select("band", F.col("node").alias("y"), F.col("comp").alias("y_comp"))
    met = x.join(y, (x["band"] == y["band"]) & (F.col("x_comp") != F.col("y_comp")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _finer_pairs(crowd: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of a finer bucket's two leaders and its members of other components."""
    large = crowd.where(F.col("n") > s.small).groupBy("node").agg(F.first("comp").alias("comp"), F.map_from_entries(F.collect_set(F.struct("place", "band"))).alias("at"))
    band = lambda i: F.try_element_at("at", F.lit(i % s.bands))
    twos = F.array(*(F.when(band(i).isNotNull() & band(i + d).isNotNull(), F.xxhash64(band(i), band(i + d))) for d in range(1, s.reach + 1) for i in range(s.bands)))
    fine = large.select("node", "comp", F.explode(F.array_compact(twos)).alias("key"))
    who = F.struct(F.xxhash64("key", "node").alias("o"), F.col("node").alias("leader"), F.col("comp").alias("lead_comp"))
    leads = fine.groupBy("key").agg(F.min(who).alias("x"), F.max(who).alias("y"))
    met = cut(fine.join(leads, "key"))
    sides = [met.where(f"comp <> {k}.lead_comp").select(F.least("node", f"{k}.leader").alias("a"), F.greatest("node", f"{k}.leader").alias("b")) for k in "xy"]
    return sides[0].union(sides[1]).distinct()


def _block_links(crowd: DataFrame, bag: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) of the outsiders and the members of other components in large buckets.

    Outsiders and members are dealt to blocks of about ``block`` by their node, and each pair of
    blocks is one group; a text is sent once for each block of the other side.
    """
    crowd = cut(crowd)
    sizes = crowd.groupBy("band").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("out").cast("long")).alias("outs"))
    sizes = sizes.select("band", F.ceil(F.col("outs") / s.block).alias("kx"), F.ceil(F.col("all") / s.block).alias("ky"))
    dealt = crowd.join(sizes, "band").withColumn("h", F.xxhash64("node"))
    steps = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    x = dealt.where("out").select("band", F.pmod("h", "kx").alias("bx"), steps("ky").alias("by"), F.lit(0).alias("side"), "node", "comp")
    y = dealt.select("band", steps("kx").alias("bx"), F.pmod("h", "ky").alias("by"), F.lit(1).alias("side"), "node", "comp")

    def run(rows: pa.Table) -> pa.Table:
        side, node, comp = (rows.column(c).to_numpy() for c in ("side", "node", "comp"))
        sets = [b for chunk in rows.column("bag").chunks for b in _lists(chunk)]
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = _linked([sets[k] for k in i], [sets[k] for k in j], s.threshold)
        a, b = i[a], j[b]
        other = comp[a] != comp[b]
        a, b = node[a[other]], node[b[other]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = x.union(y).join(bag, "node")
    return met.groupBy("band", "bx", "by").applyInArrow(run, "a long, b long").distinct()


def _linked(xs: list[np.ndarray], ys: list[np.ndarray], threshold: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all sets of ``xs`` and ``ys`` that reach the threshold.

    Overlaps are products of 0/1 matrices over the marks that both sides hold, ``width`` marks at a
    time; counts are whole numbers below 2**24 in each product and are summed as integers.
    """
    if not xs or not ys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, m = (np.array([len(v) for v in side]) for side in (xs, ys))
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    same = np.zeros((len(xs), len(ys)), np.int64)
    sides = []
    for side, size in ((xs, n), (ys, m)):
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), size)
        at = np.searchsorted(shared, flat)
        on = at < len(shared)
        on[on] = shared[at[on]] == flat[on]
        order = np.argsort(at[on], kind="stable")
        sides.append((row[on][order], at[on][order]))
    for start in range(0, len(shared), width):
        ones = []
        for (row, at), k in zip(sides, (len(xs), len(ys)), strict=True):
            a, b = np.searchsorted(at, [start, start + width])
            one = np.zeros((k, min(width, len(shared) - start)), np.float32)
            one[row[a:b], at[a:b] - start] = 1
            ones.append(one)
        same += (ones[0] @ ones[1].T).astype(np.int64)
    return np.nonzero(same >= threshold * (n[:, None] + m[None, :] - same))


def _participants(docs: DataFrame, sized: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Bags of the nodes that are in some bucket, from the first row of each."""
    wanted = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), text_mark().alias("mark"))
    rows = sized.join(wanted, "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("mark"))
    named = texts.join(rows, (texts["mark"] == rows["mark"]) & texts["doc_id"].eqNullSafe(rows["id"])).select("node", "text")
    return bags(named, s).groupBy("node").agg(F.first("bag").alias("bag"))


def keep_one_of_each(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each class of near duplicates, with all its columns: the first by (doc_id, hash of
    the text), null doc_ids last.  A row without words is a class of its own; of rows alike in doc_id
    and text one stays."""
    key = lambda doc_id, mark: F.concat_ws(":", mark.cast("string"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")))
    (name,) = spare(docs, "__keep")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    kept = classes(docs, settings or Settings()).where(first).select(key(F.col("doc_id"), F.col("mark")).alias(name))
    return docs.withColumn(name, key(F.col("doc_id"), text_mark())).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
