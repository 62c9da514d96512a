"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Tokens are words (runs of letters and numbers), and runs of other marks.  A text's features are
hashed n-grams of two token streams: the lower-cased words themselves (one and two words), and
their forms (one to three tokens), where a token's form is its kind of capitals, a mark itself, or
"again" when it repeats the token before.  A feature's value is its share of the stream.  Scores
are sparse dot products with the weights through the logistic function.

Training visits a bounded sample of labelled rows, ``max_training_rows`` of them by a hash of
doc_id (a parameter; all if fewer), gathered as sparse rows, one at a time in a fixed order, with
follow-the-regularised-leader updates for each coordinate.  The weights, 2**bits floats, are the
only thing sent to the executors.  Everything else covers all rows.

Defined results: null text counts as empty; an empty text is scored by the bias alone; without
labels every score is 0.5; rows repeated in ``labels`` count once (label 1 if any says so); null
labels and ids are left out; of several texts with one doc_id the one with the least hash teaches,
whatever the order of rows; repeated documents are scored each; labels, lang, source and doc_id
are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import textkernel as tk
from loamgrid.llm.common import text_or_empty

THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold rows of which labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    scale: float = 12.0
    max_training_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(8)]


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, slot, value) of every n-gram occurrence; slots may repeat within a text."""
    batch = tk.Batch(texts)
    points, word = batch.points, tk.word_table()[batch.points]
    kind = np.where(word == 1, 2, np.where(np.isin(batch.classes(), (tk.END, tk.SPACE, tk.BLANK)), 0, 1)).astype(np.int8)
    turn = np.flatnonzero(np.diff(kind, prepend=-1))
    stop = np.append(turn[1:], len(kind))
    keep = kind[turn] > 0
    starts, ends = turn[keep], stop[keep]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    lower = tk.lower_table()[points]
    owner, ids = batch.owner(starts), tk.range_hashes(lower, starts, ends)
    capitals = np.concatenate([[0], np.cumsum(lower != points)])
    n_caps, size = capitals[ends] - capitals[starts], ends - starts
    first_cap = lower[starts] != points[starts]
    form = np.where(n_caps == 0, 1, np.where((n_caps > 1) & (n_caps * 2 > size), 2, np.where(first_cap, 3, 4))).astype(np.uint64)
    form = np.where(kind[starts] == 1, ids, form)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    form = np.where(same, np.uint64(5), form)
    together = lambda n: owner[n:] == owner[:-n]
    grams = [(owner, tk.mix(ids ^ _SALT[0])), (owner, tk.mix(form ^ _SALT[1]))]
    if len(ids) > 1:
        t = together(1)
        grams += [(owner[1:][t], tk.mix(tk.mix(ids[:-1][t] ^ _SALT[2]) + ids[1:][t])), (owner[1:][t], tk.mix(tk.mix(form[:-1][t] ^ _SALT[3]) + form[1:][t]))]
    if len(ids) > 2:
        t = together(2)
        grams.append((owner[2:][t], tk.mix(tk.mix(tk.mix(form[:-2][t] ^ _SALT[4]) + form[1:-1][t]) + form[2:][t])))
    who = np.concatenate([g[0] for g in grams])
    slots = (np.concatenate([g[1] for g in grams]) >> np.uint64(64 - bits)).astype(np.int64)
    share = 1.0 / np.bincount(owner, minlength=len(texts)).clip(1)
    return who, slots, share[who]


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def sparse_rows(labelled: DataFrame, settings: Settings) -> DataFrame:
    """key, label and the distinct slots and values of each labelled text, as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, slots, values = texts_of(batch), [], []
            for a, b in tk.slices(texts):
                who, slot, value = features(texts[a:b], settings.bits)
                key, back = np.unique(who << settings.bits | slot, return_inverse=True)
                total = np.bincount(back, weights=value, minlength=len(key)).astype(np.float32)
                bounds = np.searchsorted(key >> settings.bits, np.arange(b - a + 1))
                slot = (key & (1 << settings.bits) - 1).astype(np.uint32)
                for i in range(b - a):
                    slots.append(slot[bounds[i] : bounds[i + 1]].tobytes())
                    values.append(total[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["key", "label", "slots", "values"])

    return labelled.select("key", "label", "text").mapInArrow(tk.released(run), "key long, label int, slots binary, values binary")


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes over (label, slots, values)."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    weights = lambda at: np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))
    for _ in range(s.epochs):
        for label, slots, values in rows:
            at, x = np.append(slots.astype(np.int64), size - 1), np.append(values.astype(np.float64) * s.scale, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    out = weights(np.arange(size))
    out[:-1] *= s.scale
    return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> np.ndarray:
    """Weights learnt from the labelled rows outside the held-out fold."""
    s = settings or Settings()
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.where(~held_out("key")).groupBy("key").agg(F.max("label").alias("label"))
    # A bounded sample: at most max_training_rows ids, and one text of each: the first by its hash.
    sample = known.orderBy(F.xxhash64("key"), "key").limit(s.max_training_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(F.broadcast(sample), "key")
    one = texts.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64(text_or_empty()).alias("mark"), "text")).alias("x")).select("key", "label", "x.text")
    found = sparse_rows(one, s).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: ((keys[i] * 0x9E3779B97F4A7C15) & ((1 << 61) - 1), keys[i])) if (keys := found["key"].to_pylist()) else []
    labels_, slots, values = (found[c].combine_chunks() for c in ("label", "slots", "values"))

    def row(i: int) -> tuple[int, np.ndarray, np.ndarray]:
        return labels_[i].as_py(), np.frombuffer(slots[i].as_buffer(), np.uint32), np.frombuffer(values[i].as_buffer(), np.float32)

    return ftrl([row(i) for i in order], s)


def scores(texts: list[str], weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in tk.slices(texts):
        who, slots, values = features(texts[a:b], bits)
        out[a:b] = np.bincount(who, weights=weights[slots] * values, minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -35, 35)))


def _sent(docs: DataFrame, weights: np.ndarray):
    """The weights, 4 bytes for each of the fixed number of slots, as a broadcast."""
    pa.default_memory_pool().release_unused()  # the training rows are done with
    return docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    s = settings or Settings()
    weights = _sent(docs, train(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(texts_of(batch), weights.value, s.bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(tk.released(run), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    s = settings or Settings()
    weights = _sent(docs, train(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(texts_of(batch), weights.value, s.bits) >= threshold))

    return docs.mapInArrow(tk.released(run), docs.schema)
