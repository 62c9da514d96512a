"""Exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z.  A document's digest is the SHA-256
of that text.  Digests are pre-aggregated over (digest, salt), so that of any number of copies at
most ``SALTS`` rows travel on, then dealt by digest to index buckets, whose number grows with the
rows.  Each bucket is a :class:`CuckooIndex`: a cuckoo filter answers whether a digest may be live,
a hit is verified against the full keys stored for its slot, and a filter that overflows is rebuilt
with twice the buckets from the stored keys.  When a larger doc_id arrives, the live entry is deleted and the new
one inserted.

Defined results: null text equals empty text; of equal texts the largest doc_id stays, a null
doc_id only if there is no other; rows that repeat both text and doc_id are each reported, and the
pipeline stage keeps one of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import shuffle_width, spare, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
#: An index bucket gets about so many digests at most, whatever the input.
BUCKET_ROWS = 500_000


class CuckooIndex:
    """A set of live digests with values: a cuckoo filter in front of the stored keys."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)  # 16-bit fingerprints, 0: free
        self.rows = [0] * (buckets * self.SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _home(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1.  A fingerprint hit counts only if the stored key agrees."""
        mark, a, b = self._home(digest)
        for bucket in (a, b):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[slot] == mark and self.keys[self.rows[slot]] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self.find(digest)
        return None if slot < 0 else self.values[self.rows[slot]]

    def insert(self, digest: bytes, value) -> None:
        """Make a digest live; it must not be live already."""
        row = self.free.pop() if self.free else len(self.keys)
        if row == len(self.keys):
            self.keys.append(digest)
            self.values.append(value)
        else:
            self.keys[row], self.values[row] = digest, value
        if not self._place(digest, row):
            self._grow()

    def delete(self, digest: bytes):
        """Take a live digest out and return its value; None if it isn't live."""
        slot = self.find(digest)
        if slot < 0:
            return None
        row, self.prints[slot] = self.rows[slot], 0
        value, self.keys[row], self.values[row] = self.values[row], None, None
        self.free.append(row)
        return value

    def _place(self, digest: bytes, row: int) -> bool:
        mark, a, b = self._home(digest)
        for bucket in (a, b):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.rows[slot] = mark, row
                    return True
        bucket = b
        for kick in range(self.KICKS):
            slot = bucket * self.SLOTS + (kick & 3)
            mark, self.prints[slot] = self.prints[slot], mark
            row, self.rows[slot] = self.rows[slot], row
            bucket = self._other(bucket, mark)
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.rows[slot] = mark, row
                    return True
        return False

    def _grow(self) -> None:
        """Resize from the stored keys until every live one has a slot."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(k, row) for row, k in enumerate(self.keys) if k is not None):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def normalised(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text (binary) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty()), 256)).alias("digest"))


def live_index(hashed: DataFrame) -> DataFrame:
    """digest, keep_id, group_size: what the index holds after all rows of (doc_id, digest)."""
    salted = hashed.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("rows"))
    buckets = max(shuffle_width(hashed.sparkSession), -(-hashed.count() // BUCKET_ROWS))
    dealt = salted.select("digest", "top", "rows").repartition(buckets, "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, top, rows in zip(*(batch.column(c).to_pylist() for c in ("digest", "top", "rows")), strict=True):
                live = index.get(digest)
                if live is None:
                    index.insert(digest, (top, rows))
                elif live[0] is None or (top is not None and top > live[0]):
                    index.delete(digest)
                    index.insert(digest, (top, live[1] + rows))
                else:
                    index.values[index.rows[index.find(digest)]] = (live[0], live[1] + rows)
        items = list(index.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], names=["digest", "keep_id", "group_size"])

    return dealt.mapInArrow(run, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``."""
    hashed = digests(docs)
    return hashed.join(live_index(hashed), "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    A text travels once, keyed by its digest and doc_id together, so copies don't meet in one task.
    """
    key = lambda digest, doc_id: F.concat_ws(":", F.hex(digest), F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")))
    (name,) = spare(docs, "__key")
    kept = live_index(digests(docs)).select(key(F.col("digest"), F.col("keep_id")).alias(name))
    rows = docs.withColumn(name, key(F.unhex(F.sha2(normalised(text_or_empty()), 256)), F.col("doc_id")))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
