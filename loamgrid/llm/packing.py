"""Packing documents into training sequences by best-fit decreasing.

A document is its token ids and one closing id.  Overlong documents are first cut into full
windows, each a sequence of its own.  What remains of each document is packed by best-fit
decreasing: longest first, each into the tightest open window that holds it, found in a segment
tree over remaining capacities.  Pieces are written to a table, then dealt to groups of about
``group_rows`` by a hash of their place in it (so neither a long document nor a
repeated doc_id can fill a group), each packed on its own: groups run side by side, memory is
bounded, and a lost executor's groups are packed again alike.  Where the documents' order is a
decision (``pack_in_order``), groups are runs of ``group_rows`` pieces in that order instead, and
sequence_id ascends with the order: by group, then by the first piece of each sequence.

Defined results: null text counts as empty (a document of the closing id alone); a row of the input
is a document, so repeated doc_ids give pieces each; equal lengths go by doc_id, then start; a
null doc_id is packed like any other; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.llm import textkernel as tk
from loamgrid.llm.common import cut, spare

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as the library gives them; each distinct pre-token is encoded once.

    Only texts of code points below 0x250 go by pre-tokens (but for the dotted
    capital I), where normalisation is the lower case of single code points; other texts go to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own only wait
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = tk.TokenMemo(1_500_000, np.uint16)  # easy texts have small code points only
        self.plain = not len(tk.tokens(tk.Batch(["probe"]), joins_space=False)[0]) == 0 and self._understood()

    def _understood(self) -> bool:
        """Whether the file's pre-tokenisation is the one the transducer was written for."""
        probe = "it's 'RE x12 ab'll ,.'d \n\tÉß don't''s"
        batch = tk.Batch([probe])
        lower = tk.Batch(["".join(chr(c) for c in tk.lower_table()[batch.points[:-1]])])
        mine = [lower.joined[s:e] for s, e in zip(*tk.tokens(lower, joins_space=False), strict=True)]
        norm = self.library.normalizer.normalize_str(probe) if self.library.normalizer else probe
        theirs = [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return mine == [x for x in theirs if x.strip()]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in tk.slices(texts, 1_000_000):
            if b - a == 1 and len(texts[a]) > 4_000_000:
                yield np.concatenate([x for part in self._parts(texts[a]) for x in self._slice([part])])
            else:
                yield from self._slice(texts[a:b])

    def _parts(self, text: str) -> list[str]:
        return [text] if any(m in text.lower() for m in self.added) else tk.cut_long(text, 1_000_000)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        batch = tk.Batch(texts)
        odd = (batch.points >= 0x250) | (batch.points == 0x130)
        hard = {*batch.owner(np.flatnonzero(odd)).tolist(), *(i for i, t in enumerate(texts) if "<|" in t and any(m in t.lower() for m in self.added))}
        if not self.plain:
            hard = set(range(len(texts)))
        if hard:
            easy = [i for i in range(len(texts)) if i not in hard]
            out: list[np.ndarray] = [self.whole(t) if i in hard else np.zeros(0, np.int32) for i, t in enumerate(texts)]
            for i, ids in zip(easy, self._slice([texts[i] for i in easy]) if easy else [], strict=True):
                out[i] = ids
            return out
        points = tk.lower_table()[batch.points]
        starts, ends = tk.tokens(batch, joins_space=False, points=points)
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        first, back, keys = tk.distinct_ranges(points, starts, ends)
        s, e = starts[first], ends[first]

        def compute(new: np.ndarray) -> list[list[int]]:
            parts = [batch.joined[a:b] for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)]
            return [x.ids for x in self.library.encode_batch_fast(parts, add_special_tokens=False)]

        lengths, ids = self.memo.ragged(keys, points, s, e, compute)
        place = np.concatenate([[0], np.cumsum(lengths)])
        sizes = lengths[back]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(place[back] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, batch.seps)]
        return np.split(flat, bounds[:-1])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, window: int = 2048, closing_id: int = 1, order: tuple[str, ...] = ()) -> DataFrame:
    """Every document cut into full windows and a rest: doc_id, start, length, crc, doc_tokens.

    ``order`` names long columns of ``docs`` that each piece keeps.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            owner: list[int] = []
            for i, (doc_id, tokens) in enumerate(zip(ids, enc.encode(["" if t is None else t for t in batch.column("text").to_pylist()]), strict=True)):
                data = np.append(tokens, closing_id).astype("<u4")
                for start in range(0, len(data), window):
                    part = data[start : start + window]
                    for col, value in zip(rows, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(data)), strict=True):
                        col.append(value)
                    owner.append(i)
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in order]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows] + kept, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *order])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *order).mapInArrow(tk.released(run), ", ".join([PIECES, *(f"{c} long" for c in order)]))


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of which capacities are present."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """The open window with the least room of at least ``length``."""
        node = length + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            while node and not (node < self.size and (self.tree[2 * node] or self.tree[2 * node + 1])):
                self.tree[node] = 0
                node >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of lengths that come longest first."""
    windows, opened = OpenWindows(capacity), 0
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = windows.pop_tightest(n)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, window = found
        at[i], offset[i] = window, capacity - room
        if room > n:
            windows.push(room - n, window)
    return at, offset


def pack(docs: DataFrame, path: str | None = None, window: int = 2048, closing_id: int = 1, group_rows: int = 4096) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    return pack_pieces(cut(pieces(docs, path, window, closing_id)), window, group_rows)


def pack_pieces(cut_pieces: DataFrame, window: int, group_rows: int) -> DataFrame:
    """Packs pieces; each full window is a sequence, rests are packed by groups of a doc_id hash."""
    n_groups = -(-max(1, cut_pieces.count()) // group_rows)
    schema = PIECES + ", sequence_id long, offset long"

    def run(rows: pa.Table) -> pa.Table:
        group = rows["group"][0].as_py()
        rows = rows.select(NAMES).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.append_column("sequence_id", pa.array((at << 32) | group)).append_column("offset", pa.array(offset))

    keyed = cut_pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return keyed.groupBy("group").applyInArrow(run, schema)


def pack_in_order(docs: DataFrame, path: str | None = None, window: int = 2048, closing_id: int = 1, group_rows: int = 4096) -> DataFrame:
    """Pieces of all documents of a Parquet table, packed by runs of the table's row order.

    The order is that of part numbers and of rows within a file, as a sorted table was written.
    """
    part, file, row = spare(docs, "__part", "__file", "__row")
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1), '') as long)"), F.lit(-1).cast("long"))
    placed = docs.withColumn(part, number).withColumn(row, F.col("_metadata.row_index").cast("long")).withColumn(file, F.xxhash64(name))
    return pack_runs(cut(pieces(placed, path, window, closing_id, (part, file, row))), (part, file, row), window, group_rows)


def pack_runs(cut_pieces: DataFrame, order: tuple[str, ...], window: int, group_rows: int) -> DataFrame:
    """Packs pieces by runs of about ``group_rows`` in ``order``, whose last column counts in a file.

    A piece's place is a two-level sum: the pieces of earlier files and row chunks, then its number
    within its chunk.
    """
    *file, row = order
    chunk = F.expr(f"{row} div {group_rows}").alias("chunk")
    sizes = cut_pieces.groupBy(*file, chunk).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*file, "chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = sizes.select(*file, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*file, "chunk").orderBy(row, "start")
    numbered = cut_pieces.withColumn("chunk", chunk).withColumn("nth", F.row_number().over(inside) - 1)
    placed = numbered.join(starts, [*file, "chunk"]).withColumn("place", F.col("first") + F.col("nth"))
    schema = PIECES + ", sequence_id long, offset long"

    def run(rows: pa.Table) -> pa.Table:
        group = rows["group"][0].as_py()
        rows = rows.sort_by([("length", "descending"), ("place", "ascending")])
        at, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        first = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, at, rows["place"].to_numpy())
        rank = np.argsort(np.argsort(first))
        return rows.select(NAMES).append_column("sequence_id", pa.array((group << 32) | rank[at])).append_column("offset", pa.array(offset))

    keyed = placed.withColumn("group", F.expr(f"place div {group_rows}")).select(*NAMES, "place", "group")
    return keyed.groupBy("group").applyInArrow(run, schema)
