"""Exact top-k inner product search by three-phase uniform thresholds.

The lists of the threshold algorithm are slices of the dimensions: the score of a candidate is the
sum of its local scores in the slices.  Vectors meet in groups: candidates are cut into groups, each
group meets each block of the (stated) queries once, and every task works through one such meeting
in chunks of candidates.

Phase 1: each slice gives, per query, its k best local scores of a group; of all groups' lists the
k best of each slice are kept, only what they name is scored, and the k-th best score is a lower
bound that can't be wrong.
Phase 2: the cutoff, bound / slices, goes back to all groups.  A candidate that is below it in
every slice can't reach the bound; the others are collected, with their local scores where these
reach the cutoff and the cutoff as the upper bound of the rest, and those whose upper bound stays
below the threshold are dropped.  Candidates go by falling length, so that queries for which
length times length is below the bound are done before a group's end.
Phase 3: only what remains is scored exactly, and the k best that reach the bound are kept.

Both passes compute local scores anew rather than keep them; what is shuffled after a meeting is k
rows per query and slice, then what reached the bound.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros.  Every other row is a candidate, whether its vec_id is null or
repeated, for every query but the one of the same row; rows whose vec_id repeats are queries each.
Ties go to the smaller vec_id, null last.  Products are exact; components beyond the range of long
count as its end, and so do scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import cut

_LONG = np.iinfo(np.int64)


def quantised(vec: str = "embedding", scale: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, vec): the quantised vectors that take part; row names the row."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v is not null")
    x = x.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    return x.select(F.monotonically_increasing_id().alias("row"), "id", quantised("v", scale).alias("vec"))


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks()
    out = np.zeros((len(col), dim), np.int64)
    flat, sizes = np.asarray(col.flatten()), np.asarray(col.value_lengths())
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


class _Meeting:
    """The queries and candidates of one group, candidates in chunks by falling length."""

    def __init__(self, queries: pa.Table, candidates: pa.Table, slices: int, chunk: int) -> None:
        dim = max(1, *(int(np.asarray(t["vec"].combine_chunks().value_lengths()).max(initial=0)) for t in (queries, candidates)))
        self.q, self.c = (_matrix(t["vec"], dim) for t in (queries, candidates))
        self.q_row, self.c_row = (t["row"].to_numpy() for t in (queries, candidates))
        self.q_length, self.c_length = (np.sqrt((m.astype(np.float64) ** 2).sum(1)) for m in (self.q, self.c))
        top = float(np.abs(self.q.astype(np.float64)).max(initial=0)) * float(np.abs(self.c.astype(np.float64)).max(initial=0)) * dim
        # Floating point only where it can't round, 64 bits only where they hold every sum.
        self.kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 else object
        self.parts = np.array_split(np.arange(dim), 1 if self.kind is object else min(slices, dim))
        self.order = np.argsort(-self.c_length, kind="stable")
        self.chunk = chunk

    def chunks(self) -> Iterator[np.ndarray]:
        return (self.order[at : at + self.chunk] for at in range(0, len(self.order), self.chunk))

    def local(self, queries: np.ndarray | slice, places: np.ndarray) -> list[np.ndarray]:
        """The local scores of each slice, (queries, places)."""
        q, c = self.q[queries].astype(self.kind), self.c[places].astype(self.kind)
        out = [q[:, s] @ c[:, s].T for s in self.parts]
        return [np.clip(x, _LONG.min, _LONG.max).astype(np.int64) if self.kind is object else x.astype(np.int64) for x in out]


def _kept(q: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of each q's first k entries by the keys, the first key first."""
    order = np.lexsort([*keys[::-1], q])
    by = q[order]
    first = np.r_[True, by[1:] != by[:-1]] if len(by) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    return order[np.arange(len(by)) - start < k]


def topk(vectors: DataFrame, query_filter: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, slices: int = 4, group: int = 16_384, chunk: int = 512, query_block: int = 4096) -> DataFrame:
    """The k best candidates of every query by integer inner product: query_id, rank, vec_id, score.

    query_filter: which rows are queries, as a condition on column ``id``.  A group has about
    ``group`` candidates and ``query_block`` queries.
    """
    rows = cut(usable_vectors(vectors, id_col, vec_col, scale))
    groups = -(-max(1, rows.count()) // group)
    query_blocks = -(-max(1, rows.where(query_filter).count()) // query_block)
    spread = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.withColumn("cb", spread(groups)).withColumn("qb", each(query_blocks)).groupBy("qb", "cb")
    queries = rows.where(query_filter).select((F.col("row") + 0).alias("row"), (F.col("id") + 0).alias("id"), F.slice("vec", 1, 1 << 30).alias("vec")).withColumn("qb", spread(query_blocks))

    def lists(q: pa.Table, c: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        if q.num_rows and c.num_rows:
            m = _Meeting(q, c, slices, chunk)
            best: list[tuple] = [() for _ in m.parts]
            for places in m.chunks():
                local = m.local(slice(None), places)
                own = m.q_row[:, None] == m.c_row[places][None, :]
                for s, x in enumerate(local):
                    x = np.where(own, _LONG.min, x)
                    at = np.argpartition(~x, min(k, x.shape[1]) - 1, axis=1)[:, :k]
                    i, j = np.repeat(np.arange(len(x)), at.shape[1]), at.ravel()
                    i, j = i[~own[i, j]], j[~own[i, j]]
                    new = (i, local[s][i, j], places[j], sum(y[i, j] for y in local))  # only what is named is scored
                    old = [np.concatenate(z) for z in zip(best[s], new, strict=True)] if best[s] else new
                    keep = _kept(old[0], [~old[1]], k)
                    best[s] = tuple(z[keep] for z in old)
            for s, (i, x, place, score) in enumerate(best):
                for col, z in zip(got, (m.q_row[i], np.full(len(i), s), x, m.c_row[place], score), strict=True):
                    col.append(z)
        return pa.table({n: pa.array(np.concatenate(z).astype(np.int64)) for n, z in zip(("query", "slice", "local", "cand", "score"), got, strict=True)})

    named = queries.withColumn("cb", each(groups)).groupBy("qb", "cb").cogroup(candidates).applyInArrow(lists, "query long, slice long, local long, cand long, score long")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by[0]).orderBy(*by[1]))
    named = named.withColumn("r", nth(("query", "slice"), (F.desc("local"), "cand"))).where(F.col("r") <= k).groupBy("query", "cand").agg(F.max("score").alias("score"))
    bound = named.withColumn("r", nth(("query",), (F.desc("score"), "cand"))).where(F.col("r") == k).select(F.col("query").alias("row"), F.col("score").alias("bound"))
    # Fewer than k named: no bound, and every candidate is collected.
    bounded = queries.join(bound, "row", "left").withColumn("cb", each(groups)).groupBy("qb", "cb")

    def resolve(q: pa.Table, c: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        i, place, score = none, none, none
        if q.num_rows and c.num_rows:
            m = _Meeting(q, c, slices, chunk)
            bounds = np.array([_LONG.min if x is None else x for x in q["bound"].to_pylist()], np.int64)
            ids = c["id"].to_pylist()
            no_id = np.array([x is None for x in ids])
            ids = np.array([0 if x is None else x for x in ids], np.int64)
            for places in m.chunks():
                # By Cauchy and Schwarz; the margin is wider than any rounding of the lengths.
                some = np.flatnonzero(m.q_length * m.c_length[places].max() * (1 + 1e-9) + 1 >= bounds)
                if not len(some):
                    break
                local = m.local(some, places)
                open_ = bounds[some][:, None] < -(1 << 62)  # no bound, or none that can be cut
                limit = np.where(open_, 0, bounds[some][:, None])
                cutoff = -(-limit // len(local))  # the least integer whose multiple reaches the bound
                seen, upper = np.zeros((len(some), len(places)), bool), np.zeros((len(some), len(places)), np.int64)
                for x in local:
                    reached = x >= cutoff
                    seen |= reached
                    upper += np.where(reached, x, cutoff - 1)
                a, j = np.nonzero((seen & (upper >= limit)) | open_)
                exact = sum(x[a, j] for x in local)
                a = some[a]
                on = (exact >= bounds[a]) & (m.q_row[a] != m.c_row[places[j]])
                i, place, score = (np.concatenate(z) for z in ((i, a[on]), (place, places[j[on]]), (score, exact[on])))
                keep = _kept(i, [~score, no_id[place], ids[place], m.c_row[place]], k)
                i, place, score = i[keep], place[keep], score[keep]
            found = [m.q_row[i], m.c_row[place], pa.array(ids[place], mask=no_id[place]), score]
            qids = q["id"].to_numpy()[i]
        else:
            found, qids = [none, none, pa.array(none), none], none
        return pa.table({n: pa.array(x) for n, x in zip(("query", "cand", "vec_id", "score", "query_id"), (*found, qids), strict=True)})

    final = bounded.cogroup(candidates).applyInArrow(resolve, "query long, cand long, vec_id long, score long, query_id long")
    ranked = final.withColumn("rank", nth(("query",), (F.desc("score"), F.col("vec_id").asc_nulls_last(), "cand"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS c, list_dot_product(q.e, c.e)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, c))::INTEGER AS rank, vec_id, score FROM s)
    WHERE rank <= 5"""
