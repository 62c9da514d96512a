"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows.  Each turn gets a rolling prefix hash:
running sums of two 64-bit hashes of (place, role, text), exact as decimals, so prefixes of any
length are summed by blocks of turns and a long conversation is spread over tasks.  A
conversation's last prefix is its key.  Conversations with the same key are one (the smallest
conv_id stands for them); an anti-join of the keys against all proper prefixes keeps the maximal
ones, and only their turns are rendered.

Every side of a join is made distinct first, so a first turn or a conversation that is shared by a
third of all rows is one row.  Defined results: turns go by (turn, role, text), nulls first and as
empty; a row with a null conv_id is left out (it belongs to no conversation); rows that repeat a
turn are turns each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgrid.llm.common import cut, discard

BLOCK_BITS = 8


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (place from 1), role, text, and the block of the place.

    Places come from two-level counts: by ranges of turn numbers, then within a range.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    rows = rows.withColumn("range", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("conv_id", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("r", F.row_number().over(inside)).join(starts, ["conv_id", "range"])
    return placed.select("conv_id", (F.col("start") + F.col("r")).alias("n"), "range", "role", "text")


def _point(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("n"), F.col("role"), F.col("text")).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n and the prefix hash (h1, h2) up to turn n of every turn."""
    rows = turns.select("conv_id", "range", "n", _point(11).alias("p1"), _point(29).alias("p2"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "range").orderBy("n")
    sums = rows.groupBy("conv_id", "range").agg(F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    starts = sums.select("conv_id", "range", *(F.coalesce(F.sum(f"s{i}").over(before), zero).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)))
    run = rows.select("conv_id", "range", "n", *(F.sum(f"p{i}").over(inside).cast("decimal(38,0)").alias(f"r{i}") for i in (1, 2))).join(starts, ["conv_id", "range"])
    return run.select("conv_id", "n", *((F.col(f"b{i}") + F.col(f"r{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another."""
    hashed = cut(prefixes(turns))
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("l")).select("conv_id", "l.*")
    distinct = last.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    ends = last.select("conv_id", F.col("n").alias("end"))
    proper = hashed.join(ends, "conv_id").where("n < end").select("n", "h1", "h2").distinct()
    kept = cut(distinct.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies"))
    discard(hashed)
    return kept


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered text of every maximal conversation.

    A turn is rendered as <|role|>, its text and <|end|>, each on its own line.
    """
    turns = cut(_turns(conversations))
    kept = maximal_conversations(turns)
    lines = turns.join(kept.select("conv_id"), "conv_id", "left_semi").withColumn("line", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
    # Two steps, by range and by conversation, so that the parts of a long one are joined side by side.
    parts = lines.groupBy("conv_id", "range").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    parts = parts.select("conv_id", "range", F.array_join(F.transform("x", lambda e: e["line"]), "").alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range", "part"))).alias("x"))
    return kept.join(whole.select("conv_id", F.array_join(F.transform("x", lambda e: e["part"]), "").alias("rendered")), "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE_SQL = """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
                      '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS line
               FROM conversations WHERE conv_id IS NOT NULL),
         p AS (SELECT conv_id, n, string_agg(line, '' ORDER BY n) OVER (PARTITION BY conv_id ORDER BY n) AS upto,
                      max(n) OVER (PARTITION BY conv_id) AS last FROM t),
         w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, upto AS rendered FROM p WHERE n = last GROUP BY n, upto)
    SELECT conv_id, n_turns, n_copies, rendered FROM w
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.last AND p.n = w.n_turns AND p.upto = w.rendered)"""
