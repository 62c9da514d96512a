"""Connected components of graphs given as tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import cut, discard


def graph_components(links: DataFrame) -> DataFrame:
    """(node, comp) of (a, b) links: comp is the least node reached.

    Labels spread along links and then jump to their label's label, so rounds grow with the
    logarithm of a component's diameter; each round is written and read again, and the round before
    it deleted.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), F.lit(None).cast("long").alias("was")))
    while True:
        now = labels.select("node", "comp")
        near = both.join(now.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread_ = now.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jumped = cut(spread_.join(now.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select("node", F.least("comp", "next").alias("comp"), "was"))
        discard(labels)
        if not jumped.where("comp <> was").limit(1).count():
            discard(both)
            out = jumped.select("node", "comp")
            out._loamgrid_path = jumped._loamgrid_path  # for who discards it
            return out
        labels = jumped
