"""Graphs of patches: least-cost distances, spanning trees, centralities, robustness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.lineage import cut, discard
from loamgrid.operators.graphs import graph_components

_STEPS = [(r, c, math.hypot(r, c)) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def _in_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """A row for each tile that a cell belongs to or borders on: adds tr, tc and own."""
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct(F.floor((F.col("row") + i) / tile).alias("tr"), F.floor((F.col("col") + j) / tile).alias("tc"))))
    out = cells.withColumn("_t", F.explode(F.array_distinct(F.flatten(around)))).select("*", "_t.tr", "_t.tc").drop("_t")
    return out.withColumn("own", (F.col("tr") == F.floor(F.col("row") / tile)) & (F.col("tc") == F.floor(F.col("col") / tile)))


def _relax(cost: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Least costs within a window, given costs to start from; r is infinite where there is no cell."""
    padded = np.pad(r, 1, constant_values=np.inf)
    steps = [(slice(1 + dr, 1 + dr + len(r)), slice(1 + dc, 1 + dc + r.shape[1]), k) for dr, dc, k in _STEPS]
    weights = [k * (padded[a, b] + r) / 2 for a, b, k in steps]
    while True:
        from_ = np.pad(cost, 1, constant_values=np.inf)
        new = cost
        for (a, b, _), w in zip(steps, weights, strict=True):
            new = np.minimum(new, from_[a, b] + w)
        if not (new < cost - 1e-12).any():
            return new
        cost = new


def cost_distance(resist: DataFrame, seeds: DataFrame, tile: int = 256) -> DataFrame:
    """row, col, source, cost: least cost from each source's pixels over (row, col, r).

    A step costs its length times the mean resistance of its two pixels.  Costs relax inside a tile
    at once; only tiles next to a border pixel that changed work in the next round, so rounds grow
    with the tiles that a path crosses, and go on until no border pixel changes.
    """
    kind = seeds.schema["source"].dataType.simpleString()
    cells = cut(_in_tiles(resist.select("row", "col", F.col("r").cast("double").alias("r")), tile))
    best = cut(seeds.select("row", "col", "source", F.lit(0.0).alias("cost")).distinct().join(resist.select("row", "col"), ["row", "col"], "left_semi"))
    active = _in_tiles(best, tile).select("tr", "tc", "source").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        at = ((pdf["row"] - r0).to_numpy(), (pdf["col"] - c0).to_numpy())
        shape = (at[0].max() + 1, at[1].max() + 1)
        r, cost = np.full(shape, np.inf), np.full(shape, np.inf)
        r[at] = pdf["r"].to_numpy()
        cost[at] = pdf["cost"].fillna(np.inf).to_numpy()
        with np.errstate(invalid="ignore"):
            new = _relax(cost, r)
        lower = pdf["own"].to_numpy() & (new[at] < cost[at] - 1e-12)
        return pdf.loc[lower, ["row", "col", "source"]].assign(cost=new[at][lower])

    while True:
        rows = cells.join(active, ["tr", "tc"]).join(best, ["row", "col", "source"], "left")
        new = cut(rows.groupBy("tr", "tc", "source").applyInPandas(run, f"row long, col long, source {kind}, cost double"))
        if not new.limit(1).count():
            return best
        before, best = best, cut(best.join(new.select("row", "col", "source"), ["row", "col", "source"], "left_anti").unionByName(new.select(*best.columns)))
        active = cut(_in_tiles(new, tile).where("not own").select("tr", "tc", "source").distinct())
        discard(before, new)
        if not active.limit(1).count():
            return best


def functional_edges(costs: DataFrame, seeds: DataFrame, mobility: float) -> DataFrame:
    """a, b, cost, w: least cost between sources and exp(-cost / mobility)."""
    c = costs.join(seeds.select("row", "col", F.col("source").alias("b")), ["row", "col"]).where("source < b").groupBy(F.col("source").alias("a"), "b").agg(F.min("cost").alias("cost"))
    return c.withColumn("w", F.exp(-F.col("cost") / mobility))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """a, b, w of a minimum spanning forest by Boruvka rounds: every component takes its lightest
    edge out (ties by endpoints), then components merge; rounds are logarithmic."""
    edges = cut(edges.select("a", "b", "w"))
    chosen, comp = None, None
    while True:
        live = edges.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
        if comp is not None:
            ca, cb = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca2")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb2"))
            live = edges.join(ca, "a", "left").join(cb, "b", "left").select("a", "b", "w", F.coalesce("ca2", "a").alias("ca"), F.coalesce("cb2", "b").alias("cb"))
        live = live.where("ca <> cb")
        ends = live.select(F.col("ca").alias("c"), "w", "a", "b").unionByName(live.select(F.col("cb").alias("c"), "w", "a", "b"))
        pick = cut(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("x")).select("x.a", "x.b", "x.w").distinct())
        if not pick.limit(1).count():
            return chosen if chosen is not None else pick
        chosen = pick if chosen is None else cut(chosen.unionByName(pick).distinct())
        comp = graph_components(chosen.select("a", "b"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, clustering: closed pairs of neighbours over possible ones, by triangle joins
    that orient each edge towards the higher degree, so hubs don't pair all their neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    d = lambda c: deg.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}"))
    up = cut(both.join(d("a"), "a").join(d("b"), "b").where("da < db or (da = db and a < b)").select("a", "b"))
    tri = up.join(up.select("a", F.col("b").alias("c")), "a").where("b < c").join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    n = tri.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    return deg.join(n, "node", "left").select("node", "degree", F.when(F.col("degree") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


class Graph:
    """An undirected graph as sorted neighbour lists; nodes are numbered in the order of names."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = ends[: len(a)], ends[len(a) :]
        pairs = np.unique(np.concatenate([np.stack([i, j], 1), np.stack([j, i], 1)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        self.to, self.source = pairs[:, 0], pairs[:, 1]  # by target, so a reduction gives each its reach
        self.degree = np.bincount(self.to, minlength=len(self.names))

    def levels(self, starts: np.ndarray, gone: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """For each step from 1, the (starts, nodes) newly reached; removed nodes aren't passed."""
        live = np.ones(len(self.to), bool) if gone is None else ~(gone[self.to] | gone[self.source])
        to, source = self.to[live], self.source[live]
        targets, first = np.unique(to, return_index=True)
        front = np.zeros((len(starts), len(self.names)), bool)
        front[np.arange(len(starts)), starts] = True
        reach = front.copy()
        while len(targets):
            new = np.zeros_like(front)
            new[:, targets] = np.logical_or.reduceat(front[:, source], first, axis=1)
            front = new & ~reach
            if not front.any():
                return
            reach |= front
            yield front

    def inverse_hops(self, gone: np.ndarray | None = None, block: int = 64) -> float:
        """Sum of 1 / hops over ordered pairs of nodes that are left, by blocks of start nodes."""
        left = np.arange(len(self.names)) if gone is None else np.flatnonzero(~gone)
        return sum(float(f.sum()) / step for at in range(0, len(left), block) for step, f in enumerate(self.levels(left[at : at + block], gone), 1))

    def efficiency(self, gone: np.ndarray | None = None) -> float:
        """Mean inverse hop distance over ordered pairs of nodes that are left."""
        n = len(self.names) - (0 if gone is None else int(gone.sum()))
        return self.inverse_hops(gone) / (n * (n - 1)) if n > 1 else 0.0


#: Hop distances need a node's whole surroundings: the edges of one graph are held by each worker,
#: 32 bytes each.  Beyond so many edges only the joined measures apply.
MOST_EDGES = 20_000_000


def graph_of(edges: DataFrame) -> Graph:
    """The patch graph (a, b); its neighbour lists, not its pairs, are held in memory."""
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; use the join-based measures")
    rows = edges.select("a", "b").toArrow()
    return Graph(np.asarray(rows["a"]), np.asarray(rows["b"]))


#: A component of at most so many nodes is worked on as one group.
MOST_NODES = 256


def _removals(graph: Graph, nodes: np.ndarray) -> pd.DataFrame:
    """near: the sum of inverse hops from each of the nodes; left: over all ordered pairs without it."""
    near, left, n = np.zeros(len(nodes)), np.zeros(len(nodes)), len(graph.names)
    for at in range(0, len(nodes), 64):
        for step, f in enumerate(graph.levels(nodes[at : at + 64]), 1):
            near[at : at + 64] += f.sum(1) / step
    for i, node in enumerate(nodes):
        left[i] = graph.inverse_hops(np.arange(n) == node)
    return pd.DataFrame({"node": graph.names[nodes], "near": near, "left": left})


def keystones(edges: DataFrame, threshold: float = 0.1) -> DataFrame:
    """node, loss, keystone: relative loss of efficiency when a node is removed.

    A removal changes hops in the node's own component only, so each component is worked on by
    itself.  Small ones are a group each; of larger ones the nodes are dealt to tasks.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = cut(edges.select("a", "b"))
    nodes = graph_components(pairs)
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    placed = cut(pairs.join(nodes.withColumnRenamed("node", "a"), "a").join(sizes, "comp"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return _removals(g, np.arange(len(g.names))).assign(comp=pdf["comp"].iloc[0])[["comp", "node", "near", "left"]]

    schema = f"comp {kind}, node {kind}, near double, left double"
    done = placed.where(F.col("m") <= MOST_NODES).groupBy("comp").applyInPandas(one, schema)
    for (comp,) in placed.where(F.col("m") > MOST_NODES).select("comp").distinct().collect():
        done = done.unionByName(_dealt(placed.where(F.col("comp") == comp), schema))
    done = cut(done)
    discard(pairs, placed, nodes)
    own = done.groupBy("comp").agg(F.sum("near").alias("own"))
    every = done.agg(F.sum("near").alias("total"), F.count(F.lit(1)).alias("n"))
    n, left = F.col("n"), F.col("total") - F.col("own") + F.col("left")
    whole = F.col("total") / (n * (n - 1))
    without = F.when(n > 2, left / ((n - 1) * (n - 2))).otherwise(0.0)
    loss = F.when(F.col("total") > 0, (whole - without) / whole).otherwise(0.0)
    out = done.join(own, "comp").join(F.broadcast(every)).select("node", loss.alias("loss"))
    return out.withColumn("keystone", F.col("loss") > threshold)


def _dealt(edges: DataFrame, schema: str) -> DataFrame:
    """The removals of one large component, whose nodes are dealt to tasks."""
    graph, spark, comp = graph_of(edges), edges.sparkSession, edges.first()["comp"]
    n, sent = len(graph.names), spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _removals(sent.value, pdf["i"].to_numpy()).assign(comp=comp)[["comp", "node", "near", "left"]]

    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism, 10_000))
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "i").mapInPandas(run, schema)


def network_summary(edges: DataFrame) -> dict[str, float]:
    """Nodes, density, components, diameter, efficiency, mean path, clustering and small-worldness."""
    g = graph_of(edges)
    n = len(g.names)
    if n < 2:
        return {"nodes": n}
    paths = far = total = 0.0
    comps = 0
    for at in range(0, n, 64):
        starts = np.arange(at, min(n, at + 64))
        least = starts.copy()
        for step, f in enumerate(g.levels(starts), 1):
            k = float(f.sum())
            paths, total, far = paths + k, total + k * step, max(far, float(step))
            least = np.minimum(least, np.where(f.any(1), f.argmax(1), n))
        comps += int((least == starts).sum())
    c = clustering(edges).agg(F.avg("clustering")).first()[0] or 0.0
    density, path = float(g.degree.sum() / (n * (n - 1))), total / paths if paths else 0.0
    return {"nodes": n, "density": density, "components": comps, "diameter": far, "efficiency": g.efficiency(), "path_length": path, "clustering": c, "small_world": (c / density) / (path / math.log(n)) if density and path else 0.0}


def robustness(edges: DataFrame, strategy: str = "degree", steps: int = 20, seed: int = 42) -> pd.DataFrame:
    """removed share, efficiency: nodes taken out by degree or at random; the area under it is the mean."""
    g = graph_of(edges)
    n = len(g.names)
    order = np.argsort(-g.degree, kind="stable") if strategy == "degree" else np.random.default_rng(seed).permutation(n)
    out = []
    for k in sorted({round(n * i / steps) for i in range(steps + 1)}):
        gone = np.zeros(n, bool)
        gone[order[:k]] = True
        out.append((k / n if n else 0.0, g.efficiency(gone)))
    return pd.DataFrame(out, columns=["removed", "efficiency"])
