"""Hand-computed grids: stencils, components, sequences."""

import random

from loamgrid.operators import components as K
from loamgrid.operators import landscape as L
from loamgrid.operators import stencil as S
from loamgrid.operators import temporal as T


def grid(spark, rows, name="cls", kind="long"):
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], f"row long, col long, {name} {kind}")


def back(df, name="cls"):
    rows = {(r["row"], r["col"]): r[name] for r in df.collect()}
    h, w = max(k[0] for k in rows) + 1, max(k[1] for k in rows) + 1
    return [[rows[r, c] for c in range(w)] for r in range(h)]


CENTRE = [[1] * 5, [1] * 5, [1, 1, 2, 1, 1], [1] * 5, [1] * 5]
PLUS = [[0] * 5, [0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0], [0] * 5]


def test_filters_remove_a_single_pixel(spark):
    flat = [[1] * 5] * 5
    g = grid(spark, CENTRE)
    assert back(S.median_filter(g, 3)) == flat
    assert back(S.majority_filter(g, 3, 0.6)) == flat
    assert back(K.small_patch_removal(g, 2, tile=2)) == flat
    assert back(K.fill_holes(g, 1, 5, tile=2)) == flat


def test_morphology_of_a_plus(spark):
    m = grid(spark, PLUS, "v")
    assert sum(map(sum, back(S.erode(m, S.disk(1)), "v"))) == 1
    assert back(S.opening(m, S.disk(1)), "v") == PLUS


def test_components_across_tiles(spark):
    diagonal = [[1 if r == c else 0 for c in range(6)] for r in range(6)]
    for eight, n in ((True, 1), (False, 6)):
        parts = K.components(grid(spark, diagonal), eight, tile=2)
        assert parts.where("cls = 1").select("patch").distinct().count() == n


def test_patch_of_two_by_two(spark):
    p = K.patches(K.components(grid(spark, [[0, 0, 0, 0], [0, 3, 3, 0], [0, 3, 3, 0], [0, 0, 0, 0]]), tile=2)).where("cls = 3").first()
    assert (p["pixels"], p["perimeter"], p["core"], p["row"], p["col"], p["shape"]) == (4, 8.0, 0.0, 1.5, 1.5, 8 / (2 * (3.141592653589793 * 4) ** 0.5))


def test_half_planes(spark):
    ai = {r["cls"]: r["ai"] for r in L.aggregation_index(grid(spark, [[1, 1, 2, 2]] * 4)).collect()}
    assert ai == {1: 100 * 10 / 14, 2: 100 * 10 / 14}


def test_sequences(spark):
    s = spark.createDataFrame([(1, t, c) for t, c in enumerate("ABAB")] + [(2, t, c) for t, c in enumerate("AABAA")], "unit int, t int, cls string")
    assert [(r["unit"], r["t"]) for r in T.oscillations(s).collect()] == [(1, 0)]
    mode = {(r["unit"], r["t"]): r["cls"] for r in T.temporal_mode(s).collect()}
    assert [mode[2, t] for t in range(5)] == list("AAAAA")


def test_empty_grid(spark):
    e = spark.createDataFrame([], "row long, col long, cls long")
    assert K.components(e).count() == 0 and S.median_filter(e).count() == 0 and L.aggregation_index(e).count() == 0


def test_cost_distance_runs_through_all_tiles(spark):
    import heapq
    import math

    from loamgrid.operators import connectivity as G

    rng = random.Random(4)
    r = {(i, j): float(rng.choice([1, 1, 2, 9])) for i in range(13) for j in range(11) if (i, j) != (5, 5) and (i != 7 or j > 8)}
    seeds = [(0, 0, 1), (12, 10, 1), (6, 2, 2), (5, 5, 3)]  # the last one is on no cell
    rows = spark.createDataFrame([(i, j, v) for (i, j), v in r.items()], "row long, col long, r double")
    got = {(x["source"], x["row"], x["col"]): x["cost"] for x in G.cost_distance(rows, spark.createDataFrame(seeds, "row long, col long, source long"), tile=4).collect()}
    want = {}
    for source in (1, 2):
        heap = [(0.0, i, j) for i, j, s in seeds if s == source]
        while heap:
            d, i, j = heapq.heappop(heap)
            if (source, i, j) in want:
                continue
            want[source, i, j] = d
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (a or b) and (i + a, j + b) in r:
                        heapq.heappush(heap, (d + math.hypot(a, b) * (r[i, j] + r[i + a, j + b]) / 2, i + a, j + b))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
