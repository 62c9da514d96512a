"""Tiled numpy kernels and look-ups against whole arrays."""

import numpy as np

from loamgrid.operators import connectivity as G
from loamgrid.operators import geometry as M
from loamgrid.operators import texture as X


def table(spark, a, name="v"):
    return spark.createDataFrame([(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"row long, col long, {name} double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def test_tiles_equal_the_whole(spark):
    a = np.random.default_rng(1).random((23, 17))
    for kernel, halo in ((X.convolution(X.gabor(0.3, 0.5, 3)[0]), 3), (X.lbp_kernel(2, 8), 3), (X.run_kernel("sre", 45, 5), 2), (X.canny_like(), 1)):
        b = np.round(a * 4) if kernel is not X.canny_like else a
        assert np.allclose(array(X.by_tile(table(spark, b), kernel, halo, tile=6), a.shape), kernel(b))


def test_run_lengths():
    assert X.run_lengths(np.array([1, 1, 2, 2, 2, 1])).tolist() == [2, 3, 1]


def test_skeleton_of_a_bar(spark):
    a = np.zeros((9, 20))
    a[3:6, 2:18] = 1
    s = array(X.skeleton(table(spark, a), halo=8, tile=10), a.shape)
    assert (s == X.thin(a)).all() and 8 < s.sum() < 20
    assert X.skeleton_points(table(spark, X.thin(a))).first()["endpoints"] == 2


def test_resample_and_affine(spark):
    a = np.arange(30.0).reshape(5, 6)
    cube = spark.createDataFrame([(r, c, [float(a[r, c])]) for r in range(5) for c in range(6)], "row long, col long, spec array<double>")
    same = {(r["row"], r["col"]): r["spec"][0] for r in M.affine(cube, 5, 6, [[1, 0, 0], [0, 1, 0]]).collect()}
    assert all(same[r, c] == a[r, c] for r in range(5) for c in range(6))
    fine = {(r["row"], r["col"]): r["spec"][0] for r in M.resample(cube, 9, 11).collect()}
    assert fine[4, 5] == (a[2, 2] + a[2, 3]) / 2 and fine[8, 10] == a[4, 5]
    pts = spark.createDataFrame([(float(x), float(y), x + 0.5, y - 0.25) for x in range(5) for y in range(5)], "x double, y double, sx double, sy double")
    assert np.allclose(M.fit_polynomial(pts, "sx"), [0.5, 1, 0, 0, 0, 0], atol=1e-8)


def test_graph_measures(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0), (3, 4, 1.0)], "a long, b long, w double")
    assert sorted((r["a"], r["b"]) for r in G.spanning_tree(e).collect()) == [(1, 2), (2, 3), (3, 4)]
    c = {r["node"]: r["clustering"] for r in G.clustering(e).collect()}
    assert c == {1: 1.0, 2: 1.0, 3: 1 / 3 * 1.0, 4: 0.0} or abs(c[3] - 1 / 3) < 1e-12
    s = G.network_summary(e)
    assert s["nodes"] == 4 and s["components"] == 1 and s["diameter"] == 2
    assert {r["node"] for r in G.keystones(e, 0.3).collect() if r["keystone"]} == {3}
    assert G.robustness(e, "degree", 4)["efficiency"].iloc[-1] == 0
