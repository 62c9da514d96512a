"""Regions, watersheds, percentiles and ranks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions.quantiles import percentiles, ranked
from loamgrid.operators import landscape as L
from loamgrid.operators import regions as R
from loamgrid.operators import uncertainty as U


def grid(spark, a, name, kind):
    return spark.createDataFrame([(r, c, a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])], f"row long, col long, {name} {kind}")


def array_of(df, name, shape, kind=float):
    out = np.zeros(shape, kind)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def blobs(seed, shape=(26, 19), classes=3):
    rng = np.random.default_rng(seed)
    a = rng.random(shape)
    for _ in range(3):
        p = np.pad(a, 1, mode="edge")
        a = sum(p[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3)) / 9
    return np.digitize(a, np.quantile(a, np.arange(1, classes) / classes))


def labelled(a):
    """Four-connected patches by their least (row, col)."""
    out, n = np.full(a.shape, -1), 0
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if out[r, c] >= 0:
                continue
            todo = [(r, c)]
            out[r, c] = n
            while todo:
                i, j = todo.pop()
                for y, x in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and out[y, x] < 0 and a[y, x] == a[i, j]:
                        out[y, x] = n
                        todo.append((y, x))
            n += 1
    return out


def plain_distance(region, reach):
    out = np.full(region.shape, float(reach))
    at = [(r, c) for r in range(region.shape[0]) for c in range(region.shape[1])]
    for r, c in at:
        for y, x in at:
            if region[y, x] != region[r, c]:
                out[r, c] = min(out[r, c], np.hypot(y - r, x - c))
    return out


def plain_basins(region, v):
    up = {}
    for r in range(region.shape[0]):
        for c in range(region.shape[1]):
            near = [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < region.shape[0] and 0 <= c + j < region.shape[1] and region[r + i, c + j] == region[r, c]]
            up[r, c] = min(near, key=lambda p: (-v[p], p))
    out = np.zeros(region.shape, np.int64)
    for p in up:
        q = p
        while up[q] != q:
            q = up[q]
        out[p] = q[0] << 31 | q[1]
    return out


def test_inner_distance_over_tiles(spark):
    region = labelled(blobs(1))
    got = R.inner_distance(grid(spark, region, "region", "long"), reach=6, tile=8)
    assert np.allclose(array_of(got, "d", region.shape), plain_distance(region, 6))


def test_basins(spark):
    region = labelled(blobs(2))
    v = np.round(np.random.default_rng(2).random(region.shape), 1)
    rows = grid(spark, region, "region", "long").join(grid(spark, v, "v", "double"), ["row", "col"])
    assert (array_of(R.basins(rows), "basin", region.shape, np.int64) == plain_basins(region, v)).all()


def test_merging_similar_regions(spark):
    cls = blobs(3, classes=4)
    v = np.random.default_rng(3).random(cls.shape) + cls * 0.2
    part = labelled(cls)
    mean = {k: v[part == k].mean() for k in np.unique(part)}
    group = {k: k for k in mean}
    for r in range(cls.shape[0]):
        for c in range(cls.shape[1]):
            for y, x in ((r + 1, c), (r, c + 1)):
                if y < cls.shape[0] and x < cls.shape[1] and abs(mean[part[r, c]] - mean[part[y, x]]) <= 0.25:
                    a, b = group[part[r, c]], group[part[y, x]]
                    group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    want = np.zeros_like(cls)
    for k in mean:
        mine = [q for q in mean if group[q] == group[k]]
        top = min(mine, key=lambda q: (-(part == q).sum(), q))
        want[part == k] = cls[part == top][0]
    got = R.merge_similar(grid(spark, cls, "cls", "long"), grid(spark, v, "v", "double"), 0.25, tile=8)
    assert (array_of(got, "cls", cls.shape, int) == want).all() and (want != cls).any()


def test_splitting_uneven_regions(spark):
    cls = blobs(4, classes=2)
    v = np.random.default_rng(4).random(cls.shape) * (np.arange(cls.shape[1]) > 9)
    part = labelled(cls)
    first = {k: min(zip(*np.nonzero(part == k), strict=True)) for k in np.unique(part)}
    runs = plain_basins(part, plain_distance(part, 5))
    want = {(r, c): runs[r, c] if v[part == part[r, c]].std() > 0.1 else int(first[part[r, c]][0]) << 31 | int(first[part[r, c]][1]) for r in range(cls.shape[0]) for c in range(cls.shape[1])}
    got = R.split_uneven(grid(spark, cls, "cls", "long"), grid(spark, v, "v", "double"), 0.1, reach=5, tile=8).collect()
    assert {(r["row"], r["col"]): r["region"] for r in got} == want
    assert all(r["cls"] == cls[r["row"], r["col"]] for r in got)


def test_watershed_features(spark):
    v = np.random.default_rng(5).random((12, 10))
    got = R.watershed_features(grid(spark, v, "v", "double"))
    p = np.pad(v, 1, mode="symmetric")
    k = np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    at = lambda w: sum(w[i, j] * p[i : i + 12, j : j + 10] for i in range(3) for j in range(3))
    b = plain_basins(np.zeros(v.shape, int), -np.round(np.hypot(at(k), at(k.T)), 9))
    edge = np.zeros(v.shape)
    edge[:-1] = np.maximum(edge[:-1], b[:-1] != b[1:])
    edge[1:] = np.maximum(edge[1:], b[:-1] != b[1:])
    edge[:, :-1] = np.maximum(edge[:, :-1], b[:, :-1] != b[:, 1:])
    edge[:, 1:] = np.maximum(edge[:, 1:], b[:, :-1] != b[:, 1:])
    q = np.pad(edge, 2, mode="symmetric")
    mean = sum(q[i : i + 12, j : j + 10] for i in range(5) for j in range(5)) / 25
    n = len(np.unique(b))
    assert np.allclose(array_of(got, "boundary", v.shape), mean) and np.allclose(array_of(got, "density", v.shape), n / 120)


def test_pruning_keeps_long_branches_whole(spark):
    a = np.zeros((20, 30), int)
    a[10, 2:28] = 1  # the trunk
    a[7:10, 8] = 1  # a branch of three
    a[3:10, 20] = 1  # a branch of seven
    a[17, 3:6] = 1  # a piece of three
    got = array_of(R.prune(grid(spark, a, "v", "long"), 4), "v", a.shape, int)
    want = a.copy()
    want[7:9, 8] = 0
    want[17] = 0
    assert (got[want == 1] == 1).all() and got[17].sum() == 0 and got[7, 8] == 0 and got[3:10, 20].all()


def test_percentiles_of_awkward_groups(spark):
    rng = random.Random(6)
    rows = [(g, rng.gauss(0, 1) if g == 1 else rng.choice([5.0, 5.0, 5.0, 1e12]) if g == 2 else 3.0 if g == 3 else float(rng.randint(0, 9))) for g in (1, 2, 3, 4) for _ in range(777)] + [(1, None), (5, -2.5)]
    df = spark.createDataFrame(rows, "g int, x double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in percentiles(df, ["g"], "x", shares, bins=16).collect()}
    for g in (1, 2, 3, 4, 5):
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], shares)), g
    one = percentiles(df, [], "x", [0.5]).first()["q"][0]
    assert one == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert percentiles(df.limit(0), ["g"], "x", [0.5]).count() == 0 and percentiles(df.limit(0), [], "x", [0.5]).first()["q"] == []


def test_ranks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, x int")
    got = {r["id"]: (r["r"], r["n"]) for r in ranked(df, ["g"], F.floor(F.col("x") / 7), "x", "id", size="n").collect()}
    for g in ("a", "b", None):
        mine = sorted((x, i) for i, k, x in rows if k == g)
        assert all(got[i] == (place, len(mine)) for place, (_, i) in enumerate(mine, 1))


def test_morans_i_over_tiles_and_with_several_points_in_a_pixel(spark):
    rng = np.random.default_rng(8)
    points = [(i, int(rng.integers(0, 30)), int(rng.integers(0, 25)), float(rng.random())) for i in range(300)]
    got = U.morans_i(spark.createDataFrame(points, "id int, row int, col int, u double"), 4.0, tile=8).first()[0]
    u = np.array([p[3] for p in points])
    z = u - u.mean()
    xy = np.array([p[1:3] for p in points])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 16
    np.fill_diagonal(near, False)
    has = near.any(1)
    lag = np.array([z[near[i]].mean() for i in np.flatnonzero(has)])
    assert got == pytest.approx(len(u) / has.sum() * (z[has] * lag).sum() / (z * z).sum())


def test_similarity_by_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(1, 9)), float(rng.choice([1.0, 1.25, 1.5]))) for i in range(200)]
    got = {r["patch"]: r["simi"] for r in L.similarity(spark.createDataFrame(rows, "patch long, cls long, area double, shape double"), block=4).collect()}
    for i, c, a, s in rows:
        if c:
            near = [(min(a, b) / max(a, b) + 1 / (1 + abs(s - t))) / 2 for j, k, b, t in rows if k == c and j != i]
            assert got[i] == pytest.approx(np.mean(near))
    assert all(got.get(i) is None for i, c, *_ in rows if not c)
