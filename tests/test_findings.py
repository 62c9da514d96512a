"""Findings of the reviews: partial grids, sizes of results, whole graphs."""

import os
import random
import time

import duckdb
import numpy as np
import pytest

from loamgrid.operators import connectivity as G
from loamgrid.operators import landscape as L
from loamgrid.operators import models as M
from loamgrid.operators import sampling as P
from loamgrid.operators import stencil as S
from loamgrid.plans.catalog import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows


def test_buffered_loo_takes_few_bytes_for_each_pair(spark, tmp_path):
    xy = {i: (i // 20, i % 20) for i in range(2013)}
    points = spark.createDataFrame([(i, *at) for i, at in xy.items()], "id long, row long, col long")
    got = P.buffered_loo(points, points.where("id % 100 = 0"), 3.0)
    near = lambda a, b: (xy[a][0] - xy[b][0]) ** 2 + (xy[a][1] - xy[b][1]) ** 2 <= 9
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(0, 2013, 100) for b in range(2013) if not near(a, b)]
    spark.range(0, 10_000, 1, 1).selectExpr("id", "id div 20 as row", "id % 20 as col").write.parquet(str(tmp_path / "points"))
    many = spark.read.parquet(str(tmp_path / "points"))
    P.buffered_loo(many.where("id % 25 = 0"), many.selectExpr("id + 0 as id", "row", "col"), 3.0).write.parquet(str(tmp_path / "loo"))
    n = spark.read.parquet(str(tmp_path / "loo")).count()
    size = sum(os.path.getsize(tmp_path / "loo" / f) for f in os.listdir(tmp_path / "loo") if f.endswith(".parquet"))
    assert 3_980_000 < n < 4_000_000 and size < 0.8 * n


def test_keystones_of_many_components(spark, monkeypatch):
    rng = random.Random(7)
    edges = {(g * 100 + a, g * 100 + b) for g in range(400) for a, b in (sorted(rng.sample(range(8), 2)) for _ in range(9))} | {(90_000 + i, 90_001 + i) for i in range(30)}
    table = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges)], "a long, b long, w double")
    start = time.time()
    got = {r["node"]: r["loss"] for r in G.keystones(table).collect()}
    assert time.time() - start < 60  # no removal walks the whole graph of some 3,000 nodes
    whole = G.graph_of(table)
    before = whole.efficiency()
    assert got.keys() == set(whole.names.tolist())
    for i in [0, 1234, len(whole.names) - 16]:
        gone = np.arange(len(whole.names)) == i
        assert got[int(whole.names[i])] == pytest.approx((before - whole.efficiency(gone)) / before, abs=1e-12)
    monkeypatch.setattr(G, "MOST_NODES", 7)  # the larger ones by nodes dealt to tasks
    few = table.where("a < 900 or a >= 90000")
    dealt = {r["node"]: r["loss"] for r in G.keystones(few).collect()}
    monkeypatch.setattr(G, "MOST_NODES", 256)
    assert dealt == pytest.approx({r["node"]: r["loss"] for r in G.keystones(few).collect()}, abs=1e-12)


@pytest.fixture(scope="module")
def cut_short(sf_dir, tmp_path_factory):
    """A scene of 60 rows whose last one ends after 16 pixels."""
    path = tmp_path_factory.mktemp("cut_short")
    duckdb.sql(
        f"""COPY (SELECT v + n * c AS vec_id, * EXCLUDE (v, n, c, vec_id) FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS v, count(*) OVER () AS n FROM read_parquet('{sf_dir}/embeddings.parquet')), range(60) r(c)
        WHERE v + n * c < 1196) TO '{path}/embeddings.parquet' (FORMAT parquet)"""
    )
    return str(path)


NEAR = "sobel prewitt roberts laplace local_stats5 texture_stats7 local_entropy median3 gaussian_classes window_diversity smooth_uniform smooth_median smooth_gaussian smooth_wiener binary_open binary_close binary_gradient".split()


@pytest.mark.parametrize("name", [*NEAR, "fourier_destripe", "resample_bilinear", "resample_nearest"])
def test_a_last_row_cut_short(spark, cut_short, name):
    assert spark_rows(QUERIES[name](spark, cut_short)) == duck_rows(ORACLES[name], cut_short)


def test_gaps_belong_to_no_rim_and_close_nothing(spark):
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 1), (2, 0, 2), (2, 2, 1)], "row long, col long, cls long")
    assert sorted(tuple(r) for r in L.rim(labels, (1,)).collect()) == [(0, 2), (2, 0)]
    assert {(r["row"], r["col"]) for r in S.close_classes(labels, S.disk(1)).collect()} == {(r["row"], r["col"]) for r in labels.collect()}


def test_neighbours_meet_in_blocks_by_cores_not_by_rows(spark):
    blocks = [M._blocks(n, 1024, 12) for n in (1000, 10_000, 100_000, 900_000)]
    assert blocks == [1, 7, 7, 7]  # 1, 3, 25 and 220 where each block held 4,096 rows
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (700, 6)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(x)], "id long, label long, features array<double>")
    got = {(r["id"], r["r"]): r["other"] for r in M.nearest(rows, rows, 5, block=64).collect()}
    d2 = ((x[:, None] - x) ** 2).sum(2)
    want = np.argsort(d2, axis=1, kind="stable")[:, :5]
    assert got == {(i, r + 1): want[i, r] for i in range(700) for r in range(5)}
