"""Graphs, tests of accuracy, searches, augmentation, comparisons and chains against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import accuracy as A
from loamgrid.operators import checks as C
from loamgrid.operators import comparison as P
from loamgrid.operators import connectivity as G
from loamgrid.operators import models as M
from loamgrid.operators import noise as N
from loamgrid.operators import sampling as S
from loamgrid.operators import uncertainty as U
from loamgrid.operators import validation as V
from loamgrid.plans import process as O
from loamgrid.plans.catalog import ORACLES, QUERIES


def random_edges(seed, n=24, p=0.12):
    rng = random.Random(seed)
    return [(100 + a, 100 + b, rng.randint(1, 9) / 4) for a, b in combinations(range(n), 2) if rng.random() < p]


def hops(edges, gone=()):
    near = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        if s in gone:
            continue
        out[s, s] = 0
        front = [s]
        while front:
            nxt = []
            for x in front:
                for y in near[x]:
                    if y not in gone and (s, y) not in out:
                        out[s, y] = out[s, x] + 1
                        nxt.append(y)
            front = nxt
    return out, [x for x in near if x not in gone]


def efficiency(edges, gone=()):
    d, left = hops(edges, gone)
    return sum(1 / k for k in d.values() if k) / (len(left) * (len(left) - 1)) if len(left) > 1 else 0.0


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, w double")


@pytest.mark.parametrize("seed", range(3))
def test_keystones_and_summary(spark, seed):
    edges = random_edges(seed)
    whole = efficiency(edges)
    got = {r["node"]: r["loss"] for r in G.keystones(table(spark, edges)).collect()}
    d, nodes = hops(edges)
    assert got.keys() == set(nodes) and all(got[x] == pytest.approx((whole - efficiency(edges, {x})) / whole) for x in nodes)
    s = G.network_summary(table(spark, edges))
    far = [k for k in d.values() if k]
    assert s["efficiency"] == pytest.approx(whole) and s["diameter"] == max(far) and s["path_length"] == pytest.approx(np.mean(far))
    assert s["components"] == len({frozenset(y for x, y in d if x == n) for n in nodes}) and s["density"] == pytest.approx(2 * len(edges) / (len(nodes) * (len(nodes) - 1)))
    r = G.robustness(table(spark, edges), steps=4)
    order = sorted(nodes, key=lambda x: (-sum(x in e[:2] for e in edges), x))
    assert r["efficiency"].tolist() == pytest.approx([efficiency(edges, set(order[: round(len(nodes) * i / 4)])) for i in range(5)])


@pytest.mark.parametrize("seed", range(3))
def test_spanning_tree_and_clustering(spark, seed):
    edges = random_edges(10 + seed)
    want, group = set(), {}
    root = lambda x: x if group.setdefault(x, x) == x else root(group[x])
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if root(a) != root(b):
            group[root(a)] = root(b)
            want.add((a, b, w))
    assert {tuple(r) for r in G.spanning_tree(table(spark, edges)).collect()} == want
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r["node"]: (r["degree"], r["clustering"]) for r in G.clustering(table(spark, edges)).collect()}
    for x, around in near.items():
        k = len(around)
        closed = sum(b in near[a] for a, b in combinations(around, 2))
        assert got[x] == (k, pytest.approx(2 * closed / (k * (k - 1)) if k > 1 else 0.0))


def test_binomial_tail():
    for n, k in ((1, 1), (10, 7), (50, 20), (333, 190), (1000, 500)):
        assert A.binomial_test(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-9)
    assert A.binomial_test(0, 9) == 1.0 and A.binomial_test(501_000_000, 1_000_000_000) < 1e-12 and 0.49 < A.binomial_test(500_000_000, 1_000_000_000) < 0.51


def test_model_tests(spark):
    rng = random.Random(3)
    rows = [(i, m, t, t if rng.random() < q else (t + 1) % 3) for i in range(400) for t in [i % 3] for m, q in (("a", 0.9), ("b", 0.8), ("c", 0.9))]
    df = spark.createDataFrame(rows, "id int, model string, y_true int, y_pred int")
    by = {(i, m): t == p for i, m, t, p in rows}
    for r in A.mcnemar(df).collect():
        x = sum(by[i, r["model_a"]] and not by[i, r["model_b"]] for i in range(400))
        y = sum(by[i, r["model_b"]] and not by[i, r["model_a"]] for i in range(400))
        stat = (abs(x - y) - 1) ** 2 / (x + y)
        assert (r["only_a"], r["only_b"]) == (x, y) and r["statistic"] == pytest.approx(stat) and r["p"] == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    one = df.where("model = 'a'")
    hits = sum(by[i, "a"] for i in range(400))
    assert A.hit_test(one).first()[:] == (400, hits, pytest.approx(A.binomial_test(hits, 400)))
    assert [r["n"] for r in A.class_hit_tests(one).collect()] == [400] * 3
    assert A.compare_models(df).first()["accuracy"] == pytest.approx(max(sum(by[i, m] for i in range(400)) for m in "abc") / 400)


def rows_of(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.4).astype(int)
    return M.vectors(spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, label long, features array<double>"))


def test_searches_find_the_best_settings(spark):
    rows = rows_of(spark)
    best, tried = M.search(rows, "knn", {"k": [1, 9], "weights": ["uniform"]}, k=3)
    got = {r["settings"]: r["accuracy"] for r in tried.collect()}
    assert got[str(best)] == max(got.values()) and len(got) == 2
    assert len(M.settings_of(M.GRIDS["rf"], 3)) == 3 and len(M.settings_of(M.GRIDS["rf"])) == 8


def test_rbf_features_separate_what_a_line_cannot(spark, tmp_path):
    rows = rows_of(spark)
    fit = lambda kind, **kw: M.estimator(kind, **kw).fit(rows)
    hit = lambda m: m.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    curved = fit("rbf_svm", dim=4, gamma=0.5, count=64)
    assert hit(curved) > 0.85 > hit(fit("svm", top=4))
    p = M.probabilities(curved, rows, 2).first()["p"]
    assert sum(p) == pytest.approx(1)


def test_weights_of_an_ensemble(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 120)
    probs = [np.abs(np.eye(3)[y] * s + rng.random((120, 3))) for s in (0.2, 1.5, 0.1)]
    e = spark.createDataFrame([(i, m, (p[i] / p[i].sum()).tolist()) for m, p in enumerate(probs) for i in range(120)], "id long, model long, p array<double>")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "id long, label long")
    weights, score = M.search_weights(e, labels, 3, draws=8)
    vote = sum(w * probs[m] / probs[m].sum(1, keepdims=True) for m, w in weights.items()).argmax(1)
    alone = [(p.argmax(1) == y).mean() for p in probs]
    assert score == pytest.approx((vote == y).mean()) and score >= max(alone)


def test_a_set_of_models(spark):
    rows = rows_of(spark)
    s = M.ModelSet()
    s.add("nb", lambda: M.estimator("nb"))
    s.add("rf", lambda: M.estimator("rf", numTrees=5))
    with pytest.raises(ValueError):
        s.predict(rows)
    s.train(rows)
    t = s.evaluate(rows).collect()
    assert {r["model"] for r in t} == {"nb", "rf"} and s.best(rows) == t[0]["model"] and t[0]["accuracy"] >= t[1]["accuracy"]
    assert C.model_issues(s.models["rf"], 4, 2) == [] and len(C.model_issues(s.models["rf"], 5, 3)) == 2


def test_nearest_rows_with_ties_and_far_values(spark):
    rng = np.random.default_rng(11)
    y = np.concatenate([rng.integers(0, 3, (400, 5)).astype(float), rng.normal(size=(50, 5)) * 1e7])
    x = np.concatenate([rng.integers(0, 3, (40, 5)).astype(float), y[-5:]])
    at, d2 = M._nearest_rows(x, y, 6)
    full = ((x[:, None] - y[None]) ** 2).sum(2)
    want = np.argsort(full, axis=1, kind="stable")[:, :6]
    assert (at == want).all() and (d2 == np.take_along_axis(full, want, 1)).all()


def test_pca_and_noise_level(spark):
    rng = np.random.default_rng(12)
    spec = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 8)) + rng.normal(size=(60, 8)) * 0.1
    cube = spark.createDataFrame([(i, i // 10, i % 10, v.tolist()) for i, v in enumerate(spec)], "id long, row long, col long, spec array<double>")
    got = np.array([r["spec"] for r in N.pca_denoise(cube, 3, 8).orderBy("id").collect()])
    z = (spec - spec.mean(0)) / spec.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(got, z @ vt[:3].T @ vt[:3] * spec.std(0) + spec.mean(0), atol=1e-6)
    a = rng.random((16, 12))
    p = np.pad(a, 1, mode="symmetric")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    row = N.noise_level(spark.createDataFrame([(r, c, a[r, c].item()) for r in range(16) for c in range(12)], "row long, col long, v double")).first()
    assert row["noise"] == pytest.approx(lap[4:12, 3:9].std() / 6) and row["snr"] == pytest.approx(a[4:12, 3:9].mean() / row["noise"])


def test_cutmix_and_augmentation(spark):
    at = [(i, r, c) for i in range(30) for r in range(8) for c in range(6)]
    a, b = (spark.createDataFrame([(*k, [v]) for k in at], "id long, row long, col long, spec array<double>") for v in (0.0, 1.0))
    mixed, lam = S.cutmix(a, b, 8, 6, seed=3)
    share = {r["id"]: r["lam"] for r in lam.collect()}
    seen = {}
    for r in mixed.collect():
        seen.setdefault(r["id"], {})[r["row"], r["col"]] = r["spec"][0]
    for i, cells in seen.items():
        inside = [k for k, v in cells.items() if v == 1.0]
        assert share[i] == pytest.approx(1 - len(inside) / 48) and len(cells) == 48
        if inside:
            rows, cols = {r for r, _ in inside}, {c for _, c in inside}
            assert len(inside) == len(rows) * len(cols) and max(rows) - min(rows) + 1 == len(rows)
    assert len({round(x, 3) for x in share.values()}) > 5
    out = S.augment(a.select("id", F.array(F.lit(1.0), F.lit(3.0)).alias("spec")), [{"brightness": 2.0}, {"noise": 0.1}])
    assert {r["step"]: r["n"] for r in out.groupBy("step").agg(F.count("*").alias("n")).collect()} == {0: 1440, 1: 1440, 2: 1440}
    assert S.memory_megabytes((1024, 1024), 8, 2) == 16.0


def test_folds_in_space_and_time(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, rng.randint(0, 9), rng.randint(0, 9), i % 2, f"2024-01-{1 + i % 28:02d}") for i in range(200)], "id long, row long, col long, label long, day string").withColumn("t", F.to_timestamp("day"))
    f = S.distance_folds(rows, 3)
    assert f.count() == 200 and {r["fold"] for r in f.select("fold").distinct().collect()} == {0, 1, 2}
    order = {i: n for n, (_, i) in enumerate(sorted((r["day"], r["id"]) for r in rows.collect()))}
    for r in S.sliding_folds(rows, 3, 2).collect():
        start = r["fold"] * 50
        assert start <= order[r["id"]] < start + 50 if r["part"] == "train" else start + 52 <= order[r["id"]] < min(start + 102, 200)
    x = M.vectors(rows.select("id", "row", "col", "label", F.array(F.col("label").cast("double")).alias("features")))
    scores = V.time_split_scores(x, S.sliding_folds(rows, 3, 2), lambda: M.estimator("nb")).collect()
    assert [r["accuracy"] for r in scores] == [1.0] * 3
    assert V.advise(V.compare(x, lambda: M.estimator("nb"), 3)).first()["advice"] == "strategies agree"


def test_uncertainty_of_everything(spark):
    rng = np.random.default_rng(13)
    p = rng.dirichlet(np.ones(3), 40)
    pred = spark.createDataFrame([(i, i // 8, i % 8, int(v.argmax()), v.tolist()) for i, v in enumerate(p)], "id long, row long, col long, cls long, p array<double>")
    e = spark.createDataFrame([(i, m, rng.dirichlet(np.ones(3)).tolist()) for i in range(40) for m in range(3)], "id long, model long, p array<double>")
    got = {r["id"]: r for r in U.analyse(pred, e, 3).collect()}
    for i in range(40):
        r = got[i]
        assert r["total"] == pytest.approx(0.5 * r["predictive"] + 0.3 * r["model"] + 0.2 * r["spatial"])
        assert r["predictive"] == pytest.approx(-(p[i] * np.log(p[i])).sum() / np.log(3), abs=1e-6)
    alone = U.analyse(pred, None, 3).first()
    assert alone["total"] == pytest.approx((0.5 * alone["predictive"] + 0.2 * alone["spatial"]) / 0.7)


def test_landscape_scores_and_advice(spark):
    row = spark.createDataFrame([(5.0, 40.0, 1.5, 1.0, 0.2, 0.4)], "pd double, lpi double, lsi double, shdi double, water_connectivity double, fragmentation double")
    connect = spark.createDataFrame([(0.2, 0.6)], "connectance double, functional double")
    s = P.advice(P.synthesis(row, connect), keystones=2).first()
    assert s["integrity_score"] == pytest.approx((0.5 + 0.4 - 0.5 + 0.5) / 4) and s["connectivity_score"] == pytest.approx(0.4)
    assert s["health_score"] == pytest.approx((0.225 + 0.4) / 2) and s["health_words"] == "unhealthy" and len(s["advice"]) == 5
    h = P.wetland_health(P.health_indicators(P.synthesis(row, connect))).first()
    assert h["health"] == pytest.approx((0.225 + 0.4 + 0 + 0.2 + 0.6) / 5) and h["grade"] == "poor"
    assert h["issues"] == [P.ISSUES[k] for k in ("functional_health", "structural_health", "water_connectivity")]
    assert h["priorities"] == [P.PRIORITIES["water_connectivity"], P.PRIORITIES["structural_health"]]
    assert P.advice(P.synthesis(row.withColumns({"lsi": F.lit(0.0), "pd": F.lit(0.0), "lpi": F.lit(100.0), "shdi": F.lit(9.0)}))).first()["advice"][0] == "keep the present state"


def test_landscapes_over_time(spark):
    rng = random.Random(9)
    a = [(r, c, rng.randint(0, 4)) for r in range(12) for c in range(12)]
    b = [(r, c, 1 if c > 5 else k) for r, c, k in a]
    maps = {d: spark.createDataFrame(m, "row long, col long, cls long") for d, m in (("2021", b), ("2020", a))}
    out = P.temporal_changes(maps, tile=5)
    wide = {r["date"]: r for r in out["metrics"].collect()}
    trend = {r["metric"]: r for r in out["trends"].collect()}
    assert set(wide) == {"2020", "2021"} and wide["2021"]["np"] < wide["2020"]["np"]
    for name in ("np", "lpi", "shdi", "integrity_score"):
        first, last = float(wide["2020"][name]), float(wide["2021"][name])
        rate = (last - first) / first if first else 0.0
        words = "increasing" if rate > 0.1 else "decreasing" if rate < -0.1 else "stable" if abs(rate) <= 0.05 else "slight change"
        assert trend[name]["change_rate"] == pytest.approx(rate) and trend[name]["direction"] == words
    moved = [(k, n[2]) for (*_, k), n in zip(a, b, strict=True) if k != n[2]]
    d = out["drivers"].first()
    assert d["change_ratio"] == pytest.approx(len(moved) / 144) and d["source_classes"] == sorted({x for x, _ in moved}) and d["target_classes"] == [1]
    assert "change" in out["summary"].where("metric = 'health_score'").first()["summary"]


def test_chains_of_processors(spark):
    rng = random.Random(10)
    m = spark.createDataFrame([(r, c, rng.randint(0, 2)) for r in range(10) for c in range(9)], "row long, col long, cls long")
    p = O.Pipeline("wetland_filters").add("small_patches", least=3)
    maps = [{(r["row"], r["col"]): r["cls"] for r in x.collect()} for x in p.maps(m)]
    history = p.history(m).orderBy("step").collect()
    assert [r["name"] for r in history] == ["median", "majority", "small_patches"]
    assert [r["changed"] for r in history] == [sum(a[k] != b[k] for k in a) for a, b in zip(maps, maps[1:], strict=False)]
    assert p.quality(m).first()["patches_before"] >= p.quality(m).first()["patches_after"]
    with pytest.raises(ValueError, match="unknown processor"):
        O.processor("none")
    with pytest.raises(ValueError, match="missing columns"):
        O.Pipeline([("median", {})]).process(m.drop("cls"))
    assert [r["method"] for r in O.compare_methods(m, ("conservative", "standard"), m).collect()] == ["conservative", "standard"]


def test_feature_sets(spark):
    rng = np.random.default_rng(14)
    a = rng.random((9, 8))
    g = spark.createDataFrame([(r, c, a[r, c].item()) for r in range(9) for c in range(8)], "row long, col long, v double")
    s = O.spatial_features(g, sizes=(3,))
    assert s.count() == 72 and len(s.columns) == 2 + 5 + 4 + 4 + 6 + 6
    p = np.pad(a, 1, mode="symmetric")
    low = np.min([p[i : i + 9, j : j + 8] for i in range(3) for j in range(3)], 0)
    q = np.pad(low, 1, mode="symmetric")
    opened = np.max([q[i : i + 9, j : j + 8] for i in range(3) for j in range(3)], 0)
    assert all(r["morph3_opening"] == pytest.approx(opened[r["row"], r["col"]]) and r["morph3_tophat"] == pytest.approx((a - opened)[r["row"], r["col"]]) for r in s.collect())
    t = O.texture_features(g, ("lbp", "gabor", "statistical"))
    assert t.count() == 72 and {"lbp", "gabor_0", "gabor_3", "stat_variance"} <= set(t.columns)
    with pytest.raises(ValueError):
        O.texture_features(g, ("none",))


def test_checks_of_parameters_and_tables(spark):
    assert C.parameter_issues({"a": 1, "b": "x"}, ["a", "c"], {"b": int}, {"a": (2, 5)}) == ["c is missing", "b isn't int", "a is out of range"]
    m = spark.createDataFrame([(0, 0, -1), (0, 0, 2)], "row long, col long, cls long")
    r = C.labelmap_issues(m).first()
    assert r["issues"] == ["repeated pixels"] and r["warnings"] == ["negative classes"]
    assert C.labelmap_issues(m.drop("cls")).first()["issues"] == ["no column cls"] and C.labelmap_issues(m.limit(0)).first()["issues"] == ["no pixels"]
    cube = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0])], "row long, col long, spec array<double>")
    assert C.consistency_issues(cube, m).first()["issues"] == ["pixels without label"] and C.consistency_issues(cube.limit(0)).first()["issues"] == ["no data"]
    odd = spark.createDataFrame([(0, 0, [float("nan"), 1.0]), (0, 1, [float("inf"), 1.0])], "row long, col long, spec array<double>")
    f = C.check_features(odd, "spatial", 4).first()
    assert f["quality"] == "Poor" and "high NaN share" in f["issues"] and "infinite values" in f["issues"]
    s = spark.createDataFrame([(1.0, 1.0, 1), (1.0, 1.0, 2), (None, 1.0, None)], "x double, y double, class_id int")
    assert C.sample_structure_issues(s).first()["issues"] == ["samples without place", "samples without label", "repeated places", "places with several classes", "all samples in one place"]
    assert C.representative_bands(64) == [0, 8, 16, 32, 48, 63] and C.texture_bands(30) == [0, 3, 6, 9, 12, 16, 19, 22, 25, 29]
    assert len(C.texture_names()) == 48 + 1 + 20 + 4 + 5 and len(C.spatial_names()) == 15 + 8 + 6 + 6
    assert C.has_geometry({"crs": "x"}) and not C.has_geometry({"a": 1})
    moved = C.check_geometry(cube, cube.limit(1)).first()
    assert moved["size_change"] == 0.5 and moved["quality"] == "Good"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
