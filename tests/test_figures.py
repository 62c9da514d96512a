"""Figures, run helpers and the geometric correction by what is known."""

import logging
import os
from xml.etree import ElementTree

import numpy as np
import pytest

from loamgrid import runtime as T
from loamgrid.operators import calibration, geometry, networks
from loamgrid.plans import process as O
from loamgrid.sources import figures as G

NS = "{http://www.w3.org/2000/svg}"


def parsed(text):
    return ElementTree.fromstring(text)


def test_ticks_span_the_range():
    for lo, hi in ((0, 1), (-3.2, 17), (1e-4, 2e-4), (5, 5), (0, 123456)):
        t = G.ticks(lo, hi)
        assert t[0] <= lo and t[-1] >= hi and len(t) <= 8 and np.allclose(np.diff(t), t[1] - t[0])


def test_lines_and_bars():
    root = parsed(G.lines({"a": [(0, 1), (1, 3)], "b<": [(0, 2), (1, float("nan"))]}, "Two & more"))
    assert len(root.findall(f"{NS}polyline")) == 2 and len(root.findall(f"{NS}circle")) == 3
    many = G.folded({f"s{i}": [(0, i), (1, i)] for i in range(11)})
    assert list(many)[-1] == "other" and len(many) == 8 and many["other"] == [(0, 8.5), (1, 8.5)]
    bars = parsed(G.bars([("x", 2.0), ("y", -1.0)], "Bars"))
    assert len(bars.findall(f"{NS}rect/{NS}title")) == 2
    assert parsed(G.bars([], "none")) is not None and parsed(G.lines({}, "none")) is not None


def test_figures_of_tables(spark):
    m = spark.createDataFrame([(r, c, (r + c) % 3) for r in range(4) for c in range(5)], "row long, col long, cls long")
    root = parsed(G.class_map(m, {0: "reed"}, "Map"))
    runs = [r for r in root.findall(f"{NS}rect") if r.find(f"{NS}title") is not None]
    assert len(runs) == 20 and {r.find(f"{NS}title").text for r in runs} == {"reed", "1", "2"}
    t = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 1, 2.0)], "y_true int, y_pred int, n double")
    assert len(parsed(G.confusion(t)).findall(f"{NS}rect/{NS}title")) == 4
    cube = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [0.0, 1.0])], "label int, spec array<double>")
    assert "0: 500, 3" in G.spectra(cube, [400.0, 500.0]) and len(parsed(G.signature([1.0, 2.0], [400.0, 500.0])).findall(f"{NS}polyline")) == 1
    assert "7" in G.class_shares(m) and parsed(G.models(spark.createDataFrame([("a", 0.5), ("b", 0.7)], "model string, accuracy double"))) is not None
    net = parsed(G.network(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "patch long, row double, col double")))
    assert len(net.findall(f"{NS}circle")) == 2
    assert len(parsed(G.history([{"epoch": 0, "accuracy": 0.5, "held_out_accuracy": 0.4}, {"epoch": 1, "accuracy": 0.7, "held_out_accuracy": 0.5}])).findall(f"{NS}polyline")) == 2
    assert parsed(G.metric_bars(spark.createDataFrame([(1.0, 2.0)], "np double, pd double"), ["np", "pd"])) is not None and parsed(G.importance([("a", 1.0), ("b", 2.0)])) is not None
    html = G.page("Report", [G.class_shares(m)], [("Values", ["class", "n"], [(0, 7)])])
    assert html.count("<svg") == 1 and "<td>7</td>" in html


def test_run_helpers(spark, tmp_path):
    assert [T.duration(x) for x in (1.5, 125, 11_100)] == ["1.50 s", "2 min 5 s", "3 h 5 min"] and [T.size(x) for x in (10, 2048, 5e9)] == ["10 B", "2.0 KB", "4.7 GB"]
    log = T.logger("loamgrid.test", path=str(tmp_path / "run.log"))
    assert T.logger("loamgrid.test", path=str(tmp_path / "run.log")) is log and len(log.handlers) == 2
    monitor = T.Monitor(log)
    with monitor.step("read"):
        pass
    monitor.record("accuracy", 0.5)
    monitor.record("accuracy", 0.7)
    assert monitor.summary()["accuracy"]["mean"] == pytest.approx(0.6) and monitor.summary()["read"]["n"] == 1

    @T.logged(log, ValueError)
    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        fails()
    logging.shutdown([])
    assert "read took" in (tmp_path / "run.log").read_text() and "fails failed: no" in (tmp_path / "run.log").read_text()
    now = iter([0.0, 2.0])
    assert T.Progress(4, "tiles", clock=lambda: next(now)).update() == "tiles [#####...............] 1/4, 6.00 s left"
    assert T.memory()["total"] > 0 and T.memory_is_enough(1) and not T.memory_is_enough(1 << 60) and "python" in T.system()
    assert T.environment_issues(spark) == [] and T.environment_issues(spark, ("no_such_module",)) == ["module no_such_module is missing"]
    out = T.output_folders(str(tmp_path / "out"))
    (tmp_path / "out" / "maps" / "a.tmp").write_text("12345")
    assert T.file_size(str(tmp_path / "out")) == 5
    os.utime(tmp_path / "out" / "maps" / "a.tmp", (0, 0))
    assert T.remove_old(out["maps"], 60, ".tmp") == ["a.tmp"] and T.file_size(out["maps"]) == 0
    T.forget(spark, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") and T.describe(spark.range(1)) == "table: 1 columns (id bigint)"
    assert T.summary_lines("Run", {"a": 0.5, "long": "x"}) == ["Run", "---", "a     0.5000", "long  x"]


def test_correction_by_what_is_known(spark):
    cube = spark.createDataFrame([(r, c, [float(r), float(c)]) for r in range(8) for c in range(6)], "row long, col long, spec array<double>")
    assert geometry.correct(cube, {}) is cube and geometry.correct(cube, {"pixel_size": [31.0, 30.0]}) is cube
    half = geometry.correct(cube, {"transform": [15.0, 0, 0, 0, -15.0, 0]})
    assert half.count() == 12 and half.where("row = 3 and col = 2").first()["spec"] == [7.0, 5.0]
    moved = geometry.correct(cube, {"rpc": {"scale": [1.0, 1.0], "offset": [1.0, 0.0]}}, method="nearest")
    assert moved.where("row = 2 and col = 3").first()["spec"] == [2.0, 4.0]
    with pytest.raises(NotImplementedError):
        geometry.correct(cube, {"crs": "EPSG:4326"}, crs="EPSG:32650")
    assert calibration.relative_azimuth({"sun_azimuth": 150.0, "view_azimuth": 100.0}) == 50.0 and calibration.relative_azimuth({}) == 0.0


def test_consistency_of_a_map(spark):
    m = spark.createDataFrame([(r, c, 3 if (r, c) == (2, 2) else 1 if c < 4 else 2) for r in range(6) for c in range(7)], "row long, col long, cls long")
    allowed = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "cls long, other long")
    least = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "cls long, least long")
    got = O.consistency_check(m, allowed, least, tile=4)
    assert got["adjacency"].count() == 8 and got["isolated"].collect()[0]["n"] == 1 and 0 < got["score"].first()["score"] < 1
    assert O.consistency_check(m)["adjacency"].count() == 0
    assert O.apply_consistency(m, 3, tile=4).where("cls = 3").count() == 0


def test_names_of_classifiers():
    from loamgrid.operators import models

    assert set(models.available()["deep"]) == set(networks.NETWORKS)
