"""Files in and out, configuration, and the whole analysis."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.plans.analysis import analyse, change_statistics
from loamgrid.plans.config import Config
from loamgrid.scene import fixture_cube, wavelengths
from loamgrid.sources import readers as R
from loamgrid.sources import writers as W


@pytest.mark.parametrize("layout", ["bsq", "bil", "bip"])
def test_envi_layouts_bands_and_window(spark, tmp_path, layout):
    a = np.arange(5 * 4 * 3, dtype="<f4").reshape(5, 4, 3)
    order = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[layout]
    a.transpose(order).tofile(tmp_path / "s.img")
    (tmp_path / "s.hdr").write_text(f"ENVI\nsamples = 4\nlines = 5\nbands = 3\ndata type = 4\ninterleave = {layout}\nbyte order = 0\nwavelength = {{400,\n 500, 600}}\n")
    cube, meta = R.load_cube(spark, str(tmp_path / "s.hdr"))
    assert meta["wavelengths"] == [400.0, 500.0, 600.0]
    assert {(r["row"], r["col"]): r["spec"] for r in cube.collect()} == {(r, c): a[r, c].tolist() for r in range(5) for c in range(4)}
    part, _ = R.load_envi(spark, str(tmp_path / "s.hdr"), bands=[2, 0], window=(1, 1, 3, 3))
    assert {(r["row"], r["col"]): r["spec"] for r in part.collect()} == {(r, c): a[r, c][[2, 0]].tolist() for r in (1, 2) for c in (1, 2)}


def test_formats_that_are_refused(spark, tmp_path):
    (tmp_path / "x.h5").touch()
    with pytest.raises(NotImplementedError, match="h5py"):
        R.load_cube(spark, str(tmp_path / "x.h5"))
    with pytest.raises(ValueError):
        R.load_cube(spark, "x.docx")
    with pytest.raises(FileNotFoundError):
        R.load_cube(spark, str(tmp_path / "none.hdr"))


def test_samples(spark, tmp_path):
    (tmp_path / "s.csv").write_text("x,y,class_id,class_name\n1.5,2.5,3,reed\n")
    assert R.load_samples(spark, str(tmp_path / "s.csv")).first().asDict() == {"x": 1.5, "y": 2.5, "class_id": 3, "class_name": "reed"}
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="class_id"):
        R.load_samples(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"class": "4"}}]}))
    assert R.load_samples(spark, str(tmp_path / "s.geojson")).first()[:3] == (1.0, 2.0, 4)


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "row long, col long, cls long")
    W.save_labelmap(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert W.png_bytes(m, {1: (255, 0, 0)})[:4] == b"\x89PNG"
    assert "<td>a</td><td>0.5000</td>" in W.html_report("t", {"a": 0.5})


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"classes": {"reed": {"id": 2}, "water": {"id": 1}}, "landscape": {"pixel_size": 30}}))
    c = Config.from_file(str(tmp_path / "c.json"))
    assert c.class_names() == ["water", "reed"] and c.get("landscape.pixel_size") == 30 and c.get("a.b", 7) == 7
    with pytest.raises(ValueError):
        Config.from_dict({"data": {"samples": {"train_ratio": 0.9}}})
    monkeypatch.setenv("LOAMGRID_LANDSCAPE__PIXEL_SIZE", "12.5")
    assert Config.from_env().get("landscape.pixel_size") == 12.5


def test_whole_analysis(spark, sf_dir):
    cube = fixture_cube(spark, sf_dir).withColumn("spec", F.slice("spec", 1, 64))
    c = Config.from_dict({"preprocessing": {"radiometric": {"enabled": False}}, "postprocessing": {"method": "conservative"}})
    a = analyse(cube, wavelengths(64), {}, c)
    assert a.labels.count() == cube.count() and 0 <= a.accuracy.first()["accuracy"] <= 1 and a.landscape.first()["ta"] == cube.count()
    assert change_statistics(a.labels, a.labels).first()["changed"] == 0
