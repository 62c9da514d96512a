"""Scenes and samples from files.

ENVI cubes (a header and a raw file) are decoded here with numpy through a Python data source: each
partition is a run of lines, read by a seek, and bands and a window are pushed down as options, so
pruned bands are never decoded.  Reading goes through Spark's own file access where a path isn't
local.  GeoTIFF, NetCDF classic, MATLAB level 5 and npz files go through Spark's binary reader to the
decoders of :mod:`loamgrid.sources.formats`.  HDF5 (and so NetCDF-4 and MATLAB 7.3) and GeoPackage
need libraries that may be absent; they are refused by name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgrid.scene import SAMPLES
from loamgrid.sources.formats import DECODERS, load_scene, read_kml, read_shapefile, shapes_table

#: Numpy types by the header's data type code.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def parse_header(text: str) -> dict:
    """Keys of an ENVI header in lower case; braces give lists of strings."""
    if not text.lstrip().startswith("ENVI"):
        raise ValueError("not an ENVI header")
    out, body = {}, text.split("\n", 1)[1] if "\n" in text else ""
    while "=" in body:
        key, rest = body.split("=", 1)
        key, rest = key.strip().split("\n")[-1].strip().lower(), rest.lstrip(" \t")
        if rest.startswith("{"):
            value, _, body = rest[1:].partition("}")
            out[key] = [x.strip() for x in value.replace("\n", " ").split(",") if x.strip()]
        else:
            value, _, body = rest.partition("\n")
            out[key] = value.strip()
    return out


def scene_of(header: dict) -> dict:
    """Rows, columns, bands, type, layout and wavelengths, with ENVI's defaults."""
    kind = ENVI_TYPES.get(int(header.get("data type", 4)))
    if kind is None:
        raise ValueError(f"data type {header['data type']} isn't supported")
    return {
        "lines": int(header["lines"]),
        "samples": int(header["samples"]),
        "bands": int(header["bands"]),
        "dtype": (">" if header.get("byte order", "0") == "1" else "<") + kind,
        "interleave": header.get("interleave", "bsq").lower(),
        "offset": int(header.get("header offset", 0)),
        "wavelengths": [float(x) for x in header.get("wavelength", [])],
    }


def companion(header_path: str) -> str:
    """The raw file beside a header: .img, .dat, .raw or no suffix."""
    stem = header_path[: -len(".hdr")] if header_path.lower().endswith(".hdr") else header_path
    for name in (stem, f"{stem}.img", f"{stem}.dat", f"{stem}.raw"):
        if os.path.isfile(name):
            return name
    raise FileNotFoundError(f"no raw file beside {header_path}")


def decode_lines(raw: bytes, s: dict, n: int) -> np.ndarray:
    """(n, samples, bands) from the bytes of n whole lines (bil, bip) or of n lines of each band (bsq)."""
    a = np.frombuffer(raw, s["dtype"])
    if s["interleave"] == "bip":
        return a.reshape(n, s["samples"], s["bands"])
    if s["interleave"] == "bil":
        return a.reshape(n, s["bands"], s["samples"]).transpose(0, 2, 1)
    return a.reshape(s["bands"], n, s["samples"]).transpose(1, 2, 0)


class _Lines(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first, self.count = first, count


class EnviReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        with open(self.path, encoding="latin-1") as f:
            self.scene = scene_of(parse_header(f.read()))
        self.raw = companion(self.path)
        self.bands = [int(b) for b in json.loads(options.get("bands", "null") or "null") or range(self.scene["bands"])]
        box = json.loads(options.get("window", "null") or "null")
        s = self.scene
        self.top, self.left, self.bottom, self.right = box or (0, 0, s["lines"], s["samples"])
        self.chunk = int(options.get("lines", 64))

    def partitions(self) -> list[InputPartition]:
        end = min(self.bottom, self.scene["lines"])
        return [_Lines(i, min(self.chunk, end - i)) for i in range(max(0, self.top), end, self.chunk)] or [_Lines(0, 0)]

    def read(self, part: _Lines) -> Iterator[tuple]:
        s, size = self.scene, np.dtype(self.scene["dtype"]).itemsize
        if not part.count:
            return
        with open(self.raw, "rb") as f:
            if s["interleave"] == "bsq":
                planes = []
                for b in self.bands:  # only the bands asked for
                    f.seek(s["offset"] + (b * s["lines"] + part.first) * s["samples"] * size)
                    planes.append(np.frombuffer(f.read(part.count * s["samples"] * size), s["dtype"]).reshape(part.count, s["samples"]))
                cube = np.stack(planes, -1)
            else:
                f.seek(s["offset"] + part.first * s["samples"] * s["bands"] * size)
                cube = decode_lines(f.read(part.count * s["samples"] * s["bands"] * size), s, part.count)[:, :, self.bands]
        for r in range(part.count):
            for c in range(max(0, self.left), min(self.right, s["samples"])):
                yield part.first + r, c, cube[r, c].astype(float).tolist()


class EnviSource(DataSource):
    """``spark.read.format("envi").option("bands", "[0, 3]").option("window", "[top, left, bottom, right]")``."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return "row bigint, col bigint, spec array<double>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return EnviReader(self.options)


def _needs(library: str, what: str):
    def refuse(*_, **__):
        raise NotImplementedError(f"reading {what} needs the library {library}, which isn't installed")

    return refuse


def load_envi(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    spark.dataSource.register(EnviSource)
    with open(path, encoding="latin-1") as f:
        meta = scene_of(parse_header(f.read()))
    read = spark.read.format("envi").option("bands", json.dumps(bands)).option("window", json.dumps(window))
    if bands is not None and meta["wavelengths"]:
        meta["wavelengths"] = [meta["wavelengths"][b] for b in bands]
    return read.load(path), meta


CUBES = {".hdr": load_envi, **dict.fromkeys(DECODERS, load_scene), ".h5": _needs("h5py", "HDF5"), ".hdf5": _needs("h5py", "HDF5")}


def load_cube(spark: SparkSession, path: str, **kw) -> tuple[DataFrame, dict]:
    """(cube, metadata) by suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in CUBES:
        raise ValueError(f"unsupported format {suffix}")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return CUBES[suffix](spark, path, **kw)


def load_table_cube(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A cube stored as Parquet; the window reaches the scan as pushed filters."""
    cube = spark.read.parquet(path)
    if window:
        top, left, bottom, right = window
        cube = cube.where((F.col("row") >= top) & (F.col("row") < bottom) & (F.col("col") >= left) & (F.col("col") < right))
    return cube if bands is None else cube.withColumn("spec", F.array(*(F.element_at("spec", b + 1) for b in bands)))


def load_csv_samples(spark: SparkSession, path: str) -> DataFrame:
    """x, y, class_id and what else is there; the three are required."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"x", "y", "class_id"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    kinds = {f.name: f.dataType.simpleString() for f in SAMPLES}
    return raw.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in raw.columns))


def _features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """kind, coordinates (JSON) and properties of each feature; with ``lines`` each line is a collection."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def _named(properties: str = "properties") -> tuple:
    p = lambda k: F.try_element_at(properties, F.lit(k))
    return F.expr(f"try_cast(coalesce(try_element_at({properties}, 'class_id'), try_element_at({properties}, 'class'), try_element_at({properties}, 'label')) as int)").alias("class_id"), p("class_name").alias("class_name")


def load_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point features: x, y, class_id (class_id, class or label), class_name."""
    f = _features(spark, path, lines).where("kind = 'Point'").withColumn("at", F.from_json("coordinates", "array<double>"))
    return f.select(F.col("at")[0].alias("x"), F.col("at")[1].alias("y"), *_named())


def load_geojson_shapes(spark: SparkSession, path: str) -> DataFrame:
    """id, rings, class_id, class_name of points, polygons and multipolygons."""
    pair, ring = "array<double>", "array<array<double>>"
    one = F.when(F.col("kind") == "Point", F.array(F.array(F.from_json("coordinates", pair)))).when(F.col("kind") == "Polygon", F.from_json("coordinates", f"array<{ring}>")).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("coordinates", f"array<array<{ring}>>")))
    return _features(spark, path).withColumn("rings", one).where("rings is not null").select(F.monotonically_increasing_id().alias("id"), "rings", *_named())


def _content(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def load_shapes(spark: SparkSession, path: str) -> DataFrame:
    """id, rings, class_id, class_name of a shapefile (with its .dbf), KML or GeoJSON file."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".shp":
        return shapes_table(spark, read_shapefile(_content(spark, path), _content(spark, path[:-4] + ".dbf")))
    if suffix == ".kml":
        return shapes_table(spark, read_kml(_content(spark, path).decode("utf-8")))
    if suffix in (".geojson", ".json"):
        return load_geojson_shapes(spark, path)
    raise ValueError(f"unsupported format {suffix}")


def load_shape_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a file of shapes: x, y, class_id, class_name."""
    one = load_shapes(spark, path).where("size(rings) = 1 and size(rings[0]) = 1")
    return one.select(F.col("rings")[0][0][0].alias("x"), F.col("rings")[0][0][1].alias("y"), "class_id", "class_name")


SAMPLE_READERS = {".csv": load_csv_samples, ".txt": load_csv_samples, ".geojson": load_geojson, ".json": load_geojson, ".shp": load_shape_points, ".kml": load_shape_points, ".gpkg": _needs("geopandas", "GeoPackage")}


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SAMPLE_READERS:
        raise ValueError(f"unsupported format {suffix}")
    return SAMPLE_READERS[suffix](spark, path)


def load_registry(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A model registry (a JSON object of models by id) as rows id, type, name, checksum."""
    entry = "struct<name: string, type: string, checksum: string>"
    r = spark.read.schema(f"models map<string, {entry}>").option("multiLine", True).json(path).select(F.explode("models").alias("id", "m")).select("id", "m.*")
    return r if kind is None else r.where(F.col("type") == kind)


def verify_checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """file, ok of files by md5 against (file, checksum), an ``md5:`` prefix allowed."""
    got = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"))
    return expected.join(got, "file", "left").select("file", (F.coalesce(F.col("md5"), F.lit("")) == F.regexp_replace("checksum", "^md5:", "")).alias("ok"))
