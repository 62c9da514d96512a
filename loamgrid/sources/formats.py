"""Decoders of scene files in plain numpy: baseline TIFF and BigTIFF with geographic tags, MATLAB
level 5, NetCDF classic, npz.  Each turns the bytes of a file into (rows, columns, bands) and metadata.

Files come through Spark's ``binaryFile`` reader, so any store works; a file is one task's work (Spark
bounds it at 2 GB), and a folder of scenes is read side by side.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Array names tried first in container formats.
DATASET_KEYS = ["data", "hyperspectral", "reflectance", "radiance", "image"]
#: Parts of names of a band dimension.
BAND_NAMES = ("band", "bands", "wavelength", "spectral")

# TIFF. Struct codes by field type; sample kinds by sample format.
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SAMPLE = {1: "u", 2: "i", 3: "f"}


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    out: dict[int, tuple] = {}
    for _ in range(count):
        tag, kind = struct.unpack_from(order + "HH", data, at)
        n = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
        place, room = (at + 12, 8) if big else (at + 8, 4)
        code = _FIELD.get(kind)
        if code is not None:
            size = struct.calcsize("=" + code) * n
            if size > room:
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            out[tag] = (data[place : place + n].rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, place)
        at += 20 if big else 12
    return order, out


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-width codes, most significant bit first, widened one code early."""
    table: list[bytes] = []
    out, width, bits, held, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """Strips or tiles, chunky or planar, uncompressed, deflate, LZW or PackBits, with or without
    horizontal differencing."""
    order, t = _tags(data)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    w, h, bands = one(256), one(257), one(277, 1)
    bits, kind, packing, planar, predictor = one(258, 8), one(339, 1), one(259, 1), one(284, 1) == 2, one(317, 1)
    if packing not in _UNPACK:
        raise ValueError(f"TIFF compression {packing} isn't supported")
    if predictor not in (1, 2) or kind not in _SAMPLE or bits not in (8, 16, 32, 64) or len(set(t.get(258, (8,)))) > 1:
        raise ValueError("this layout of TIFF samples isn't supported")
    dtype = np.dtype(f"{order}{_SAMPLE[kind]}{bits // 8}")
    tiled = 322 in t
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    across, down = -(-w // bw), -(-h // bh)
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    out = np.zeros((h, w, bands), dtype.newbyteorder("="))
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(i, across * down) if planar else (0, i)
        r, c = place // across * bh, place % across * bw
        depth, rows = (1 if planar else bands), (bh if tiled else min(bh, h - r))
        block = np.frombuffer(_UNPACK[packing](data[at : at + size]), dtype, rows * bw * depth).reshape(rows, bw, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: h - r, : w - c]
        if planar:
            out[r : r + len(part), c : c + part.shape[1], plane] = part[:, :, 0]
        else:
            out[r : r + len(part), c : c + part.shape[1]] = part
    meta: dict = {"format": "GeoTIFF", "height": h, "width": w, "bands": bands, "dtype": out.dtype.name}
    if 33550 in t and 33922 in t:
        sx, sy = t[33550][:2]
        i, j, _, x, y, _ = t[33922][:6]
        meta["transform"] = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
        x0, y0 = meta["transform"][2], meta["transform"][5]
        meta["bounds"] = [x0, y0 - h * sy, x0 + w * sx, y0]
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if 3072 in codes or 2048 in codes:
        meta["crs"] = f"EPSG:{codes.get(3072, codes.get(2048))}"
    if 42113 in t:
        meta["nodata"] = float(one(42113))
    return out, meta


def write_tiff(a: np.ndarray, transform: list[float] | None = None, epsg: int | None = None, rows_per_strip: int = 64) -> bytes:
    """(rows, columns) or (rows, columns, bands) as a deflated little-endian TIFF in strips."""
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, bands = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    strips = [zlib.compress(np.ascontiguousarray(a[r : r + rows_per_strip], a.dtype.newbyteorder("<")).tobytes()) for r in range(0, h, rows_per_strip)]
    offsets = np.cumsum([8] + [len(s) + len(s) % 2 for s in strips])
    fields: list[tuple[int, int, tuple]] = [
        (256, 4, (w,)), (257, 4, (h,)), (258, 3, (a.dtype.itemsize * 8,) * bands), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(offsets[:-1].tolist())),
        (277, 3, (bands,)), (278, 4, (rows_per_strip,)), (279, 4, tuple(map(len, strips))), (284, 3, (1,)), (339, 3, (kind,) * bands),
    ]
    if transform:
        sx, _, x0, _, sy, y0 = transform
        fields += [(33550, 12, (sx, -sy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0))]
    if epsg:
        fields.append((34735, 3, (1, 1, 0, 1, 3072, 0, 1, epsg)))
    at, extra, directory = int(offsets[-1]), b"", b""
    for tag, code, values in sorted(fields):
        raw = struct.pack(f"<{len(values)}{_FIELD[code]}", *values)
        if len(raw) > 4:
            place = at + 2 + 12 * len(fields) + 4 + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        directory += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + directory + b"\0\0\0\0" + extra


# MATLAB level 5. Numpy types by data type code.
_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _mat_elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: size and type share a word, the data is the next one
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size if kind == 15 else 8 + -(-size // 8) * 8


def mat_arrays(data: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a MATLAB level 5 file by name, in file order."""
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order is None:
        raise ValueError("not a MATLAB level 5 file")
    out: dict[str, np.ndarray] = {}
    for kind, body in _mat_elements(data[128:], order):
        if kind == 15:
            kind, body = next(_mat_elements(zlib.decompress(body), order))
        if kind != 14:
            continue
        parts = list(_mat_elements(body, order))
        if len(parts) < 4 or not 6 <= parts[0][1][0 if order == "<" else 3] <= 15 or parts[3][0] not in _MAT:
            continue  # text, cells, structures and sparse arrays are no scenes
        shape = np.frombuffer(parts[1][1], order + "i4")
        out[parts[2][1].decode("latin-1")] = np.frombuffer(parts[3][1], order + _MAT[parts[3][0]]).reshape(shape, order="F")
    return out


# NetCDF classic. Numpy types by code.
_NC = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variables(data: bytes) -> tuple[dict[str, tuple[tuple[str, ...], np.ndarray]], dict]:
    """(dimension names, array) of each variable, and the global attributes, of a classic file."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    wide, at = data[3] == 2, 4

    def number(code: str = ">I") -> int:
        nonlocal at
        at += struct.calcsize(code)
        return struct.unpack_from(code, data, at - struct.calcsize(code))[0]

    def name() -> str:
        nonlocal at
        n = number()
        at += -(-n // 4) * 4
        return data[at - -(-n // 4) * 4 :][:n].decode("utf-8")

    def attributes() -> dict:
        nonlocal at
        tag, n = number(), number()
        out = {}
        for _ in range(n if tag == 12 else 0):
            key, kind, count = name(), number(), number()
            size = np.dtype(_NC[kind]).itemsize * count
            raw = data[at : at + size]
            at += -(-size // 4) * 4
            out[key] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, _NC[kind]).astype(float).tolist()
        return out

    records, tag, n = number(), number(), number()
    dims = [(name(), number()) for _ in range(n if tag == 10 else 0)]
    meta = attributes()
    tag, n = number(), number()
    heads = []
    for _ in range(n if tag == 11 else 0):
        key, rank = name(), number()
        ids = [number() for _ in range(rank)]
        attributes()
        kind, size, begin = number(), number(), number(">Q" if wide else ">I")
        heads.append((key, ids, kind, size, begin))
    per_record = [v for v in heads if v[1] and dims[v[1][0]][1] == 0]
    step = sum(v[3] for v in per_record) if len(per_record) != 1 else 0
    out = {}
    for key, ids, kind, _, begin in heads:
        dtype, shape = np.dtype(_NC[kind]), [dims[i][1] for i in ids]
        if ids and shape[0] == 0:
            one = int(np.prod(shape[1:])) * dtype.itemsize
            shape[0] = records
            raw = b"".join(data[begin + i * (step or one) :][:one] for i in range(records))
        else:
            raw = data[begin : begin + int(np.prod(shape)) * dtype.itemsize]
        out[key] = tuple(dims[i][0] for i in ids), np.frombuffer(raw, dtype).reshape(shape)
    return out, meta


def main_array(arrays: dict[str, np.ndarray]) -> str:
    """The first known name that is 3-D, else the largest 3-D array, the first on ties."""
    solid = [k for k, a in arrays.items() if a.ndim == 3 and a.dtype.kind in "iuf"]
    if not solid:
        raise ValueError("the file holds no 3-D array")
    return next((k for k in DATASET_KEYS if k in solid), None) or max(solid, key=lambda k: arrays[k].size)


def band_axis(names: tuple[str, ...]) -> int:
    """The place of the band dimension: by its name, else the last."""
    return next((i for i, n in enumerate(names) if any(b in n.lower() for b in BAND_NAMES)), len(names) - 1)


def _wavelengths(arrays: dict[str, np.ndarray]) -> list[float]:
    found = next((arrays[k] for k in arrays if k.lower() in ("wavelength", "wavelengths", "bands", "wl")), None)
    return [] if found is None else np.asarray(found, float).ravel().tolist()


def read_mat(data: bytes) -> tuple[np.ndarray, dict]:
    arrays = mat_arrays(data)
    key = main_array(arrays)
    return arrays[key], {"format": "MATLAB", "data_key": key, "wavelengths": _wavelengths(arrays)}


def read_netcdf(data: bytes) -> tuple[np.ndarray, dict]:
    variables, attributes = netcdf_variables(data)
    arrays = {k: a for k, (_, a) in variables.items()}
    key = main_array(arrays)
    return np.moveaxis(arrays[key], band_axis(variables[key][0]), -1), {**attributes, "format": "NetCDF", "data_variable": key, "wavelengths": _wavelengths(arrays)}


def read_npz(data: bytes) -> tuple[np.ndarray, dict]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        arrays = {k: z[k] for k in z}
    key = main_array(arrays)
    return arrays[key], {"format": "npz", "data_key": key, "wavelengths": _wavelengths(arrays)}


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, dict]]] = {".tif": read_tiff, ".tiff": read_tiff, ".mat": read_mat, ".nc": read_netcdf, ".npz": read_npz}


def _suffix(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower()


def scene_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path and meta (JSON) of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            metas = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                cube, meta = DECODERS[_suffix(p)](content)
                metas.append(json.dumps({"height": cube.shape[0], "width": cube.shape[1], "bands": cube.shape[2], **meta}, default=str))
            yield pd.DataFrame({"path": pdf["path"], "meta": metas})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, meta string")


def scene_pixels(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, rows: int = 64) -> DataFrame:
    """scene_id (the file), row, col, spec of all files of a path; bands and a window (top, left,
    bottom, right) are cut out before pixels become rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                cube, _ = DECODERS[_suffix(p)](content)
                top, left, bottom, right = window or (0, 0, *cube.shape[:2])
                bottom, right, top, left = min(bottom, cube.shape[0]), min(right, cube.shape[1]), max(0, top), max(0, left)
                for r in range(top, bottom, rows):
                    part = cube[r : min(r + rows, bottom), left:right]
                    part = (part if bands is None else part[:, :, bands]).astype(np.float64)
                    n = part.shape[0] * part.shape[1]
                    at = np.indices(part.shape[:2]).reshape(2, n)
                    yield pd.DataFrame({"scene_id": p.rsplit("/", 1)[-1], "row": at[0] + r, "col": at[1] + left, "spec": list(part.reshape(n, -1))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "scene_id string, row long, col long, spec array<double>")


def load_scene(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    """(cube, metadata) of one file."""
    meta = json.loads(scene_metadata(spark, path).first()["meta"])
    if bands is not None:
        meta["bands"] = len(bands)
        if meta.get("wavelengths"):
            meta["wavelengths"] = [meta["wavelengths"][b] for b in bands]
    return scene_pixels(spark, path, bands, window).select("row", "col", "spec"), meta


# Samples as shapes.


def rings_of(shape: str, coordinates) -> list[list[tuple[float, float]]]:
    """The rings of a polygon or several; points give one ring of one point."""
    if shape == "Point":
        return [[(coordinates[0], coordinates[1])]]
    if shape == "Polygon":
        return [[(p[0], p[1]) for p in ring] for ring in coordinates]
    if shape == "MultiPolygon":
        return [[(p[0], p[1]) for p in ring] for polygon in coordinates for ring in polygon]
    raise ValueError(f"shape {shape} isn't supported")


def read_shapefile(shp: bytes, dbf: bytes) -> list[tuple[list[list[tuple[float, float]]], dict[str, str]]]:
    """(rings, attributes) of each point or polygon of a shapefile."""
    count, header, width = struct.unpack_from("<IHH", dbf, 4)
    names, at = [], 32
    while dbf[at] != 0x0D:
        names.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        place, row = header + i * width + 1, {}
        for name, size in names:
            row[name] = dbf[place : place + size].decode("utf-8", "replace").strip()
            place += size
        rows.append(row)
    out, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">I", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        row = rows[len(out)] if len(out) < len(rows) else {}
        if kind in (1, 11, 21):
            out.append(([[struct.unpack_from("<dd", shp, at + 12)]], row))
        elif kind in (5, 15, 25):
            parts, points = struct.unpack_from("<II", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", shp, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
            pairs = list(zip(xy[::2], xy[1::2], strict=True))
            out.append(([pairs[a:b] for a, b in zip(starts, starts[1:], strict=False)], row))
        else:
            out.append(([], row))
        at += 8 + size
    return out


def read_kml(text: str) -> list[tuple[list[list[tuple[float, float]]], dict[str, str]]]:
    """(rings, attributes) of each placemark with points or polygons."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    pairs = lambda s: [tuple(map(float, p.split(",")[:2])) for p in (s or "").split()]
    out = []
    for mark in root.iter("Placemark"):
        row = {d.get("name"): (d.findtext("value") or d.text or "").strip() for tag in ("Data", "SimpleData") for d in mark.iter(tag)}
        row["name"] = (mark.findtext("name") or "").strip()
        out.append(([pairs(c.text) for c in mark.iter("coordinates")], row))
    return out


def shapes_table(spark: SparkSession, shapes: list[tuple[list, dict[str, str]]]) -> DataFrame:
    """id, rings, class_id, class_name of decoded shapes."""
    pick = lambda row, *names: next((v for n in names for k, v in row.items() if k.lower() == n and v != ""), None)
    rows = [(i, [[list(map(float, p)) for p in ring] for ring in rings], pick(row, "class_id", "class", "label"), pick(row, "class_name", "name")) for i, (rings, row) in enumerate(shapes) if rings]
    table = spark.createDataFrame(rows, "id long, rings array<array<array<double>>>, class_id string, class_name string")
    return table.withColumn("class_id", F.expr("try_cast(try_cast(class_id as double) as int)"))


def pixels_inside(shapes: DataFrame, height: int, width: int, transform: list[float] | None = None) -> DataFrame:
    """id, class_id, row, col of the pixels of each shape: a point's pixel, or those whose corner
    lies in a polygon (even-odd rule over all rings).

    Each shape looks at the rows of its bounds; a row's pixels are the runs between crossings, so
    work grows with rows and edges, not with the bounding box.
    """
    a, _, c, _, e, f = transform or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shape_id, class_id, rings in zip(pdf["id"], pdf["class_id"], pdf["rings"], strict=True):
                xs, ys = [], []
                lines = [np.array([[(p[0] - c) / a, (p[1] - f) / e] for p in ring]) for ring in rings]
                if len(lines) == 1 and len(lines[0]) == 1:
                    xs, ys = [np.floor(lines[0][:, 0])], [np.floor(lines[0][:, 1])]
                else:
                    ends = [(r[:-1], r[1:]) if len(r) > 1 and (r[0] == r[-1]).all() else (r, np.roll(r, -1, 0)) for r in lines]
                    p, q = np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])
                    for row in range(max(0, int(np.ceil(p[:, 1].min()))), min(height - 1, int(np.floor(p[:, 1].max()))) + 1):
                        over = (p[:, 1] <= row) != (q[:, 1] <= row)
                        cross = np.sort(p[over, 0] + (row - p[over, 1]) * (q[over, 0] - p[over, 0]) / (q[over, 1] - p[over, 1]))
                        for left, right in zip(cross[::2], cross[1::2], strict=False):
                            cols = np.arange(max(0, int(np.ceil(left))), min(width - 1, int(np.ceil(right)) - 1) + 1)
                            xs.append(cols)
                            ys.append(np.full(len(cols), row))
                x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (xs, ys))
                on = (x >= 0) & (x < width) & (y >= 0) & (y < height)
                yield pd.DataFrame({"id": shape_id, "class_id": class_id, "row": y[on], "col": x[on]})

    return shapes.select("id", "class_id", "rings").mapInPandas(run, "id long, class_id int, row long, col long")
