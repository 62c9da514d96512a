"""Scene and sample files: decoders against files written here byte by byte, and round trips."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.sources import formats as X
from loamgrid.sources import readers as R
from loamgrid.sources import writers as W


def pixels(df):
    return {(r["row"], r["col"]): r["spec"] for r in df.collect()}


def whole(a):
    return {(r, c): a[r, c].astype(float).tolist() for r in range(a.shape[0]) for c in range(a.shape[1])}


def tiff(a, order="<", packing=1, planar=False, tile=None, predictor=1, rows=2):
    """A TIFF file of (h, w, bands) in strips or tiles."""
    h, w, bands = a.shape
    dtype = a.dtype.newbyteorder(order)
    planes = [a[:, :, b : b + 1] for b in range(bands)] if planar else [a]
    blocks = []
    for p in planes:
        if tile:
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    blocks.append(np.pad(p[r : r + tile, c : c + tile], ((0, max(0, r + tile - h)), (0, max(0, c + tile - w)), (0, 0))))
        else:
            blocks += [p[r : r + rows] for r in range(0, h, rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
    raw = [np.ascontiguousarray(b.astype(dtype)).tobytes() for b in blocks]
    raw = [{1: bytes, 8: zlib.compress, 5: lzw, 32773: lambda x: b"".join(bytes([len(x[i : i + 128]) - 1]) + x[i : i + 128] for i in range(0, len(x), 128))}[packing](x) for x in raw]
    at = 8 + np.cumsum([0] + [len(x) for x in raw])
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [a.dtype.itemsize * 8] * bands), 259: (3, [packing]), 277: (3, [bands]), 284: (3, [2 if planar else 1]), 317: (3, [predictor]), 339: (3, [kind] * bands)}
    fields |= {322: (3, [tile]), 323: (3, [tile]), 324: (4, at[:-1]), 325: (4, [len(x) for x in raw])} if tile else {278: (3, [rows]), 273: (4, at[:-1]), 279: (4, [len(x) for x in raw])}
    head, extra, start = b"", b"", int(at[-1])
    for tag in sorted(fields):
        code, values = fields[tag]
        body = struct.pack(f"{order}{len(values)}{'HI'[code == 4]}", *map(int, values))
        if len(body) > 4:
            place = start + 2 + 12 * len(fields) + 4 + len(extra)
            extra += body
            body = struct.pack(order + "I", place)
        head += struct.pack(order + "HHI", tag, code, len(values)) + body.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + b"".join(raw) + struct.pack(order + "H", len(fields)) + head + b"\0" * 4 + extra


def lzw(data):
    """TIFF's codes of a text, most significant bit first."""
    codes, bits, n = [], 0, 0
    table = {bytes([i]): i for i in range(256)}
    out, width, size = bytearray(), 9, 258

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)

    put(256)
    word = b""
    for i in range(len(data)):
        one = data[i : i + 1]
        if word + one in table:
            word += one
            continue
        put(table[word])
        codes.append(table[word])
        table[word + one] = size
        size += 1
        if size > 4093:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = one
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("layout", [{}, {"planar": True}, {"tile": 16}, {"tile": 16, "planar": True}, {"predictor": 2}])
def test_tiff_layouts(order, packing, layout):
    rng = np.random.default_rng(1)
    for dtype in ("u1", "i2", "f4"):
        if dtype == "f4" and "predictor" in layout:
            continue
        a = (rng.random((37, 21, 3)) * 90).astype(dtype)
        got, meta = X.read_tiff(tiff(a, order, packing, **layout))
        assert (got == a).all() and meta["bands"] == 3 and got.dtype == np.dtype(dtype)


def test_lzw_of_long_texts():
    data = bytes(np.random.default_rng(2).integers(0, 7, 60_000).astype(np.uint8))
    assert X.unpack_lzw(lzw(data)) == data


def test_geotiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(3).random((30, 12, 4)).astype(np.float32)
    path = str(tmp_path / "scene.tif")
    W.save_bytes(spark, X.write_tiff(a, [30.0, 0.0, 500.0, 0.0, -30.0, 900.0], 32650, 7), path)
    cube, meta = R.load_cube(spark, path)
    assert pixels(cube) == whole(a)
    assert meta["crs"] == "EPSG:32650" and meta["transform"] == [30.0, 0.0, 500.0, 0.0, -30.0, 900.0] and meta["bounds"] == [500.0, 0.0, 860.0, 900.0]
    part, meta = R.load_cube(spark, path, bands=[3, 0], window=(5, 2, 9, 40))
    assert pixels(part) == {k: [v[3], v[0]] for k, v in whole(a).items() if 5 <= k[0] < 9 and k[1] >= 2} and meta["bands"] == 2
    with pytest.raises(ValueError):
        X.read_tiff(b"nothing")
    both = X.scene_pixels(spark, str(tmp_path))
    assert both.count() == 360 and {r[0] for r in both.select("scene_id").distinct().collect()} == {"scene.tif"}


def mat(arrays, order="<", packed=False):
    """A MATLAB level 5 file."""
    codes = {"f8": (6, 9), "f4": (7, 7), "u2": (11, 4), "u1": (9, 2)}
    element = lambda kind, body: struct.pack(order + "II", kind, len(body)) + body + b"\0" * (-len(body) % 8)
    out = b"MATLAB 5.0".ljust(124, b" ") + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, a in arrays.items():
        cls, kind = codes[a.dtype.str[1:]]
        small = struct.pack(order + "HH" if order == "<" else order + "HH", *((1, len(name)) if order == "<" else (len(name), 1))) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack(order + "II", cls, 0)) + element(5, np.array(a.shape, order + "i4").tobytes()) + small + element(kind, a.astype(a.dtype.newbyteorder(order)).tobytes(order="F"))
        one = element(14, body)
        out += struct.pack(order + "II", 15, len(zlib.compress(one))) + zlib.compress(one) if packed else one
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_matlab(spark, tmp_path, order, packed):
    a = np.random.default_rng(4).integers(0, 999, (5, 6, 7)).astype("u2")
    (tmp_path / "s.mat").write_bytes(mat({"gt": np.ones((5, 6), "u1"), "indian_pines": a, "wl": np.arange(7, dtype="f8")}, order, packed))
    cube, meta = R.load_cube(spark, str(tmp_path / "s.mat"))
    assert pixels(cube) == whole(a) and meta["data_key"] == "indian_pines" and meta["wavelengths"] == list(range(7))


def netcdf(dims, variables, attributes):
    """A classic file; a dimension of length 0 is the record dimension with two records."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">I", len(s)) + pad(s.encode())
    atts = lambda d: struct.pack(">II", 12 if d else 0, len(d)) + b"".join(name(k) + struct.pack(">II", 2, len(v)) + pad(v.encode()) for k, v in d.items())
    codes = {"f4": 5, "f8": 6, "i2": 3}
    ids = {n: i for i, (n, _) in enumerate(dims)}
    fixed = [(n, d, a) for n, d, a in variables if not d or dict(dims)[d[0]]]
    record = [(n, d, a) for n, d, a in variables if d and not dict(dims)[d[0]]]

    def build(begins):
        head = b"CDF\x01" + struct.pack(">I", 2) + struct.pack(">II", 10, len(dims)) + b"".join(name(n) + struct.pack(">I", k) for n, k in dims) + atts(attributes)
        head += struct.pack(">II", 11, len(variables))
        for n, d, a in variables:
            size = len(pad((a[0] if (n, d) in [(x, y) for x, y, _ in record] else a).tobytes()))
            head += name(n) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", ids[x]) for x in d) + atts({}) + struct.pack(">III", codes[a.dtype.str[1:]], size, begins.get(n, 0))
        return head

    at, begins = len(build({})), {}
    body = b""
    for n, _, a in fixed:
        begins[n] = at + len(body)
        body += pad(a.astype(a.dtype.newbyteorder(">")).tobytes())
    for i in range(2 if record else 0):
        for n, _, a in record:
            begins.setdefault(n, at + len(body))
            body += pad(np.asarray(a[i], a.dtype.newbyteorder(">")).tobytes())
    return build(begins) + body


def test_netcdf(spark, tmp_path):
    a = np.random.default_rng(5).random((3, 4, 5)).astype("f4")
    (tmp_path / "s.nc").write_bytes(netcdf([("band", 3), ("y", 4), ("x", 5)], [("wavelength", ("band",), np.array([1.0, 2.0, 3.0])), ("reflectance", ("band", "y", "x"), a)], {"title": "made here"}))
    cube, meta = R.load_cube(spark, str(tmp_path / "s.nc"))
    assert pixels(cube) == whole(np.moveaxis(a, 0, -1)) and meta["wavelengths"] == [1.0, 2.0, 3.0] and meta["title"] == "made here"
    b = np.arange(2 * 3 * 5).reshape(2, 3, 5).astype("i2")
    got, _ = X.netcdf_variables(netcdf([("time", 0), ("y", 3), ("x", 5)], [("data", ("time", "y", "x"), b), ("t", ("time",), np.array([7.0, 9.0]))], {}))
    assert (got["data"][1] == b).all() and got["t"][1].tolist() == [7.0, 9.0]


def test_npz(spark, tmp_path):
    a = np.random.default_rng(6).random((3, 4, 2))
    np.savez(tmp_path / "s.npz", other=np.ones((9, 9, 9)), data=a, wavelengths=np.array([1.0, 2.0]))
    cube, meta = R.load_cube(spark, str(tmp_path / "s.npz"))
    assert pixels(cube) == whole(a) and meta["wavelengths"] == [1.0, 2.0]
    m = spark.createDataFrame([(0, 0, 1), (2, 1, 5)], "row long, col long, cls long")
    W.save_npz(m, str(tmp_path / "m.npz"))
    with np.load(tmp_path / "m.npz") as z:
        assert z["classification"].tolist() == [[1, 0], [0, 0], [0, 5]]


def shapefile(polygons):
    shp, dbf = b"", b""
    for i, rings in enumerate(polygons, 1):
        points = [p for r in rings for p in r]
        starts = np.cumsum([0] + [len(r) for r in rings])[:-1]
        body = struct.pack("<I", 5) + struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<II", len(rings), len(points)) + struct.pack(f"<{len(rings)}I", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        shp += struct.pack(">II", i, len(body) // 2) + body
        dbf += b" " + str(i + 4).rjust(6).encode()
    field = b"CLASS".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    return b"\0" * 100 + shp, b"\x03\0\0\0" + struct.pack("<IHH", len(polygons), 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\r" + dbf


def inside(x, y, rings):
    """Even-odd rule by crossings to the right."""
    hit = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
    return hit


def test_polygons_and_points(spark, tmp_path):
    hole = [[(1.2, 1.1), (11.7, 2.3), (10.2, 13.9), (0.6, 9.4)], [(4.1, 4.2), (7.3, 4.9), (6.2, 8.8)]]
    other = [[(13.5, 1.5), (18.25, 6.5), (13.5, 12.75)]]
    shp, dbf = shapefile([hole, other])
    (tmp_path / "p.shp").write_bytes(shp)
    (tmp_path / "p.dbf").write_bytes(dbf)
    want = {(k, r, c) for k, rings in ((5, hole), (6, other)) for r in range(20) for c in range(16) if inside(c, r, rings)}
    got = {(x["class_id"], x["row"], x["col"]) for x in X.pixels_inside(R.load_shapes(spark, str(tmp_path / "p.shp")), 20, 16).collect()}
    assert got == want and len(got) > 60
    moved = X.pixels_inside(R.load_shapes(spark, str(tmp_path / "p.shp")), 20, 16, [1.0, 0.0, 2.0, 0.0, -1.0, 15.0])
    up = {(k, r, c) for k, rings in ((5, hole), (6, other)) for r in range(20) for c in range(16) if inside(c, r, [[(x - 2, 15 - y) for x, y in ring] for ring in rings])}
    assert {(x["class_id"], x["row"], x["col"]) for x in moved.collect()} == up
    collection = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": hole}, "properties": {"class_id": "5"}}, {"geometry": {"type": "MultiPolygon", "coordinates": [other]}, "properties": {"label": "6"}}, {"geometry": {"type": "Point", "coordinates": [3.5, 2.5]}, "properties": {"class": "7"}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(collection))
    g = X.pixels_inside(R.load_shapes(spark, str(tmp_path / "p.geojson")), 20, 16)
    assert {(x["class_id"], x["row"], x["col"]) for x in g.collect()} == want | {(7, 2, 3)}
    (tmp_path / "p.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>reed</name><ExtendedData><Data name="class"><value>3</value></Data></ExtendedData><Point><coordinates>4.5,5.5,0</coordinates></Point></Placemark></Document></kml>')
    assert R.load_samples(spark, str(tmp_path / "p.kml")).collect() == [(4.5, 5.5, 3, "reed")]
    assert R.load_samples(spark, str(tmp_path / "p.shp")).count() == 0


def test_workbook_and_document(spark):
    t = spark.createDataFrame([("a<b", 1.5, None), (None, 2.0, 3)], "name string, v double, n int")
    with zipfile.ZipFile(io.BytesIO(W.spreadsheet({"first": t, "second": t.select(F.sum("v").alias("s"))}))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b" in sheet and "<v>1.5</v>" in sheet and 'name="second"' in z.read("xl/workbook.xml").decode()
    pdf = W.pdf_report("A (title)", [f"line {i}" for i in range(120)])
    at = int(pdf.rsplit(b"startxref", 1)[1].split()[0])
    places = [int(x[:10]) for x in pdf[at:].split(b"\n")[3:-6]]
    assert pdf.startswith(b"%PDF-1.4") and pdf[at:].startswith(b"xref") and pdf.count(b"/Type /Page ") == 3
    assert all(pdf[p:].startswith(f"{i} 0 obj".encode()) for i, p in enumerate(places, 1))
