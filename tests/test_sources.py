"""Sources and sinks beside their queries: errors, file formats, metadata, plans."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geotide import scratch
from geotide.model import Frame, Grid, NoRasterForTime, QueryError, Rect, Unit
from geotide.operators import rasters
from geotide.plans.tree import Node, Run, run_query
from geotide.queries_io import ask
from geotide.sources import raster as store, tiff, vector

PIXELS = "t1 double, t2 double, px long, py long, value double"


def test_ragged_and_broken_lines(spark):
    folder = scratch.folder(spark)
    scratch.put(f"{folder}/ragged.csv", b"x,y,a\n1,2,3\n4,5\n")
    read = lambda name, **p: ask(spark, {"type": "csv_source", "params": {"filename": f"{folder}/{name}.csv", "columns": {"textual": ["a"]}} | p}).df.collect()
    with pytest.raises(PySparkException):
        read("ragged", on_error="keep")
    scratch.put(f"{folder}/long.csv", b"x,y,a\n1,2,3,4\n")
    with pytest.raises(PySparkException):
        read("long")
    scratch.put(f"{folder}/lines.csv", b'x,y,a\n1,2,"q\nr"\n\n3,4,"s,""t"""\n')
    assert [r["a"] for r in read("lines")] == ["q\nr", 's,"t"']
    with pytest.raises(QueryError):
        read("lines", columns={"textual": ["none"]})
    with pytest.raises(PySparkException):
        ask(spark, {"type": "csv_source", "params": {"filename": "data:text/plain,x,y%0Aone,2%0A"}}).df.collect()
    with pytest.raises(QueryError):
        ask(spark, {"type": "csv_source", "params": {"filename": "data:text/plain;base64,eCx5"}})


def test_text_in_wkt_by_columns(spark):
    good = ["POINT(1 2)", "MULTIPOINT((1 2),(3 4))", "MULTIPOINT (1 2, 3 4)", "LINESTRING(0 0,1e1 -1.5E-1)", "POLYGON((0 0,1 0,1 1,0 0),(0 0,1 0,1 1,0 0))", "multipolygon(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "POLYGON EMPTY"]
    bad = ["POINT(1)", "POINT(1 2 3)", "POLYGON((0 0,1 0,1 1))", "LINESTRING(0 0", "CIRCLE(1 1)", "POINT(a b)", "", None, "LINESTRING((0 0,1 1))", "POLYGON(0 0,1 0,1 1,0 0)"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", vector._wkt(F.col("t")).alias("g")).collect()
    from geotide.functions.geometry import parse_wkt

    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else tuple(v)
    for r in rows:
        if r["t"] in good:
            kind, geom = parse_wkt(r["t"])
            assert r["g"]["kind"] == kind and (r["t"].endswith("EMPTY") or plain(r["g"][kind]) == plain([list(g) if isinstance(g, list) else g for g in geom])), r["t"]
        else:
            assert r["g"]["kind"] is None, r["t"]


def _tiff(values: np.ndarray, *, tile: int = 0, predictor: int = 1, compression: int = 8, big: bool = False) -> bytes:
    order, (h, w) = ">" if big else "<", values.shape
    kind, bits = {"u1": (1, 8), "i2": (2, 16), "f4": (3, 32)}[values.dtype.str[1:]]
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), values.dtype)
        padded[:h, :w] = values
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [values[y : y + 3] for y in range(0, h, 3)]
    if predictor == 2:
        parts = [np.concatenate((p[:, :1], np.diff(p, axis=1)), axis=1).astype(p.dtype) for p in parts]
    pack = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))}[compression]
    strips = [pack(p.astype(p.dtype.newbyteorder(order)).tobytes()) for p in parts]
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s)
    n = len(strips)
    body = b"".join(strips) + struct.pack(f"{order}{2 * n}I", *places, *map(len, strips))
    one = (places[0], len(strips[0])) if n == 1 else (at, at + 4 * n)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, compression)]
    tags += [] if tile else [(273, 4, n, one[0])]
    tags += [(277, 3, 1, 1)] + ([] if tile else [(278, 4, 1, 3), (279, 4, n, one[1])]) + [(317, 3, 1, predictor)]
    tags += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, one[0]), (325, 4, n, one[1])] if tile else []
    tags += [(339, 3, 1, kind)]
    entries = b"".join(struct.pack(order + "HHI", t, k, c) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, c, v in tags)
    return (b"MM\0*" if big else b"II*\0") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4)


def test_kinds_of_tiff():
    rs = np.random.RandomState(1)
    for dtype, how in (("u1", {}), ("u1", {"tile": 16, "predictor": 2}), ("i2", {"big": True, "compression": 1}), ("f4", {"tile": 16}), ("u1", {"compression": 32773})):
        values = (rs.rand(20, 37) * 200 - (0 if dtype == "u1" else 100)).astype(dtype)
        got = np.zeros(values.shape)
        for x, y, part in tiff.blocks(_tiff(values, **how), 0):
            got[y : y + part.shape[0], x : x + part.shape[1]] = part
        assert np.array_equal(got, values.astype(float)), (dtype, how)
    with pytest.raises(QueryError):
        list(tiff.blocks(b"PNG", 0))
    # Codes 256 65 66 258 260 257: a table entry may name itself.
    codes = [256, 65, 66, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff._lzw(bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))) == b"ABABABA"


def test_raster_store(spark):
    folder, grid = scratch.folder(spark), Grid(0, 0, 16, 8, 16, 8)
    unit = Unit("raw", "unknown", 0.0, 10.0)
    store.create(spark, folder, "s", store.Description(grid, [store.Channel("Byte", unit, store.Transform(2.0, "off"))]))
    rows = [(float(t), t + 10.0, x, y, float(x + y + t)) for t in (0, 10, 30) for x in range(16) for y in range(8)]
    store.store(spark, spark.createDataFrame(rows, PIXELS), folder, "s", 0, attributes={"off": "1.5"}, levels=2)
    r = store.read(spark, folder, "s", 0, Rect(0, 0, 16, 8, 12.0, 13.0))
    assert (r.unit.min, r.unit.max, r.datatype, r.attributes) == (1.5, 21.5, "Byte", {"off": "1.5"}) and r.df.count() == 128
    assert {tuple(x) for x in r.df.filter("px = 3 and py = 4").collect()} == {(10.0, 20.0, 3, 4, 17 * 2 + 1.5)}
    plain = store.read(spark, folder, "s", 0, Rect(2, 2, 3.5, 3.5, 35.0, 36.0), transform=False)
    assert sorted((x["px"], x["py"], x["value"]) for x in plain.df.collect()) == [(2, 2, 34.0), (2, 3, 35.0), (3, 2, 35.0), (3, 3, 36.0)]
    plan = plain.df._jdf.queryExecution().executedPlan().toString()
    assert "t1#" in plan and "PartitionFilters" in plan and "PushedFilters: [IsNotNull(px)" in plan.replace("PushedFilters: [IsNotNull(py)", "PushedFilters: [IsNotNull(px)")
    half = store.read(spark, folder, "s", 0, Rect(0, 0, 16, 8, 0.0, 1.0, width=8, height=4), transform=False)
    assert half.grid == Grid(0, 0, 16, 8, 8, 4) and half.df.count() == 32
    for rect in (Rect(0, 0, 16, 8, 22.0, 23.0), Rect(0, 0, 16, 8, -5.0, -4.0)):
        with pytest.raises(NoRasterForTime):
            store.read(spark, folder, "s", 0, rect)
    with pytest.raises(QueryError):
        store.read(spark, folder, "none", 0, Rect(0, 0, 1, 1))
    with pytest.raises(QueryError):  # no raw image
        tree = {"type": "meteosat_radiance", "sources": {"raster": [{"type": "table_source", "params": {"name": "r"}}]}}
        ask(spark, tree, tables={"r": lambda s, q: Frame(s.createDataFrame(rows, PIXELS), "raster", q, grid=grid)})


def test_matrix_equals_brute_force(spark):
    rs = np.random.RandomState(3)
    grid, image, kernel = Grid(0, 0, 1, 1, 21, 13), rs.randint(0, 9, (13, 21)).astype(float), rs.randint(-3, 4, (5, 5))
    image[4, 7] = np.nan
    rows = [(0.0, 1.0, int(x), int(y), float(image[y, x])) for y in range(13) for x in range(21)]
    out = {(r["px"], r["py"]): r["value"] for r in rasters.matrix(spark.createDataFrame(rows, PIXELS), grid, kernel.ravel().tolist(), 5, tile=6).collect()}
    padded = np.pad(image, 2, mode="edge")
    want = {(x, y): (padded[y : y + 5, x : x + 5] * kernel).sum() for y in range(13) for x in range(21)}
    assert out == {k: v for k, v in want.items() if v == v}


def test_trees(spark):
    tree = {"type": "csv_source", "params": {"filename": "data:text/plain,x,y%0A1,2%0A", "provenance": {"local_identifier": "data.a"}}}
    run = Run(spark)
    frame = run.build(Node.of(tree), Rect(0, 0, 9, 9))
    assert run.provenance(frame) == [{"local_identifier": "data.a"}]
    with pytest.raises(QueryError):
        run.permitted(frame, set())
    assert Node.of(json.dumps(tree)).semantic_id == Node.of(dict(reversed(tree.items()))).semantic_id
    for bad in ({"type": "none"}, {"type": "difference", "sources": {"points": [tree]}}):
        with pytest.raises(QueryError):
            run_query(run, {"query": bad, "spatial_reference": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}})
