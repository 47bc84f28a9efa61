"""Queries of the sources and sinks: what is written from the driver's tables is read back by query trees."""

from __future__ import annotations

import glob
import io
import json
import os
import struct
import tempfile
import zipfile
import zlib

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import scratch
from .functions.geometry import parse_wkt
from .functions.timeops import parse, raster_valid, snap, snap_raster, to_datetime
from .model import EOT, Frame, Grid, Rect, Unit
from .operators import plots
from .plans.tree import Run, registered, run_query
from .queries import DAY, P, POLYGONS, R, T, _flat, flat, points, polygons, query, series, timed
from .sources import export, raster as store, shapefile, vector

BOX = {"x1": -60, "y1": -30, "x2": 90.5, "y2": 60}
WORLD = {"x1": -180, "y1": -90, "x2": 180, "y2": 90}
_IN_BOX = "x BETWEEN -60 AND 90.5 AND y BETWEEN -30 AND 60"


def ask(spark: SparkSession, tree: dict, box: dict = WORLD, time: tuple[float, float] | None = None, size: tuple[int, int] | None = None, **run) -> Frame:
    query_ = {"query": tree, "spatial_reference": box}
    if time:
        query_["temporal_reference"] = {"start": time[0], "end": time[1]}
    if size:
        query_["resolution"] = {"type": "pixels", "x": size[0], "y": size[1]}
    return run_query(Run(spark, **run), query_)


def values(*rows: tuple) -> str:
    """Literal rows in SQL."""
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def written(df: DataFrame, sep: str = ",") -> str:
    """A folder of delimited files of the rows, with headers."""
    path = f"{scratch.folder(df.sparkSession)}/table.csv"
    df.write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


# Delimited text.


@query(f"WITH {P} SELECT x, y, num, txt FROM p WHERE {_IN_BOX}")
def csv_source(spark, d):
    path = written(points(spark, d), ";")
    params = {"filename": path, "separator": ";", "columns": {"x": "x", "y": "y", "numeric": ["num"], "textual": ["txt"]}}
    return ask(spark, {"type": "csv_source", "params": params}, BOX).df


def _events_file(spark: SparkSession, d: str) -> str:
    e = timed(spark, d).selectExpr("x", "y", "id", "date_format(timestamp_seconds(floor(t1)), \"yyyy-MM-dd'T'HH:mm:ss\") as begin", "date_format(timestamp_seconds(floor(t1) + 3600), 'dd.MM.yy HH:mm') as stop", "cast(id % 7200 + 1 as string) as lasts", "txt")
    return written(e)


_WHOLE = f"WITH {T}, w AS (SELECT *, floor(t1) AS a FROM e)"
SPAN = (1704844800.0, 1706745600.0)


def _events(spark: SparkSession, d: str, **params) -> DataFrame:
    columns = {"x": "x", "y": "y", "time1": "begin", "numeric": ["id"]} | params.pop("columns", {})
    return ask(spark, {"type": "csv_source", "params": {"filename": _events_file(spark, d), "columns": columns, "time1_format": {"format": "iso"}} | params}, BOX, SPAN).df


@query(f"{_WHOLE} SELECT x, y, a AS t1, {EOT}::DOUBLE AS t2, id::DOUBLE AS id FROM w WHERE {_IN_BOX} AND a < {SPAN[1]}")
def csv_source_time_start(spark, d):
    return _events(spark, d, time="start", duration="inf")


@query(f"{_WHOLE} SELECT x, y, a AS t1, a + id % 7200 + 1 AS t2, id::DOUBLE AS id FROM w WHERE {_IN_BOX} AND a < {SPAN[1]} AND a + id % 7200 + 1 > {SPAN[0]}")
def csv_source_time_duration(spark, d):
    return _events(spark, d, time="start+duration", columns={"time2": "lasts"})


@query(f"{_WHOLE}, u AS (SELECT *, floor((a + 3600) / 60) * 60 AS b FROM w) SELECT x, y, a AS t1, b AS t2, id::DOUBLE AS id FROM u WHERE {_IN_BOX} AND a < {SPAN[1]} AND b > {SPAN[0]}")
def csv_source_time_end_custom(spark, d):
    return _events(spark, d, time="start+end", columns={"time2": "stop"}, time2_format={"format": "custom", "custom_format": "%d.%m.%y %H:%M"})


def _inline(spark: SparkSession, text: str, **params) -> DataFrame:
    return ask(spark, {"type": "csv_source", "params": {"filename": f"data:text/plain,{text}", "columns": {"x": "x", "y": "y", "numeric": ["a"], "textual": ["b"]}} | params}).df


_ERRORS = "x,y,a,b%0A0,0,1,2%0A0,0,asdf,qwert%0Aone,2,3,4%0A,5,6,7%0A8,9,,\"q,\"\"%0A\"\"r\"%0A"


@query(f"SELECT * FROM ({values((0.0, 0.0, 1.0, '2'))}) t(x, y, a, b)")
def csv_source_errors_skip(spark, d):
    return _inline(spark, _ERRORS, on_error="skip")


@query(f"SELECT x, y, a, replace(b, '/', chr(10)) AS b FROM ({values((0.0, 0.0, 1.0, '2'), (0.0, 0.0, 'nan', 'qwert'), (8.0, 9.0, 'nan', 'q,"/"r'))}) t(x, y, a, b)".replace("'nan'", "'nan'::DOUBLE"))
def csv_source_errors_keep(spark, d):
    return _inline(spark, _ERRORS, on_error="keep")


@query(f"WITH {P} SELECT x, y, txt || chr(10) || '\"' || id || '\", ' || txt AS name FROM p WHERE {_IN_BOX}")
def csv_source_quoted_lines(spark, d):
    path = written(points(spark, d).selectExpr("x", "y", "concat(txt, '\n', '\"', id, '\", ', txt) as name"))
    return ask(spark, {"type": "csv_source", "params": {"filename": path, "columns": {"textual": ["name"]}}}, BOX).df


def _wkt_polygons() -> str:
    rows = []
    for pid, w, a, b in POLYGONS:
        flat_ = w.replace("POLYGON", "POLYGON ")
        rows.append(f"({pid}, '{flat_}', {a}::DOUBLE, {b}::DOUBLE)")
    return ", ".join(rows)


def _edges(name: str) -> str:
    """Points of each polygon in order: id, poly, ring, place, x, y."""
    rows = [f"({i}, {p}, {r}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for i, w, _, _ in POLYGONS for p, poly in enumerate(parse_wkt(w)[1]) for r, ring in enumerate(poly) for k, (x, y) in enumerate(ring)]
    return f"{name}(id, poly, ring, place, x, y) AS (VALUES {', '.join(rows)})"


def corners(df: DataFrame, key: str = "id") -> DataFrame:
    out = df.select(F.col(key).cast("int").alias("id"), F.posexplode("geom").alias("poly", "_p")).select("id", "poly", F.posexplode("_p").alias("ring", "_r"))
    return out.select("id", "poly", "ring", F.posexplode("_r").alias("place", "_q")).select("id", "poly", "ring", "place", "_q.x", "_q.y")


@query(f"WITH {_edges('c')} SELECT * FROM c WHERE id <> 3")
def csv_source_wkt_polygons(spark, d):
    rows = [(w.replace(",", " , ") if i == 2 else w.lower(), str(i)) for i, w, _, _ in POLYGONS] + [("POLYGON((0 0, 1 1, 0 0))", "9"), ("POLYGON((0 0, 1 1", "9"), ("POINT(1 1)", "9"), ("nonsense", "9")]
    path = written(spark.createDataFrame(rows, "shape string, id string"))
    params = {"filename": path, "geometry": "wkt", "type": "polygons", "on_error": "skip", "columns": {"x": "shape", "numeric": ["id"]}}
    return corners(ask(spark, {"type": "csv_source", "params": params}, {"x1": 0, "y1": 0, "x2": 50, "y2": 50}).df.filter("id <> 3"))


@query(f"SELECT * FROM ({values((0.0, 0.0), (12.0, 12.0), (3.0, 4.0), (5.0, 5.0), (-1.5, 0.25))}) t(x, y)")
def csv_source_wkt_points(spark, d):
    rows = [("POINT(0 0)",), (" point ( 12  12 ) ",), ("MULTIPOINT((3 4), (5 5))",), ("MULTIPOINT(-1.5 .25, 500 500)",), ("POINT(1 2, 3 4)",), ("POINT EMPTY",)]
    path = written(spark.createDataFrame(rows, "g string"))
    return ask(spark, {"type": "csv_source", "params": {"filename": path, "geometry": "wkt", "on_error": "skip", "columns": {"x": "g"}}}).df


# Well-known text.


@query(f"SELECT * FROM ({values((0.0, 0.0), (12.0, 12.0), (3.0, 4.0), (5.0, 5.0))}) t(x, y)")
def wkt_source_points(spark, d):
    return ask(spark, {"type": "wkt_source", "params": {"type": "points", "wkt": "GEOMETRYCOLLECTION(POINT(0 0), POINT(12 12), MULTIPOINT((3 4), (5 5)))"}}).df.select("x", "y")


@query(f"SELECT * FROM ({values((0, 1, 3, 'LINESTRING(0.0 0.0,1.0 1.0,2.0 1.0)'), (1, 2, 3, 'MULTILINESTRING((12.0 12.0,12.0 11.0,15.0 12.0),(2.0 2.0,2.0 1.0,5.0 2.0))'))}) t(id, parts, first, wkt)")
def wkt_source_lines(spark, d):
    text = "GEOMETRYCOLLECTION(LINESTRING(0 0, 1 1 ,2 1), MULTILINESTRING((12 12, 12 11, 15 12), (2 2, 2 1, 5 2)), LINESTRING(100 50, 101 51))"
    f = ask(spark, {"type": "wkt_source", "params": {"type": "lines", "wkt": text}}, {"x1": 0, "y1": 0, "x2": 20, "y2": 20})
    return f.df.select(F.col("id").cast("int").alias("id"), F.size("geom").alias("parts"), F.size(F.col("geom")[0]).alias("first"), export.wkt(F.col("geom"), "lines").alias("wkt"))


@query(f"SELECT * FROM ({values((1, 725846400.0, 820454400.0))}) t(id, t1, t2)")
def wkt_source_polygons_time(spark, d):
    text = f"GEOMETRYCOLLECTION({', '.join(w for _, w, _, _ in POLYGONS)})"
    params = {"type": "polygons", "wkt": text, "time": [[a, b] for _, _, a, b in POLYGONS]}
    f = ask(spark, {"type": "wkt_source", "params": params}, {"x1": 30, "y1": 36, "x2": 36, "y2": 41}, (800000000.0, 810000000.0))
    return f.df.select(F.col("id").cast("int").alias("id"), "t1", "t2").filter("id < 2")


# Files of features.

_TOUCH = (1705000000.0, 1705600000.0)


def _geojson(spark: SparkSession, d: str) -> str:
    path = f"{scratch.folder(spark)}/events.geojson"
    e = timed(spark, d).filter("id % 10 = 0").withColumns({"t1": F.floor("t1").cast("double"), "t2": F.floor("t1").cast("double") + 3600})
    scratch.put(path, export.geojson(e.withColumn("num", F.when(F.col("id") % 20 == 0, F.col("num"))).withColumn("id", F.col("id").cast("double")), "points").encode())
    return path


_OGR = f"WITH {T}, w AS (SELECT x, y, floor(t1) AS t1, floor(t1) + 3600 AS t2, id::DOUBLE AS id, CASE WHEN id % 20 = 0 THEN num ELSE 0 END AS num, txt FROM e WHERE id % 10 = 0)"


@query(f"{_OGR} SELECT * FROM w WHERE {_IN_BOX} AND t1 <= {_TOUCH[1]} AND t2 >= {_TOUCH[0]}")
def ogr_raw_source_geojson(spark, d):
    """Numbers that are missing become 0 on keep; times include their ends."""
    columns = {"time1": "time_start", "time2": "time_end", "numeric": ["id", "num"], "textual": ["txt"]}
    iso = {"format": "iso"}
    params = {"filename": _geojson(spark, d), "type": "points", "columns": columns, "time": "start+end", "time1_format": iso, "time2_format": iso, "on_error": "keep"}
    return ask(spark, {"type": "ogr_raw_source", "params": params}, BOX, _TOUCH).df


@query(f"{_OGR} SELECT x, y, id FROM w WHERE {_IN_BOX}")
def ogr_source(spark, d):
    """By a dataset's description, whose layer gives the columns."""
    path = _geojson(spark, d)
    folder = path.rsplit("/", 1)[0]
    scratch.put(f"{folder}/events.json", json.dumps({"filename": path, "on_error": "skip", "type": "lines", "layers": {"all": {"type": "points"}}}).encode())
    return ask(spark, {"type": "ogr_source", "params": {"name": "events", "layer_name": "all", "numeric": ["id"]}}, BOX, folder=folder).df


def write_shapes(path: str, rows: list[tuple[list, dict[str, str]]], kind: int) -> None:
    """A small shapefile of points (kind 1, one pair each) or polygons (kind 5, rings) with text attributes."""
    body, names = b"", list(rows[0][1])
    for k, (shape, _) in enumerate(rows):
        if kind == 1:
            record = struct.pack("<i2d", 1, *shape)
        else:
            flat_, first = [p for r in shape for p in r], [sum(map(len, shape[:n])) for n in range(len(shape))]
            xs, ys = [p[0] for p in flat_], [p[1] for p in flat_]
            record = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(shape), len(flat_)) + struct.pack(f"<{len(first)}i", *first) + b"".join(struct.pack("<2d", *p) for p in flat_)
        body += struct.pack(">2i", k + 1, len(record) // 2) + record
    scratch.put(path, struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body)
    width = 32
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([width]) + bytes(15) for n in names) + b"\r"
    table = b"".join(b" " + b"".join(r[n].encode().ljust(width) for n in names) for _, r in rows)
    scratch.put(path[:-4] + ".dbf", struct.pack("<B3BIHH20x", 3, 0, 1, 1, len(rows), 32 + len(head), 1 + width * len(names)) + head + table)


_NATIONS = "SELECT ((n_nationkey * 37) % 360)::DOUBLE - 180 AS x, ((n_nationkey * 53) % 180)::DOUBLE - 90 AS y, n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation"


@query(f"WITH n AS ({_NATIONS}) SELECT * FROM n WHERE x >= -90")
def ogr_raw_source_shapefile(spark, d):
    path = f"{scratch.folder(spark)}/nations.shp"
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").collect()  # 25 nations
    write_shapes(path, [(((r[0] * 37) % 360 - 180.0, (r[0] * 53) % 180 - 90.0), {"n_nationkey": str(r[0]), "n_name": r[1]}) for r in rows], 1)
    params = {"filename": path, "type": "points", "columns": {"numeric": ["n_nationkey"], "textual": ["n_name"]}}
    return ask(spark, {"type": "ogr_raw_source", "params": params}, WORLD | {"x1": -90}).df


@query(f"WITH {_edges('c')} SELECT * FROM c WHERE id = 2")
def ogr_raw_source_shapefile_polygons(spark, d):
    path = f"{scratch.folder(spark)}/shapes.shp"
    turned = lambda r, k: shapefile._clockwise(r) != (k == 0)  # noqa: E731  (shells stand clockwise in the file, holes do not)
    given = [parse_wkt(w)[1][0] for _, w, _, _ in POLYGONS[:2]]
    write_shapes(path, [([r[::-1] if turned(r, k) else r for k, r in enumerate(rings)], {"id": str(i + 1)}) for i, rings in enumerate(given)], 5)
    params = {"filename": path, "type": "polygons", "columns": {"numeric": ["id"]}}
    read = ask(spark, {"type": "ogr_raw_source", "params": params}, {"x1": 30, "y1": 10, "x2": 50, "y2": 50}).df.filter("id = 2")
    back = [turned(r, k) for k, r in enumerate(given[1])]
    return corners(read.withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r, k: F.when(F.array(*map(F.lit, back))[k], F.reverse(r)).otherwise(r)))))


# Databases.


@query(f"WITH {T} SELECT x, y, t1, t2, num, txt, id FROM e WHERE {_IN_BOX} AND t1 < {SPAN[1]} AND t2 > {SPAN[0]}")
def featurecollectiondb_source(spark, d):
    folder = scratch.folder(spark)
    vector.store(timed(spark, d), folder, "me", "events", "points")
    return ask(spark, {"type": "featurecollectiondb_source", "params": {"owner": "me", "data_set_name": "events"}}, BOX, SPAN, folder=folder).df.select("x", "y", "t1", "t2", "num", "txt", "id")


@query(f"WITH {_edges('c')} SELECT * FROM c WHERE id = 1")
def featurecollectiondb_source_polygons(spark, d):
    folder = scratch.folder(spark)
    vector.store(polygons(spark), folder, "me", "areas", "polygons")
    return corners(ask(spark, {"type": "featurecollectiondb_source", "params": {"owner": "me", "data_set_name": "areas"}}, {"x1": -100, "y1": 60, "x2": 0, "y2": 80}, folder=folder).df)


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_DERBY_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}


def database(spark: SparkSession, df: DataFrame, name: str) -> str:
    """The URL of a database with ``df`` as its only table, which driver and executors read alike.

    The driver builds it from rows that a task has written, with one bulk import, and packs it into the shared folder; a
    packed database is open to any number of processes, which an embedded one is not. The folder must be mounted."""
    jvm, (files, at) = spark.sparkContext._jvm, fs.FileSystem.from_uri(scratch.folder(spark))
    if not isinstance(files, fs.LocalFileSystem):
        raise RuntimeError("the database for JDBC needs a shared folder that is mounted")
    df.coalesce(1).write.csv(f"file://{at}/rows")
    with tempfile.TemporaryDirectory() as own:
        url = f"jdbc:derby:{own}/db"
        link = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{url};create=true", jvm.java.util.Properties())
        columns = ", ".join(f'"{c}" {_DERBY_TYPES[kind]}' for c, kind in df.dtypes)
        link.createStatement().execute(f"CREATE TABLE {name} ({columns})")
        for part in sorted(glob.glob(f"{at}/rows/*.csv")):
            load = link.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
            load.setString(1, name)
            load.setString(2, part)
            load.execute()
            os.remove(part)
        link.close()
        try:
            jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{url};shutdown=true", jvm.java.util.Properties())
        except Py4JJavaError as e:  # how this database says that it has ended
            if e.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(f"{at}/db.jar", "w", zipfile.ZIP_STORED) as z:  # stored: pages are read by place
            for folder, _, names in os.walk(f"{own}/db"):
                for f in names:
                    z.write(f"{folder}/{f}", os.path.relpath(f"{folder}/{f}", own))
    return f"jdbc:derby:jar:({at}/db.jar)db"


@query(f"WITH {P} SELECT id, x, y, num FROM p WHERE {_IN_BOX}")
def postgres_source(spark, d):
    """A packed database in the shared folder stands for the server."""
    url = database(spark, points(spark, d).select("id", "x", "y", "num"), "PTS")
    asked = {"query": {"type": "postgres_source", "params": {"connection": {"url": url, "driver": _DERBY}, "query": '"id", "x", "y", "num" FROM PTS'}}, "spatial_reference": BOX | {"projection": "EPSG:3857"}}
    return run_query(Run(spark), asked).df


# Rasters.

GRID = Grid(-180, -90, 180, 90, 64, 32)
MONTH = 820454400.0  # 1996-01-01
_RAW = Unit("raw", "unknown", 0.0, 1023.0)


def stored(spark: SparkSession, d: str, levels: int = 3) -> str:
    """A folder with the monthly series as a source: plain, and as counts of a satellite whose calibration is an attribute."""
    folder = scratch.folder(spark)
    calibrated = store.Transform("msg.CalibrationSlope", "msg.CalibrationOffset", Unit("radiance", "unknown"), "Float32")
    store.create(spark, folder, "sales", store.Description(GRID, [store.Channel("Int16", Unit("sales", "pieces", 0.0, 50.0)), store.Channel("Int16", _RAW), store.Channel("Int16", _RAW, calibrated)]))
    s = series(spark, d)
    store.store(spark, s.select("t1", "t2", "px", "py", "value"), folder, "sales", 0, levels=levels)
    counts = s.select("t1", "t2", "px", "py", F.floor(F.col("price") % 900 + 100).alias("value"))
    attributes = {"msg.Satellite": "9", "msg.Channel": "9", "msg.CalibrationOffset": "-10.4568", "msg.CalibrationSlope": "0.205034"}
    for channel in (1, 2):
        store.store(spark, counts, folder, "sales", channel, attributes=attributes, levels=1)
    return folder


def _db(channel: int = 0) -> dict:
    return {"type": "rasterdb_source", "params": {"sourcename": "sales", "channel": channel}}


_AT = f"t1 <= {MONTH} AND t2 > {MONTH}"


@query(f"WITH {R} SELECT t1, t2, px, py, value FROM r WHERE {_AT}")
def rasterdb_source(spark, d):
    return ask(spark, _db(), time=(MONTH, MONTH + DAY), folder=stored(spark, d)).df


@query(f"WITH {R} SELECT t1, t2, px // 2 AS px, py // 2 AS py, value FROM r WHERE {_AT} AND px % 2 = 0 AND py % 2 = 0")
def rasterdb_source_half_resolution(spark, d):
    return ask(spark, _db(), time=(MONTH, MONTH + DAY), size=(32, 16), folder=stored(spark, d)).df


@query(f"WITH {R} SELECT t1, t2, px, py, floor(price % 900 + 100) * 0.205034 - 10.4568 AS value, -10.4568 AS lo, 1023 * 0.205034 - 10.4568 AS hi FROM r WHERE {_AT}".replace("-10.4568 AS lo", "-10.4568::DOUBLE AS lo").replace("1023 * 0.205034 - 10.4568 AS hi", "(1023::DOUBLE * 0.205034::DOUBLE + -10.4568::DOUBLE) AS hi").replace("* 0.205034 - 10.4568 AS value", "* 0.205034::DOUBLE + -10.4568::DOUBLE AS value"))
def rasterdb_source_transform(spark, d):
    f = ask(spark, _db(2), time=(MONTH, MONTH + DAY), folder=stored(spark, d))
    return f.df.withColumns({"lo": F.lit(f.unit.min), "hi": F.lit(f.unit.max)})


@query(f"WITH {R} SELECT 100::DOUBLE AS t1, 200::DOUBLE AS t2, px, py, value FROM r WHERE {_AT}")
def rasterdb_link(spark, d):
    folder = stored(spark, d)
    end = 823132800.0
    store.link(spark, folder, "sales", 0, (MONTH, end), (100.0, 200.0))
    return ask(spark, _db(), time=(150.0, 151.0), folder=folder).df


@query(f"WITH {R} SELECT px, py, round(-10.4568 + floor(price % 900 + 100) * 0.205034, 6) AS value, round(1023 * 0.205034 - 10.4568, 6)::DOUBLE AS hi FROM r WHERE {_AT}")
def meteosat_radiance_tree(spark, d):
    f = ask(spark, {"type": "meteosat_radiance", "sources": {"raster": [_db(1)]}}, time=(MONTH, MONTH + DAY), folder=stored(spark, d))
    return f.df.select("px", "py", F.round("value", 6).alias("value"), F.round(F.lit(f.unit.max), 6).alias("hi"))


@query(f"WITH {R} SELECT px, py, round((0.0143877523 * 100 * 931.700 / ln(1.19104273e-16 * 1e6 * 931.700 ** 3 / ((-10.4568 + floor(price % 900 + 100) * 0.205034) * 1e-5) + 1) - 0.6400) / 0.9983, 4) AS value FROM r WHERE {_AT}")
def meteosat_temperature_tree(spark, d):
    f = ask(spark, {"type": "meteosat_temperature", "sources": {"raster": [_db(1)]}}, time=(MONTH, MONTH + DAY), folder=stored(spark, d))
    return f.df.select("px", "py", F.round("value", 4).alias("value"))


@query(f"WITH {R} SELECT t1, t2, px, py, floor(value / 3) AS value FROM r WHERE {_AT}")
def expression_input_type(spark, d):
    """Whole-numbered input divides as whole numbers do, and the result is of the input's type."""
    tree = {"type": "expression", "params": {"datatype": "input", "expression": "A / 3"}, "sources": {"raster": [_db()]}}
    return ask(spark, tree, time=(MONTH, MONTH + DAY), folder=stored(spark, d)).df


def _files(spark: SparkSession, d: str) -> dict:
    """A file for each month of 1996, two bands."""
    folder = scratch.folder(spark)
    s = series(spark, d).filter((F.col("t1") >= MONTH) & (F.col("t1") < MONTH + 90 * DAY)).cache()
    for r in s.select("t1").distinct().collect():  # three months
        at = s.filter(F.col("t1") == r["t1"])
        bands = [at, at.withColumn("value", F.col("value") * 2)]
        scratch.put(f"{folder}/sales_{to_datetime(r['t1']):%Y-%m}.tiff", export.raster_tiff(bands, 64, 32, no_data=-1.0))
    s.unpersist()
    return {"path": f"{folder}/sales_%%%TIME_STRING%%%.tiff", "time_format": "%Y-%m", "interval": {"unit": "Month", "value": 1}, "start": MONTH, "end": MONTH + 366 * DAY, "no_data": -1.0, "extent": [-180, -90, 180, 90]}


@query(f"WITH {R} SELECT t1, t2, px, py, value FROM r WHERE t1 = {MONTH}")
def gdal_source(spark, d):
    """A moment within the month names its file."""
    return ask(spark, {"type": "gdal_source", "params": {"channel": 0, "gdal_params": _files(spark, d)}}, time=(MONTH + 20 * DAY, MONTH + 21 * DAY)).df


@query(f"WITH {R} SELECT t1, t2, x.range AS px, y.range AS py, value * 2 * 0.5 + 7 AS value FROM range(32) x, range(16) y JOIN r ON r.px = x.range * 2 + 1 AND r.py = y.range * 2 + 1 WHERE t1 = {MONTH + 31 * DAY}")
def gdal_source_channel_by_start(spark, d):
    """The channel is the number of starts so far; pixels are taken at the resolution asked for."""
    params = _files(spark, d) | {"channel_starts": [MONTH, MONTH + 31 * DAY], "scale": 0.5, "offset": 7.0}
    return ask(spark, {"type": "gdal_source", "params": {"gdal_params": params}}, time=(MONTH + 31 * DAY, MONTH + 32 * DAY), size=(32, 16)).df


# Units, counts, starts and moments of the raster time snap, with the snapped start and its end.
SNAPS = [
    ("Month", 1, "2000-01-01T00:00:00", "2000-11-11T11:11:11", "2000-11-01T00:00:00", "2000-12-01T00:00:00"),
    ("Month", 3, "2000-01-01T00:00:00", "2000-11-11T11:11:11", "2000-10-01T00:00:00", "2001-01-01T00:00:00"),
    ("Month", 7, "2000-01-01T00:00:00", "2001-01-01T11:11:11", "2000-08-01T00:00:00", "2001-03-01T00:00:00"),
    ("Year", 3, "2010-01-01T00:00:00", "2014-01-03T01:01:00", "2013-01-01T00:00:00", "2016-01-01T00:00:00"),
    ("Day", 16, "2018-01-01T00:00:00", "2018-02-16T01:00:00", "2018-02-02T00:00:00", "2018-02-18T00:00:00"),
    ("Hour", 13, "2010-01-01T00:00:00", "2010-01-02T04:00:00", "2010-01-02T02:00:00", "2010-01-02T15:00:00"),
    ("Minute", 31, "2010-01-01T00:00:00", "2010-01-01T01:01:00", "2010-01-01T00:31:00", "2010-01-01T01:02:00"),
    ("Second", 31, "2010-01-01T23:59:00", "2010-01-02T00:00:01", "2010-01-01T23:59:31", "2010-01-02T00:00:02"),
]


def _epoch(text: str) -> float:
    return parse(text, "iso")


@query("SELECT u, n, epoch(a::TIMESTAMP)::DOUBLE AS t1, epoch(b::TIMESTAMP)::DOUBLE AS t2 FROM (" + values(*[(u, n, a, b) for u, n, _, _, a, b in SNAPS]) + ") t(u, n, a, b)")
def raster_time_snap(spark, d):
    rows = [(u, n, *raster_valid(u, n, _epoch(s), EOT, _epoch(w))) for u, n, s, w, _, _ in SNAPS]
    assert all(snap_raster(u, n, _epoch(s), _epoch(w)) == _epoch(a) for u, n, s, w, a, _ in SNAPS)
    return spark.createDataFrame(rows, "u string, n int, t1 double, t2 double")


# Snap units with a number, whether smaller units are reset, a moment and the snapped one.
MOMENTS = [
    ("dayInMonth", 5, True, 1443398401, 1441411200), ("dayInMonth", 5, False, 1443398401, 1441411201), ("dayInMonth", 31, True, 1443398401, 1443571200),
    ("dayInYear", 20, True, 1443398401, 1421712000), ("dayInYear", 20, False, 1443398401, 1421712001), ("seasonInYear", 1, True, 1443398401, 1420070400),
    ("seasonInYear", 1, False, 1443398401, 1422403201), ("dayInWeek", 1, True, 1443571201, 1443398400), ("dayInWeek", 5, False, 1443571201, 1443744001),
    ("monthInYear", 4, True, 1443571201, 1427846400), ("monthInYear", 4, False, 1443571201, 1430352001), ("hourOfDay", 10, True, 1443571201, 1443607200),
    ("hourOfDay", 10, False, 1443571201, 1443607201),
]


@query("SELECT u, n, r = 1 AS reset, t::DOUBLE AS t FROM (" + values(*[(u, n, int(r), t) for u, n, r, _, t in MOMENTS]) + ") x(u, n, r, t)")
def snap_units(spark, d):
    return spark.createDataFrame([(u, n, r, snap(float(w), u, n, r)) for u, n, r, w, _ in MOMENTS], "u string, n int, reset boolean, t double")


# Sinks.


def _fixed(c: str) -> str:
    return f"printf('%.6f', {c})"


@query(f"""WITH {T} SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}},"properties":{{"id":' || id || ',"num":' || CASE WHEN id % 2 = 0 THEN 'null' ELSE num::VARCHAR END || ',"txt":"' || txt || '","time_start":"' || strftime(make_timestamp((floor(t1) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '","time_end":"' || strftime(make_timestamp((floor(t2) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '"}}}}' AS feature FROM e""")
def export_geojson(spark, d):
    e = timed(spark, d).withColumn("num", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("num"))).select("x", "y", "t1", "t2", "id", "num", "txt")
    path = f"{scratch.folder(spark)}/events"
    export.write_geojson(e, "points", path)
    return spark.read.text(path).withColumnRenamed("value", "feature")


@query(f"""WITH {P} SELECT DISTINCT line FROM (SELECT 'lon,lat,"txt","id","num"' AS line UNION ALL SELECT {_fixed('x')} || ',' || {_fixed('y')} || ',"' || txt || '",' || {_fixed('id::DOUBLE')} || ',' || {_fixed('num')} FROM p)""")
def export_csv(spark, d):
    path = f"{scratch.folder(spark)}/points"
    export.write_csv(points(spark, d), "points", path)
    return spark.read.text(path).distinct().withColumnRenamed("value", "line")


@query(f"""WITH {P} SELECT '{_fixed('0').replace("'", "''")}' AS line WHERE false UNION ALL SELECT unnest(['@RELATION export', '', '@ATTRIBUTE longitude NUMERIC', '@ATTRIBUTE latitude NUMERIC', '@ATTRIBUTE txt STRING', '@ATTRIBUTE id NUMERIC', '@ATTRIBUTE num NUMERIC', '', '@DATA']) UNION ALL SELECT {_fixed('x')} || ',' || {_fixed('y')} || ',"' || txt || '",' || {_fixed('id::DOUBLE')} || ',' || {_fixed('num')} FROM p""")
def export_arff(spark, d):
    head, rows = export.arff_rows(points(spark, d), "points")
    return spark.createDataFrame([(h,) for h in head], "line string").unionByName(rows)


@query(f"WITH {P} SELECT 'POINT(' || x || ' ' || y || ')' AS wkt FROM p")
def export_wkt(spark, d):
    return export.wkt_rows(points(spark, d), "points")


def _png_rows(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """Pixels of an eight-bit RGBA image without row filters."""
    width, height = struct.unpack(">2I", data[16:24])
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    rows = zlib.decompress(body)
    return [(x, height - 1 - y, *rows[y * (4 * width + 1) + 1 + 4 * x : y * (4 * width + 1) + 5 + 4 * x]) for y in range(height) for x in range(width)]


_GRID_SQL = "g AS (SELECT x.range AS px, y.range AS py FROM range(64) x, range(32) y)"


@query(f"WITH {_flat('a')}, {_GRID_SQL} SELECT px, py, coalesce(5 * value, 0)::INT AS r, coalesce(255 - 5 * value, 0)::INT AS g, 0 AS b, CASE WHEN value IS NULL THEN 0 ELSE 255 END AS a FROM g LEFT JOIN a USING (px, py)")
def export_png(spark, d):
    image = export.raster_png(flat(spark, d), 64, 32, [(0.0, (0, 255, 0, 255)), (51.0, (255, 0, 0, 255))])
    return spark.createDataFrame(_png_rows(image), "px long, py long, r int, g int, b int, a int")


@query(f"WITH {_flat('a')}, {_GRID_SQL} SELECT px, py, coalesce(value, 0)::INT AS value FROM g LEFT JOIN a USING (px, py)")
def export_pgm(spark, d):
    image = export.raster_pgm(flat(spark, d), 64, 32)
    head, body = image[:12], image[12:]
    assert head == b"P5 64 32 255"
    return spark.createDataFrame([(k % 64, 31 - k // 64, v) for k, v in enumerate(body[1:])], "px long, py long, value int")


@query(f"WITH {_flat('a')}, {_GRID_SQL} SELECT px, py, coalesce(value, 0)::INT AS y, 128 AS u, 128 AS v FROM g LEFT JOIN a USING (px, py)")
def export_yuv(spark, d):
    image = export.raster_yuv(flat(spark, d), 64, 32)
    planes = image[2048:2560], image[2560:]
    return spark.createDataFrame([(k % 64, 31 - k // 64, image[k], planes[0][k // 128 * 32 + k % 64 // 2], planes[1][k // 128 * 32 + k % 64 // 2]) for k in range(2048)], "px long, py long, y int, u int, v int")


@query(f"WITH {_flat('a')} SELECT t.px, t.py, a.value / 4 AS value FROM a JOIN a t USING (px, py)")
def export_tiff(spark, d):
    """Written, and read again from the file."""
    folder = scratch.folder(spark)
    scratch.put(f"{folder}/one.tiff", export.raster_tiff(flat(spark, d).withColumn("value", F.col("value") / 4), 64, 32))
    series_ = store.FileSeries(f"{folder}/one.tiff", "%Y", "Year", 1, 0.0, 1e9, -9999.0)
    return store.read_files(spark, series_, Rect(-180, -90, 180, 90, 0.0, 1.0))[0].select("px", "py", "value")


@query(f"SELECT * FROM ({values(('data.json', 1), ('provenance.json', 1), ('workflow.json', 1))}) t(name, fine)")
def export_zip(spark, d):
    tree = {"type": "table_source", "params": {"name": "p"}}
    f = ask(spark, tree, tables={"p": lambda s, r: Frame(points(s, d).limit(3), "points", r, provenance=[{"citation": "customers"}])})
    data = export.geojson(f.df, "points").encode()
    with zipfile.ZipFile(io.BytesIO(export.archive(tree, data, "json", f.provenance))) as z:
        want = {"workflow.json": tree, "provenance.json": [{"citation": "customers"}], "data.json": json.loads(data)}
        return spark.createDataFrame([(n, int(json.loads(z.read(n)) == want[n])) for n in z.namelist()], "name string, fine int")


@query("SELECT k.range AS bucket, 5.0::DOUBLE + k.range * 4 AS lower, count(l_quantity) AS n FROM range(10) k LEFT JOIN lineitem ON l_quantity BETWEEN 5 AND 45 AND least(floor((l_quantity - 5) / 4), 9) = k.range GROUP BY ALL")
def plot_histogram_json(spark, d):
    plot = json.loads(plots.histogram_json(plots.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 5, 45, 10)))
    lo, hi, n = (plot["metadata"][k] for k in ("min", "max", "numberOfBuckets"))
    return spark.createDataFrame([(k, lo + k * (hi - lo) / n, c) for k, c in enumerate(plot["data"])], "bucket long, lower double, n long")


@query("SELECT r_regionkey::BIGINT AS k, 5::BIGINT AS points, 0::BIGINT AS nodata, 4.0::DOUBLE AS most, 2 AS dimensions FROM region")
def plot_xygraph_json(spark, d):
    plot = json.loads(plots.scatter_json(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("double").alias("k"), F.col("r_regionkey").cast("double").alias("j")), ["k", "j"]))
    m = plot["metadata"]
    return spark.createDataFrame([(int(k), m["numberOfPoints"], m["nodata"], m["range"][1]["max"], m["dimensions"]) for k, _ in plot["data"]], "k long, points long, nodata long, most double, dimensions int")


_TOP = "SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 20"


@query(f"WITH t AS ({_TOP}) SELECT t.v AS value, t.n, (SELECT count(DISTINCT p_brand) FROM part) AS distinct_, (SELECT count(*) FROM part) AS count_ FROM t")
def plot_statistics_json(spark, d):
    f = ask(spark, {"type": "statistics", "sources": {"points": [{"type": "table_source", "params": {"name": "p"}}]}}, tables={"p": lambda s, r: Frame(s.read.parquet(f"{d}/part.parquet").selectExpr("0D as x", "0D as y", "p_brand"), "points", r)})
    plot = json.loads(plots.statistics_json(f.df))["data"]["p_brand"]
    return spark.createDataFrame([(v, n, plot["distinct"], plot["count"]) for v, n in plot["top"].items()], "value string, n long, distinct_ long, count_ long")


# What needs no table.


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in registered()) + ") t(name)")
def operator_registry(spark, d):
    return spark.createDataFrame([(n,) for n in registered()], "name string")

