"""Queries as JSON trees: {"type": operator, "params": {...}, "sources": {kind: [trees]}}.

A tree is turned into lazy DataFrames from the leaves; operators that rewrite the rectangle do so before their sources
are built, so sources filter by what is really needed.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import crs, timeops
from ..functions.geometry import KINDS
from ..functions.timeops import Step, TimeShift
from ..model import BOT, EOT, Frame, Grid, QueryError, Rect, Unit
from ..operators import combined, features, plots, rasters, satellite
from ..sources import raster as raster_source, shapefile, vector

Builder = Callable[["Run", dict, dict[str, list["Node"]], Rect], Frame]
_OPERATORS: dict[str, Builder] = {}
ORDER = ("raster", "points", "lines", "polygons")


def operator(*names: str) -> Callable[[Builder], Builder]:
    """Register an operator; modules outside may add their own."""

    def add(f: Builder) -> Builder:
        for n in names:
            _OPERATORS[n] = f
        return f

    return add


def registered() -> list[str]:
    return sorted(_OPERATORS)


@dataclass(frozen=True)
class Node:
    type: str
    params: dict
    sources: dict[str, list[Node]]

    @staticmethod
    def of(tree: dict | str) -> Node:
        d = json.loads(tree) if isinstance(tree, str) else tree
        if d.get("type") not in _OPERATORS:
            raise QueryError(f"no operator {d.get('type')!r}")
        sources = {k: [Node.of(t) for t in d.get("sources", {}).get(k, [])] for k in ORDER if d.get("sources", {}).get(k)}
        if sum(map(len, sources.values())) >= 20:
            raise QueryError("fewer than 20 sources")
        return Node(d["type"], d.get("params", {}), sources)

    def tree(self) -> dict:
        return {"type": self.type, "params": self.params, "sources": {k: [n.tree() for n in v] for k, v in self.sources.items()}}

    @property
    def semantic_id(self) -> str:
        """Equal for equal trees, whatever the order of keys."""
        return json.dumps(self.tree(), sort_keys=True, separators=(",", ":"))


@dataclass
class Run:
    spark: SparkSession
    tables: dict[str, Callable[[SparkSession, Rect], Frame]] = field(default_factory=dict)
    folder: str = ""
    python: dict[str, Callable[[list[Frame]], DataFrame]] = field(default_factory=dict)
    shared: dict[str, Frame] = field(default_factory=dict)

    def build(self, node: Node, rect: Rect) -> Frame:
        """A node's frame; equal subtrees at equal rectangles are built once."""
        key = hashlib.sha1(f"{node.semantic_id}|{rect}".encode()).hexdigest()
        if key not in self.shared:
            self.shared[key] = _OPERATORS[node.type](self, node.params, node.sources, rect)
        return self.shared[key]

    def provenance(self, frame: Frame) -> list[dict]:
        return list({json.dumps(p, sort_keys=True): p for p in frame.provenance}.values())

    def permitted(self, frame: Frame, allowed: set[str]) -> None:
        if gone := [p["local_identifier"] for p in frame.provenance if p.get("local_identifier") and p["local_identifier"] not in allowed]:
            raise QueryError(f"no permission for {gone}")


def _need(sources: dict[str, list[Node]], **counts: int) -> None:
    for kind, n in counts.items():
        if len(sources.get(kind, [])) != n:
            raise QueryError(f"{n} {kind} sources expected")


def _one(run: Run, sources: dict[str, list[Node]], rect: Rect, kinds: tuple[str, ...] = ("points", "lines", "polygons")) -> Frame:
    nodes = [n for k in kinds for n in sources.get(k, [])]
    if len(nodes) != 1:
        raise QueryError("one source expected")
    return run.build(nodes[0], rect)


@operator("numeric_attribute_filter", "points_filter_by_range")
def _numeric(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _one(run, s, rect)
    return replace(f, df=features.numeric_filter(f.df, p["name"], p.get("rangeMin", features.DEFAULT_MIN), p.get("rangeMax", features.DEFAULT_MAX), p.get("includeNoData", False)))


@operator("textual_attribute_filter")
def _textual(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _one(run, s, rect)
    return replace(f, df=features.textual_filter(f.df, p["name"], p["engine"], p["searchString"]))


@operator("difference")
def _difference(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    _need(s, points=2)
    a, b = (run.build(n, rect) for n in s["points"])
    return replace(a, df=features.difference(a.df, b.df, p.get("epsilonDistance", 0.0)), provenance=a.provenance + b.provenance)


@operator("point_in_polygon_filter")
def _pip(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    _need(s, points=1, polygons=1)
    a, b = run.build(s["points"][0], rect), run.build(s["polygons"][0], rect)
    df = features.point_in_polygon(a.df, b.df, point_time=a.has_time, polygon_time=b.has_time, cell=p.get("cell"))
    return replace(a, df=df, has_time=a.has_time or b.has_time, provenance=a.provenance + b.provenance)


@operator("table_source")
def _table(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    """A frame that the caller gave by name."""
    if p["name"] not in run.tables:
        raise QueryError(f"no table {p['name']!r}")
    return run.tables[p["name"]](run.spark, rect)


def _text_source(p: dict, ogr: bool) -> vector.TextSource:
    c = p.get("columns", {})
    form = lambda k: (p.get(k, {}).get("format", "seconds"), p.get(k, {}).get("custom_format"))
    columns = vector.Columns(c.get("x", "x"), c.get("y", "y"), c.get("time1"), c.get("time2"), tuple(c.get("numeric", ())), tuple(c.get("textual", ())))
    rules = {"bad_number": 0.0, "inclusive": True} if ogr else {}
    return vector.TextSource(columns, p.get("separator", ","), p.get("geometry", "xy"), p.get("type", "points"), p.get("time", "none"), p.get("duration", "inf"), form("time1_format"), form("time2_format"), p.get("on_error", "abort"), provenance=p.get("provenance", {}), **rules)


@operator("csv_source")
def _csv(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    source = _text_source(p, ogr=False)
    return Frame(vector.read_text(run.spark, p["filename"], source, rect), source.kind, rect, has_time=source.time != "none", provenance=[source.provenance])


@operator("ogr_raw_source")
def _ogr_raw(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    """Delimited text, GeoJSON or shapefiles, by ``format`` or the ending of the file's name."""
    source = _text_source(p, ogr=True)
    ending = str(p["filename"]).rstrip("/").rsplit(".", 1)[-1].lower()
    form = p.get("format") or {"json": "geojson", "geojson": "geojson", "shp": "shapefile"}.get(ending, "text")
    readers = {"geojson": vector.read_geojson, "shapefile": shapefile.read_shapefile, "text": vector.read_text}
    if form not in readers:
        raise QueryError(f"no format {form!r}")
    return Frame(readers[form](run.spark, p["filename"], source, rect), source.kind, rect, has_time=source.time != "none", provenance=[source.provenance])


@operator("ogr_source")
def _ogr(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    found = vector.Catalog(run.spark, run.folder).get(p["name"], p.get("layer_name"))
    columns = found.get("columns", {}) | {k: p[k] for k in ("numeric", "textual") if k in p}
    return _ogr_raw(run, found | {"columns": columns}, s, rect)


@operator("wkt_source")
def _wkt(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    df = vector.read_wkt(run.spark, p["wkt"], p["type"], rect, [tuple(t) for t in p["time"]] if "time" in p else None)
    if p["type"] == "points":
        df = df.withColumn("_p", F.explode("geom")).select("id", "_p.x", "_p.y", "t1", "t2").filter(F.col("x").between(rect.x1, rect.x2) & F.col("y").between(rect.y1, rect.y2))
    return Frame(df if "time" in p else df.drop("t1", "t2"), p["type"], rect, has_time="time" in p)


@operator("featurecollectiondb_source")
def _stored(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    df = vector.load(run.spark, run.folder, p["owner"], p["data_set_name"], rect)
    kind = "points" if "x" in df.columns else "polygons" if df.schema["geom"].dataType.simpleString() == KINDS["polygons"] else "lines"
    return Frame(df, kind, rect, has_time="t1" in df.columns)


@operator("postgres_source")
def _jdbc(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    return Frame(vector.read_jdbc(run.spark, p["connection"], p["query"], rect), "points", rect)


@operator("rasterdb_source")
def _rasterdb(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    r = raster_source.read(run.spark, run.folder, p["sourcename"], p.get("channel", 0), rect, p.get("transform", True))
    return Frame(r.df, "raster", rect, grid=r.grid, has_time=True, unit=r.unit, datatype=r.datatype, globals=dict(r.attributes), provenance=[p["provenance"]] if "provenance" in p else [])


@operator("gdal_source")
def _gdal(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    d = p["gdal_params"]
    starts = tuple(timeops.parse(t, "iso") if isinstance(t, str) else float(t) for t in d.get("channel_starts", ()))
    series = raster_source.FileSeries(d["path"], d["time_format"], d["interval"]["unit"], d["interval"]["value"], d["start"], d["end"], d.get("no_data"), d.get("scale", 1.0), d.get("offset", 0.0), starts)
    df, w, h = raster_source.read_files(run.spark, series, rect, p.get("channel", 0))
    own = Grid(*d["extent"], w, h)
    out = rect.grid() if rect.width else own
    unit = Unit.from_json(d["unit"]) if "unit" in d else Unit()
    return Frame(rasters.fit(df, own, out) if rect.width else df, "raster", rect, grid=out, has_time=True, unit=unit, datatype=d.get("datatype", "Float64"))


def _rasters(run: Run, s: dict, rect: Rect) -> list[Frame]:
    """The first raster fixes the grid; others are fitted to it."""
    out: list[Frame] = []
    for n in s.get("raster", []):
        f = run.build(n, rect)
        if out and f.grid != out[0].grid:
            f = replace(f, df=rasters.fit(f.df, f.grid, out[0].grid), grid=out[0].grid)
        out.append(f)
    if not out:
        raise QueryError("a raster source is needed")
    return out


def _like(fs: list[Frame], df: DataFrame, **changes) -> Frame:
    return replace(fs[0], df=df, provenance=[p for f in fs for p in f.provenance], **changes)


@operator("expression")
def _expression(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    fs = _rasters(run, s, rect)
    kind = p.get("datatype", "input")
    kind = fs[0].datatype if kind == "input" else kind
    unit = Unit.from_json(p["unit"]) if "unit" in p else fs[0].unit
    return _like(fs, rasters.expression([f.df for f in fs], p["expression"], kind, [f.datatype in rasters.TYPES for f in fs]), unit=unit, datatype=kind)


@operator("classification")
def _classification(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    fs = _rasters(run, s, rect)
    return _like(fs, rasters.classification(fs[0].df, [tuple(r) for r in p["RemapRange"]], p.get("reclassNoData", False), p.get("noDataClass", 0)))


@operator("matrix")
def _matrix(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    fs = _rasters(run, s, rect)
    return _like(fs, rasters.matrix(fs[0].df, fs[0].grid, p["matrix"], p["matrix_size"], fs[0].unit))


@operator("temporal_aggregation")
def _temporal(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    _need(s, raster=1)
    f = run.build(s["raster"][0], replace(rect, t2=rect.t1 + p["duration"]))
    if p.get("instants"):  # the source's rasters are valid at single moments
        return replace(f, df=rasters.temporal_samples(f.df, p["aggregation"], rect.t1, p["duration"]))
    return replace(f, df=rasters.temporal_aggregation(f.df, p["aggregation"], rect.t1, p["duration"]))


@operator("rgba_composite")
def _rgba(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    _need(s, raster=3)
    fs = _rasters(run, s, rect)
    scales = [(p[f"raster_{c}_min"], p[f"raster_{c}_max"], p.get(f"raster_{c}_scale", 1.0)) for c in ("r", "g", "b")]
    return _like(fs, rasters.rgba([f.df for f in fs], scales))


@operator("rasterization")
def _heat(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    radius = p.get("radius", 8)
    f = run.build(s["points"][0], rect.enlarged(math.ceil(radius)))
    g = rect.grid()
    df = combined.heatmap(f.df, g, radius, p.get("attribute") or None).withColumns({"t1": F.lit(rect.t1), "t2": F.lit(rect.t2)})
    return Frame(df, "raster", rect, grid=g, has_time=True, provenance=f.provenance)


@operator("rasterize_polygon")
def _burn(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = run.build(s["polygons"][0], rect)
    g = rect.grid()
    df = combined.rasterize_polygons(f.df, g).withColumns({"t1": F.lit(rect.t1), "t2": F.lit(rect.t2)})
    return Frame(df, "raster", rect, grid=g, has_time=True, provenance=f.provenance)


@operator("raster_value_extraction")
def _extract(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    fs, names = _rasters(run, s, rect), p["names"]
    if "polygons" in s:
        f = run.build(s["polygons"][0], rect)
        df = f.df
        for name, r in zip(names, fs):
            df = combined.extract_zonal(df, r.df, r.grid, "id", name)
    else:
        f = run.build(s["points"][0], rect)
        df = (combined.extract_over_time if f.has_time else combined.extract)(f.df, {n: r.df for n, r in zip(names, fs)}, fs[0].grid)
    return replace(f, df=df, has_time="t1" in df.columns, provenance=f.provenance + [q for r in fs for q in r.provenance])


@operator("projection")
def _projection(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    src, dst = p["src_projection"], p["dest_projection"]
    if dst != rect.crs:
        raise QueryError("the query asks for another reference system")
    box = crs.project_rect(run.spark, rect, src)
    inner = replace(rect, x1=box[0], y1=box[1], x2=box[2], y2=box[3], crs=src)
    if "raster" in s:
        f = run.build(s["raster"][0], inner)
        return replace(f, df=combined.project_raster(f.df, f.grid, src, rect.grid(), dst), rect=rect, grid=rect.grid())
    f = _one(run, s, inner)
    df = combined.project_points(f.df, src, rect) if f.kind == "points" else combined.project_shapes(f.df, f.kind, src, rect)
    return replace(f, df=df, rect=rect)


def _steps(p: dict) -> TimeShift:
    ends = []
    for end in ("from", "to"):
        shift, snap = p.get("shift", {}).get(end), p.get("snap", {}).get(end)
        step = Step(unit=shift["unit"], value=shift["value"]) if shift else Step()
        ends.append(replace(step, snap_unit=snap["unit"], snap_value=snap["value"], reset=snap.get("allowReset", False)) if snap else step)
    stretch = p.get("stretch")
    return TimeShift(*ends, factor=stretch["factor"] if stretch else None, fixed=stretch.get("fixedPoint", "center") if stretch else "center")


@operator("timeshift")
def _timeshift(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    shift, held = _steps(p), []
    nodes = [n for k in ORDER for n in s.get(k, [])]
    if len(nodes) != 1:
        raise QueryError("one source expected")

    def source(r: Rect) -> DataFrame:
        held.append(run.build(nodes[0], r))
        return held[0].df

    df = combined.shifted(source, rect, shift)
    return replace(held[0], df=df, rect=rect)


def _image(p: dict, f: Frame) -> satellite.Image:
    g = f.globals
    named = p.get("forceSatellite") or g.get("msg.Satellite", 8)
    number = int(str(named).rsplit("-", 1)[-1])
    return satellite.Image(number, int(g.get("msg.Channel", 1)), float(g.get("msg.CalibrationOffset", 0.0)), float(g.get("msg.CalibrationSlope", 1.0)))


def _raw(f: Frame) -> None:
    if not f.unit.is_a("raw") or f.unit.min is None or f.unit.max is None:
        raise QueryError("a raw satellite image with a range is needed")


@operator("meteosat_radiance")
def _radiance(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _rasters(run, s, rect)[0]
    _raw(f)
    image = _image(p, f)
    ends = sorted(image.offset + v * image.slope for v in (f.unit.min, f.unit.max))
    return replace(f, df=satellite.radiance(f.df, image), datatype="Float32", unit=Unit("radiance", "W·m^(-2)·sr^(-1)·cm^(-1)", *ends, "continuous"))


@operator("meteosat_temperature")
def _temperature(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _rasters(run, s, rect)[0]
    _raw(f)
    return replace(f, df=satellite.temperature(f.df, _image(p, f)), datatype="Float32", unit=Unit("temperature", "k", 200.0, 330.0, "continuous"))


@operator("meteosat_solar_angle")
def _angle(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _rasters(run, s, rect)[0]
    ends = (0.0, 360.0) if p["solarangle"] == "azimuth" else (0.0, 180.0)
    return replace(f, df=satellite.solar_angle(f.df, f.grid, rect.t1, p["solarangle"]), datatype="Float32", unit=Unit("solarangle", "degree", *ends, "continuous"))


@operator("meteosat_reflectance")
def _reflectance(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _rasters(run, s, rect)[0]
    df = satellite.reflectance(f.df, _image(p, f), f.grid, rect.t1, p.get("solarCorrection", True), p.get("forceHRV", False))
    return replace(f, df=df, datatype="Float32", unit=Unit("reflectance", "fraction", 0.0, 1.0, "continuous"))


@operator("meteosat_co2_correction")
def _co2(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    _need(s, raster=3)
    fs = _rasters(run, s, rect)
    return _like(fs, satellite.co2_correction(*[f.df for f in fs]))


@operator("meteosat_pansharpening")
def _sharpen(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    """The first source is the high-resolution channel, the second the one to sharpen, at a third of its resolution."""
    _need(s, raster=2)
    low = run.build(s["raster"][1], rect)
    g = low.grid
    hrv = run.build(s["raster"][0], replace(rect, x1=g.x1, y1=g.y1, x2=g.x2, y2=g.y2, width=g.width * 3, height=g.height * 3))
    wide = Grid(g.x1, g.y1, g.x2, g.y2, g.width * 3, g.height * 3)
    fine = hrv.df if hrv.grid == wide else rasters.fit(hrv.df, hrv.grid, wide)
    df = satellite.pansharpen(low.df, fine, g, p.get("local_regression", 5), low.unit.max, spatial=p.get("spatial", False), distance=bool(p.get("distance", 1)))
    return _like([low, hrv], df, grid=wide)


def _thermal(run: Run, p: dict, s: dict, rect: Rect) -> tuple[list[Frame], dict]:
    """Sources: solar zenith angle, then the difference of brightness temperatures (10.8 less 3.9), whose unit has a range.
    The bounds of day and night are parameters."""
    _need(s, raster=2)
    fs = _rasters(run, s, rect)
    unit = fs[1].unit
    if unit.min is None or unit.max is None:
        raise QueryError("the difference needs a unit with a range")
    return fs, dict(day=tuple(p.get("day", (0.0, 80.0))), night=tuple(p.get("night", (93.0, 180.0))), span=(unit.min, unit.max))


@operator("meteosat_gccthermthresholddetection")
def _thresholds(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    fs, how = _thermal(run, p, s, rect)
    found = satellite.thermal_thresholds(fs[1].df, fs[0].df, **how)
    return _like(fs, satellite.threshold_raster(fs[0].df, found, how["day"], how["night"]), datatype="Float32", unit=Unit(min=min(found.values()), max=max(found.values())))


@operator("meteosat_gccthermthresholddetection_plot")
def _threshold_plot(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    """The histograms by which the thresholds are found."""
    fs, how = _thermal(run, p, s, rect)
    return Frame(satellite.thermal_histogram(fs[1].df, fs[0].df, **how), "plot", rect, provenance=[q for f in fs for q in f.provenance])


@operator("histogram")
def _histogram(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _one(run, s, rect, ("raster", "points", "lines", "polygons"))
    column = p.get("attribute") or "value"
    r = p.get("range", "data")
    lo, hi = (f.unit.min, f.unit.max) if r == "unit" else plots.value_range(f.df, column) if r == "data" else r
    return Frame(plots.histogram(f.df, column, lo, hi, p.get("buckets", 0), f.kind == "raster" and f.datatype in rasters.TYPES), "plot", rect, provenance=f.provenance)


@operator("statistics")
def _statistics(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _one(run, s, rect, ("raster", "points", "lines", "polygons"))
    names = [c for c, t in f.df.dtypes if t == "double" and c not in ("x", "y", "t1", "t2")]
    return Frame(plots.statistics(f.df, names, [c for c, t in f.df.dtypes if t == "string"]), "plot", rect, provenance=f.provenance)


@operator("feature_attributes_plot")
def _scatter(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    f = _one(run, s, rect)
    if len(p["attributeNames"]) not in (2, 3):
        raise QueryError("two or three attributes")
    return Frame(plots.scatter(f.df, p["attributeNames"]), "plot", rect, provenance=f.provenance)


@operator("r_script", "python_script")
def _script(run: Run, p: dict, s: dict, rect: Rect) -> Frame:
    """A function that the caller registered by name, over the sources' frames: scripts in text are not run."""
    if p.get("name") not in run.python:
        raise QueryError("scripts are functions given by name")
    fs = [run.build(n, rect) for k in ORDER for n in s.get(k, [])]
    return Frame(run.python[p["name"]](fs), p.get("result", "points"), rect, provenance=[q for f in fs for q in f.provenance])


def rect_of(d: dict) -> Rect:
    """The rectangle of a query file."""
    sp, t, res = d["spatial_reference"], d.get("temporal_reference", {}), d.get("resolution")
    size = (res.get("x", 1000), res.get("y", 1000)) if res and res.get("type") == "pixels" else (None, None)
    start = t.get("start", BOT)
    return Rect(sp["x1"], sp["y1"], sp["x2"], sp["y2"], start, t.get("end", start + 0.001 if "start" in t else EOT), sp.get("projection", "EPSG:4326"), *size)


def run_query(run: Run, query: dict) -> Frame:
    """A query file: tree and rectangle."""
    return run.build(Node.of(query["query"]), rect_of(query))
