"""Raster sources: a store of pixel tables with zoom levels, and files chosen by time.

A stored source is a folder of three parts: ``source`` (one JSON text: grid and channels), ``rasters`` (a small table of
what is valid when, with each raster's attributes and where its pixels are) and ``pixels``, partitioned by channel, zoom
and begin of validity, so that a query lists and reads the files of one raster at one zoom level.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeops import raster_valid, to_datetime
from ..model import Grid, NoRasterForTime, QueryError, Rect, Unit
from .tiff import decode, header

PIXELS = "t1 double, t2 double, px long, py long, value double"


@dataclass(frozen=True)
class Transform:
    """value * scale + offset; each a number, or the name of a raster's attribute (1 and 0 where it lacks)."""

    scale: float | str = 1.0
    offset: float | str = 0.0
    unit: Unit | None = None
    datatype: str | None = None

    def of(self, attributes: dict[str, str]) -> tuple[float, float]:
        get = lambda v, default: float(attributes.get(v, default)) if isinstance(v, str) else float(v)
        return get(self.scale, 1.0), get(self.offset, 0.0)


@dataclass(frozen=True)
class Channel:
    datatype: str = "Float64"
    unit: Unit = Unit()
    transform: Transform | None = None


@dataclass(frozen=True)
class Description:
    grid: Grid
    channels: list[Channel]
    crs: str = "EPSG:4326"

    def to_json(self) -> str:
        one = lambda c: {"datatype": c.datatype, "unit": c.unit.to_json()} | ({"transform": {"scale": c.transform.scale, "offset": c.transform.offset, "datatype": c.transform.datatype, "unit": c.transform.unit and c.transform.unit.to_json()}} if c.transform else {})
        g = self.grid
        return json.dumps({"crs": self.crs, "grid": [g.x1, g.y1, g.x2, g.y2, g.width, g.height], "channels": [one(c) for c in self.channels]})

    @staticmethod
    def from_json(text: str) -> Description:
        d = json.loads(text)
        channels = []
        for c in d["channels"]:
            t = c.get("transform")
            transform = Transform(t["scale"], t["offset"], Unit.from_json(t["unit"]) if t.get("unit") else None, t.get("datatype")) if t else None
            channels.append(Channel(c["datatype"], Unit.from_json(c["unit"]), transform))
        return Description(Grid(*d["grid"]), channels, d["crs"])


def create(spark: SparkSession, folder: str, name: str, description: Description) -> None:
    spark.createDataFrame([(description.to_json(),)], "value string").coalesce(1).write.text(f"{folder}/{name}/source")


def describe(spark: SparkSession, folder: str, name: str) -> Description:
    try:
        rows = spark.read.text(f"{folder}/{name}/source").head(1)
    except AnalysisException as e:
        raise QueryError(f"no raster source {name!r}") from e
    return Description.from_json(rows[0][0])


_RASTERS = "channel int, t1 double, t2 double, pixels_t1 double, levels int, attributes map<string,string>"


def store(spark: SparkSession, raster: DataFrame, folder: str, name: str, channel: int = 0, *, attributes: dict[str, str] | None = None, levels: int | None = None) -> None:
    """Import a raster series (t1, t2, px, py, value): the pixels of each zoom level by nearest sampling, halved each time
    until both axes are below 1024, or ``levels``."""
    grid = describe(spark, folder, name).grid
    deepest = levels or 1
    while levels is None and max(grid.width, grid.height) >> (deepest - 1) >= 2048:
        deepest += 1
    zooms = F.array(*[F.lit(z) for z in range(deepest)])
    fits = F.filter(zooms, lambda z: (F.expr("px").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), z) - 1) == 0) & (F.expr("py").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), z) - 1) == 0))
    pixels = raster.select("t1", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col("value").cast("double").alias("value"))
    out = pixels.withColumn("zoom", F.explode(fits)).select(F.lit(channel).alias("channel"), "zoom", "t1", F.call_function("shiftright", "px", "zoom").alias("px"), F.call_function("shiftright", "py", "zoom").alias("py"), "value")
    # One writer or few for each partition, and pixels in order, so that files skip by place.
    out = out.repartition("zoom", "t1", F.floor(F.col("py") / 256)).sortWithinPartitions("zoom", "t1", "py", "px")
    out.write.mode("append").partitionBy("channel", "zoom", "t1").parquet(f"{folder}/{name}/pixels")
    known = F.create_map(*[F.lit(x) for kv in (attributes or {}).items() for x in kv]) if attributes else F.lit(None)
    index = raster.groupBy("t1").agg(F.max("t2").alias("t2")).select(F.lit(channel).alias("channel"), "t1", "t2", F.col("t1").alias("pixels_t1"), F.lit(deepest).alias("levels"), known.cast("map<string,string>").alias("attributes"))
    index.write.mode("append").parquet(f"{folder}/{name}/rasters")


def link(spark: SparkSession, folder: str, name: str, channel: int, of: tuple[float, float], to: tuple[float, float]) -> None:
    """Use a stored raster for another time span; its pixels are not copied."""
    rows = spark.read.schema(_RASTERS).parquet(f"{folder}/{name}/rasters").filter((F.col("channel") == channel) & (F.col("t1") == of[0]) & (F.col("t2") == of[1]))
    rows.withColumns({"t1": F.lit(float(to[0])), "t2": F.lit(float(to[1]))}).write.mode("append").parquet(f"{folder}/{name}/rasters")


def zoom_for(rect: Rect, grid: Grid, levels: int) -> int:
    """Halve while both axes still have twice the pixels asked for."""
    if not rect.width or not rect.height:
        return 0
    w, h, zoom = (rect.x2 - rect.x1) / grid.sx, (rect.y2 - rect.y1) / grid.sy, 0
    while zoom + 1 < levels and w >= 2 * rect.width and h >= 2 * rect.height:
        w, h, zoom = w / 2, h / 2, zoom + 1
    return zoom


@dataclass(frozen=True)
class Stored:
    df: DataFrame
    grid: Grid
    unit: Unit
    datatype: str
    attributes: dict[str, str]


def read(spark: SparkSession, folder: str, name: str, channel: int, rect: Rect, transform: bool = True) -> Stored:
    """The raster valid for the rectangle (the latest that begins before and ends after it) at the zoom level that fits
    its resolution, cut to its pixels, with what its source says of it."""
    found = describe(spark, folder, name)
    if not 0 <= channel < len(found.channels):
        raise QueryError(f"no channel {channel}")
    if rect.crs != found.crs:
        raise QueryError(f"the source is in {found.crs}")
    index = spark.read.schema(_RASTERS).parquet(f"{folder}/{name}/rasters").filter((F.col("channel") == channel) & (F.col("t1") <= rect.t1) & (F.col("t2") >= rect.t2))
    best = index.agg(F.max_by(F.struct("t1", "t2", "pixels_t1", "levels", "attributes"), "t1").alias("r")).first()["r"]
    if best is None:
        raise NoRasterForTime(f"{rect.t1} to {rect.t2}")
    zoom, grid = zoom_for(rect, found.grid, best["levels"]), found.grid
    g = Grid(grid.x1, grid.y1, grid.x1 + grid.sx * (grid.width >> zoom << zoom), grid.y1 + grid.sy * (grid.height >> zoom << zoom), grid.width >> zoom, grid.height >> zoom)
    cut = lambda v, a, s: int((v - a) // s)
    box = F.col("px").between(cut(rect.x1, g.x1, g.sx), cut(rect.x2, g.x1, g.sx)) & F.col("py").between(cut(rect.y1, g.y1, g.sy), cut(rect.y2, g.y1, g.sy))
    pixels = spark.read.schema("px long, py long, value double, channel int, zoom int, t1 double").parquet(f"{folder}/{name}/pixels")
    out = pixels.filter((F.col("channel") == channel) & (F.col("zoom") == zoom) & (F.col("t1") == best["pixels_t1"]) & box)
    attributes, own = dict(best["attributes"] or {}), found.channels[channel]
    unit, datatype, value = own.unit, own.datatype, F.col("value")
    if transform and own.transform:
        scale, offset = own.transform.of(attributes)
        value, unit, datatype = value * F.lit(scale) + F.lit(offset), own.transform.unit or Unit(), own.transform.datatype or datatype
        if own.unit.min is not None and own.unit.max is not None and unit.min is None:
            unit = replace(unit, min=own.unit.min * scale + offset, max=own.unit.max * scale + offset)
    return Stored(out.select(F.lit(best["t1"]).alias("t1"), F.lit(best["t2"]).alias("t2"), "px", "py", value.alias("value")), g, unit, datatype, attributes)


@dataclass(frozen=True)
class FileSeries:
    """Files named by time: a template with %%%TIME_STRING%%%, a time format, and the interval of validity. With
    ``starts`` the channel is the number of starts up to the time asked for."""

    template: str
    time_format: str
    unit: str
    n: int
    start: float
    end: float
    no_data: float | None = None
    scale: float = 1.0
    offset: float = 0.0
    starts: tuple[float, ...] = ()

    def file_for(self, rect: Rect) -> tuple[str, float, float]:
        """The file for a rectangle and its validity; corners and times may stand in the name too."""
        t1, t2 = raster_valid(self.unit, self.n, self.start, self.end, rect.t1)
        name = self.template.replace("%%%TIME_STRING%%%", to_datetime(t1).strftime(self.time_format))
        known = {"MINX": rect.x1, "MINY": rect.y1, "MAXX": rect.x2, "MAXY": rect.y2, "T1": rect.t1, "T2": rect.t2}
        return re.sub("%%%([A-Z0-9]+)%%%", lambda m: str(known[m[1]]) if m[1] in known else m[0], name), t1, t2


def channel_by_starts(starts: tuple[float, ...], t: float) -> int:
    """The number of starts up to t: the channel, from 1."""
    n = sum(s <= t for s in starts)
    if not n:
        raise NoRasterForTime(str(t))
    return n


def read_files(spark: SparkSession, series: FileSeries, rect: Rect, channel: int = 0) -> tuple[DataFrame, int, int]:
    """The file for the rectangle's time as pixels with its rows turned upward; channel counts from 0. Tasks decode it."""
    name, t1, t2 = series.file_for(rect)
    if series.starts:
        channel = channel_by_starts(series.starts, rect.t1) - 1
    try:
        files = spark.read.format("binaryFile").load(name).select("content")
    except AnalysisException as e:
        raise NoRasterForTime(name) from e
    size = files.mapInArrow(header, "width long, height long").first()
    if size is None:
        raise NoRasterForTime(name)
    pixels = files.mapInArrow(decode(channel), "px long, py long, value double").filter(~F.isnan("value"))
    if series.no_data is not None:
        pixels = pixels.filter(F.col("value") != float(series.no_data))
    return pixels.select(F.lit(t1).alias("t1"), F.lit(t2).alias("t2"), "px", "py", (F.col("value") * F.lit(float(series.scale)) + F.lit(float(series.offset))).alias("value")), size["width"], size["height"]
