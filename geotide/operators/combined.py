"""Operators between features and rasters, reprojection and time shifts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import crs
from ..functions.geometry import in_polygons, lines_meet_box, polygon_bounds, polygons_meet_box
from ..functions.timeops import TimeShift
from ..model import Grid, QueryError, Rect
from .rasters import PIXEL


def extract(points: DataFrame, rasters: dict[str, DataFrame], grid: Grid) -> DataFrame:
    """Each point's pixel value by attribute name; NaN off the grid or without data. Adds the rasters' common validity."""
    out = points.withColumn("_px", grid.px(F.col("x"))).withColumn("_py", grid.py(F.col("y")))
    times = []
    for name, r in rasters.items():
        times.append(r.select("t1", "t2").distinct())
        out = out.join(r.select(F.col("px").alias("_px"), F.col("py").alias("_py"), F.col("value").cast("double").alias(name)), ["_px", "_py"], "left").withColumn(name, F.coalesce(name, F.lit(float("nan"))))
    span = times[0]
    for t in times[1:]:
        span = span.unionByName(t)
    span = span.agg(F.max("t1").alias("t1"), F.min("t2").alias("t2"))
    return out.drop("_px", "_py", "t1", "t2").crossJoin(F.broadcast(span))  # one row


def extract_over_time(points: DataFrame, rasters: dict[str, DataFrame], grid: Grid) -> DataFrame:
    """Points with t1 take the raster that is valid then: an equality join on the pixel with the interval as residual."""
    out = points.withColumn("_px", grid.px(F.col("x"))).withColumn("_py", grid.py(F.col("y")))
    for name, r in rasters.items():
        series = r.select(F.col("px").alias("_rx"), F.col("py").alias("_ry"), F.col("t1").alias("_r1"), F.col("t2").alias("_r2"), F.col("value").cast("double").alias(name))
        on = (F.col("_px") == F.col("_rx")) & (F.col("_py") == F.col("_ry")) & (F.col("t1") >= F.col("_r1")) & (F.col("t1") < F.col("_r2"))
        out = out.join(series, on, "left").withColumn(name, F.coalesce(name, F.lit(float("nan")))).drop("_rx", "_ry", "_r1", "_r2")
    return out.drop("_px", "_py")


def polygon_pixels(polygons: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """Pixels whose centre lies in a polygon (geom), once a polygon: rows of its box first, then centres."""
    b = polygon_bounds(F.col("geom"))
    clamp = lambda c, last: F.greatest(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), c))
    x0, x1 = clamp(grid.px(F.col("_b.x1")), grid.width - 1), clamp(grid.px(F.col("_b.x2")), grid.width - 1)
    y0, y1 = clamp(grid.py(F.col("_b.y1")), grid.height - 1), clamp(grid.py(F.col("_b.y2")), grid.height - 1)
    boxed = polygons.withColumn("_b", b).withColumn("py", F.explode(F.sequence(y0, y1))).withColumn("px", F.explode(F.sequence(x0, x1)))
    return boxed.filter(in_polygons(F.col("geom"), grid.cx(F.col("px")), grid.cy(F.col("py")))).select(*keep, *PIXEL)


def extract_zonal(polygons: DataFrame, raster: DataFrame, grid: Grid, key: str, name: str) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the pixels with centres in each polygon; NaN without any."""
    data = raster.filter("value is not null and not isnan(value)").select(*PIXEL, "value")
    stats = polygon_pixels(polygons, grid, key).join(data, PIXEL).groupBy(key).agg(
        F.avg("value").alias(f"{name}_mean"), F.stddev_samp("value").alias(f"{name}_stdev"), F.min("value").alias(f"{name}_min"), F.max("value").alias(f"{name}_max")
    )
    made = [f"{name}_{s}" for s in ("mean", "stdev", "min", "max")]
    return polygons.join(stats, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in made})


def rasterize_polygons(polygons: DataFrame, grid: Grid) -> DataFrame:
    """1 where a pixel's centre lies in any polygon; other pixels have no data."""
    return polygon_pixels(polygons, grid).distinct().withColumn("value", F.lit(1.0))


def _disc(radius: float) -> list[tuple[int, int, float]]:
    r = math.ceil(radius)
    return [(x, y, math.hypot(x, y)) for y in range(-r, r + 1) for x in range(-r, r + 1) if math.hypot(x, y) < radius]


def heatmap(points: DataFrame, grid: Grid, radius: float = 8, attribute: str | None = None) -> DataFrame:
    """Points spread over discs of pixels. The grid is that of the result; points up to the radius outside count too.

    Without attribute: a cone of counts, 10 a point, not above 255 times the cone of the nearest point. With one: the
    mean of the pixels' means, weighted by closeness. Pixels that nothing reaches have value 0 or no data.
    """
    if radius <= 0:
        raise QueryError("a radius is positive")
    reach = math.ceil(radius)
    px, py = grid.px(F.col("x")), grid.py(F.col("y"))
    near = points.select(px.alias("px"), py.alias("py"), *([attribute] if attribute else []))
    near = near.filter(F.col("px").between(-reach, grid.width - 1 + reach) & F.col("py").between(-reach, grid.height - 1 + reach))
    if attribute:
        near = near.filter(F.col(attribute).isNotNull() & ~F.isnan(attribute))
    cell = near.groupBy(*PIXEL).agg((F.avg(attribute) if attribute else F.count(F.lit(1)).cast("double")).alias("v"))
    disc = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(1 - d / radius).alias("w")) for x, y, d in _disc(radius)])
    sent = cell.select(*PIXEL, "v", F.explode(disc).alias("o")).select((F.col("px") + F.col("o.dx")).alias("px"), (F.col("py") + F.col("o.dy")).alias("py"), "v", F.col("o.w").alias("w"))
    sent = sent.filter(grid.inside(F.col("px"), F.col("py"))).groupBy(*PIXEL)
    if attribute:
        return sent.agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))
    return sent.agg(F.floor(F.least(F.sum(F.col("v") * F.col("w")) * 10, F.max("w") * 255)).cast("double").alias("value"))


def project_points(points: DataFrame, src: str, rect: Rect) -> DataFrame:
    """Points in the rectangle's reference system, less those that do not project or leave the rectangle."""
    x, y = crs.transform(F.col("x"), F.col("y"), src, rect.crs)
    out = points.withColumn("_x", x).withColumn("_y", y).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})
    return out.filter(F.col("x").between(rect.x1, rect.x2) & F.col("y").between(rect.y1, rect.y2))


def project_shapes(features: DataFrame, kind: str, src: str, rect: Rect) -> DataFrame:
    """Lines or polygons (geom) in the rectangle's reference system, less those with a coordinate that does not project and
    those that do not meet the rectangle."""

    def point(p: Column) -> Column:
        x, y = crs.transform(p["x"], p["y"], src, rect.crs)
        return F.struct(x.alias("x"), y.alias("y"))

    line = lambda a: F.transform(a, point)
    flat = F.flatten("_geom") if kind == "lines" else F.flatten(F.flatten("_geom"))
    moved = features.withColumn("_geom", F.transform("geom", line if kind == "lines" else lambda p: F.transform(p, line)))
    good = ~F.exists(flat, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    moved = moved.filter(good).withColumn("geom", F.col("_geom")).drop("_geom")
    return moved.filter((lines_meet_box if kind == "lines" else polygons_meet_box)(F.col("geom"), rect))


def project_raster(raster: DataFrame, source: Grid, src: str, target: Grid, dst: str) -> DataFrame:
    """Each target pixel's centre looked up in the source grid; no data where it falls outside."""
    pixels = raster.sparkSession.range(target.width * target.height).select((F.col("id") % target.width).alias("px"), F.floor(F.col("id") / target.width).alias("py"))
    x, y = crs.transform(target.cx(F.col("px")), target.cy(F.col("py")), dst, src)
    want = pixels.select(*PIXEL, source.px(x).alias("_x"), source.py(y).alias("_y"))
    return want.join(raster.select("t1", "t2", F.col("px").alias("_x"), F.col("py").alias("_y"), "value"), ["_x", "_y"]).select("t1", "t2", *PIXEL, "value")


def shifted(source, rect: Rect, shift: TimeShift) -> DataFrame:
    """``source`` is asked (rect -> DataFrame) at the shifted time; the result's times are moved back."""
    t1, t2 = shift.apply(rect.t1, rect.t2)
    df = source(Rect(rect.x1, rect.y1, rect.x2, rect.y2, t1, t2, rect.crs, rect.width, rect.height))
    if "t1" not in df.columns:
        return df
    a, b = shift.reverse(F.col("t1"), F.col("t2"))
    return df.withColumns({"t1": a, "t2": b}).filter("t1 < t2")
