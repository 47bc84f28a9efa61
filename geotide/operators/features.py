"""Filters and joins on vector features."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geometry import in_polygons, polygon_bounds, segments
from ..model import BOT, EOT, QueryError

#: The lower bound where none is given: the smallest normal double, which drops zero and negative values.
DEFAULT_MIN = sys.float_info.min
DEFAULT_MAX = sys.float_info.max


def numeric_filter(df: DataFrame, name: str, lo: float = DEFAULT_MIN, hi: float = DEFAULT_MAX, include_no_data: bool = False) -> DataFrame:
    """Closed range; NaN and null are no-data."""
    c = F.col(name)
    none = c.isNull() | F.isnan(c)
    inside = (c >= lo) & (c <= hi)
    return df.filter(none | inside) if include_no_data else df.filter(inside & ~F.isnan(c))


def textual_filter(df: DataFrame, name: str, engine: str, text: str) -> DataFrame:
    """exact, contains or startswith, case-sensitive; null counts as empty text."""
    c = F.coalesce(F.col(name), F.lit(""))
    if engine == "exact":
        return df.filter(c == text)
    if engine not in ("contains", "startswith"):
        raise QueryError(f"no engine {engine!r}")
    return df if text == "" else df.filter(c.contains(text) if engine == "contains" else c.startswith(text))


def difference(minuend: DataFrame, subtrahend: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Points of the minuend without a point of the subtrahend within ``epsilon``; time is ignored.

    With a distance, points meet through the cells of a grid of that size: the subtrahend's points are put in their own
    and the eight cells around, so the anti-join keeps an equality key.
    """
    if epsilon < 0:
        raise QueryError("a distance is not negative")
    if epsilon == 0:
        other = subtrahend.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
        return minuend.join(other, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_anti")
    side = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c: F.floor(c / F.lit(float(epsilon)))
    other = (
        subtrahend.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        .distinct()
        .withColumn("_i", F.explode(F.transform(side, lambda d: cell(F.col("_x")) + d)))
        .withColumn("_j", F.explode(F.transform(side, lambda d: cell(F.col("_y")) + d)))
    )
    close = (F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 <= float(epsilon) ** 2
    return minuend.join(other, (cell(F.col("x")) == F.col("_i")) & (cell(F.col("y")) == F.col("_j")) & close, "left_anti")


#: A polygon is cut in at most this many cells; wider ones in cells of 64 times the side.
MOST_CELLS = 4096


def cell_side(polygons: DataFrame) -> float:
    """A grid's cell of an eighth of a usual polygon's side, whatever the reference system: most of a polygon's cells then
    lie inside it, and few of them carry its edges."""
    b = polygon_bounds(F.col("geom"))
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    r = polygons.select(side.alias("s")).agg(F.percentile_approx("s", 0.5), F.max("s")).first()
    return max(float(r[0] or 0.0) / 8, float(r[1] or 0.0) / 4096) or 1.0


def _cells(polygons: DataFrame, side: float) -> DataFrame:
    """A row for each cell that a polygon (geom, ...) touches: _level, _i, _j, and ``_inside`` where the cell lies inside, so
    that only cells at the border need the edges (``_geom`` is null elsewhere)."""
    b = polygon_bounds(F.col("geom"))
    count = lambda lo, hi, s: F.floor(b[hi] / s) - F.floor(b[lo] / s) + 1
    level = F.when(count("x1", "x2", side) * count("y1", "y2", side) > MOST_CELLS, 1).otherwise(0)
    sized = polygons.withColumn("_level", level).withColumn("_b", b).withColumn("_s", F.when(F.col("_level") == 1, side * 64).otherwise(side))
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"_b.{lo}") / F.col("_s")), F.floor(F.col(f"_b.{hi}") / F.col("_s"))))
    cut = sized.withColumn("_i", at("x1", "x2")).withColumn("_j", at("y1", "y2"))
    x1, y1 = F.col("_i") * F.col("_s"), F.col("_j") * F.col("_s")
    x2, y2 = x1 + F.col("_s"), y1 + F.col("_s")
    meets = lambda s: (F.least(s["a"]["x"], s["b"]["x"]) <= x2) & (F.greatest(s["a"]["x"], s["b"]["x"]) >= x1) & (F.least(s["a"]["y"], s["b"]["y"]) <= y2) & (F.greatest(s["a"]["y"], s["b"]["y"]) >= y1)
    border = F.exists("geom", lambda p: F.exists(p, lambda r: F.exists(segments(r), meets)))
    cut = cut.withColumn("_border", border).withColumn("_inside", ~F.col("_border") & in_polygons(F.col("geom"), (x1 + x2) / 2, (y1 + y2) / 2))
    return cut.filter("_border or _inside").withColumn("_geom", F.when(F.col("_border"), F.col("geom"))).drop("geom", "_b", "_s", "_border")


def _meet(points: DataFrame, polygons: DataFrame, side: float | None, how: str) -> DataFrame:
    """Points and the polygons (geom, p1, p2) that hold them, joined by grid cell. ``how``: inner or left_semi."""
    side = cell_side(polygons) if side is None else side
    cut = _cells(polygons, side)
    holds = F.col("_inside") | in_polygons(F.col("_geom"), F.col("x"), F.col("y"))

    def on(level: int):
        s = side * 64**level
        return (F.floor(F.col("x") / s) == F.col("_i")) & (F.floor(F.col("y") / s) == F.col("_j")) & holds

    fine, wide = (cut.filter(F.col("_level") == k) for k in (0, 1))
    if wide.isEmpty():
        return points.join(fine, on(0), how)
    if how == "inner":
        return points.join(fine, on(0)).unionByName(points.join(wide, on(1)))
    return points.join(fine, on(0), "left_semi").unionByName(points.join(fine, on(0), "left_anti").join(wide, on(1), "left_semi"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, *, point_time: bool = False, polygon_time: bool = False, cell: float | None = None) -> DataFrame:
    """Points (x, y, ...) in any polygon (geom). With time on either side, a point is valid where it and a containing
    polygon are: strictly overlapping pieces are merged, touching ones are not, and each merged piece is a row.

    ``cell``: the side of the grid's cells, by default an eighth of a usual polygon's."""
    if not point_time and not polygon_time:
        return _meet(points, polygons.select("geom"), cell, "left_semi")
    columns = [c for c in points.columns if c not in ("t1", "t2")]
    timed = points if point_time else points.drop("t1", "t2").withColumn("t1", F.lit(BOT)).withColumn("t2", F.lit(EOT))
    bounds = [F.col(c) if polygon_time else F.lit(e) for c, e in (("t1", BOT), ("t2", EOT))]
    other = polygons.select("geom", bounds[0].alias("_p1"), bounds[1].alias("_p2"))
    # Equal points are told apart by nothing and share their pieces: they are one row with a number of times.
    key = [*columns, "_from", "_to"]
    timed = timed.withColumnsRenamed({"t1": "_from", "t2": "_to"}).groupBy(*key).agg(F.count(F.lit(1)).alias("_times"))
    hits = _meet(timed, other, cell, "inner").select(*key, "_times", F.greatest("_from", "_p1").alias("t1"), F.least("_to", "_p2").alias("t2")).filter("t1 < t2")
    in_order = W.partitionBy(*key).orderBy("t1", "t2")
    reach = F.max("t2").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    marked = hits.withColumn("_new", F.when(F.col("t1") < reach, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy(*key, "_island").agg(F.first("_times").alias("_times"), F.min("t1").alias("t1"), F.max("t2").alias("t2"))
    return merged.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*columns, "t1", "t2")
