"""Operators on rasters: long DataFrames (t1, t2, px, py, value), no-data as null or missing rows."""

from __future__ import annotations

import math
import string
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formula import compile
from ..model import Grid, QueryError, Unit

#: Bits and sign of the integer pixel types.
TYPES = {"Byte": (8, False), "Int16": (16, True), "UInt16": (16, False), "Int32": (32, True), "UInt32": (32, False)}
PIXEL = ["px", "py"]


def to_type(c: Column, datatype: str) -> Column:
    """A double as a pixel type holds it: integers truncate toward zero and wrap."""
    if datatype == "Float64":
        return c.cast("double")
    if datatype == "Float32":
        return c.cast("float").cast("double")
    bits, signed = TYPES[datatype]
    whole = F.when(F.isnan(c) | (F.abs(c) >= 2.0**62), F.lit(0.0)).otherwise(F.signum(c) * F.floor(F.abs(c)))
    n = F.pmod(whole.cast("long"), F.lit(1 << bits))
    return (F.when(n >= (1 << (bits - 1)), n - (1 << bits)).otherwise(n) if signed else n).cast("double")


def no_data_for(datatype: str, unit: Unit) -> float:
    """The value that stands for no-data on writing: NaN, or just outside the unit's range."""
    if datatype.startswith("Float"):
        return math.nan
    bits, signed = TYPES[datatype]
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    if unit.min is not None and lo <= unit.min - 1 <= hi:
        return unit.min - 1
    if unit.max is not None and lo <= unit.max + 1 <= hi:
        return unit.max + 1
    raise QueryError("no value is left for no-data")


def stack(rasters: list[DataFrame]) -> DataFrame:
    """Pixels that have data in all rasters, as columns a, b, ...; validity is the intersection."""
    if not 1 <= len(rasters) <= 26:
        raise QueryError("one to 26 rasters")
    named = [r.filter("value is not null and not isnan(value)").select(*PIXEL, F.col("t1").alias(f"_s{k}"), F.col("t2").alias(f"_e{k}"), F.col("value").alias(string.ascii_lowercase[k])) for k, r in enumerate(rasters)]
    joined = reduce(lambda a, b: a.join(b, PIXEL), named)
    n = range(len(rasters))
    t1 = F.greatest(*[F.col(f"_s{k}") for k in n]) if len(rasters) > 1 else F.col("_s0")
    t2 = F.least(*[F.col(f"_e{k}") for k in n]) if len(rasters) > 1 else F.col("_e0")
    return joined.withColumn("t1", t1).withColumn("t2", t2).filter("t1 < t2").drop(*[f"_{s}{k}" for s in "se" for k in n])


def expression(rasters: list[DataFrame], text: str, datatype: str = "Float64", integer: list[bool] | None = None) -> DataFrame:
    """A formula over the rasters A, B, ... of one grid; a result that is not a number is no-data."""
    ints = integer or [False] * len(rasters)
    names = {string.ascii_uppercase[k]: (F.col(string.ascii_lowercase[k]).cast("long" if ints[k] else "double"), "i" if ints[k] else "d") for k in range(len(rasters))}
    value, kind = compile(text, names)
    value = F.when(value, 1.0).otherwise(0.0) if kind == "b" else value.cast("double")
    return stack(rasters).select("t1", "t2", *PIXEL, to_type(value, datatype).alias("value")).filter("value is not null")


def classification(raster: DataFrame, ranges: list[tuple[float, float, float]], reclass_no_data: bool = False, no_data_class: int = 0) -> DataFrame:
    """Closed ranges of single-precision values; the last range that fits wins, values in none are no-data."""
    v = F.col("value").cast("float")
    found: Column = F.lit(None).cast("double")
    for lo, hi, cls in ranges:
        found = F.when((v >= F.lit(lo).cast("float")) & (v <= F.lit(hi).cast("float")), float(cls)).otherwise(found)
    none = F.col("value").isNull() | F.isnan("value")
    return raster.withColumn("value", F.when(none, F.lit(float(no_data_class) if reclass_no_data else None)).otherwise(found)).filter("value is not null")


def _correlate(grid: Grid, weights: list[int], size: int, tile: int):
    h, w = size // 2, np.array(weights, np.float64).reshape(size, size)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(rows["_tx"].iloc[0]) * tile, int(rows["_ty"].iloc[0]) * tile
        held = np.full((tile + 2 * h, tile + 2 * h), np.nan)
        held[rows["py"].to_numpy() - y0 + h, rows["px"].to_numpy() - x0 + h] = rows["value"].to_numpy()
        # Beyond the grid the edge's pixels are repeated.
        at = lambda first, n: np.clip(np.arange(first - h, first + tile + h), 0, n - 1) - first + h
        held = held[np.ix_(at(y0, grid.height), at(x0, grid.width))]
        out = np.zeros((tile, tile))
        for dy, dx in np.ndindex(size, size):
            out += w[dy, dx] * held[dy : dy + tile, dx : dx + tile]
        py, px = np.nonzero(~np.isnan(out[: max(0, grid.height - y0), : max(0, grid.width - x0)]))
        return pd.DataFrame({"t1": rows["t1"].iloc[0], "t2": rows["t2"].iloc[0], "px": px + x0, "py": py + y0, "value": out[py, px]})

    return run


def matrix(raster: DataFrame, grid: Grid, weights: list[int], size: int, unit: Unit = Unit(), tile: int = 128) -> DataFrame:
    """Correlation with a square matrix, edge pixels repeated beyond the edge, clamped to the unit's range.

    A pixel without data, or with such a neighbour, has none. Pixels are dealt to tiles with a margin of half the
    matrix, so that each is sent about once whatever the matrix's size, and a tile is computed as an array."""
    if size < 3 or size % 2 == 0 or len(weights) != size * size:
        raise QueryError("an odd matrix of 3 or more")
    h, side = size // 2, max(tile, 4 * (size // 2))
    near = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - h) / side), F.lit(0).cast("long")), F.least(F.floor((F.col(c) + h) / side), F.lit((n - 1) // side).cast("long")))
    data = raster.filter("value is not null and not isnan(value)").filter(grid.inside(F.col("px"), F.col("py")))
    data = data.select("t1", "t2", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col("value").cast("double").alias("value"))
    sent = data.withColumn("_tx", F.explode(near("px", grid.width))).withColumn("_ty", F.explode(near("py", grid.height)))
    out = sent.groupBy("t1", "t2", "_tx", "_ty").applyInPandas(_correlate(grid, weights, size, side), "t1 double, t2 double, px long, py long, value double")
    if unit.min is not None:
        out = out.withColumn("value", F.greatest("value", F.lit(float(unit.min))))
    return out.withColumn("value", F.least("value", F.lit(float(unit.max)))) if unit.max is not None else out


def temporal_aggregation(raster: DataFrame, how: str, start: float, duration: float) -> DataFrame:
    """min, max or avg of each pixel over the rasters valid from ``start`` on for ``duration`` seconds.

    A pixel without data in any of those rasters has none. avg is unweighted.
    """
    if how not in ("min", "max", "avg"):
        raise QueryError(f"no aggregation {how!r}")
    part = raster.filter((F.col("t1") < start + duration) & (F.col("t2") > start))
    times = part.select("t1", "t2").distinct().agg(F.count(F.lit(1)).alias("_all"), F.min("t1").alias("t1"), F.max("t2").alias("t2"))
    data = part.filter("value is not null and not isnan(value)").groupBy(*PIXEL).agg(getattr(F, how)("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    return data.join(F.broadcast(times), F.col("_n") == F.col("_all")).select("t1", "t2", *PIXEL, "value")  # one row


def temporal_samples(raster: DataFrame, how: str, start: float, span: float, n: int = 3) -> DataFrame:
    """For rasters that are valid at instants only: min, max or avg of each pixel over the rasters last begun at ``start``
    and at ``n`` more moments, evenly spread over ``span``. A pixel without data in any sample has none."""
    if how not in ("min", "max", "avg"):
        raise QueryError(f"no aggregation {how!r}")
    moments = [start + k * span / n for k in range(n + 1)]
    begins = raster.agg(F.array(*[F.max(F.when(F.col("t1") <= m, F.col("t1"))) for m in moments]).alias("t1"))
    at = begins.select(F.explode("t1").alias("t1")).filter("t1 is not null").groupBy("t1").agg(F.count(F.lit(1)).alias("_times"))
    data = raster.filter("value is not null and not isnan(value)").join(F.broadcast(at), "t1")  # at most n + 1 rows
    value = {"min": F.min("value"), "max": F.max("value"), "avg": F.sum(F.col("value") * F.col("_times")) / (n + 1)}[how]
    return data.groupBy(*PIXEL).agg(value.alias("value"), F.sum("_times").alias("_n")).filter(F.col("_n") == n + 1).select(F.lit(start).alias("t1"), F.lit(start + span).alias("t2"), *PIXEL, "value")


def rgba(rasters: list[DataFrame], scales: list[tuple[float, float, float]]) -> DataFrame:
    """Three rasters as bytes of one number, red lowest, alpha full; (min, max, scale) a channel. Without data: 0."""
    planes = []
    for k, r in enumerate(rasters):
        lo, hi, scale = scales[k]
        v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(255.0 * scale * (F.col("value") - lo) / (hi - lo) + 0.5)))
        planes.append(r.withColumn("value", F.when(~F.isnan("value"), v)))
    every = reduce(lambda a, b: a.unionByName(b), [p.select("t1", "t2", *PIXEL) for p in planes]).groupBy(*PIXEL).agg(F.max("t1").alias("_t1"), F.min("t2").alias("_t2"))
    packed = F.col("a").cast("long").bitwiseOR(F.shiftleft(F.col("b").cast("long"), 8)).bitwiseOR(F.shiftleft(F.col("c").cast("long"), 16)).bitwiseOR(F.lit(255 << 24).cast("long"))
    both = stack(planes).select(*PIXEL, "t1", "t2", packed.alias("value"))
    return every.join(both, PIXEL, "left").select(F.coalesce("t1", "_t1").alias("t1"), F.coalesce("t2", "_t2").alias("t2"), *PIXEL, F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def fit(raster: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """The nearest pixel for each pixel of another grid in the same reference system; none outside the source."""
    spark = raster.sparkSession
    pixels = spark.range(target.width * target.height).select((F.col("id") % target.width).alias("px"), F.floor(F.col("id") / target.width).alias("py"))
    want = pixels.select("px", "py", source.px(target.cx(F.col("px"))).alias("_x"), source.py(target.cy(F.col("py"))).alias("_y"))
    return want.join(raster.select("t1", "t2", F.col("px").alias("_x"), F.col("py").alias("_y"), "value"), ["_x", "_y"]).select("t1", "t2", *PIXEL, "value")


def cut(raster: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a part, whose first pixel becomes 0, 0."""
    inside = F.col("px").between(x, x + width - 1) & F.col("py").between(y, y + height - 1)
    return raster.filter(inside).withColumns({"px": F.col("px") - x, "py": F.col("py") - y})


def blit(raster: DataFrame, part: DataFrame, x: int, y: int, grid: Grid) -> DataFrame:
    """``part`` laid over the raster with its first pixel at x, y; what it has no data for shows the raster."""
    moved = part.withColumns({"px": F.col("px") + x, "py": F.col("py") + y}).filter(grid.inside(F.col("px"), F.col("py")) & F.col("value").isNotNull())
    both = raster.select("t1", "t2", *PIXEL, "value", F.lit(0).alias("_o")).unionByName(moved.select("t1", "t2", *PIXEL, "value", F.lit(1).alias("_o")))
    top = both.groupBy(*PIXEL).agg(F.max_by(F.struct("t1", "t2", "value"), "_o").alias("_v"))
    return top.select("_v.t1", "_v.t2", *PIXEL, "_v.value")


def scale(raster: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Another number of pixels over the same box: each new one takes the nearest old one."""
    near = lambda c, old, new: F.floor((F.col(c) + 0.5) * F.lit(old / new))
    pixels = raster.sparkSession.range(new_width * new_height).select((F.col("id") % new_width).alias("px"), F.floor(F.col("id") / new_width).alias("py"))
    want = pixels.select(*PIXEL, near("px", width, new_width).alias("_x"), near("py", height, new_height).alias("_y"))
    return want.join(raster.select("t1", "t2", F.col("px").alias("_x"), F.col("py").alias("_y"), "value"), ["_x", "_y"]).select("t1", "t2", *PIXEL, "value")


def flip(raster: DataFrame, grid: Grid, x: bool = False, y: bool = False) -> DataFrame:
    return raster.withColumns({"px": F.lit(grid.width - 1) - F.col("px") if x else F.col("px"), "py": F.lit(grid.height - 1) - F.col("py") if y else F.col("py")})


def with_no_data(raster: DataFrame, grid: Grid, datatype: str, unit: Unit) -> DataFrame:
    """Every pixel of the grid as it is written: the datatype's no-data value where there is none."""
    pixels = raster.sparkSession.range(grid.width * grid.height).select((F.col("id") % grid.width).alias("px"), F.floor(F.col("id") / grid.width).alias("py"))
    held = raster.select(*PIXEL, to_type(F.col("value"), datatype).alias("value")).filter("value is not null and not isnan(value)")
    return pixels.join(held, PIXEL, "left").select(*PIXEL, F.coalesce("value", F.lit(no_data_for(datatype, unit))).alias("value"))


def replace_by_range(raster: DataFrame, ranges: list[tuple[float, float, float]]) -> DataFrame:
    """Closed ranges of single-precision values to numbers; the last range that fits wins, others are no-data."""
    return classification(raster, ranges)
