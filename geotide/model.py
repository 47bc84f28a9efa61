"""Descriptors of space, time and grids; data itself stays in DataFrames.

Points have columns x, y (one row a feature); lines and polygons a nested array ``geom``; any feature may have t1, t2
in epoch seconds, half-open, and plain attribute columns. A raster is a long DataFrame (t1, t2, px, py, value) with a
Grid; a missing row and a null value both mean no-data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

#: Begin and end of time in epoch seconds: years 1 and 9999.
BOT, EOT = -62135596800.0, 253402300799.0
#: An instant is as long as this.
EPSILON = 0.001


class QueryError(ValueError):
    """A query that cannot be answered as stated."""


class NoRasterForTime(QueryError):
    """A raster source has nothing at the time asked for."""


@dataclass(frozen=True)
class Rect:
    """A query rectangle: closed box, half-open time, optional resolution in pixels."""

    x1: float
    y1: float
    x2: float
    y2: float
    t1: float = BOT
    t2: float = EOT
    crs: str = "EPSG:4326"
    width: int | None = None
    height: int | None = None

    def __post_init__(self) -> None:
        if self.x1 > self.x2 or self.y1 > self.y2:
            raise QueryError("the box is upside down")
        if not self.t1 < self.t2:
            raise QueryError("the time interval is empty")

    def grid(self) -> Grid:
        if not self.width or not self.height:
            raise QueryError("a raster needs a resolution")
        return Grid(self.x1, self.y1, self.x2, self.y2, self.width, self.height)

    def enlarged(self, pixels: int) -> Rect:
        g = self.grid()
        dx, dy = g.sx * pixels, g.sy * pixels
        return replace(self, x1=self.x1 - dx, x2=self.x2 + dx, y1=self.y1 - dy, y2=self.y2 + dy, width=g.width + 2 * pixels, height=g.height + 2 * pixels)


@dataclass(frozen=True)
class Grid:
    """Pixels over a box; a pixel's centre lies half a pixel in, and world to pixel takes the floor."""

    x1: float
    y1: float
    x2: float
    y2: float
    width: int
    height: int

    @property
    def sx(self) -> float:
        return (self.x2 - self.x1) / self.width

    @property
    def sy(self) -> float:
        return (self.y2 - self.y1) / self.height

    def px(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x1)) / F.lit(self.sx))

    def py(self, y: Column) -> Column:
        return F.floor((y - F.lit(self.y1)) / F.lit(self.sy))

    def cx(self, px: Column) -> Column:
        return F.lit(self.x1) + (px + 0.5) * F.lit(self.sx)

    def cy(self, py: Column) -> Column:
        return F.lit(self.y1) + (py + 0.5) * F.lit(self.sy)

    def inside(self, px: Column, py: Column) -> Column:
        return px.between(0, self.width - 1) & py.between(0, self.height - 1)


@dataclass(frozen=True)
class Unit:
    measurement: str = "unknown"
    unit: str = "unknown"
    min: float | None = None
    max: float | None = None
    interpolation: str = "unknown"
    classes: dict[int, str] = field(default_factory=dict)

    @staticmethod
    def from_json(text: str | dict) -> Unit:
        d = json.loads(text) if isinstance(text, str) else text
        if "measurement" not in d or "unit" not in d:
            raise QueryError("a unit needs measurement and unit")
        classes = {}
        if d["unit"].lower() == "classification":
            if not d.get("classes"):
                raise QueryError("a classification needs classes")
            try:
                classes = {int(k): v for k, v in d["classes"].items()}
            except ValueError as e:
                raise QueryError("class keys are integers") from e
        return Unit(d["measurement"], d["unit"], d.get("min"), d.get("max"), d.get("interpolation", "unknown"), classes)

    def to_json(self) -> dict:
        out = {"measurement": self.measurement, "unit": self.unit, "interpolation": self.interpolation}
        out |= {"min": self.min, "max": self.max} if self.min is not None else {}
        return out | ({"classes": {str(k): v for k, v in self.classes.items()}} if self.classes else {})

    def is_a(self, measurement: str) -> bool:
        return self.measurement.lower() == measurement.lower()


@dataclass
class Frame:
    """A DataFrame with what its kind needs beside the columns."""

    df: DataFrame
    kind: str
    rect: Rect
    grid: Grid | None = None
    has_time: bool = False
    unit: Unit = field(default_factory=Unit)
    datatype: str = "Float64"
    globals: dict[str, float | str] = field(default_factory=dict)
    provenance: list[dict] = field(default_factory=list)


def in_rect(rect: Rect, *, has_time: bool) -> Column:
    """Single points (x, y) in the closed box, and valid at some time of the half-open interval."""
    x, y = F.col("x"), F.col("y")
    where = (x >= rect.x1) & (x <= rect.x2) & (y >= rect.y1) & (y <= rect.y2)
    return where & in_time(rect.t1, rect.t2) if has_time else where


def in_time(t1: float, t2: float) -> Column:
    return (F.col("t1") < t2) & (F.col("t2") > t1)
