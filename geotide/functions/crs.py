"""Closed-form projections as column expressions: EPSG:4326, EPSG:3857 and the geostationary view SR-ORG:81."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..model import QueryError, Rect

R = 6378137.0
#: The whole extent of a reference system; others are unbounded.
EXTENTS = {"EPSG:4326": (-180.0, -90.0, 180.0, 90.0), "EPSG:3857": (-20037508.34, -20037508.34, 20037508.34, 20037508.34), "SR-ORG:81": (-5568748.276, -5568748.276, 5568748.276, 5568748.276)}
_A, _B, _H = 6378169.0, 6356583.8, 35785831.0


def extent(crs: str) -> tuple[float, float, float, float]:
    inf = math.inf
    return EXTENTS.get(crs, (-inf, -inf, inf, inf))


def _to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    fine = F.abs(y) < 90
    return F.when(fine, F.radians(x) * R), F.when(fine, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * R)


def _from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / R), F.degrees(F.lit(2.0) * F.atan(F.exp(y / R)) - math.pi / 2)


def _to_geos(x: Column, y: Column) -> tuple[Column, Column]:
    """As seen from the satellite over 0 E; null beyond the horizon."""
    lon, lat = F.radians(x), F.atan(F.tan(F.radians(y)) * (_B / _A) ** 2)
    e2 = 1 - (_B / _A) ** 2
    rl = F.lit(_B) / F.sqrt(1 - e2 * F.cos(lat) ** 2)
    d = _A + _H
    rx, ry, rz = d - rl * F.cos(lat) * F.cos(lon), rl * F.cos(lat) * F.sin(lon), rl * F.sin(lat)
    seen = d * (d - rx) - (d - rx) ** 2 - ry**2 - (_A / _B) ** 2 * rz**2 > 0
    return F.when(seen, F.atan(ry / rx) * _H), F.when(seen, F.asin(rz / F.sqrt(rx**2 + ry**2 + rz**2)) * _H)


def _from_geos(x: Column, y: Column) -> tuple[Column, Column]:
    a, b = x / _H, y / _H
    d, k = _A + _H, (_A / _B) ** 2
    q = F.cos(b) ** 2 + k * F.sin(b) ** 2
    root = (d * F.cos(a) * F.cos(b)) ** 2 - q * (d * d - _A * _A)
    sn = F.when(root >= 0, (d * F.cos(a) * F.cos(b) - F.sqrt(F.greatest(root, F.lit(0.0)))) / q)
    s1, s2, s3 = d - sn * F.cos(a) * F.cos(b), sn * F.sin(a) * F.cos(b), sn * F.sin(b)
    return F.degrees(F.atan(s2 / s1)), F.degrees(F.atan(k * s3 / F.sqrt(s1**2 + s2**2)))


_TO: dict[str, Callable] = {"EPSG:4326": lambda x, y: (x, y), "EPSG:3857": _to_mercator, "SR-ORG:81": _to_geos}
_FROM: dict[str, Callable] = {"EPSG:4326": lambda x, y: (x, y), "EPSG:3857": _from_mercator, "SR-ORG:81": _from_geos}


def transform(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    """x and y in another reference system; null where it does not reach."""
    for c in (src, dst):
        if c not in _TO:
            raise QueryError(f"no closed form for {c}")
    return (x, y) if src == dst else _TO[dst](*_FROM[src](x, y))


def border(rect: Rect, n: int = 20) -> list[tuple[float, float]]:
    """``n`` points along the border, from the lower left corner on, evenly spaced on each side."""
    per = n // 4
    out = []
    for k in range(per):
        f = k / per
        w, h = rect.x2 - rect.x1, rect.y2 - rect.y1
        out += [(rect.x1 + f * w, rect.y1), (rect.x2, rect.y1 + f * h), (rect.x2 - f * w, rect.y2), (rect.x1, rect.y2 - f * h)]
    return out


def project_rect(spark, rect: Rect, dst: str) -> tuple[float, float, float, float]:
    """The box in ``dst`` around the projected border."""
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in border(rect)])
    rows = spark.range(1).select(F.inline(pts)).select(*[c.alias(n) for c, n in zip(transform(F.col("x"), F.col("y"), rect.crs, dst), "xy")])
    r = rows.filter("x is not null and y is not null").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        raise QueryError("the rectangle lies outside the projection")
    return tuple(r)
