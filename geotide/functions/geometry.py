"""Geometry as column expressions over nested arrays, and well-known text.

A ring or line is array<struct<x, y>>, a polygon an array of rings (shell first), a feature an array of lines or
polygons.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..model import QueryError, Rect

POINT = "struct<x:double,y:double>"
KINDS = {"points": f"array<{POINT}>", "lines": f"array<array<{POINT}>>", "polygons": f"array<array<array<{POINT}>>>"}


def segments(ring: Column) -> Column:
    """A ring's or line's segments as structs (a, b)."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an edge counts if it spans y half-open (below, up to) and meets it strictly left of x."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = ((a["y"] < y) & (b["y"] >= y)) | ((b["y"] < y) & (a["y"] >= y))
        return spans & (a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"]) < x)

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def in_polygons(polygons: Column, x: Column, y: Column) -> Column:
    """In the shell and in no hole of any polygon."""
    return F.exists(polygons, lambda p: in_ring(p[0], x, y) & ~F.exists(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: in_ring(r, x, y)))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Segments ab and cd share a point: by orientation, with the collinear cases."""

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def on(p: Column, q: Column, r: Column) -> Column:
        return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    touch = ((o1 == 0) & on(a, b, c)) | ((o2 == 0) & on(a, b, d)) | ((o3 == 0) & on(c, d, a)) | ((o4 == 0) & on(c, d, b))
    return ((o1 != o2) & (o3 != o4)) | touch


def _corner(x: float, y: float) -> Column:
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))


def box_edges(r: Rect) -> list[tuple[Column, Column]]:
    c = [_corner(r.x1, r.y1), _corner(r.x2, r.y1), _corner(r.x2, r.y2), _corner(r.x1, r.y2)]
    return [(c[k], c[(k + 1) % 4]) for k in range(4)]


def in_box(p: Column, r: Rect) -> Column:
    return p["x"].between(r.x1, r.x2) & p["y"].between(r.y1, r.y2)


def line_meets_box(line: Column, r: Rect) -> Column:
    def hit(s: Column) -> Column:
        found = in_box(s["a"], r)
        for a, b in box_edges(r):
            found = found | segments_meet(s["a"], s["b"], a, b)
        return found

    return F.exists(segments(line), hit)


def lines_meet_box(lines: Column, r: Rect) -> Column:
    return F.exists(lines, lambda line: line_meets_box(line, r))


def polygons_meet_box(polygons: Column, r: Rect) -> Column:
    """A corner of the box in the feature, or a shell that meets the box."""
    corner = F.lit(False)
    for x in (r.x1, r.x2):
        for y in (r.y1, r.y2):
            corner = corner | in_polygons(polygons, F.lit(x), F.lit(y))
    return corner | F.exists(polygons, lambda p: line_meets_box(p[0], r))


def bounds(points: Column) -> Column:
    """x1, y1, x2, y2 of a flat array of points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def polygon_bounds(polygons: Column) -> Column:
    return bounds(F.flatten(F.flatten(polygons)))


# Well-known text.

Points = list[tuple[float, float]]
_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"bad text at {at}: {text[at:at + 20]!r}")
        out.append(m.group(1))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _tokens(text), 0

    def next(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise QueryError("the text ends early")
        t = self.tokens[self.at]
        self.at += 1
        if want and t != want:
            raise QueryError(f"{want!r} expected, {t!r} found")
        return t

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def many(self, item) -> list:
        if self.peek().upper() == "EMPTY":
            self.next()
            return []
        self.next("(")
        out = [item()]
        while self.peek() == ",":
            self.next()
            out.append(item())
        self.next(")")
        return out

    def coordinate(self) -> tuple[float, float]:
        if self.peek() == "(":
            self.next()
            c = self.coordinate()
            self.next(")")
            return c
        return float(self.next()), float(self.next())

    def line(self) -> Points:
        return self.many(self.coordinate)

    def ring(self) -> Points:
        r = self.line()
        if len(r) < 4 or r[0] != r[-1]:
            raise QueryError("a ring is closed and has four coordinates or more")
        return r

    def polygon(self) -> list[Points]:
        return self.many(self.ring)

    def geometry(self) -> tuple[str, list]:
        kind = self.next().upper()
        if kind == "POINT":
            return "points", self.many(self.coordinate)
        if kind == "MULTIPOINT":
            return "points", self.many(self.coordinate)
        if kind == "LINESTRING":
            return "lines", [self.line()]
        if kind == "MULTILINESTRING":
            return "lines", self.many(self.line)
        if kind == "POLYGON":
            return "polygons", [self.polygon()]
        if kind == "MULTIPOLYGON":
            return "polygons", self.many(self.polygon)
        raise QueryError(f"no geometry: {kind}")


def parse_wkt(text: str) -> tuple[str, list]:
    """Kind and coordinates of one geometry."""
    r = _Reader(text)
    out = r.geometry()
    if r.peek():
        raise QueryError("text after the geometry")
    return out


def parse_collection(text: str) -> list[tuple[str, list]]:
    r = _Reader(text)
    if r.next().upper() != "GEOMETRYCOLLECTION":
        raise QueryError("a GEOMETRYCOLLECTION is expected")
    return r.many(r.geometry)


def wkt(geom: Column, kind: str) -> Column:
    """Well-known text of a feature column."""

    def pt(p: Column) -> Column:
        return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))

    def run(a: Column, item) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(a, item), ","), F.lit(")"))

    one, many, item = {
        "points": ("POINT", "MULTIPOINT", pt),
        "lines": ("LINESTRING", "MULTILINESTRING", lambda a: run(a, pt)),
        "polygons": ("POLYGON", "MULTIPOLYGON", lambda p: run(p, lambda a: run(a, pt))),
    }[kind]
    single = F.concat(F.lit(one), F.concat(F.lit("("), pt(geom[0]), F.lit(")")) if kind == "points" else item(geom[0]))
    return F.when(F.size(geom) == 1, single).otherwise(F.concat(F.lit(many), run(geom, item)))
