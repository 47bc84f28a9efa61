"""Queries of formulas, time, rasters and shapes that need no file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.geometry import KINDS, parse_wkt
from .functions.timeops import Step, TimeShift
from .model import Frame, Grid, Rect, Unit, in_rect
from .operators import combined, plots, rasters
from .plans.tree import Run, run_query
from .queries import DAY, GRID, P, R, START, T, _flat, flat, points, polygons, query, series, timed
from .queries_io import _edges, ask, corners

# Formulas over one image of whole numbers from 1 to 50.

A = "(a.value / 8 - 3)"  # negative and fractional values too


def formula(name: str, text: str, sql: str, places: int = 9) -> None:
    """A query of one formula over A and its SQL over {A}."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        image = flat(spark, d).withColumn("value", F.col("value") / 8 - 3)
        return rasters.expression([image], text).select("px", "py", F.round("value", places).alias("value"))

    run.__name__ = f"formula_{name}"
    value = sql.replace("{A}", A)
    query(f"WITH {_flat('a')}, v AS (SELECT px, py, round(({value})::DOUBLE, {places}) AS value FROM a) SELECT * FROM v WHERE value IS NOT NULL AND NOT isnan(value)")(run)


formula("trigonometry", "sin(A) + asin(A / 4) - cos(A) * acos(A / 4) + tan(A) + atan(A)", "sin({A}) + asin({A} / 4) - cos({A}) * acos({A} / 4) + tan({A}) + atan({A})")
formula("mod", "mod(A, 0.75) + 10 * fmod(A, -2)", "({A} - 0.75 * trunc({A} / 0.75)) + 10 * ({A} - 2 * trunc({A} / 2))")
formula("remainder", "remainder(A, 2)", "{A} - 2 * round_even({A} / 2, 0)")
formula("ceil_floor", "ceil(A) + 100 * floor(A)", "ceil({A}) + 100 * floor({A})")
formula("round", "round(A * 4)", "round({A} * 4)")
formula("trunc", "trunc(A)", "trunc({A})")
formula("fract", "fract(A) + abs(A) + fabs(A)", "{A} - floor({A}) + 2 * abs({A})")
formula("pow", "pow(abs(A) + 1, 1.5)", "(abs({A}) + 1) ** 1.5", 6)
formula("sqrt_exp", "A >= 0 ? sqrt(A) + exp(A) : exp(A)", "CASE WHEN {A} >= 0 THEN sqrt(greatest({A}, 0)) + exp({A}) ELSE exp({A}) END", 6)
formula("exp2_exp10", "exp2(A) + exp10(A)", "2.0::DOUBLE ** {A} + 10.0::DOUBLE ** {A}", 5)
formula("logarithms", "log(abs(A) + 1) + log2(abs(A) + 1) + log10(abs(A) + 1)", "ln(abs({A}) + 1) + log2(abs({A}) + 1) + log10(abs({A}) + 1)")
formula("min_max", "min(A, 0.5) + 10 * max(A, -0.5)", "least({A}, 0.5) + 10 * greatest({A}, -0.5)")
formula("logic", "!(A > 1) && (A != 0 || A <= -2) ? 1 : (A == 0 ? 7 : 2)", "CASE WHEN NOT ({A} > 1) AND ({A} <> 0 OR {A} <= -2) THEN 1 WHEN {A} = 0 THEN 7 ELSE 2 END")


@query(f"WITH {_flat('a')} SELECT px, py, (a.value::BIGINT // 7 + a.value::BIGINT // 2 * 100)::DOUBLE AS value FROM a")
def formula_integer_division(spark, d):
    return rasters.expression([flat(spark, d)], "A / 7 + A / 2 * 100", integer=[True]).select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT px, py, CASE WHEN v > 127 THEN v - 256 ELSE v END::DOUBLE AS value FROM (SELECT px, py, ((value * 9)::BIGINT % 256 + 256) % 256 AS v FROM a) t".replace("CASE WHEN v > 127 THEN v - 256 ELSE v END", "v"))
def expression_byte_wraps(spark, d):
    return rasters.expression([flat(spark, d)], "A * 9.5 - A * 0.5", "Byte").select("px", "py", "value")


# Filters by the tree, and by any predicate.


@query(f"WITH {P} SELECT id, num FROM p WHERE num BETWEEN 10 AND 4000")
def points_filter_by_range(spark, d):
    tree = {"type": "points_filter_by_range", "params": {"name": "num", "rangeMin": 10, "rangeMax": 4000}, "sources": {"points": [{"type": "table_source", "params": {"name": "p"}}]}}
    return ask(spark, tree, tables={"p": lambda s, r: Frame(points(s, d), "points", r)}).df.select("id", "num")


@query(f"WITH {P} SELECT id FROM p WHERE x * y > 100 AND txt <> 'BUILDING'")
def predicate_filter(spark, d):
    return points(spark, d).filter((F.col("x") * F.col("y") > 100) & (F.col("txt") != "BUILDING")).select("id")


@query(f"WITH {P} SELECT id, x FROM p WHERE id % 3 = 1")
def mask_filter(spark, d):
    """A mask is a column: rows where it is set stay."""
    keep = points(spark, d).select("id", (F.col("id") % 3 == 1).alias("keep"))
    return points(spark, d).join(keep.filter("keep"), "id", "left_semi").select("id", "x")


@query("SELECT * FROM (VALUES (2), (3)) t(id)")
def numeric_filter_polygons(spark, d):
    tree = {"type": "numeric_attribute_filter", "params": {"name": "num", "rangeMin": 1.5, "rangeMax": 9}, "sources": {"polygons": [{"type": "table_source", "params": {"name": "p"}}]}}
    return ask(spark, tree, tables={"p": lambda s, r: Frame(polygons(s).withColumn("num", F.col("id").cast("double")), "polygons", r)}).df.select(F.col("id").cast("int").alias("id"))


# Projections of shapes and rasters.

_R = "6378137.0"
_MERC = f"round(radians(x) * {_R}, 3) AS x, round(ln(tan(pi() / 4 + radians(y) / 2)) * {_R}, 3) AS y"
EUROPE = Rect(0.0, 0.0, 6e6, 6e6, crs="EPSG:3857")


@query(f"WITH {_edges('c')} SELECT id, poly, ring, place, {_MERC} FROM c WHERE id <= 2")
def projection_polygons(spark, d):
    """The tree asks its source for the rectangle of the other reference system."""
    tree = {"type": "projection", "params": {"src_projection": "EPSG:4326", "dest_projection": "EPSG:3857"}, "sources": {"polygons": [{"type": "table_source", "params": {"name": "p"}}]}}
    asked = {"query": tree, "spatial_reference": {"projection": "EPSG:3857", "x1": EUROPE.x1, "y1": EUROPE.y1, "x2": EUROPE.x2, "y2": EUROPE.y2}}
    out = run_query(Run(spark, {"p": lambda s, r: Frame(polygons(s).filter("id <= 2"), "polygons", r)}), asked).df
    return corners(out).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


LINES = [(1, "MULTILINESTRING((12 12, 12 11, 15 12), (2 2, 2 1, 5 2))"), (2, "LINESTRING(-10 -10, 10 10)"), (3, "LINESTRING(-20 -20, -10 -10)"), (4, "LINESTRING(1 1, 2 90)"), (5, "LINESTRING(-5 20, 30 85)")]


def lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, parse_wkt(w)[1]) for i, w in LINES], f"id long, geom {KINDS['lines']}")


def _line_rows() -> str:
    return ", ".join(f"({i}, {p}, {k}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for i, w in LINES if i in (1, 2, 5) for p, line in enumerate(parse_wkt(w)[1]) for k, (x, y) in enumerate(line))


@query(f"WITH c(id, part, place, x, y) AS (VALUES {_line_rows()}) SELECT id, part, place, {_MERC} FROM c")
def projection_lines(spark, d):
    """A line that does not project at one end goes, as does one that misses the rectangle."""
    out = combined.project_shapes(lines(spark), "lines", "EPSG:4326", EUROPE)
    out = out.select(F.col("id").cast("int").alias("id"), F.posexplode("geom").alias("part", "_l")).select("id", "part", F.posexplode("_l").alias("place", "_q"))
    return out.select("id", "part", "place", F.round("_q.x", 3).alias("x"), F.round("_q.y", 3).alias("y"))


@query(f"""WITH {_flat('a')}, t AS (SELECT x.range AS px, y.range AS py, degrees((-1e7 + (x.range + 0.5) * 5e5) / {_R}) AS lon, degrees(2 * atan(exp((-1e7 + (y.range + 0.5) * 1e6) / {_R})) - pi() / 2) AS lat FROM range(40) x, range(20) y)
SELECT t.px, t.py, a.value FROM t JOIN a ON a.px = floor((lon + 180) / 5.625) AND a.py = floor((lat + 90) / 5.625)""")
def projection_raster(spark, d):
    return combined.project_raster(flat(spark, d), GRID, "EPSG:4326", Grid(-1e7, -1e7, 1e7, 1e7, 40, 20), "EPSG:3857").select("px", "py", "value")


# Time.


@query(f"WITH {T} SELECT id, t1 - {1705000000 - 1704844800} AS t1, t2 - {1705000000 - 1704844800} - {200000 - 864000} AS t2 FROM e WHERE t1 < 1705200000 AND t2 > 1705000000 AND t1 - {1705000000 - 1704844800} < t2 - {1705000000 - 1704844800} - {200000 - 864000}")
def timeshift_absolute(spark, d):
    """The time asked for is set to fixed moments; the result's times move back by as much."""
    shift = TimeShift(Step("absolute", 1705000000.0), Step("absolute", 1705200000.0))
    source = lambda r: timed(spark, d).filter(in_rect(r, has_time=True)).select("id", "t1", "t2")
    return combined.shifted(source, Rect(-180, -90, 180, 90, 1704844800.0, 1705708800.0), shift)


@query(f"WITH {T} SELECT id, t1, t2 - 864000 AS t2 FROM e WHERE t1 < 1706572800 AND t2 > 1704844800 AND t1 < t2 - 864000 UNION ALL SELECT id, t1 + 432000, t2 - 432000 FROM (SELECT id, t1 - 432000 AS t1, t2 + 864000 AS t2 FROM e) WHERE t1 < 1706140800 AND t2 > 1704412800 AND t1 + 432000 < t2 - 432000")
def timeshift_stretch(spark, d):
    """Twice the interval: from its start, and from its centre."""
    out = []
    for fixed, longer in (("start", 0), ("center", 864000)):
        base = timed(spark, d).withColumns({"t1": F.col("t1") - (432000 if longer else 0), "t2": F.col("t2") + longer})
        source = lambda r, base=base: base.filter(in_rect(r, has_time=True)).select("id", "t1", "t2")
        out.append(combined.shifted(source, Rect(-180, -90, 180, 90, 1704844800.0, 1705708800.0), TimeShift(factor=2.0, fixed=fixed)))
    return out[0].unionByName(out[1])


@query(f"WITH {R} SELECT t1 - 31622400 AS t1, t2 - 31622400 AS t2, px, py, value FROM r WHERE t1 < 820540800 + 31622400 AND t2 > 820454400 + 31622400")
def timeshift_raster(spark, d):
    """The raster a year later, at the time asked for."""
    shift = TimeShift(Step("years", 1), Step("years", 1))
    source = lambda r: series(spark, d).filter((F.col("t1") < r.t2) & (F.col("t2") > r.t1)).select("t1", "t2", "px", "py", "value")
    return combined.shifted(source, Rect(-180, -90, 180, 90, 820454400.0, 820540800.0), shift)


SAMPLES = 120 * DAY


@query(f"""WITH {R}, m AS (SELECT {START} + k.range * {SAMPLES} / 3 AS s FROM range(4) k), b AS (SELECT s, (SELECT max(t1) FROM r WHERE r.t1 <= s) AS t1 FROM m)
SELECT px, py, round(sum(value) / 4, 6) AS value FROM b JOIN r USING (t1) GROUP BY px, py HAVING count(*) = 4""")
def temporal_samples(spark, d):
    """Rasters valid at instants: the mean over the last ones at four moments."""
    instants = series(spark, d).withColumn("t2", F.col("t1") + 0.001)
    return rasters.temporal_samples(instants, "avg", START, SAMPLES).select("px", "py", F.round("value", 6).alias("value"))


# Rasters.


@query(f"WITH {_flat('a')} SELECT px, py, CASE WHEN value BETWEEN 30 AND 50 THEN -0.5 WHEN value BETWEEN 10 AND 30 THEN 2.25 END::DOUBLE AS value FROM a WHERE value >= 10")
def replacement_by_range(spark, d):
    return rasters.replace_by_range(flat(spark, d), [(10, 30, 2.25), (30, 50, -0.5)]).select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT px - 10 AS px, py - 5 AS py, value FROM a WHERE px BETWEEN 10 AND 29 AND py BETWEEN 5 AND 14")
def raster_cut(spark, d):
    return rasters.cut(flat(spark, d), 10, 5, 20, 10).select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT x.range AS px, y.range AS py, value FROM range(100) x, range(20) y JOIN a ON a.px = floor((x.range + 0.5) * 0.64) AND a.py = floor((y.range + 0.5) * 1.6)")
def raster_scale(spark, d):
    return rasters.scale(flat(spark, d), 64, 32, 100, 20).select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT 63 - px AS px, 31 - py AS py, value FROM a")
def raster_flip(spark, d):
    return rasters.flip(flat(spark, d), GRID, x=True, y=True).select("px", "py", "value")


@query(f"WITH {_flat('a')}, b AS (SELECT px + 50 AS px, py + 20 AS py, value + 1000 AS value FROM a WHERE px < 14 AND py < 12 AND value > 10) SELECT px, py, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (px, py)")
def raster_blit(spark, d):
    part = flat(spark, d).filter("px < 20 and py < 20 and value > 10").withColumn("value", F.col("value") + 1000)
    return rasters.blit(flat(spark, d), part, 50, 20, GRID).select("px", "py", "value")


@query(f"WITH {_flat('a')}, g AS (SELECT x.range AS px, y.range AS py FROM range(64) x, range(32) y) SELECT px, py, coalesce(CASE WHEN value > 25 THEN value END, 0)::DOUBLE AS value FROM g LEFT JOIN a USING (px, py)")
def raster_no_data(spark, d):
    """As bytes of a unit from 1 to 50, no-data is 0."""
    return rasters.with_no_data(flat(spark, d).filter("value > 25"), GRID, "Byte", Unit(min=1.0, max=50.0))


# Plots.


@query(f"WITH {P}, f AS (SELECT num, y, num > 0 AS fine FROM p) SELECT count(*) FILTER (NOT fine) AS nodata, min(num) FILTER (fine) AS num_min, max(num) FILTER (fine) AS num_max, min(y) FILTER (fine) AS y_min, max(y) FILTER (fine) AS y_max FROM f")
def feature_attributes_ranges(spark, d):
    marked = points(spark, d).withColumn("num", F.when(F.col("num") > 0, F.col("num")).otherwise(float("nan")))
    return plots.scatter_ranges(marked, ["num", "y"])


@query(f"WITH {P} SELECT 'num' AS name, count(num) AS count, 0::BIGINT AS missing, round(avg(num), 6) AS mean, NULL::BIGINT AS distinct_ FROM p UNION ALL SELECT 'txt', count(*), 0, NULL, count(DISTINCT txt) FROM p")
def statistics_of_features(spark, d):
    out = plots.statistics(points(spark, d), ["num"], ["txt"])
    return out.select("name", "count", "missing", F.round("mean", 6).alias("mean"), F.col("distinct").alias("distinct_"))


@query(f"WITH {R}, v AS (SELECT value FROM r WHERE t1 <= 820454400 AND t2 > 820454400), b AS (SELECT least(greatest(1, floor(sqrt((SELECT count(*) FROM v)))), max(value) - min(value) + 1)::BIGINT AS n, min(value) AS lo, max(value) AS hi FROM v), c AS (SELECT least(floor((value - lo) / (hi - lo) * n), n - 1)::BIGINT AS bucket, count(*) AS k FROM v, b GROUP BY 1) SELECT x.range AS bucket, coalesce(k, 0)::BIGINT AS n FROM (SELECT unnest(range(0, (SELECT n FROM b))) AS range) x LEFT JOIN c ON c.bucket = x.range")
def histogram_of_raster(spark, d):
    """A whole-numbered raster has no more buckets than values."""
    s = lambda sp, r: Frame(series(sp, d).filter((F.col("t1") <= r.t1) & (F.col("t2") > r.t1)).select("t1", "t2", "px", "py", "value"), "raster", r, grid=GRID, has_time=True, datatype="Int16")
    tree = {"type": "histogram", "params": {"range": "data"}, "sources": {"raster": [{"type": "table_source", "params": {"name": "s"}}]}}
    return ask(spark, tree, time=(820454400.0, 820454401.0), tables={"s": s}).df.filter("bucket >= 0").select("bucket", "n")


# Registered functions.


@query(f"WITH {P} SELECT txt, count(*) AS n, round(avg(num), 6) AS mean FROM p GROUP BY txt")
def python_script(spark, d):
    """A function that the caller registered by name, over the frames of its sources."""
    means = lambda frames: frames[0].df.groupBy("txt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("num"), 6).alias("mean"))
    tree = {"type": "r_script", "params": {"name": "means", "result": "plot"}, "sources": {"points": [{"type": "table_source", "params": {"name": "p"}}]}}
    return ask(spark, tree, tables={"p": lambda s, r: Frame(points(s, d), "points", r)}, python={"means": means}).df

