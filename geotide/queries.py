"""One query for each operator over the driver's tables, with the same in SQL.

Points come from customers and events, a monthly raster series from line items, polygons are literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import crs
from .functions.geometry import KINDS, parse_wkt
from .functions.timeops import Step, TimeShift
from .model import Frame, Grid, Rect, in_rect
from .operators import combined, features, plots, rasters, satellite
from .plans.tree import Run, run_query
from .streaming.validity import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY = 86400.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Derived relations.


def seconds(column: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) / 1000000D"


def points(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.selectExpr("c_custkey as id", "((c_custkey * 37) % 3600) / 10D - 180D as x", "((c_custkey * 53) % 1800) / 10D - 90D as y", "c_acctbal as num", "c_mktsegment as txt")


def timed(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.selectExpr("event_id as id", "((event_id * 37) % 3600) / 10D - 180D as x", "((event_id * 53) % 1800) / 10D - 90D as y", f"{seconds('ts')} as t1", f"{seconds('ts')} + 3600D as t2", "value as num", "event_type as txt")


GRID = Grid(-180, -90, 180, 90, 64, 32)


def series(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("cast(l_partkey % 64 as bigint) as px", "cast(l_suppkey % 32 as bigint) as py", "trunc(cast(l_shipdate as date), 'MM') as m", "l_quantity", "l_extendedprice")
    return li.groupBy("m", "px", "py").agg(F.max("l_quantity").alias("value"), F.max("l_extendedprice").alias("price")).select((F.unix_date("m") * DAY).alias("t1"), (F.unix_date(F.add_months("m", 1)) * DAY).alias("t2"), "px", "py", "value", "price")


def flat(spark: SparkSession, d: str, column: str = "l_quantity", line: int | None = None) -> DataFrame:
    """An image of all line items: quantities summed, prices by their maximum; ``line``: the band of one line number."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    li = li if line is None else li.filter(F.col("l_linenumber") == line)
    value = F.sum(column) % 50 + 1 if line is None and column == "l_quantity" else F.max(column)
    return li.groupBy((F.col("l_partkey") % 64).alias("px"), (F.col("l_suppkey") % 32).alias("py")).agg(value.alias("value")).select(F.lit(0.0).alias("t1"), F.lit(DAY).alias("t2"), "px", "py", "value")


P = "p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 3600) / 10::DOUBLE - 180 AS x, ((c_custkey * 53) % 1800) / 10::DOUBLE - 90 AS y, c_acctbal AS num, c_mktsegment AS txt FROM customer)"
T = "e AS (SELECT event_id AS id, ((event_id * 37) % 3600) / 10::DOUBLE - 180 AS x, ((event_id * 53) % 1800) / 10::DOUBLE - 90 AS y, epoch_us(ts) / 1000000::DOUBLE AS t1, epoch_us(ts) / 1000000::DOUBLE + 3600 AS t2, value AS num, event_type AS txt FROM events)"
R = "r AS (SELECT epoch_us(date_trunc('month', l_shipdate)::TIMESTAMP) / 1000000::DOUBLE AS t1, epoch_us((date_trunc('month', l_shipdate) + INTERVAL 1 MONTH)::TIMESTAMP) / 1000000::DOUBLE AS t2, l_partkey % 64 AS px, l_suppkey % 32 AS py, max(l_quantity) AS value, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)"


def _flat(name: str, column: str = "l_quantity", line: int | None = None) -> str:
    value = "sum(l_quantity) % 50 + 1" if line is None and column == "l_quantity" else f"max({column})"
    where = "" if line is None else f"WHERE l_linenumber = {line}"
    return f"{name} AS (SELECT l_partkey % 64 AS px, l_suppkey % 32 AS py, {value} AS value FROM lineitem {where} GROUP BY ALL)"


POLYGONS = [
    (1, "POLYGON((-100 -40, 20 -60, 60 10, -30 70, -120 30, -100 -40))", 694224000.0, 757382400.0),
    (2, "POLYGON((35 10, 45 45, 15 40, 10 20, 35 10),(20 30, 35 35, 30 20, 20 30))", 725846400.0, 820454400.0),
    (3, "MULTIPOLYGON(((40 40, 20 45, 45 30, 40 40)),((20 35, 10 30, 10 10, 30 5, 45 20, 20 35),(30 20, 20 15, 20 25, 30 20)),((-170 -80, -60 -80, -60 -10, -170 -10, -170 -80)))", 694224000.0, 1893456000.0),
]


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, parse_wkt(w)[1], a, b) for i, w, a, b in POLYGONS], f"id long, geom {KINDS['polygons']}, t1 double, t2 double")


def _polygon_sql() -> str:
    rows = []
    for pid, w, _, _ in POLYGONS:
        for k, poly in enumerate(parse_wkt(w)[1]):
            for r, ring in enumerate(poly):
                rows += [f"({pid}, {k}, {r}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ring, ring[1:])]
    times = ", ".join(f"({pid}, {a}::DOUBLE, {b}::DOUBLE)" for pid, _, a, b in POLYGONS)
    return f"edge(pid, poly, ring, xi, yi, xj, yj) AS (VALUES {', '.join(rows)}), ptime(pid, p1, p2) AS (VALUES {times})"


def _hits(points: str, key: str) -> str:
    """(key..., pid) of points in polygons by edge parity."""
    return f"""ringhit AS (SELECT {key}, pid, poly, ring FROM {points}, edge WHERE ((yi < y AND yj >= y) OR (yj < y AND yi >= y)) AND xi + (y - yi) / (yj - yi) * (xj - xi) < x GROUP BY {key}, pid, poly, ring HAVING count(*) % 2 = 1),
hit AS (SELECT DISTINCT {key}, pid FROM (SELECT {key}, pid, poly FROM ringhit GROUP BY {key}, pid, poly HAVING min(ring) = 0 AND max(ring) = 0))"""


RECT = Rect(-60, -30, 90.5, 60)


# Filters.


@query(f"WITH {P} SELECT * FROM p WHERE x BETWEEN -60 AND 90.5 AND y BETWEEN -30 AND 60")
def bbox_filter(spark, d):
    return points(spark, d).filter(in_rect(RECT, has_time=False))


@query(f"WITH {T} SELECT id, x, y, t1, t2 FROM e WHERE x BETWEEN -60 AND 90.5 AND y BETWEEN -30 AND 60 AND t1 < 1706745600 AND t2 > 1704844800")
def st_filter_time(spark, d):
    return timed(spark, d).filter(in_rect(Rect(-60, -30, 90.5, 60, 1704844800.0, 1706745600.0), has_time=True)).select("id", "x", "y", "t1", "t2")


@query(f"WITH {P} SELECT id, num FROM p WHERE num BETWEEN -100 AND 5000")
def numeric_filter(spark, d):
    return features.numeric_filter(points(spark, d), "num", -100, 5000).select("id", "num")


@query(f"WITH {P} SELECT id, num FROM p WHERE num > 0")
def numeric_filter_default_min(spark, d):
    return features.numeric_filter(points(spark, d), "num").select("id", "num")


@query(f"WITH {P} SELECT id FROM p WHERE num < 0 OR num BETWEEN 100 AND 300")
def numeric_filter_nodata(spark, d):
    marked = points(spark, d).withColumn("num", F.when(F.col("num") < 0, float("nan")).otherwise(F.col("num")))
    return features.numeric_filter(marked, "num", 100, 300, True).select("id")


@query(f"WITH {P} SELECT id, txt FROM p WHERE txt = 'BUILDING'")
def text_exact(spark, d):
    return features.textual_filter(points(spark, d), "txt", "exact", "BUILDING").select("id", "txt")


@query(f"WITH {P} SELECT id, txt FROM p WHERE contains(txt, 'UILD')")
def text_contains(spark, d):
    return features.textual_filter(points(spark, d), "txt", "contains", "UILD").select("id", "txt")


@query(f"WITH {P} SELECT id, txt FROM p WHERE starts_with(txt, 'MA')")
def text_startswith(spark, d):
    return features.textual_filter(points(spark, d), "txt", "startswith", "MA").select("id", "txt")


# Joins.


@query(f"WITH {P} SELECT id, x, y, num FROM p a WHERE num > 1000 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.num > 4000 AND b.x = a.x AND b.y = a.y)")
def difference_eps0(spark, d):
    tree = lambda lo: {"type": "numeric_attribute_filter", "params": {"name": "num", "rangeMin": lo}, "sources": {"points": [{"type": "table_source", "params": {"name": "points"}}]}}
    run = Run(spark, {"points": lambda s, r: Frame(points(s, d).filter(in_rect(r, has_time=False)), "points", r)})
    asked = {"query": {"type": "difference", "sources": {"points": [tree(1000.000001), tree(4000.000001)]}}, "spatial_reference": {"x1": -180, "y1": -90, "x2": 180, "y2": 90}}
    return run_query(run, asked).df.select("id", "x", "y", "num")


@query(f"WITH {P} SELECT id FROM p a WHERE num > 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.num <= 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9)")
def difference_eps(spark, d):
    p = points(spark, d)
    return features.difference(p.filter("num > 0"), p.filter("num <= 0"), 3.0).select("id")


@query(f"WITH {P}, {_polygon_sql()}, {_hits('p', 'id')} SELECT DISTINCT id FROM hit")
def pip_no_time(spark, d):
    return features.point_in_polygon(points(spark, d), polygons(spark)).select("id")


@query(f"WITH {P}, {_polygon_sql()}, {_hits('p', 'id')} SELECT DISTINCT id FROM hit WHERE pid = 2")
def pip_hole(spark, d):
    return features.point_in_polygon(points(spark, d), polygons(spark).filter("id = 2")).select("id")


def _islands(points: str, t1: str, t2: str) -> str:
    return f"""WITH {P}, {T}, {_polygon_sql()}, {_hits(points, 'id')},
v AS (SELECT h.id, greatest({t1}, t.p1) AS t1, least({t2}, t.p2) AS t2 FROM hit h JOIN {points} q USING (id) JOIN ptime t USING (pid) WHERE greatest({t1}, t.p1) < least({t2}, t.p2)),
m AS (SELECT *, CASE WHEN t1 < max(t2) OVER (PARTITION BY id ORDER BY t1, t2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY t1, t2 ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT id, min(t1) AS t1, max(t2) AS t2 FROM g GROUP BY id, island"""


@query(_islands("p", "-62135596800::DOUBLE", "253402300799::DOUBLE"))
def pip_time_merge(spark, d):
    return features.point_in_polygon(points(spark, d), polygons(spark), polygon_time=True).select("id", "t1", "t2")


@query(_islands("e", "q.t1", "q.t2"))
def pip_time_split(spark, d):
    return features.point_in_polygon(timed(spark, d), polygons(spark), point_time=True, polygon_time=True).select("id", "t1", "t2")


# Projection and time.


@query(f"WITH {P} SELECT id, round(radians(x) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) AS y FROM p WHERE abs(y) < 80")
def project_4326_3857(spark, d):
    rect = Rect(-2.1e7, *[-2.1e7, 2.1e7, 2.1e7], crs="EPSG:3857")
    out = combined.project_points(points(spark, d).filter("abs(y) < 80"), "EPSG:4326", rect)
    return out.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {P} SELECT id, round(degrees(x * 10000 / 6378137.0), 6) AS x, round(degrees(2 * atan(exp(y * 10000 / 6378137.0)) - pi() / 2), 6) AS y FROM p")
def project_back(spark, d):
    m = points(spark, d).withColumns({"x": F.col("x") * 10000, "y": F.col("y") * 10000})
    x, y = crs.transform(F.col("x"), F.col("y"), "EPSG:3857", "EPSG:4326")
    return m.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {T} SELECT id, t1 - 432000 AS t1, t2 - 432000 AS t2 FROM e WHERE t1 < 1705708800 + 432000 AND t2 > 1704844800 + 432000")
def timeshift_relative(spark, d):
    shift = TimeShift(Step("days", 5), Step("days", 5))
    source = lambda r: timed(spark, d).filter(in_rect(r, has_time=True)).select("id", "t1", "t2")
    return combined.shifted(source, Rect(-180, -90, 180, 90, 1704844800.0, 1705708800.0), shift)


@query(f"WITH {T} SELECT id, t1 + 777600 AS t1, t2 + 2592000 - 1036800 AS t2 FROM e WHERE t1 < 1705708800 + 1036800 AND t2 + 2592000 > 1704844800 - 777600")
def timeshift_snap(spark, d):
    shift = TimeShift(Step(snap_unit="dayInMonth", snap_value=1, reset=True), Step(snap_unit="monthInYear", snap_value=2, reset=True))
    longer = timed(spark, d).withColumn("t2", F.col("t2") + 2592000)
    source = lambda r: longer.filter(in_rect(r, has_time=True)).select("id", "t1", "t2")
    return combined.shifted(source, Rect(-180, -90, 180, 90, 1704844800.0, 1705708800.0), shift)


# Rasters.


@query(f"WITH {_flat('a', line=1)}, {_flat('b', line=2)} SELECT px, py, a.value * 2 + b.value / 4 - 1 AS value FROM a JOIN b USING (px, py)")
def expression_add(spark, d):
    return rasters.expression([flat(spark, d, line=1), flat(spark, d, line=2)], "A * 2 + B / 4 - 1").select("px", "py", "value")


@query(f"WITH {_flat('a', line=1)}, {_flat('b', line=2)} SELECT px, py, CASE WHEN a.value > b.value AND a.value > 40 THEN a.value - b.value ELSE abs(b.value * 1.5) END::DOUBLE AS value FROM a JOIN b USING (px, py)")
def expression_ternary(spark, d):
    return rasters.expression([flat(spark, d, line=1), flat(spark, d, line=2)], "A > B && A > 40 ? A - B : abs(B * 1.5)").select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT px, py, (((a.value::BIGINT & 12) << 3) | (a.value::BIGINT >> 1))::DOUBLE AS value FROM a")
def expression_bits(spark, d):
    return rasters.expression([flat(spark, d)], "((A & 12) << 3) | (A >> 1)", integer=[True]).select("px", "py", "value")


@query(f"WITH {_flat('a')} SELECT px, py, CASE WHEN value BETWEEN 45 AND 50 THEN 3 WHEN value BETWEEN 20 AND 47 THEN 2 ELSE 1 END::DOUBLE AS value FROM a WHERE value BETWEEN 45 AND 50 OR value BETWEEN 20 AND 47 OR value BETWEEN 1 AND 10")
def classification_overlap(spark, d):
    return rasters.classification(flat(spark, d), [(1, 10, 1), (20, 47, 2), (45, 50, 3)]).select("px", "py", "value")


@query(
    f"""WITH {_flat('a', line=1)}, {_flat('b', line=2)}, {_flat('c', line=3)},
u AS (SELECT px, py FROM a UNION SELECT px, py FROM b UNION SELECT px, py FROM c),
s AS (SELECT px, py, greatest(0, least(255, floor(255 * (a.value - 1) / 49 + 0.5)))::BIGINT AS r, greatest(0, least(255, floor(255 * 2 * (b.value - 1) / 49 + 0.5)))::BIGINT AS g, greatest(0, least(255, floor(255 * (c.value - 10) / 40 + 0.5)))::BIGINT AS b FROM a JOIN b USING (px, py) JOIN c USING (px, py))
SELECT px, py, coalesce(r | (g << 8) | (s.b << 16) | 4278190080, 0)::BIGINT AS value FROM u LEFT JOIN s USING (px, py)"""
)
def rgba_composite(spark, d):
    return rasters.rgba([flat(spark, d, line=k) for k in (1, 2, 3)], [(1, 50, 1.0), (1, 50, 2.0), (10, 50, 1.0)]).select("px", "py", "value")


START, SPAN = 788918400.0, 150 * DAY


def _temporal(agg: str) -> str:
    value = "round(avg(value), 6)" if agg == "avg" else f"{agg}(value)"
    return f"WITH {R}, w AS (SELECT * FROM r WHERE t1 < {START + SPAN} AND t2 > {START}), n AS (SELECT count(DISTINCT t1) AS n, min(t1) AS t1, max(t2) AS t2 FROM w) SELECT n.t1, n.t2, px, py, {value} AS value FROM w, n GROUP BY px, py, n.n, n.t1, n.t2 HAVING count(*) = n.n"


def _temporal_query(how: str) -> Query:
    def run(spark, d):
        out = rasters.temporal_aggregation(series(spark, d), how, START, SPAN)
        return out.withColumn("value", F.round("value", 6)) if how == "avg" else out

    run.__name__ = f"temporal_agg_{how}"
    return query(_temporal(how))(run)


temporal_agg_min, temporal_agg_max, temporal_agg_avg = (_temporal_query(h) for h in ("min", "max", "avg"))


@query(
    f"""WITH {_flat('a')}, k(i, w) AS (VALUES (0,1),(1,2),(2,1),(3,2),(4,4),(5,2),(6,1),(7,2),(8,1)),
t AS (SELECT x.range AS px, y.range AS py FROM range(64) x, range(32) y)
SELECT t.px, t.py, sum(a.value * w)::DOUBLE AS value FROM t, k JOIN a ON a.px = greatest(0, least(63, t.px + i % 3 - 1)) AND a.py = greatest(0, least(31, t.py + i // 3 - 1)) GROUP BY t.px, t.py HAVING count(*) = 9"""
)
def matrix_kernel(spark, d):
    return rasters.matrix(flat(spark, d), GRID, [1, 2, 1, 2, 4, 2, 1, 2, 1], 3).select("px", "py", "value")


@query(
    f"""WITH {_flat('a')}, t AS (SELECT x.range AS px, y.range AS py FROM range(50) x, range(40) y),
w AS (SELECT px, py, floor((-170.0 + (px + 0.5) * (330.0 / 50) + 180) / 5.625)::BIGINT AS sx, floor((-85.0 + (py + 0.5) * (180.0 / 40) + 90) / 5.625)::BIGINT AS sy FROM t)
SELECT w.px, w.py, value FROM w JOIN a ON a.px = sx AND a.py = sy"""
)
def fit_raster(spark, d):
    return rasters.fit(flat(spark, d), GRID, Grid(-170, -85, 160, 95, 50, 40)).select("px", "py", "value")


@query(f"WITH {P}, {_flat('a')} SELECT id, coalesce(value, 'NaN'::DOUBLE) AS v, 0::DOUBLE AS t1, 86400::DOUBLE AS t2 FROM p LEFT JOIN a ON a.px = floor((x + 180) / 5.625) AND a.py = floor((y + 90) / 5.625)")
def extract_points(spark, d):
    return combined.extract(points(spark, d), {"v": flat(spark, d)}, GRID).select("id", "v", "t1", "t2")


@query(f"WITH {T}, {R}, s AS (SELECT id, x, y, t1 - 946684800 + 189302400 AS t FROM e) SELECT id, coalesce(value, 'NaN'::DOUBLE) AS v FROM s LEFT JOIN r ON r.px = floor((x + 180) / 5.625) AND r.py = floor((y + 90) / 5.625) AND t >= r.t1 AND t < r.t2")
def extract_points_time(spark, d):
    moved = timed(spark, d).withColumn("t1", F.col("t1") - 946684800 + 189302400)
    return combined.extract_over_time(moved, {"v": series(spark, d)}, GRID).select("id", "v")


_CENTRES = "c AS (SELECT x.range AS px, y.range AS py, -180 + (x.range + 0.5) * 5.625 AS x, -90 + (y.range + 0.5) * 5.625 AS y FROM range(64) x, range(32) y)"


@query(f"WITH {_CENTRES}, {_polygon_sql()}, {_hits('c', 'px, py')}, {_flat('a')} SELECT pid::BIGINT AS id, round(avg(value), 6) AS v_mean, round(stddev_samp(value), 6) AS v_stdev, min(value) AS v_min, max(value) AS v_max FROM hit JOIN a USING (px, py) GROUP BY pid")
def extract_zonal(spark, d):
    out = combined.extract_zonal(polygons(spark), flat(spark, d), GRID, "id", "v")
    return out.filter("not isnan(v_mean)").select("id", F.round("v_mean", 6).alias("v_mean"), F.round("v_stdev", 6).alias("v_stdev"), "v_min", "v_max")


@query(f"WITH {_CENTRES}, {_polygon_sql()}, {_hits('c', 'px, py')} SELECT DISTINCT px, py, 1::DOUBLE AS value FROM hit")
def rasterize_polygon_grid(spark, d):
    return combined.rasterize_polygons(polygons(spark), GRID)


def _heat(value: bool) -> str:
    cell = "avg(num)" if value else "count(*)::DOUBLE"
    out = "round(sum(v * w) / sum(w), 6)" if value else "floor(least(sum(v * w) * 10, max(w) * 255))"
    return f"""WITH {P}, cell AS (SELECT floor((x + 90) / 2.8125)::BIGINT AS px, floor((y + 45) / 2.8125)::BIGINT AS py, {cell} AS v FROM p GROUP BY 1, 2),
o AS (SELECT x.range - 4 AS dx, y.range - 4 AS dy, 1 - sqrt((x.range - 4) ** 2 + (y.range - 4) ** 2) / 4 AS w FROM range(9) x, range(9) y WHERE sqrt((x.range - 4) ** 2 + (y.range - 4) ** 2) < 4)
SELECT px + dx AS px, py + dy AS py, {out} AS value FROM cell, o WHERE px + dx BETWEEN 0 AND 63 AND py + dy BETWEEN 0 AND 31 GROUP BY 1, 2"""


HEAT = Grid(-90, -45, 90, 45, 64, 32)


@query(_heat(False))
def heatmap_freq(spark, d):
    return combined.heatmap(points(spark, d), HEAT, 4)


@query(_heat(True))
def heatmap_value(spark, d):
    return combined.heatmap(points(spark, d), HEAT, 4, "num").withColumn("value", F.round("value", 6))


# Plots.


def _hist(lo: float, hi: float, n: str) -> str:
    return f"""WITH b AS (SELECT {n}::BIGINT AS n), v AS (SELECT CASE WHEN l_quantity BETWEEN {lo} AND {hi} THEN least(floor((l_quantity - {lo}) / {hi - lo} * b.n), b.n - 1) ELSE -1 END::BIGINT AS bucket FROM lineitem, b),
c AS (SELECT bucket, count(*) AS n FROM v GROUP BY bucket) SELECT k.range AS bucket, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT unnest(range(-1, (SELECT n FROM b))) AS range) k LEFT JOIN c ON c.bucket = k.range"""


@query(_hist(5.0, 45.0, "10"))
def histogram_minmax(spark, d):
    return plots.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 5, 45, 10).select("bucket", "n")


@query(_hist(1.0, 50.0, "least(greatest(1, floor(sqrt((SELECT count(*) FROM lineitem)))), 50)"))
def histogram_data(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return plots.histogram(li, "l_quantity", *plots.value_range(li, "l_quantity"), integer=True).select("bucket", "n")


@query("SELECT 'l_quantity' AS name, count(*) AS count, 0::BIGINT AS nan_count, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS stddev FROM lineitem UNION ALL SELECT 'l_tax', count(*), 0::BIGINT, min(l_tax), max(l_tax), round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem")
def stats_numeric(spark, d):
    out = plots.numeric_statistics(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_tax"])
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 0.001 * (SELECT count(*) FROM part) ORDER BY n DESC, value LIMIT 20")
def stats_text_topk(spark, d):
    return plots.text_statistics(spark.read.parquet(f"{d}/part.parquet"), "p_brand")


@query(f"WITH {P} SELECT num, y FROM p WHERE num > 0 ORDER BY num, y")
def xy_graph(spark, d):
    marked = points(spark, d).withColumn("num", F.when(F.col("num") > 0, F.col("num")).otherwise(float("nan")))
    return plots.scatter(marked, ["num", "y"])


@query(f"WITH {P} SELECT floor(x / 10)::BIGINT AS i, floor(y / 10)::BIGINT AS j, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(num), 4) AS num_mean, round(var_pop(num), 6) AS num_var FROM p GROUP BY 1, 2")
def cluster_grid(spark, d):
    out = plots.cluster_cells(points(spark, d), 1.0, 5, ["num"])
    return out.select("i", "j", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("num_mean", 4).alias("num_mean"), F.round("num_var", 6).alias("num_var"))


@query()
def cluster_circles(spark, d):
    return plots.cluster(points(spark, d), 0.5)


# Satellite images: prices stand for counts.

IMAGE = satellite.Image(9, 9, -10.4568, 0.205034)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return flat(spark, d, "l_extendedprice").withColumn("value", F.floor(F.col("value") % 900 + 100).cast("double"))


_RAW = f"{_flat('f', 'l_extendedprice')}, a AS (SELECT px, py, floor(value % 900 + 100)::DOUBLE AS value FROM f)"


@query(f"WITH {_RAW} SELECT px, py, round(-10.4568 + value * 0.205034, 6) AS value FROM a")
def meteosat_radiance(spark, d):
    return satellite.radiance(raw(spark, d), IMAGE).select("px", "py", F.round("value", 6).alias("value"))


@query(f"WITH {_RAW} SELECT px, py, round((0.0143877523 * 100 * 931.700 / ln(1.19104273e-16 * 1e6 * 931.700 ** 3 / ((-10.4568 + value * 0.205034) * 1e-5) + 1) - 0.6400) / 0.9983, 4) AS value FROM a")
def meteosat_temperature(spark, d):
    return satellite.temperature(raw(spark, d), IMAGE).select("px", "py", F.round("value", 4).alias("value"))


VIEW, NOON = Grid(-4000000, -4000000, 4000000, 4000000, 64, 32), 1325419200.0


def _sun_sql(value: str) -> str:
    s, f = satellite.Sun.at(NOON), satellite.VIEW_ANGLE
    return f"""WITH {_RAW}, v AS (SELECT px, py, value, radians((px * 125000.0 - 4000000) * -({f!r})) AS va, radians((py * 250000.0 - 4000000) * ({f!r})) AS vb FROM a),
q AS (SELECT *, cos(vb) ** 2 + 1.006803 * sin(vb) ** 2 AS q, 42164 * cos(va) * cos(vb) AS along FROM v),
n AS (SELECT *, CASE WHEN along ** 2 - q * 1737121856 >= 0 THEN (along - sqrt(greatest(along ** 2 - q * 1737121856, 0))) / q END AS sn FROM q),
l AS (SELECT *, 42164 - sn * cos(va) * cos(vb) AS s1, sn * sin(va) * cos(vb) AS s2, -sn * sin(vb) AS s3 FROM n),
g AS (SELECT *, atan(1.006804 * s3 / sqrt(s1 ** 2 + s2 ** 2)) AS lat, degrees(atan(s2 / s1)) AS lon FROM l),
h AS (SELECT *, radians({s.sidereal * 15!r} + lon) - {s.ascension!r} AS h FROM g),
z AS (SELECT *, acos(cos(lat) * cos(h) * {math.cos(s.declination)!r} + {math.sin(s.declination)!r} * sin(lat)) AS z FROM h),
d AS (SELECT *, degrees(z + {satellite.EARTH_RADIUS / satellite.ASTRONOMICAL_UNIT!r} * sin(z)) AS zenith FROM z)
SELECT px, py, {value} AS value FROM d"""


@query(_sun_sql("round(zenith, 5)"))
def meteosat_solar_angle(spark, d):
    return satellite.solar_angle(raw(spark, d), VIEW, NOON, "zenith").select("px", "py", F.round("value", 5).alias("value"))


@query(_sun_sql(f"round(value * {(1 - 0.0167 * math.cos(2 * math.pi * (1 - 3) / 365)) ** 2!r} / {satellite.ETSR[9][0] / math.pi!r} / cos(radians(least(zenith, 80))), 4)").replace("least(zenith, 80)", "CASE WHEN zenith IS NULL THEN 80 ELSE least(zenith, 80) END"))
def meteosat_reflectance(spark, d):
    return satellite.reflectance(raw(spark, d), satellite.Image(9, 1, 0.0, 1.0), VIEW, NOON).select("px", "py", F.round("value", 4).alias("value"))


_BT = ", ".join(f"{n} AS (SELECT px, py, 200 + value AS value FROM {n}0)" for n in "abc")


@query(f"WITH {_flat('a0', line=1)}, {_flat('b0', line=2)}, {_flat('c0', line=3)}, {_BT} SELECT px, py, round((a.value ** 4 + b.value ** 4 - (b.value - (b.value - c.value) / 4) ** 4) ** 0.25, 5) AS value FROM a JOIN b USING (px, py) JOIN c USING (px, py)")
def meteosat_co2_correction(spark, d):
    r = [flat(spark, d, line=k).withColumn("value", F.col("value") + 200) for k in (1, 2, 3)]
    return satellite.co2_correction(*r).select("px", "py", F.round("value", 5).alias("value"))


LOW = Grid(-180, -90, 180, 90, 21, 10)


def low_band(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a third of the image's resolution."""
    return flat(spark, d, "l_extendedprice").filter("px < 63 and py < 30").groupBy(F.floor(F.col("px") / 3).alias("px"), F.floor(F.col("py") / 3).alias("py")).agg((F.max("value") % 90 + 5).alias("value")).select(F.lit(0.0).alias("t1"), F.lit(DAY).alias("t2"), "px", "py", F.floor("value").cast("double").alias("value"))


def _sharp_sql(coarse: str, weight: str) -> str:
    return f"""WITH {_flat('hrv')}, {_flat('pr', 'l_extendedprice')},
low AS (SELECT px // 3 AS px, py // 3 AS py, floor(max(value) % 90 + 5)::DOUBLE AS value FROM pr WHERE px < 63 AND py < 30 GROUP BY ALL),
co AS ({coarse}),
pair AS (SELECT px, py, ln(low.value + 0.1) AS v, ln(co.h) AS h FROM low JOIN co USING (px, py)),
s AS (SELECT px, py, sum(w) AS n, sum(w * h) AS x, sum(w * v) AS y, sum(w * h * v) AS xy, sum(w * h * h) AS xx FROM
  (SELECT px + dx.range - 2 AS px, py + dy.range - 2 AS py, h, v, {weight} AS w FROM pair, range(5) dx, range(5) dy) GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN abs(n * xx - x * x) > 1e-9 * n * xx AND abs((n * xy - x * y) / (n * xx - x * x)) <= 20 THEN (n * xy - x * y) / (n * xx - x * x) ELSE 0 END AS b FROM s)
SELECT z.px, z.py, round(least(exp((b.y - b.b * b.x) / b.n) * z.value ** b.b - 0.1, 80), 4) AS value FROM hrv z JOIN b ON b.px = z.px // 3 AND b.py = z.py // 3 JOIN pair ON pair.px = b.px AND pair.py = b.py"""


_NEAR = "1 / greatest(sqrt((dx.range - 2) ** 2 + (dy.range - 2) ** 2), 0.5)"


@query(_sharp_sql("SELECT px // 3 AS px, py // 3 AS py, avg(value) AS h FROM hrv GROUP BY 1, 2 HAVING count(*) = 9", _NEAR))
def meteosat_pansharpening(spark, d):
    return satellite.pansharpen(low_band(spark, d), flat(spark, d), LOW, cap=80.0).select("px", "py", F.round("value", 4).alias("value"))


_RESPONSE = ", ".join(f"({k % 9 - 4}, {k // 9 - 4}, {satellite.RESPONSE[k // 9][k % 9]!r})" for k in range(81))
_MIRROR = "(CASE WHEN l.px * 3 + 1 - dx BETWEEN 0 AND 62 THEN 1 ELSE 2 END) * (CASE WHEN l.py * 3 + 1 - dy BETWEEN 0 AND 29 THEN 1 ELSE 2 END)"


@query(
    _sharp_sql(
        f"SELECT l.px, l.py, sum(value * r * {_MIRROR}) AS h FROM (SELECT x.range AS px, y.range AS py FROM range(21) x, range(10) y) l, (VALUES {_RESPONSE}) m(dx, dy, r) JOIN hrv ON hrv.px = l.px * 3 + 1 + dx AND hrv.py = l.py * 3 + 1 + dy WHERE hrv.px > 0 AND hrv.py > 0 AND hrv.px < 63 AND hrv.py < 30 GROUP BY ALL",
        "1.0",
    )
)
def meteosat_pansharpening_spatial(spark, d):
    image = flat(spark, d).filter("px < 63 and py < 30")
    return satellite.pansharpen(low_band(spark, d), image, LOW, cap=80.0, spatial=True, distance=False).select("px", "py", F.round("value", 4).alias("value"))


DAYTIME, NIGHT = (0.0, 80.0), (93.0, 180.0)


def thermal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A difference of temperatures from -25 to 25 and a zenith angle."""
    difference = rasters.expression([flat(spark, d)], "A - 26.0")
    return difference, flat(spark, d, "l_extendedprice").withColumn("value", F.col("value") % 180)


_THERMAL = f"{_flat('q')}, {_flat('pr', 'l_extendedprice')}, dz AS (SELECT px, py, q.value - 26 AS d, pr.value % 180 AS z FROM q JOIN pr USING (px, py))"
_PARTS = "CASE WHEN z >= 0 AND z < 80 THEN 'day' WHEN z >= 93 AND z < 180 THEN 'night' END"


@query(f"WITH {_THERMAL} SELECT {_PARTS} AS part, least(floor((d + 25) / 0.5), 99)::BIGINT AS bucket, count(*) AS n FROM dz WHERE {_PARTS} IS NOT NULL AND d BETWEEN -25 AND 25 GROUP BY 1, 2")
def meteosat_gccthermthresholddetection_plot(spark, d):
    return satellite.thermal_histogram(*thermal(spark, d), day=DAYTIME, night=NIGHT, span=(-25.0, 25.0))


def _threshold_sql() -> str:
    """The search as SQL over the 100 buckets, cold to warm: the land peak from -5 degrees (bucket 40) on, then running
    states from there down."""
    return f"""WITH RECURSIVE {_THERMAL},
hist AS (SELECT p.part, k.range AS k, coalesce(c.n, 0) AS n FROM (VALUES ('day'), ('night')) p(part) CROSS JOIN range(100) k
  LEFT JOIN (SELECT {_PARTS} AS part, least(floor((d + 25) / 0.5), 99)::BIGINT AS bucket, count(*) AS n FROM dz WHERE d BETWEEN -25 AND 25 GROUP BY 1, 2) c ON c.part = p.part AND c.bucket = k.range),
land AS (SELECT part, arg_max(k, n * 1000 - k) AS land FROM hist WHERE k >= 40 GROUP BY part),
down(part, k, least, rising, over, soft, merged) AS (
  SELECT part, land, land, 0, false, 0, 0 FROM land
  UNION ALL
  SELECT s.part, h.k,
    CASE WHEN s.over OR h.n > u.n OR h.n >= l.n THEN s.least ELSE h.k END,
    CASE WHEN s.over THEN s.rising WHEN h.n > u.n THEN s.rising + 1 ELSE greatest(s.rising - 1, 0) END,
    s.over OR (h.n > u.n AND s.rising + 1 >= 3),
    CASE WHEN u.n > 0 AND h.n / u.n::DOUBLE > 0.8 AND h.n / u.n::DOUBLE <= 1.0 THEN s.soft + 1 ELSE 0 END,
    CASE WHEN s.merged = 0 AND u.n > 0 AND h.n / u.n::DOUBLE > 0.8 AND h.n / u.n::DOUBLE <= 1.0 AND s.soft + 1 >= 3 THEN h.k + s.soft + 1 ELSE s.merged END
  FROM down s JOIN hist h ON h.part = s.part AND h.k = s.k - 1 JOIN hist u ON u.part = s.part AND u.k = s.k JOIN hist l ON l.part = s.part AND l.k = s.least),
done AS (SELECT * FROM down WHERE k = 0),
peak AS (SELECT d.*, coalesce((SELECT min(h.k) FROM hist h JOIN hist l ON l.part = h.part AND l.k = d.least WHERE h.part = d.part AND h.k < d.least AND h.n > l.n), d.least) AS cloud FROM done d),
found AS (SELECT part, CASE WHEN rising < 3 OR least * 0.5 - 25 < -12 OR (cloud <> least AND CASE WHEN cloud * 0.5 - 25 <> 0 THEN (least * 0.5 - 25) / (cloud * 0.5 - 25) > 0.85 ELSE least * 0.5 - 25 > 0 END)
  THEN merged * 0.5 - 25 ELSE least * 0.5 - 25 END AS t FROM peak)
SELECT px, py, CASE WHEN z::FLOAT BETWEEN 93 AND 180 THEN (SELECT t FROM found WHERE part = 'night') WHEN z::FLOAT BETWEEN 80 AND 93 THEN -9999 ELSE (SELECT t FROM found WHERE part = 'day') END::DOUBLE AS value FROM dz"""


@query(_threshold_sql())
def meteosat_gccthermthresholddetection(spark, d):
    difference, zenith = thermal(spark, d)
    found = satellite.thermal_thresholds(difference, zenith, day=DAYTIME, night=NIGHT, span=(-25.0, 25.0))
    return satellite.threshold_raster(zenith, found, DAYTIME, NIGHT).select("px", "py", "value")


# Streams.


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) / 1000000::DOUBLE AS t1, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) / 1000000::DOUBLE + 3600 AS t2, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, d):
    out = windowed(spark.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", "value")
    return out.withColumn("mean", F.round("mean", 6))
