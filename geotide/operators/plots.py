"""Terminal results: histograms, statistics, scatter data and circle clusters."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def value_range(df: DataFrame, column: str) -> tuple[float, float]:
    r = df.filter(f"{column} is not null and not isnan({column})").agg(F.min(column), F.max(column)).first()
    return (float(r[0]), float(r[1])) if r[0] is not None else (0.0, 0.0)


def histogram(df: DataFrame, column: str, lo: float, hi: float, buckets: int = 0, integer: bool = False) -> DataFrame:
    """bucket, lower, upper, n for every bucket, and bucket -1 for values out of range or without data.

    Equal widths, the maximum in the last bucket. 0 buckets: the root of the number of rows; whole-numbered data takes
    no more than max - min + 1; an empty range takes one.
    """
    if buckets <= 0:
        buckets = max(1, math.isqrt(df.count()))
    if integer:
        buckets = min(buckets, int(hi - lo) + 1)
    buckets = 1 if lo == hi else buckets
    width = (hi - lo) / buckets
    v = F.col(column).cast("double")
    inside = v.isNotNull() & ~F.isnan(v) & (v >= lo) & (v <= hi)
    at = F.least(F.floor((v - lo) / (hi - lo) * buckets), F.lit(buckets - 1)) if hi > lo else F.lit(0)
    counts = df.select(F.when(inside, at).otherwise(-1).cast("long").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(-1, buckets).withColumnRenamed("id", "bucket")
    edge = lambda k: F.when(F.col("bucket") >= 0, F.lit(float(lo)) + (F.col("bucket") + k) * width)
    return every.join(counts, "bucket", "left").select("bucket", edge(0).alias("lower"), edge(1).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def numeric_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, count, nan_count, min, max, mean, stddev (population; null with fewer than two values) in one pass."""
    aggs = []
    for c in columns:
        v = F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
        aggs.append(F.struct(F.lit(c).alias("name"), F.count(v).alias("count"), (F.count(F.lit(1)) - F.count(v)).alias("nan_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_pop(v)).alias("stddev")))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def text_statistics(df: DataFrame, column: str, top: int = 20, least: float = 0.001) -> DataFrame:
    """value, n of the most frequent texts with at least that share, the most frequent first, then by text."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("_all") * least).drop("_all").orderBy(F.desc("n"), "value").limit(top)  # one row


def statistics(df: DataFrame, numeric: list[str], textual: list[str], top: int = 20) -> DataFrame:
    """A row for each numeric and each text attribute: name, kind, count, missing, min, max, mean, stddev, distinct and the
    most frequent texts as ``top`` (value, n)."""
    nothing = {"distinct": "bigint", "top": "array<struct<value:string,n:bigint>>"}
    parts = [numeric_statistics(df, numeric).withColumn("kind", F.lit("numeric")).withColumnRenamed("nan_count", "missing").withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})] if numeric else []
    for c in textual:
        best = text_statistics(df, c, top).agg(F.collect_list(F.struct("value", "n")).alias("top"))  # at most ``top`` rows
        counts = df.agg(F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct"))
        row = counts.crossJoin(F.broadcast(best)).withColumns({"name": F.lit(c), "kind": F.lit("text")})  # one row each
        parts.append(row.withColumns({m: F.lit(None).cast("double") for m in ("min", "max", "mean", "stddev")}))
    columns = ["name", "kind", "count", "missing", "min", "max", "mean", "stddev", "distinct", "top"]
    return reduce(lambda a, b: a.unionByName(b), [p.select(columns) for p in parts])


def scatter(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with all values, sorted by them."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]
    out = df
    for f in fine:
        out = out.filter(f)
    return out.select(*columns).orderBy(*columns)


def scatter_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows lack a value, and the least and greatest of each column among the others."""
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    ends = [f(F.when(fine, F.col(c))).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.agg(F.count_if(~fine).alias("nodata"), *ends)


def scatter_json(df: DataFrame, columns: list[str]) -> str:
    ends = scatter_ranges(df, columns).first()
    data = [list(r) for r in scatter(df, columns).toLocalIterator()]
    ranges = [{"min": ends[f"{c}_min"], "max": ends[f"{c}_max"]} for c in columns]
    return json.dumps({"type": "xygraph", "metadata": {"dimensions": len(columns), "nodata": ends["nodata"], "numberOfPoints": len(data), "range": ranges}, "data": data})


def statistics_json(stats: DataFrame) -> str:
    out = {}
    for r in stats.collect():  # a row for each attribute
        out[r["name"]] = {"type": "numeric", "count": r["count"], "nan_count": r["missing"], "min": r["min"], "max": r["max"], "mean": r["mean"], "stddev": r["stddev"]} if r["kind"] == "numeric" else {"type": "text", "count": r["count"], "distinct": r["distinct"], "top": {t["value"]: t["n"] for t in r["top"]}}
    return json.dumps({"type": "layer_statistics", "data": out})


def histogram_json(hist: DataFrame, unit: dict | None = None) -> str:
    rows = sorted(hist.collect(), key=lambda r: r["bucket"])
    inside = [r for r in rows if r["bucket"] >= 0]
    meta = {"type": "histogram", "metadata": {"min": inside[0]["lower"], "max": inside[-1]["upper"], "nodata": rows[0]["n"], "numberOfBuckets": len(inside), "unit": unit or {}}}
    return json.dumps(meta | {"data": [r["n"] for r in inside]})


def cluster_cells(points: DataFrame, resolution: float, min_radius: float, numeric: list[str] = [], textual: list[str] = []) -> DataFrame:
    """First stage of circle clustering: points by grid cell, with count, centre, sums of squares and up to five texts."""
    size = resolution * min_radius * 2
    cell = [F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")]
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"{c}_var")]
    for c in textual:
        aggs.append(F.array_sort(F.slice(F.array_sort(F.collect_set(c)), 1, 5)).alias(f"{c}_texts"))
    return points.groupBy(*cell).agg(*aggs)


def cluster(points: DataFrame, resolution: float, min_radius: float = 5, min_distance: float = 1) -> DataFrame:
    """x, y, radius, n of circles that do not overlap: cells first, then circles merged in order of size and place.

    The merge depends on order and works on cells, not points; it is one task by its nature, over as many rows as cells.
    """
    cells = cluster_cells(points, resolution, min_radius).select(F.lit(0).alias("one"), "n", "x", "y")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        todo = rows.sort_values(["n", "x", "y"], ascending=[False, True, True])[["x", "y", "n"]].to_numpy().tolist()
        radius = lambda n: (min_radius + math.log(n)) * resolution
        out: list[list[float]] = []
        while todo:
            x, y, n = todo.pop(0)
            hit = next((k for k, (a, b, m) in enumerate(out) if math.hypot(a - x, b - y) < radius(m) + radius(n) + min_distance * resolution), None)
            if hit is None:
                out.append([x, y, n])
            else:
                a, b, m = out.pop(hit)
                todo.insert(0, [(a * m + x * n) / (m + n), (b * m + y * n) / (m + n), m + n])
        return pd.DataFrame({"x": [o[0] for o in out], "y": [o[1] for o in out], "radius": [radius(o[2]) for o in out], "n": [int(o[2]) for o in out]})

    return cells.groupBy("one").applyInPandas(merge, "x double, y double, radius double, n long")


def circle_merge(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> tuple[float, float]:
    """Mean and variance of two groups (n, mean, variance) pooled."""
    (n, m, v), (k, p, w) = a[:3], b[:3]
    mean = (n * m + k * p) / (n + k)
    return mean, (n * (v + (m - mean) ** 2) + k * (w + (p - mean) ** 2)) / (n + k)


def as_json_lines(df: DataFrame) -> Iterator[str]:
    return (r for r in df.toJSON().toLocalIterator())
