"""Mixing sources to target weights by capped water-filling, on DataFrame functions only.

Each source asks for its share of ``share`` times all words by weight. A source stops at ``cap`` epochs, and what
it cannot take is shared out again by weight until none is above its cap. Sorted by cap per weight, the capped
sources are a prefix, so the fixed point needs one ordered pass over the sources instead of rounds.

A source of rate r = target / size takes floor(r) whole repetitions of each document and samples the fraction by
systematic selection: documents of a stratum, in order of size, are picked at every 1/f-th place from a seeded
start. Strata are hashed parts of a source of about ``stratum`` documents, so no task holds a whole source. A
document above ``whole_max`` of its source is too coarse to be picked whole: it takes the fraction as a part of
its words. The plan of a rerun is the same.

The ordered passes run over one row a source in one task: sources are to be collections, up to some hundred thousand, not
single sites.

Null texts have size 0, very long ones are counted whole; a null source is a source of its own, last in order; sources
without words get target 0; an empty table gives an empty plan; repeated rows are planned row by row, equal places in
the order of sizes go by a hash and by id; other columns are ignored, or kept as asked, but for columns named as one
of the plan's; names with _gt_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .runtime import table, uniform

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size, ...) with weight and target; one row a source, so the ordered passes are small."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    table_of = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(table_of, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_all", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    by_ratio = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    full = ranked.withColumn("_full", F.col("_cap") / F.col("weight") <= (F.col("_all") - before) / after)
    level = (F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(W.partitionBy())) / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy())
    return full.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * level)).drop("_cap", "_all", "_full")


def plan(
    spark: SparkSession,
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
    stratum: int = 512,
    whole_max: float = 0.002,
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole repetitions), part (words of a last, partial one), taken."""
    keep = tuple(c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken"))
    held = [f"_gt_{k}" for k in range(len(keep))]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = table(spark, docs.select("doc_id", "source", *[F.col(c).alias(h) for c, h in zip(keep, held)], size.alias("size")), "mix")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    filled = water_fill(totals, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (
        sized.join(filled.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epochs", F.floor(rate))
        .withColumn("_f", rate - F.floor(rate))
        .withColumn("_u", uniform(seed, F.col("doc_id")))
        .withColumn("_stratum", F.floor(F.col("_u") * F.ceil(F.col("_rows") / stratum)))
        .withColumn("_coarse", F.col("size") > F.col("source_size") * F.lit(whole_max))
    )
    place = F.row_number().over(W.partitionBy("source", "_stratum", "_coarse").orderBy("size", "_u", "doc_id"))
    start = uniform(seed + 1, F.col("source"), F.col("_stratum"))
    picked = F.floor(F.col("_place") * F.col("_f") + start) > F.floor((F.col("_place") - 1) * F.col("_f") + start)
    part = F.when(F.col("_coarse"), F.floor(F.col("_f") * F.col("size") + F.col("_u"))).when(picked, F.col("size")).otherwise(0)
    return planned.withColumn("_place", place).withColumn("part", part.cast("long")).select(
        "doc_id", "source", *[F.col(h).alias(c) for c, h in zip(keep, held)], "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "part",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
    )


def repeat(planned: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each repetition of a planned document that kept its text, a partial one cut after ``part`` words."""
    times = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = planned.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("part").cast("int"))
    return rows.withColumn(text, F.when((F.col("epoch") > F.col("epochs")) & (F.col("part") < F.col("size")), F.array_join(words, " ")).otherwise(F.col(text)))
