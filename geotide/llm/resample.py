"""Quality selection by importance resampling of hashed n-gram models.

Words and word pairs fall into ``buckets`` hashed buckets. Two bag-of-n-grams models with add-one smoothing are
counted: the target's from documents labelled good (at most ``most_targets``, chosen by a hash of the id) and the raw
text's from all documents. A document's log weight is the sum over its n-grams of log(target / raw). Documents are
sampled without replacement by Gumbel top-k: key = log weight + Gumbel noise seeded by the id, and the ``share`` of
rows with the largest keys is kept, exactly: a search by bits over the keys, in steps of 2**-20, finds the boundary in
four counting passes; equal keys go by a hash of the id, rows equal in both by their place in the written table.

score is the logistic of the mean log ratio times ``sharpness``, a length-free view of the same model.

Texts without words have log weight 0 and score 0.5; very long texts are counted whole; null ids share one noise value;
repeated rows have one key and are sampled row by row; without labels the weights are all 0 and the sample is uniform; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import ready, table, uniform
from .words import blocks, mix


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    most_targets: int = 20000
    share: float = 0.5
    seed: int = 23
    sharpness: float = 20.0


def features(words: np.ndarray, buckets: int) -> np.ndarray:
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate((words, pairs)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = batch.column(1).to_pylist()
            for block in blocks(batch.column(0).to_pylist()):
                for i in range(len(block)):
                    if len(w := block.words(i)):
                        n = np.bincount(features(w, buckets), minlength=buckets)
                        total[0] += n
                        if good[block.first + i]:
                            total[1] += n
        for kind in range(2):
            used = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind), pa.int64()), pa.array(used, pa.int64()), pa.array(total[kind][used])], ["kind", "bucket", "n"])

    return run


def _weigh(ratio: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for block in blocks(batch.column(1).to_pylist()):
                for i in range(len(block)):
                    w = block.words(i)
                    f = features(w, buckets) if len(w) else w
                    n.append(len(f)), weight.append(float(ratio[f].sum()) if len(f) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "n_features", "log_weight"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> np.ndarray:
    """log(target / raw) by bucket. labels: (doc_id, quality)."""
    ready(spark)
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    ids = good.filter(uniform(cfg.seed, F.col("doc_id")) < min(1.0, cfg.most_targets / max(1, n))).select(F.col("doc_id").alias("_id"))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left").select(F.col("text").cast("binary").alias("text"), F.col("_id").isNotNull().alias("good"))
    rows = marked.mapInArrow(_count(cfg.buckets), "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, cfg.buckets), np.float64)
    counts[rows.column("kind").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    if not counts[1].sum():
        return np.zeros(cfg.buckets)
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + cfg.buckets)
    return np.log(p[1]) - np.log(p[0])


def weigh(spark: SparkSession, docs: DataFrame, ratio: np.ndarray, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, n_features, log_weight, score, key for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_weigh(ratio, cfg.buckets), f"doc_id {kind}, n_features long, log_weight double")
    gumbel = -F.log(-F.log((uniform(cfg.seed + 1, F.col("doc_id")) * (1 - 2.0**-40) + 2.0**-41)))
    mean = F.when(F.col("n_features") > 0, F.col("log_weight") / F.col("n_features")).otherwise(0.0)
    return out.withColumn("score", 1 / (1 + F.exp(-cfg.sharpness * mean))).withColumn("key", F.col("log_weight") + gumbel)


def _edge(rows: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """The value with fewer than ``k`` rows above and at least ``k`` at or above it, and how many are above: a search by 16
    bits at a time, so that only counts of 65,536 bins come to the driver."""
    at = value.bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned
    prefix, above = 0, 0
    for shift in (48, 32, 16, 0):
        inside = rows if shift == 48 else rows.filter(F.shiftrightunsigned(at, shift + 16) == F.lit(prefix))
        bins = inside.groupBy(F.shiftrightunsigned(at, shift).bitwiseAND(F.lit(0xFFFF)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                prefix = prefix << 16 | r["bin"]
                break
            above += r["n"]
    return prefix - (1 << 63), above


def top(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (a written table of doc_id, key, ...) with ``kept``: exactly the ``k`` rows with the largest keys in steps of
    2**-20, equal ones by a hash of the id, rows of one id and key by their place in the files (all of them if fewer)."""
    if k <= 0 or rows.count() <= k:
        return rows.withColumn("kept", F.lit(k > 0))
    levels = [F.floor(F.col("key") * float(1 << 20)).cast("long"), F.xxhash64("doc_id"), F.xxhash64("_metadata.file_name", "_metadata.row_index")]
    left, kept, tied = k, F.lit(False), F.lit(True)
    for value in levels:
        edge, above = _edge(rows.filter(tied), value, left)
        kept = kept | (tied & (value > edge))
        tied, left = tied & (value == edge), left - above
        if rows.filter(tied).count() == left:
            break
    return rows.withColumn("kept", kept | tied)


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, n_features, log_weight, score, key, kept for each row of ``docs`` (doc_id, text)."""
    rows = table(spark, weigh(spark, docs, fit(spark, docs, labels, cfg), cfg), "weights")
    return top(rows, int(rows.count() * cfg.share + 0.5))
