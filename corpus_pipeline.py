"""A corpus pipeline of five stages; each reads the documents that the one before has written.

run() writes every stage's rows as Parquet to the shared folder and reads them again. A document's columns are passed
on by the first four stages; the last returns the mixing plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geotide.llm import decontam, mixing, neardup, spans, toxicity
from geotide.llm.runtime import table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay."""
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(spark, docs, model, docs.columns).filter("_gt_score < 0.5").select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return neardup.one_of_each(spark, docs).select(*docs.columns)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but the first place; a document of nothing else goes."""
    done = spans.remove_repeats(spark, docs)
    return done.filter("n_removed = 0 or n_removed < n_sentences").select(*docs.columns)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items stay."""
    found = decontam.find_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).select(*docs.columns)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.plan(spark, docs)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("repeats", _repeats), ("benchmark", _benchmark), ("mixing", _mixing)]

#: Learned scores, MinHash and SimHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
