"""Where toxicity is learned."""

import os
import random

import corpus_pipeline
from pyspark.sql import functions as F

from geotide.llm import toxicity
from geotide.llm.runtime import _BATCH, LITTLE, ready

from .test_operators import words


def test_the_driver_does_not_train(spark, monkeypatch):
    driver, learn = os.getpid(), toxicity.learn

    def elsewhere(*given):
        assert os.getpid() != driver
        return learn(*given)

    rs = random.Random(5)
    docs = spark.createDataFrame([(k, words(rs, 30) + (" zwerkop " if k % 4 == 0 else " ") + words(rs, 5)) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "learn", elsewhere)
    model = toxicity.fit(spark, docs, labels)
    got = {r["doc_id"]: r["_gt_score"] for r in toxicity.score(spark, docs, model, ["doc_id"]).collect()}
    assert len(model.landmarks) > 0 and all((got[k] >= 0.5) == (k % 4 == 0) for k in range(120))


def test_kept_texts_go_to_the_workers_once_and_little_at_a_time(spark, tmp_path, monkeypatch):
    judge = toxicity._judge

    def weighed(model):
        run = judge(model)

        def light(batches):
            for batch in batches:
                assert batch.nbytes < 6 << 20 and batch.nbytes < 15_000 * batch.num_rows
                yield batch

        return lambda batches: run(light(batches))

    monkeypatch.setattr(toxicity, "_judge", weighed)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" äwörd"), 1200)).alias("text"), F.lit(1).alias("label"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline._toxicity(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.exceptAll(docs).isEmpty() and out.count() == 3000


def test_a_session_keeps_its_own_limit_of_a_batch(spark):
    own = spark.conf.get(_BATCH)
    try:
        for limit, least in (("32m", f"{LITTLE}b"), ("1m", "1m")):
            ready(spark)
            spark.conf.set(_BATCH, limit)
            ready(spark, LITTLE)
            assert spark.conf.get(_BATCH) == least
            ready(spark)
            assert spark.conf.get(_BATCH) == limit
    finally:
        spark.conf.set(_BATCH, own)
