"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from geotide.llm.queries import ORACLES, QUERIES

from .test_operators import words


def test_stages_on_planted_cases(spark, tmp_path):
    rs = random.Random(2)
    bad = "zwerkop"
    rows, labels = [], []
    for k in range(240):
        t = words(rs, 70)
        if k % 6 == 0:
            t += f" {bad} " + words(rs, 5)
        rows.append((k, t + ".", "en", f"s{k % 4}", len(t)))
        labels.append((k, 1, int(k % 6 == 0)))
    item = words(rs, 40)
    passage = ". ".join(words(rs, 9) for _ in range(8)) + "."
    extra = [(1000, rows[1][1]), (1001, words(rs, 30) + " " + item + " " + words(rs, 30)), (1002, words(rs, 40) + ". " + passage + " " + words(rs, 40)), (1003, words(rs, 40) + ". " + passage + " " + words(rs, 40)), (1004, None), (1005, "")]
    rows += [(i, t, "en", "s1", 0) for i, t in extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {k for k in range(240) if k % 6}
    assert seen[0] == clean | {1000, 1001, 1002, 1003, 1004, 1005}
    assert seen[1] == seen[0] - {1000} and seen[2] == seen[1] and seen[3] == seen[2] - {1001}
    assert seen[4] == seen[3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "benchmark", "mixing"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, clashing column names, a very long text; then no rows at all."""
    rs = random.Random(4)
    one, long = words(rs, 50) + ".", words(rs, 30000)
    kind = "doc_id long, text string, lang string, source string, score double, matches string, n_removed int, component_id string, size long, label int, _gt_x int"
    rows = [(k, words(rs, 40) + ("." if k % 2 else " zwerkop"), None) for k in range(60)] + [(100, one, "a"), (100, one, "a"), (100, one + " more", "b"), (None, one, None), (None, None, None), (200, None, "a"), (201, "", None), (202, long, "b")]
    spark.createDataFrame([(i, t, None, s, 1.0, "m", 2, "c", 3, 4, 5) for i, t, s in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(60)] + [(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, words(rs, 20))], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert {k for k in ids if k is not None and k < 60} == set(range(1, 60, 2)) and ids.count(100) == 1 and {200, 201, 202} <= set(ids)
    assert next(r for r in out if r["doc_id"] == 202)["size"] == 30000
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs, str(tmp_path))
        assert empty.count() == 0 and (k == 4 or empty.columns == docs.columns)


def test_every_dealt_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
