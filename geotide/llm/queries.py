"""The queries of the text operators over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, forest, langid, lm, mixing, neardup, resample, spans, toxicity, urls
from .runtime import remainder

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learnt = remainder("doc_id", 5) != 0
    model = toxicity.fit(spark, docs.filter(learnt), _read(spark, sf_dir, "labels").filter(learnt))
    out = toxicity.score(spark, docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("_gt_score").alias("score"), (F.col("_gt_score") >= 0.5).cast("int").alias("predicted"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, _read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lm.fit(spark, docs.filter(remainder("doc_id", 7) != 2))
    out = lm.score(spark, docs, model)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark, _read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(spark, docs).select("doc_id", "n_sentences", "n_removed", "text")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(spark, _read(spark, sf_dir, "embeddings"), every=50)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.select(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(spark, docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_max("matches.similarity").alias("similarity"), F.col("matches.item_id").alias("item_ids"), "matches")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    filters = langid.fit(spark, docs.filter(remainder("doc_id", 3) != 1))
    out = langid.predict(spark, docs, filters, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_minhash": op3_minhash,
    "op4_language_model": op4_language_model,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_neighbours": op7_neighbours,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op2_sql(damping: float = 0.85, rounds: int = 80, margin: float = 0.1) -> str:
    """The same walks, a step for each round; 80 leave a part of 0.85 ** 80 open."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps = []
    for name, frm, to in (("t", "src", "dst"), ("d", "dst", "src")):
        steps.append(f"{name}0 AS (SELECT host, {1 - damping!r} / (SELECT greatest(1, count(*)) FROM {name}_seed) AS score FROM {name}_seed)")
        steps.append(f"{name}_step AS (SELECT {frm} AS f, {to} AS g, n / sum(n) OVER (PARTITION BY {frm}) AS p FROM links)")
        for k in range(1, rounds + 1):
            steps.append(f"{name}{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT g AS host, score * p * {damping} AS score FROM {name}_step JOIN {name}{k - 1} ON f = host UNION ALL SELECT host, score FROM {name}0) GROUP BY host)")
    link = urls.LINK.replace("'", "''")
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
rest AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, html, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict, rpath := rpath), length(rhost || rpath)) AS b
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
ruled AS (SELECT p.page_id, p.host, p.path, p.html, b.b AS b FROM parsed p LEFT JOIN best b USING (page_id)),
stand AS (SELECT host, bool_or(b.verdict = 'allow') AS allowed, bool_or(b.verdict = 'block') AS blocked, bool_or(b.verdict = 'block' AND b.rpath IN ('', '/')) AS root FROM ruled WHERE b IS NOT NULL GROUP BY host),
t_seed AS (SELECT host FROM stand WHERE allowed AND NOT blocked),
d_seed AS (SELECT host FROM stand WHERE root AND NOT allowed),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {_LOWER.format(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM parsed) WHERE src <> dst AND src <> '' GROUP BY src, dst),
{", ".join(steps)},
hosts AS (SELECT DISTINCT host FROM parsed),
scored AS (SELECT host, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {margin} / (SELECT count(*) FROM hosts) THEN 'block' ELSE 'allow' END AS v
  FROM hosts LEFT JOIN t{rounds} t USING (host) LEFT JOIN d{rounds} d USING (host))
SELECT r.page_id, r.host, r.path, r.b.rule AS rule, coalesce(r.b.verdict, s.v) AS verdict FROM ruled r JOIN scored s USING (host)
"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _op5_sql(seed: int = 11, stratum: int = 512, whole_max: float = 0.002) -> str:
    def u(seed: int, *cols: str) -> str:
        text = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols]])
        return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)::DOUBLE / {1 << 48}::DOUBLE)"

    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS every FROM totals),
f AS (SELECT *, cap / weight <= (every - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_
  FROM w WINDOW r AS (ORDER BY cap / weight, encode(source) NULLS LAST)),
t AS (SELECT source AS src, source_size, n, CASE WHEN full_ THEN cap ELSE weight * ((every - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ()) END AS target FROM f),
j AS (SELECT s.*, t.source_size, t.n, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {u(seed, "doc_id")} AS u FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.src),
k AS (SELECT *, floor(rate)::BIGINT AS epochs, rate - floor(rate) AS fr, floor(u * ceil(n / {stratum}::DOUBLE))::BIGINT AS st, size > source_size * {whole_max}::DOUBLE AS coarse FROM j),
p AS (SELECT *, row_number() OVER (PARTITION BY source, st, coarse ORDER BY size, u, doc_id) AS place, {u(seed + 1, "source", "st")} AS start_ FROM k),
q AS (SELECT *, (CASE WHEN coarse THEN floor(fr * size + u) WHEN floor(place * fr + start_) > floor((place - 1) * fr + start_) THEN size ELSE 0 END)::BIGINT AS part FROM p)
SELECT doc_id, source, size, source_size, target, epochs, part, (epochs * size + part)::BIGINT AS taken FROM q
"""


ORACLES: dict[str, str] = {"op2_url_filters": _op2_sql(), "op3_minhash": _OP3_SQL, "op5_mixing": _op5_sql()}
