"""Language identification by n-gram sets in a bit-sliced Bloom filter.

For each language the most frequent letter n-grams of a sample of its documents are a set. All sets share one Bloom
filter whose rows hold a bit for each language, so the AND of a few rows is the mask of all languages that contain an
n-gram. A document's n-grams are looked up, the masks counted by language, and each count is corrected for the false
positives to expect at that language's fill: (hits / n - f) / (1 - f). The largest decides; ties go to the language
with more documents. score is the winner's share of all corrected counts.

Texts are lower-cased; runs of characters other than letters count as one space. Learning takes at most
``per_language`` documents of each language, chosen by a hash of the id, and ``grams`` n-grams with at least
``least`` occurrences. Null texts and texts without letters are ``und`` with score 0, as is everything when there is
nothing to learn from; very long texts are read whole; rows without language are not learned from; repeated rows are
judged alike; other columns are passed through, but for columns named as the two results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .runtime import ready, uniform
from .words import mix


@dataclass(frozen=True)
class Settings:
    n: int = 4
    per_language: int = 2000
    grams: int = 20000
    least: int = 3
    hashes: int = 3
    bits_per_gram: int = 16


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.frombuffer("".join("1" if chr(c).isalpha() else "0" for c in range(0x110000)).encode(), np.uint8) == 49)
    return _letters[0]


def grams(text: str | None, n: int) -> np.ndarray | None:
    """Hashes of the letter n-grams of a text in order, or nothing where it has no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[cp]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    seq = np.where(letter, cp, 32)[keep]
    seq = np.concatenate(([32], seq, [32] * (1 + max(0, n - 2 - len(seq))))).astype(np.uint64)
    m = len(seq) - n + 1
    h = seq[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + seq[k : k + m]
    return mix(h)


class Filters:
    """The bit-sliced filter: a word of 64 languages for each row and slice."""

    def __init__(self, langs: list[str], sets: list[np.ndarray], cfg: Settings) -> None:
        self.langs, self.cfg = langs, cfg
        most = max([len(s) for s in sets], default=1)
        self.mask = np.uint64((1 << max(10, (most * cfg.bits_per_gram - 1).bit_length())) - 1)
        self.slices = [np.zeros(int(self.mask) + 1, np.uint64) for _ in range(-(-len(langs) // 64))]
        for k, s in enumerate(sets):
            for row in self._rows(s):
                self.slices[k // 64][row] |= np.uint64(1 << (k % 64))
        fill = [((self.slices[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))]
        self.false = np.array(fill) ** cfg.hashes

    def _rows(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & self.mask).astype(np.int64) for k in range(self.cfg.hashes)]

    def shares(self, h: np.ndarray) -> np.ndarray:
        """For each language, the corrected share of the n-grams ``h`` that it contains."""
        rows, count = self._rows(h), []
        for table_ in self.slices:
            m = table_[rows[0]]
            for r in rows[1:]:
                m &= table_[r]
            count += [int(((m >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(min(64, len(self.langs) - len(count)))]
        return np.maximum(0.0, (np.array(count) / len(h) - self.false) / (1 - self.false))

    def decide(self, text: str | None) -> tuple[str, float]:
        h = grams(text, self.cfg.n)
        if h is None or not self.langs:
            return "und", 0.0
        share = self.shares(h)
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum()) if share[best] > 0 else 1.0 / len(self.langs)


def _count(n: int, most: int = 2_000_000):
    """Counts by language, sent on whenever ``most`` n-grams of a language are held."""

    def counted(lang: str, hs: list[np.ndarray]) -> pa.RecordBatch:
        g, c = np.unique(np.concatenate(hs), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (h := grams(text, n)) is not None:
                    by.setdefault(lang, []).append(h)
                    if sum(map(len, by[lang])) >= most:
                        yield counted(lang, by.pop(lang))
            for lang, hs in by.items():
                yield counted(lang, hs)

    return run


def fit(spark: SparkSession, docs: DataFrame, cfg: Settings = Settings()) -> Filters:
    """Filters from documents (doc_id, text, lang)."""
    ready(spark)
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters([], [], cfg)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, cfg.per_language / n))])
    sample = known.filter(uniform(17, F.col("doc_id")) < share[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_count(cfg.n), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= cfg.least)
    # A language's n-grams are those of a bounded sample, so one ordered pass for each, all in one job.
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("_place", place).filter(F.col("_place") <= cfg.grams).select("lang", "gram").toArrow().to_pandas()
    held = {lang: rows["gram"].to_numpy().view(np.uint64) for lang, rows in best.groupby("lang")}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    return Filters(langs, [held.get(lang, np.zeros(0, np.uint64)) for lang in langs], cfg)


def _judge(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [filters.decide(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()), *batch.columns[1:]], ["_gt_lang", "_gt_score", *batch.schema.names[1:]])

    return run


def predict(spark: SparkSession, docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score for ``text``; columns of those two names are replaced."""
    ready(spark)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    schema = ", ".join(["_gt_lang string", "_gt_score double", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]])
    judged = docs.select(F.col("text").alias("_gt_b"), *keep).mapInArrow(_judge(filters), schema)
    return judged.select(*keep, F.col("_gt_lang").alias("lang_pred"), F.col("_gt_score").alias("score"))
