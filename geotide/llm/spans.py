"""Substring dedup by sliding sentence spans.

A sentence ends after a word that ends in ``. ! ? ; :`` or at a line break; a longer one than ``longest`` words is
cut further after words chosen by their own hash, so that a passage is cut alike wherever it stands. A run of sentences
counts when it has at least ``sentences`` sentences and ``words`` words, or at least ``several`` sentences none of which
was cut further. All sentences of a run that also stands earlier (by doc_id, then place) are removed.

Not all runs need be hashed: from every sentence starts one span, the shortest run with enough words, and at every
sentence ends one; every ``several`` uncut sentences in a row are one. Each sentence of a longer run lies in one of
those inside it: after the first span of a run, every sentence has enough words before it to end another. Spans are
hashed and joined over the whole table.

Counts and first places are pre-aggregated by hash before the shuffle, and only spans that repeat meet their
occurrences again in a join that can be split where a passage is very frequent.

Null and empty texts have no sentences and stay as they are; texts without a repeated span stay byte by byte; a text
whose sentences all go becomes empty. Very long texts are read whole. Whole-numbered ids are ordered by value, others by
their text, rows without id come first. Rows that share an id are documents of their own, ordered by a hash of the text;
of rows equal in id and text one is first, any other loses what its spans cover. Other columns are passed through, but
for columns named as the two counts, which are replaced; names that begin with _gt_ are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import LITTLE, drop, ready, table
from .words import Block, blocks, mix


@dataclass(frozen=True)
class Settings:
    sentences: int = 2
    words: int = 20
    several: int = 3
    longest: int = 16
    cut: int = 3


_END = np.zeros(256, bool)
_END[list(b".!?;:")] = True


def sentence_ends(block: Block, i: int, cfg: Settings) -> np.ndarray:
    """For document i: the number of words up to the end of each sentence."""
    return sentences(block, i, cfg)[0]


def sentences(block: Block, i: int, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For document i: the number of words up to the end of each sentence, and which ones were not cut further."""
    lo, hi = block.bounds[i], block.bounds[i + 1]
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    raw = np.frombuffer(block.buf, np.uint8)
    starts, ends, h = block.starts[lo:hi], block.ends[lo:hi], block.hashes[lo:hi]
    stop = _END[raw[ends - 1]]
    line = np.cumsum(raw[starts[0] : ends[-1]] == 10)  # line breaks so far
    at = line[starts - starts[0]]
    stop[:-1] |= at[1:] != at[:-1]
    stop[-1] = True
    cut = np.flatnonzero(stop) + 1
    length = np.diff(cut, prepend=0)
    whole = np.ones(len(cut), bool)
    if (length > cfg.longest).any():
        long = np.repeat(length > cfg.longest, length)
        stop |= long & (h % np.uint64(cfg.cut) == 0)
        cut = np.flatnonzero(stop) + 1
        whole = ~long[cut - 1]
    return cut, whole


def spans(words: np.ndarray, cut: np.ndarray, whole: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all spans, ordered by place: hash, first and last sentence."""
    n = len(cut)
    if not n:
        return words[:0], cut, cut
    begin = np.concatenate(([0], cut[:-1]))
    each = np.arange(n)
    last = np.maximum(np.searchsorted(cut, begin + cfg.words), each + cfg.sentences - 1)
    first = np.minimum(np.searchsorted(begin, cut - cfg.words, side="right") - 1, each - cfg.sentences + 1)
    row = each[: max(0, n - cfg.several + 1)]
    uncut = np.concatenate(([0], np.cumsum(whole)))
    row = row[uncut[row + cfg.several] - uncut[row] == cfg.several]
    pair = np.concatenate((each[last < n] * n + last[last < n], first[first >= 0] * n + each[first >= 0], row * n + row + cfg.several - 1))
    first, last = np.divmod(np.unique(pair), n)
    begin, end = begin[first], cut[last]
    # A span's hash is a difference of prefix sums of word hashes times powers, moved to the span's start.
    power, inverse = _powers(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), first, last


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_held[0]) < n:
        for k, base in enumerate((0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64))):
            step = np.full(2 * n, base, np.uint64)
            step[0] = 1
            _held[k] = np.cumprod(step, dtype=np.uint64)
    return _held


def _find(cfg: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(1).to_pylist()):
                found += [spans(block.words(i), *sentences(block, i, cfg), cfg)[0].view(np.int64) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc", "spans"])

    return run


def _cut(cfg: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeated, again = (batch.column(k).to_pylist() for k in range(3))
            out, count, gone = [], [], []
            for block in blocks(texts):
                for i in range(len(block)):
                    text, marks = texts[block.first + i], repeated[block.first + i]
                    cut, whole = sentences(block, i, cfg)
                    steps = np.zeros(len(cut) + 1, np.int64)
                    if marks or again[block.first + i]:
                        _, first, last = spans(block.words(i), cut, whole, cfg)
                        at = np.arange(len(last)) if again[block.first + i] else np.asarray(marks, np.int64)
                        at = at[at < len(last)]
                        np.add.at(steps, first[at], 1)
                        np.add.at(steps, last[at] + 1, -1)
                    off = np.cumsum(steps[:-1]) > 0
                    if off.any():
                        text = _without(text, block, i, cut, off)
                    out.append(text), count.append(len(cut)), gone.append(int(off.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, pa.binary()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names[3:], "_gt_text", "_gt_n", "_gt_gone"])

    return run


def _without(text: bytes, block: Block, i: int, cut: np.ndarray, off: np.ndarray) -> bytes:
    """The text less the sentences marked ``off``, each with the space up to the next one."""
    lo, base = block.bounds[i], block.offsets[i]
    first = np.concatenate(([0], cut[:-1]))
    begin = block.starts[lo + first] - base
    end = np.concatenate((begin[1:], [len(text)]))
    parts = [text[: begin[0]]]
    parts += [text[a:b] for a, b, x in zip(begin.tolist(), end.tolist(), off.tolist()) if not x]
    return b"".join(parts) if len(parts) > 1 else b""


def _order(docs: DataFrame) -> Column:
    """What documents are ordered by: whole numbers by value, other ids by their text; rows without id come first."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return F.when(F.col("doc_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("doc_id").cast("string")))


def _copies(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (with _gt_doc, _gt_hash) with ``_gt_again``, set on all but one of the rows with one id and text, and whether
    some id has several texts."""
    twice = docs.groupBy("_gt_doc").agg(F.count(F.lit(1)).alias("_n"), F.min("_gt_hash").alias("_lo"), F.max("_gt_hash").alias("_hi")).filter("_n > 1")
    twice = table(spark, twice, "twice")
    if twice.isEmpty():
        return docs.withColumn("_gt_again", F.lit(False)), False
    several = not twice.filter("_lo <> _hi").isEmpty()
    same = docs.join(twice.select("_gt_doc"), "_gt_doc", "left_semi").groupBy("_gt_doc", "_gt_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_gt_doc", "_gt_hash")
    same = table(spark, same, "same")
    if same.isEmpty():
        return docs.withColumn("_gt_again", F.lit(False)), several
    # Once written, a row is told from its equals by its place in the files; the least place is found before the shuffle.
    apart = table(spark, docs.join(same, ["_gt_doc", "_gt_hash"], "left_semi"), "apart")
    apart = apart.withColumn("_gt_at", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")))
    least = apart.groupBy("_gt_doc", "_gt_hash").agg(F.min("_gt_at").alias("_gt_least"))
    apart = apart.join(least, ["_gt_doc", "_gt_hash"]).withColumn("_gt_again", F.col("_gt_at") != F.col("_gt_least")).drop("_gt_at", "_gt_least")
    rest = docs.join(same, ["_gt_doc", "_gt_hash"], "left_anti").withColumn("_gt_again", F.lit(False))
    return rest.unionByName(apart.select(rest.columns)), several


def remove_repeats(spark: SparkSession, docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` less repeated sentences, and with n_sentences and n_removed."""
    ready(spark, LITTLE)
    docs = docs.drop("n_sentences", "n_removed")
    rest = [c for c in docs.columns if c != "text"]
    # Texts are told apart by 64 bits of their hash, within one id.
    held, several = _copies(spark, docs.withColumn("_gt_doc", _order(docs)).withColumn("_gt_hash", F.xxhash64("text")))
    # Where an id has several texts, rows are ordered by id and text; else the id says it all and less is shuffled.
    key = F.struct("_gt_doc", "_gt_hash") if several else F.col("_gt_doc")
    kind = held.select(key.alias("k")).schema["k"].dataType.simpleString()
    found = held.filter("not _gt_again").select(key.alias("doc"), F.col("text").cast("binary").alias("text")).mapInArrow(_find(cfg), f"doc {kind}, spans array<long>")
    found = table(spark, found, "spans")
    each = found.select("doc", F.posexplode("spans").alias("place", "span"))
    first = each.groupBy("span").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("span", "first")
    first = table(spark, first, "first")  # read anew, so that the join's hot spans can be split
    again = table(spark, each.join(first, "span"), "again")
    drop(spark, found)
    inside = again.filter("doc = first")
    least = inside.groupBy("span").agg(F.min("place").alias("least"))
    late = inside.join(least, "span").filter("place > least").select("doc", "place")
    marks = again.filter("doc > first").select("doc", "place").unionByName(late).groupBy(F.col("doc").alias("_gt_id")).agg(F.collect_set("place").alias("_gt_places"))
    marks = table(spark, marks, "marks")
    drop(spark, again), drop(spark, first)
    held = held.withColumn("_gt_key", key).join(marks, F.col("_gt_key") == F.col("_gt_id"), "left")
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "_gt_text binary", "_gt_n long", "_gt_gone long"])
    done = held.select(F.col("text").cast("binary").alias("_gt_b"), "_gt_places", "_gt_again", *rest).mapInArrow(_cut(cfg), schema)
    return done.select(*[F.col("_gt_text").cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col("_gt_n").alias("n_sentences"), F.col("_gt_gone").alias("n_removed"))
