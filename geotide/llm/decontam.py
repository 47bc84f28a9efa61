"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

A document is read through windows as long as each benchmark item, a stride of an eighth of the length apart. A
window's 64-bit SimHash sums the signs of its words and word pairs. Items of one length are indexed by the 8 bytes of
their fingerprints: for every byte value the index holds the bit set of items within ``radius // 8`` bits there. A
fingerprint within ``radius`` of an item must agree to that many bits in some byte, so the union of eight look-ups
misses none of them; the whole distance is then taken. Candidates are verified at every offset within a stride by the
similarity of weighted shingles: sum of weights times smaller counts over the same with larger counts, a shingle's
weight being 1 over the number of items of the whole benchmark that have it. A shingle of the window that the item lacks
weighs as much as the mean of those of the item that the window lacks: an edit costs what it replaces, however many
other items share it. A match needs ``percent``.

Windows without any shingle of any item are not hashed: their similarity is 0. Items shorter than a shingle match
where their words stand exactly.

The benchmark is cut in parts of about ``part_chars`` characters by a hash of the item. Tasks index each part and write
it to the shared folder; documents are read once, by tasks that look every part's known shingles up and load a part's
items only where some of its shingles occur. Nothing of the benchmark comes to the driver but the sum of its lengths,
and an item's match does not depend on the others of its part.

Null and empty texts and items match nothing; very long texts are read whole; an item given twice is reported twice, items
without id are left out; repeated documents are judged row by row, equal matches go by item id; an empty table gives none;
other columns are passed through, but for one named ``matches``, which is replaced; names with _gt_ are reserved.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .runtime import LITTLE, new_path, ready, table, uniform
from .store import load, load_object, save, save_object
from .words import Block, blocks, mix, shingles


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    radius: int = 15
    region: int = 16384
    part_chars: int = 2_000_000


def signs(words: np.ndarray) -> np.ndarray:
    """Running sums, a row for each word boundary, of the signs of words and (from the second word on) of pairs."""
    pairs = np.zeros_like(words)
    pairs[1:] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    out = np.zeros((2, len(words) + 1, 64), np.int32)
    for k, h in enumerate((words, pairs)):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=out[k, 1:])
    return out


def fingerprints(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the words begin:end, as 8 bytes a row. A pair belongs to its second word."""
    votes = sums[0][end] - sums[0][begin] + sums[1][end] - sums[1][np.minimum(begin + 1, end)]
    return np.packbits(votes > 0, axis=1)


class BlockIndex:
    """Fingerprints of items of one length, by byte and value the bit set of items near there."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        off = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        near = off <= radius // 8
        self.table = np.stack([np.packbits(near[:, prints[:, k]], axis=1) for k in range(8)])

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``prints`` and items within the radius."""
        union = self.table[0][prints[:, 0]]
        for k in range(1, 8):
            union = union | self.table[k][prints[:, k]]
        row, item = np.nonzero(np.unpackbits(union, axis=1, count=len(self.prints)))
        close = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1) <= self.radius
        return row[close], item[close]


class Items:
    """Items of one part. shared: shingles that several items of the whole benchmark have, and in how many;
    without it the part is the whole."""

    def __init__(self, ids: list[int], texts: list[bytes | None], cfg: Settings, shared: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.cfg, self.short, by_length = cfg, defaultdict(dict), defaultdict(list)
        self.ids, self.counts = ids, {}
        words = [b.words(i) for b in blocks(texts) for i in range(len(b))]
        found, lengths = [], []
        for k, w in enumerate(words):
            s, c = np.unique(shingles(w, cfg.words), return_counts=True)
            if 0 < len(w) < cfg.words:
                self.short[len(w)].setdefault(int(s[0]), []).append(k)
            elif len(w):
                by_length[len(w)].append(k)
                self.counts[k] = (s, c)
                found.append(s)
                lengths.append(np.full(len(s), len(w), np.uint64))
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.known, held = np.unique(every, return_counts=True)
        held = held.astype(np.float64)
        if shared is not None:
            at = np.searchsorted(self.known, shared[0])
            held[at] = shared[1]
        self.own = {k: 1.0 / held[np.searchsorted(self.known, s)] for k, (s, _) in self.counts.items()}
        # Lengths of the items that hold each known shingle, one after another.
        pairs = np.unique(np.stack((np.searchsorted(self.known, every), np.concatenate(lengths).astype(np.int64) if lengths else every.astype(np.int64))), axis=1)
        self.first, self.lengths = np.searchsorted(pairs[0], np.arange(len(self.known) + 1)), pairs[1]
        self.groups = {}
        for n, ks in by_length.items():
            prints = np.concatenate([fingerprints(signs(words[k]), np.array([0]), np.array([n])) for k in ks])
            self.groups[n] = (ks, BlockIndex(prints, cfg.radius))

    def similarity(self, k: int, window: np.ndarray) -> float:
        s, c = self.counts[k]
        t, d = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(s, t), len(s) - 1)
        both = s[at] == t
        same = np.zeros(len(s), np.int64)
        same[at[both]] = np.minimum(d[both], c[at[both]])
        own = self.own[k]
        common, lacking = (own * same).sum(), (own * (c - same)).sum()
        foreign = (len(window) - same.sum()) * lacking / max(1, (c - same).sum())
        return float(common / (common + lacking + foreign))

    def matches(self, words: np.ndarray, sh: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Of one document: item, similarity, first word and end of its best window, for every item that matches.

        sh: the document's shingles, hits: the places of those that are known."""
        found: dict[int, tuple[float, int, int]] = {}
        for n, known in self.short.items():
            if n <= len(words):
                for at, x in enumerate(shingles(words, n).tolist()):
                    for k in known.get(x, ()):
                        found.setdefault(k, (1.0, at, at + n))
        for part in np.split(hits, np.flatnonzero(np.diff(hits // self.cfg.region)) + 1) if len(hits) else ():
            self._region(words, sh, part, found)
        return [(self.ids[k], *found[k]) for k in sorted(found, key=lambda k: (self.ids[k], k))]

    def _region(self, words: np.ndarray, sh: np.ndarray, hits: np.ndarray, found: dict) -> None:
        by_length: dict[int, list[int]] = defaultdict(list)
        for p, x in zip(hits.tolist(), np.searchsorted(self.known, sh[hits]).tolist()):
            for n in self.lengths[self.first[x] : self.first[x + 1]].tolist():
                by_length[n].append(p)
        reach = max(by_length) + max(by_length) // 8 + 1
        lo, hi = max(0, int(hits[0]) - reach), min(len(words), int(hits[-1]) + self.cfg.words + reach)
        sums = signs(words[lo:hi])
        for n, ps in by_length.items():
            stride, p = max(1, n // 8), np.unique(ps)
            top = max(0, len(words) - n)
            starts = self._starts(p, n, top)
            starts = starts[(starts >= lo) & (np.minimum(starts + n, len(words)) <= hi)]
            if not len(starts):
                continue
            ks, index = self.groups[n]
            row, item = index.find(fingerprints(sums, starts - lo, np.minimum(starts + n, len(words)) - lo))
            for i in np.unique(item).tolist():
                # Only windows that the item's own shingles ask for: others depend on what else is in the block.
                s = self.counts[ks[i]][0]
                mine = p[s[np.minimum(np.searchsorted(s, sh[p]), len(s) - 1)] == sh[p]]
                near = np.intersect1d(starts[row[item == i]], self._starts(mine, n, top)) if len(mine) else mine
                if not len(near):
                    continue
                offsets = np.unique(np.clip(near[:, None] + np.arange(-stride, stride + 1)[None, :], 0, top))
                self._verify(ks[i], n, sh, offsets, found)

    def _starts(self, p: np.ndarray, n: int, top: int) -> np.ndarray:
        """First words of the windows of ``n`` words to hash around shingles at ``p``."""
        stride = max(1, n // 8)
        first = np.maximum(0, p - (n - self.cfg.words)) // stride
        grid = first[:, None] + np.arange((n - self.cfg.words) // stride + 2)[None, :]
        return np.unique(np.append(np.minimum(grid * stride, top).ravel(), np.minimum(np.maximum(0, p - n // 2), top)))

    def _verify(self, k: int, n: int, sh: np.ndarray, offsets: np.ndarray, found: dict) -> None:
        """Exact similarity at the offsets whose known shingles could suffice, the best bound first."""
        s, c = self.counts[k]
        own = self.own[k]
        need = (own * c).sum() * self.cfg.percent / 100 - 1e-9
        lo, hi = int(offsets[0]), min(int(offsets[-1]) + n - self.cfg.words + 1, len(sh))
        at = np.minimum(np.searchsorted(s, sh[lo:hi]), len(s) - 1)
        sums = np.concatenate(([0.0], np.cumsum(np.where(s[at] == sh[lo:hi], own[at], 0.0))))
        bound = sums[np.minimum(offsets + n - self.cfg.words + 1, hi) - lo] - sums[offsets - lo]
        total = (own * c).sum()
        for o in np.argsort(-bound, kind="stable").tolist():
            best = found.get(k, (0.0,))[0]
            if bound[o] < need or best >= 0.999 or bound[o] / total <= best:
                break
            start = int(offsets[o])
            x = self.similarity(k, sh[start : start + n - self.cfg.words + 1])
            if x * 100 >= self.cfg.percent - 1e-9 and x > best:
                found[k] = (x, start, min(start + n, len(sh) + self.cfg.words - 1))


MATCHES = "array<struct<item_id:bigint,similarity:double,first_word:bigint,end_word:bigint>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def _known(known: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted shingles with a table of bits that tells most others apart at once."""
    size = 1 << max(16, (16 * len(known)).bit_length())
    shift = 64 - (size.bit_length() - 1)
    maybe = np.zeros(size, bool)
    maybe[(known >> np.uint64(shift)).astype(np.int64)] = True
    return {"known": known, "maybe": maybe, "shift": np.array([shift], np.uint64)}


def _hits(sh: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    known = held["known"]
    if not len(known) or not len(sh):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(held["maybe"][(sh >> held["shift"][0]).astype(np.int64)])
    return at[known[np.minimum(np.searchsorted(known, sh[at]), len(known) - 1)] == sh[at]]


def _scan(path: str, parts: list[tuple[int, bool]], cfg: Settings):
    """parts: number of each part that has items, and whether it has some shorter than a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = []
            for block in blocks(batch.column(0).to_pylist()):
                block: Block
                sh = [shingles(block.words(i), cfg.words) if block.bounds[i + 1] - block.bounds[i] >= cfg.words else block.words(i)[:0] for i in range(len(block))]
                every, ends = np.concatenate(sh), np.cumsum([len(s) for s in sh])
                found: list[list[tuple]] = [[] for _ in sh]
                for part, short in parts:
                    hits = _hits(every, load(path, f"known-{part}"))
                    if not len(hits) and not short:
                        continue
                    items: Items = load_object(path, f"items-{part}")  # type: ignore[assignment]
                    doc = np.searchsorted(ends, hits, side="right")
                    for i in range(len(sh)) if short else np.unique(doc).tolist():
                        own = hits[doc == i] - (ends[i] - len(sh[i]))
                        found[i] += items.matches(block.words(i), sh[i], own)
                out += [[dict(zip(("item_id", "similarity", "first_word", "end_word"), m)) for m in sorted(f, key=lambda m: m[0])] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _KIND), *batch.columns[1:]], ["_gt_b", "_gt_m", *batch.schema.names[1:]])

    return run


def _shingles_of(cfg: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, found = batch.column(0).to_pylist(), []
            for block in blocks(batch.column(1).to_pylist()):
                words = [block.words(i) for i in range(len(block))]
                found += [np.unique(shingles(w, cfg.words)).view(np.int64) if len(w) >= cfg.words else np.zeros(0, np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["_part", "shingle"])

    return run


def _shared(items: DataFrame, cfg: Settings) -> DataFrame:
    """_part, shingle, n: shingles that several items of any parts have, in how many, for each part that has them."""
    each = items.select("_part", F.col("text").cast("binary").alias("b")).mapInArrow(_shingles_of(cfg), "_part long, shingle array<long>")
    by_part = each.select("_part", F.explode("shingle").alias("shingle")).groupBy("_part", "shingle").agg(F.count(F.lit(1)).alias("_m"))
    whole = by_part.groupBy("shingle").agg(F.sum("_m").alias("n")).filter("n > 1")
    return by_part.select("_part", "shingle").join(whole, "shingle").select("_part", "shingle", "n")


def _index(path: str, cfg: Settings):
    def run(rows: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"part": np.zeros(0, np.int64), "short": np.zeros(0, bool)})
        rows = rows.sort_values(["item_id", "b"])
        part = int(rows["_part"].iloc[0])
        items = Items(rows["item_id"].tolist(), [bytes(b) for b in rows["b"]], cfg, (shared["shingle"].to_numpy().astype(np.int64).view(np.uint64), shared["n"].to_numpy()))
        save(path, f"known-{part}", _known(items.known))
        save_object(path, f"items-{part}", items)
        return pd.DataFrame({"part": [part], "short": [bool(items.short)]})

    return run


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` with ``matches``: items found in the text, by item id. benchmark: (item_id, text)."""
    ready(spark, LITTLE)
    docs = docs.drop("matches")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // cfg.part_chars) or 1
    items = table(spark, items.withColumn("_part", F.floor(uniform(3, F.col("item_id"), F.col("text")) * parts).cast("long")), "items")
    path = new_path(spark, "index")
    rows = items.select("_part", "item_id", F.col("text").cast("binary").alias("b")).groupBy("_part")
    made = rows.cogroup(_shared(items, cfg).groupBy("_part")).applyInPandas(_index(path, cfg), "part long, short boolean").collect()  # a row a part
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(["_gt_b binary", f"_gt_m {MATCHES}", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]])
    held = docs.select(F.col("text").cast("binary").alias("_gt_b"), *rest).mapInArrow(_scan(path, sorted((r["part"], r["short"]) for r in made), cfg), schema)
    return held.select(*[F.col("_gt_b").cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col("_gt_m").alias("matches"))
