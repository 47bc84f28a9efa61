"""Scoring text by an Elias-Fano n-gram trie.

Level 1 holds the distinct words: their sorted 63-bit hashes are one monotone sequence, so a word's place is its id,
and the running totals of their exact counts are another. Level 2 holds the word pairs in order of context: monotone
pointers give each context's range, the successors' ids plus the context's offset are monotone too, and each pair has
a probability quantised to 8 bits on a log scale. Level 3 holds the triples in the same way: pointers from each pair to
the range of its successors, the successors' ids plus the pair's offset, the quantised share of each triple in its
context, and for each pair the quantised weight of what its context leaves to the shorter one. A query finds a word by
successor search in level 1, a pair relative to its context in level 2, a triple in the range of its pair in level 3.

A pair's probability is smoothed by the word's: (c(u v) + K p(v)) / (c(u) + K) with p(v) = (c(v) + 1) / (N + V + 1) and
K = kappa c(u) ** power, as the number of different successors grows with a context's count; an unknown context leaves
p(v). A triple's is c(u v w) / (c(u v) + K) + K / (c(u v) + K) p(w | v) in the same way, K from c(u v), with the pair's
quantised probability. A text is its words and one end, and its first context is
the end; the first word is judged by pairs. ``order`` 2 leaves level 3 out.

Levels are cut in shards, level 1 by hash, levels 2 and 3 together by ranges of (context, successor) of about
``shard_tokens`` tokens, a very frequent context over several, so that no task holds a level. All counts are exact over
all training texts; nothing is pruned. Shards are written to the shared folder by tasks and memory-mapped by scoring
tasks (read into bounded memory where the folder is no mounted one). A scoring task opens the shards that its texts ask
for; texts of a huge vocabulary ask for most, so it reads about the whole model over its life. Word ids take 32 bits:
more distinct words are an error.

Null texts are empty: one end token. Very long texts are scored whole. Without training texts all words are unknown,
N = V = 0 and every score is 0. Repeated rows are counted and scored row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .elias_fano import EliasFano
from .runtime import drop, new_path, ready, table
from .store import load, save
from .words import Block, blocks

#: The hash of the end token; no word is empty, so this stands for no word.
END = np.int64(0x1D8E4E27C47D124F)
_SIZE = 1 << 21
#: Bytes of text that are scored at once: what is asked of a shard is asked in one visit, and each has a price of its own.
_SCORED = 1 << 22


@dataclass(frozen=True)
class Settings:
    order: int = 3
    kappa: float = 1.0
    power: float = 0.8
    shard_words: int = 2_000_000
    shard_tokens: int = 1_500_000


    def rest(self, count: np.ndarray) -> np.ndarray:
        """How much a context of that count weighs the shorter one."""
        return self.kappa * np.asarray(count, np.float64) ** self.power


@dataclass
class Model:
    path: str
    cfg: Settings
    tokens: int = 0
    words: int = 0
    shift: int = 63
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))


def _sequence(path: str, name: str, prefix: str) -> EliasFano:
    held = load(path, name)
    key = f"_{prefix}"
    if key not in held:
        held[key] = EliasFano({k[len(prefix) :]: v for k, v in held.items() if k.startswith(prefix)})  # type: ignore[assignment]
    return held[key]  # type: ignore[return-value]


# Level 1.


def words_of(block: Block) -> np.ndarray:
    return (block.hashes >> np.uint64(1)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0).to_pylist(), _SIZE):
            h, n = np.unique(words_of(block), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END)), pa.array(np.append(n, len(block)).astype(np.int64))], ["word", "n"])


def _build_words(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        shard, h, n = int(rows["shard"].iloc[0]), rows["word"].to_numpy(), rows["n"].to_numpy()
        total = np.cumsum(n)
        arrays = {f"word_{k}": v for k, v in EliasFano.build(h, 1 << 63).items()} | {f"total_{k}": v for k, v in EliasFano.build(total, int(total[-1]) + 1, search=False).items()}
        save(path, f"words-{shard}", arrays)
        return pd.DataFrame({"shard": [shard], "n": [len(h)], "tokens": [int(total[-1])]})

    return run


def counts_at(model: Model, ids: np.ndarray) -> np.ndarray:
    """Exact counts by word id."""
    out = np.zeros(len(ids), np.int64)
    shard = np.searchsorted(model.first, ids, side="right") - 1
    for s in np.unique(shard).tolist():
        on = shard == s
        at = ids[on] - model.first[s]
        total = _sequence(model.path, f"words-{s}", "total_")
        now, before = total.access(at).astype(np.int64), np.zeros(len(at), np.int64)
        before[at > 0] = total.access(at[at > 0] - 1).astype(np.int64)
        out[on] = now - before
    return out


def find_words(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1 where unknown) and count of each word."""
    ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    if not model.words:
        return ids, counts
    shard = words >> model.shift if model.shift < 63 else np.zeros(len(words), np.int64)
    for s in np.unique(shard).tolist():
        if model.first[s + 1] == model.first[s]:
            continue
        on = np.flatnonzero(shard == s)
        at, known = _sequence(model.path, f"words-{s}", "word_").successor(words[on])
        ids[on[known]] = at[known] + model.first[s]
    counts[ids >= 0] = counts_at(model, ids[ids >= 0])
    return ids, counts


# Levels 2 and 3.


def _pairs(block: Block, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of all documents in a row, the end last in each."""
    ends = block.bounds[1:]
    seq = np.insert(ids, ends, end)
    context = np.empty_like(seq)
    context[0], context[1:] = end, seq[:-1]
    return context, seq


def _ids(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Ids and counts of a block's words, and those of the end."""
    distinct, back = np.unique(np.append(words_of(block), END), return_inverse=True)
    ids, counts = find_words(model, distinct)
    ids, counts = ids[back], counts[back]
    return ids[:-1], counts[:-1], int(ids[-1]), int(counts[-1])


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, nexts, size = [], [], 0
            for block in blocks(batch.column(0).to_pylist(), _SIZE):
                ids, _, end, _ = _ids(model, block)
                u, v = _pairs(block, ids, end)
                pairs.append((u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64))
                # What follows each pair; nothing follows an end.
                nexts.append(np.where(v == end, -1, np.append(v[1:], end)))
                size += len(u)
                if size > 1_000_000:
                    yield _packed(model, pairs, nexts)
                    pairs, nexts, size = [], [], 0
            if pairs:
                yield _packed(model, pairs, nexts)

    return run


#: Bytes of each kind of number that are as good as random and are sent as they are.
_PLAIN = (3, 0, 0, 2, 0)


def _planes(a: np.ndarray, plain: int) -> tuple[bytes, bytes]:
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return planes[:plain].tobytes(), planes[plain:].tobytes()


def _packed(model: Model, pairs: list[np.ndarray], nexts: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs and triples with counts, cut by shard and compressed."""
    keys, at, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    if model.cfg.order > 2:
        after = np.concatenate(nexts)
        some = after >= 0
        triples, times = np.unique((at[some].astype(np.uint64) << np.uint64(32)) | after[some].astype(np.uint64), return_counts=True)
    else:
        triples, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    del at
    follow = np.searchsorted(triples, np.arange(len(keys) + 1, dtype=np.uint64) << np.uint64(32))
    cuts = np.append(np.searchsorted(keys, model.bounds), len(keys))
    shard, data = [], []
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[s], cuts[s + 1]
        c, d = follow[a], follow[b]
        parts = [np.diff(keys[a:b], prepend=np.uint64(0)), n[a:b].astype(np.uint32), np.diff(follow[a : b + 1]).astype(np.uint32), triples[c:d].astype(np.uint32), times[c:d].astype(np.uint32)]
        shard.append(s)
        low, high = zip(*[_planes(p, plain) for p, plain in zip(parts, _PLAIN)])
        data.append(struct.pack("<2q", b - a, d - c) + b"".join(low) + zlib.compress(b"".join(high), 1))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(data, pa.binary())], ["shard", "data"])


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Pairs, their counts, how many triples follow each, these triples' last words and counts."""
    n, m = struct.unpack("<2q", data[:16])
    sizes, kinds = (n, n, n, m, m), (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
    raw = zlib.decompress(data[16 + sum(size * plain for size, plain in zip(sizes, _PLAIN)) :])
    at, place, out = 0, 16, []
    for size, plain, kind in zip(sizes, _PLAIN, kinds):
        width = np.dtype(kind).itemsize
        planes = np.empty((width, size), np.uint8)
        planes[:plain] = np.frombuffer(data, np.uint8, size * plain, place).reshape(plain, size)
        planes[plain:] = np.frombuffer(raw, np.uint8, size * (width - plain), at).reshape(width - plain, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        place, at = place + size * plain, at + size * (width - plain)
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _unigram(model: Model, ids: np.ndarray) -> np.ndarray:
    """Smoothed probability by word id."""
    distinct, back = np.unique(ids, return_inverse=True)
    return ((counts_at(model, distinct) + 1) / (model.tokens + model.words + 1))[back]


def _quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes on the scale of the values, and that scale."""
    low, high = (float(p.min()), float(p.max())) if len(p) else (0.0, 0.0)
    step = max((high - low) / 255, 1e-12)
    return np.rint((p - low) / step).astype(np.uint8), np.array([low, step])


def _build_pairs(model: Model):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        parts = [_unpacked(d) for d in rows.pop("data")]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        counts, keys = counts[order], keys[order]
        del order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n, keys = np.add.reduceat(counts.astype(np.int64), first), keys[first]
        del counts, first
        arrays = _triples(model, keys, n, parts) if model.cfg.order > 2 else {}
        del parts
        u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del keys
        lo, hi = int(u[0]), int(u[-1])
        starts = np.searchsorted(u, np.arange(lo, hi + 2))
        contexts, back = np.unique(u, return_inverse=True)
        seen = counts_at(model, contexts)[back]
        rest = model.cfg.rest(seen)
        p = np.log10((n + rest * _unigram(model, v)) / (seen + rest))
        del n, contexts, back, seen, rest
        arrays["code"], arrays["scale"] = _quantised(p)
        arrays["range"] = np.array([lo, hi])
        arrays |= {f"start_{k}": x for k, x in EliasFano.build(starts, len(u) + 1, search=False).items()}
        arrays |= {f"next_{k}": x for k, x in EliasFano.build((u - lo) * model.words + v, (hi - lo + 1) * model.words).items()}
        save(model.path, f"pairs-{shard}", arrays)
        return pd.DataFrame({"shard": [shard], "n": [len(u)]})

    return run


def _triples(model: Model, keys: np.ndarray, n: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Level 3 of a shard: ``keys`` are its distinct pairs, ``n`` their counts."""
    found = [(np.repeat(np.searchsorted(keys, k), follow).astype(np.uint64) << np.uint64(32)) | last for k, _, follow, last, _ in parts]
    all_, times = np.concatenate(found), np.concatenate([p[4] for p in parts])
    del found
    order = np.argsort(all_, kind="stable")
    times, all_ = times[order], all_[order]
    del order
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.zeros(0, np.int64)
    c, all_ = np.add.reduceat(times.astype(np.int64), first) if len(first) else first, all_[first]
    del times, first
    pair, last = (all_ >> np.uint64(32)).astype(np.int64), (all_ & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.searchsorted(all_, np.arange(len(keys) + 1, dtype=np.uint64) << np.uint64(32))
    del all_
    rest, arrays = model.cfg.rest(n), {}
    arrays["share"], arrays["share_scale"] = _quantised(np.log10(c / (n + rest)[pair]))
    arrays["left"], arrays["left_scale"] = _quantised(np.log10(rest / (n + rest)))
    arrays |= {f"start3_{k}": x for k, x in EliasFano.build(starts, len(pair) + 1, search=False).items()}
    return arrays | {f"next3_{k}": x for k, x in EliasFano.build(pair * model.words + last, len(keys) * model.words).items()}


def _by_shard(model: Model, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shards that sorted pairs ask for, with the range of these pairs."""
    at = np.append(np.searchsorted(keys, model.bounds), len(keys))
    for s in np.flatnonzero(np.diff(at)).tolist():
        yield s, int(at[s]), int(at[s + 1])


def find_pairs(model: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the quantised probability of sorted pairs, NaN where a pair is unknown, and their places in their shards."""
    out, where = np.full(len(keys), np.nan), np.full(len(keys), -1, np.int64)
    for s, a, b in _by_shard(model, keys):
        held = load(model.path, f"pairs-{s}")
        if not held:
            continue
        lo, hi = (int(x) for x in held["range"])
        u, v = (keys[a:b] >> np.uint64(32)).astype(np.int64), (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        i, j = np.searchsorted(u, lo), np.searchsorted(u, hi, side="right")
        if i == j:
            continue
        u, v, a = u[i:j] - lo, v[i:j], a + i
        new = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        times = np.diff(new, append=len(u))
        begin, end = _sequence(model.path, f"pairs-{s}", "start_").span(u[new])
        place, known = _sequence(model.path, f"pairs-{s}", "next_").within(u * model.words + v, np.repeat(begin, times), np.repeat(end, times))
        found, place = a + np.flatnonzero(known), place[known]
        low, step = held["scale"]
        out[found] = low + step * held["code"][place]
        where[found] = place
    return out, where


def _values(held: dict, name: str) -> np.ndarray:
    """What the 256 codes of a level stand for."""
    key = f"_{name}_values"
    if key not in held:
        low, step = held[f"{name}_scale"]
        held[key] = 10.0 ** (low + step * np.arange(256))
    return held[key]


def find_triples(model: Model, keys: np.ndarray, where: np.ndarray, pair: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words ``last`` after the known pairs ``keys[pair]`` (pair ascending): the triple's share in its context, 0 where it
    is unknown, and the weight that the context leaves to the shorter one."""
    share, left = np.zeros(len(pair)), np.ones(len(pair))
    at = np.searchsorted(pair, np.arange(len(keys) + 1))
    for s, a, b in _by_shard(model, keys):
        i, j = int(at[a]), int(at[b])
        if i == j:
            continue
        held = load(model.path, f"pairs-{s}")
        times = np.diff(at[a : b + 1])
        asked = np.flatnonzero(times)
        place, times = where[a + asked], times[asked]
        left[i:j] = np.repeat(_values(held, "left")[held["left"][place]], times)
        begin, end = (np.repeat(x, times) for x in _sequence(model.path, f"pairs-{s}", "start3_").span(place))
        some = np.flatnonzero(last[i:j] >= 0)
        triple = np.repeat(place * model.words, times)[some] + last[i:j][some]
        found, known = _sequence(model.path, f"pairs-{s}", "next3_").within(triple, begin[some], end[some])
        share[i + some[known]] = _values(held, "share")[held["share"][found[known]]]
    return share, left


def fit(spark: SparkSession, docs: DataFrame, cfg: Settings = Settings()) -> Model:
    """A model of the texts of ``docs`` (text), its files in the shared folder."""
    ready(spark)
    text = docs.select(F.col("text").cast("binary").alias("text"))
    counts = table(spark, text.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    words = counts.count()
    if words >= 1 << 32:
        raise ValueError(f"{words} distinct words, word ids take 32 bits")
    model = Model(new_path(spark, "trie"), cfg, words=words)
    if not words:
        return model
    shards = 1 << max(0, (-(-words // cfg.shard_words) - 1).bit_length())
    model.shift = 63 - (shards.bit_length() - 1)
    sharded = counts.withColumn("shard", F.shiftright("word", model.shift) if model.shift < 63 else F.lit(0).cast("long"))
    built = {r["shard"]: r for r in sharded.groupBy("shard").applyInPandas(_build_words(model.path), "shard long, n long, tokens long").collect()}
    model.first = np.concatenate(([0], np.cumsum([built[s]["n"] if s in built else 0 for s in range(shards)])))
    model.tokens = sum(r["tokens"] for r in built.values())
    model.bounds = _bounds(spark, model, counts)
    drop(spark, counts)
    pairs = text.mapInArrow(_count_pairs(model), "shard long, data binary")
    pairs.groupBy("shard").applyInPandas(_build_pairs(model), "shard long, n long").agg(F.sum("n")).collect()
    return model


def _bounds(spark: SparkSession, model: Model, counts: DataFrame) -> np.ndarray:
    """The first pair of each shard. Ids follow hashes, so cuts at even steps of ids are even cuts of the other words;
    a context with more tokens than a shard's is cut further by its successors."""
    size = model.cfg.shard_tokens
    parts = -(-model.tokens // size)
    cuts = {(model.words * k // parts) << 32 for k in range(parts)}
    heavy = [r["word"] for r in counts.filter(F.col("n") > size // 2).select("word").collect()]  # at most 2 * parts
    if heavy:
        ids, n = find_words(model, np.array(sorted(heavy), np.int64))
        for u, c in zip(ids.tolist(), n.tolist()):
            pieces = -(-c // size)
            cuts |= {(u << 32) | (model.words * k // pieces) for k in range(pieces)} | {(u + 1) << 32}
    return np.array(sorted(cuts), np.uint64)


def _longer(model: Model, score: np.ndarray, at: np.ndarray, pair: np.ndarray, keys: np.ndarray, where: np.ndarray, v: np.ndarray, end: int) -> None:
    """Turn scores by pairs into scores by triples, for the words after the known pairs (numbers ``pair``, ascending) at
    ``at``."""
    inner = v[at] != end
    at, pair = at[inner] + 1, pair[inner]
    share, left = find_triples(model, keys, where, pair, v[at])
    score[at] = np.log10(share + left * 10.0 ** score[at])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = model.tokens + model.words + 1
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for block in blocks(batch.column(1).to_pylist(), _SCORED):
                ids, counts, end, end_count = _ids(model, block)
                ends = block.bounds[1:]
                c = np.insert(counts, ends, end_count)
                u, v = _pairs(block, ids, end)
                cu = np.empty_like(c)
                cu[0], cu[1:] = end_count, c[:-1]
                base = np.log10((c + 1) / total)
                score = base.copy()
                known = np.flatnonzero((u >= 0) & (cu > 0))
                rest = model.cfg.rest(cu[known])
                score[known] += np.log10(rest / (cu[known] + rest))
                both = known[v[known] >= 0]
                del ids, counts, cu, known, rest
                if len(both):
                    asked = (u[both].astype(np.uint64) << np.uint64(32)) | v[both].astype(np.uint64)
                    order = np.argsort(asked)
                    both, asked = both[order], asked[order]
                    del u, order
                    new = np.append(True, asked[1:] != asked[:-1])
                    keys, back = asked[new], np.cumsum(new) - 1  # words in the order of their pairs from here on
                    del asked, new
                    found, where = find_pairs(model, keys)
                    p = found[back]
                    seen = ~np.isnan(p)
                    both, back = both[seen], back[seen]
                    score[both] = p[seen]
                    if model.cfg.order > 2:
                        _longer(model, score, both, back, keys, where, v, end)
                at = block.bounds + np.arange(len(block.bounds))
                for i in range(len(block)):
                    a, b = at[i], at[i + 1]
                    out[0].append(int(b - a)), out[1].append(int((c[a:b] > 0).sum())), out[2].append(float(base[a:b].sum())), out[3].append(float(score[a:b].sum()))
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text)."""
    ready(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
