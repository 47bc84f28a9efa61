"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

A unit is a word reduced to its letters in any alphabet (signs inside it that stand for letters are read as those, other
signs go), or a run of single letters joined. The kernel compares two units, each between a mark for its begin and one
for its end, by their common subsequences of four characters that span at most ``span``; each letter skipped costs a
factor ``decay``. Gapped, doubled and inserted letters thus cost a little and not a match, and words of one family share
what they have in common. The kernel is divided by its value for strings of the same lengths without repeated
letters. A sentence is the bag of its units.

The machine is trained on the sentences of labelled documents, by multiple instances: every unit of a sentence of label
0 is negative; of a document labelled 1 only some units are to blame. It starts with all of them and then takes, in
``rounds`` rounds, the ``share`` of the document's units with the highest margins as its witnesses, so that the rare
forms of one family are found through the kernel; in the last round also variants of the best witnesses with inserted
and doubled letters. Half of the landmarks are the units whose documents favour label 1 most, the others are spread over
all units. The Nystroem map makes the machine linear, where Newton steps on the squared hinge solve it; as the features
are explicit (hashed to 2**bits), the landmark expansion collapses into one weight for each, and scoring costs no more
with more landmarks.

A document is judged by its largest margin and by the mean of its words' positive margins; a logistic fit on labelled
documents that the machine was not trained on turns both into the score. Where the machine has learned nothing the fit
is flat and every score is about the share of label 1.

Bounds of the training sample: ``per_label`` documents of each label, chosen by a hash of the id, equal texts once;
of their sentences at most ``sentences`` a label, chosen by a hash of the text and place, each of at most
``longest_sentence`` words (longer ones are cut, nothing is lost). Scoring reads whole texts of any length.

Null and empty texts score as texts without insults; without labels, or with one label only, every score is the share
of label 1 (0 without labels). Labels given twice count as the larger; repeated rows are judged alike, equal scores stay
equal; other columns are passed through as asked.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .runtime import LITTLE, drop, ready, table, uniform
from .words import blocks


@dataclass(frozen=True)
class Settings:
    decay: float = 0.6
    span: int = 7
    bits: int = 16
    landmarks: int = 512
    per_label: int = 3000
    sentences: int = 25_000
    longest_sentence: int = 64
    longest: int = 24
    units: int = 24_000
    share: float = 0.02
    rounds: int = 4
    variants: int = 6
    cost: float = 1000.0
    negative_cost: float = 75.0
    ridge: float = 1.0


#: Signs read as letters when they stand inside a word.
_LEET = str.maketrans("013457@$!|", "oieastasii")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_STOP = re.compile(r"[.!?;:\n]+")


def unit(token: str) -> str:
    """The letters a token stands for."""
    t = token.lower()
    if t.isalpha() and t.isascii():
        return t
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    if t.isalpha():
        return t
    t = t.strip(_EDGE)
    if any(c.isalpha() for c in t):
        t = t.translate(_LEET)
    return "".join(c for c in t if c.isalpha())


def pieces(letters: str, longest: int) -> list[str]:
    """A unit, or overlapping windows of a very long one; nothing of fewer than three letters."""
    if len(letters) <= longest:
        return [letters] if len(letters) >= 3 else []
    half = longest // 2
    return [letters[k : k + longest] for k in range(0, len(letters) - half, half)]


def sentences(text: str, cfg: Settings) -> list[list[str]]:
    """The distinct units of each sentence."""
    out = []
    for s in _STOP.split(text):
        words = s.split()
        for at in range(0, len(words), cfg.longest_sentence):
            own = {p for w in words[at : at + cfg.longest_sentence] for p in pieces(unit(w), cfg.longest)}
            if own:
                out.append(sorted(own))
    return out


# The kernel.

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def steps(cfg: Settings) -> list[tuple[tuple[int, int, int], float]]:
    """Places of the second to fourth character after the first, with their weight."""
    return [((i, j, k), cfg.decay ** (k - 3)) for k in range(3, cfg.span) for j in range(2, k) for i in range(1, j)]


def features(strings: list[str], cfg: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of steps: the strings it fits in, the hashed four characters, and its weight."""
    marked = ["^" + s + "$" for s in strings]
    length = np.array([len(s) for s in marked], np.int64)
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(marked)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(own))  # characters from here to the string's end
    for (i, j, k), weight in steps(cfg):
        at = np.flatnonzero(left > k)
        h = (cp[at] * _MIX[0]) ^ (cp[at + i] * _MIX[1])
        h = h * _MIX[2] + cp[at + j]
        h = (h ^ (h >> np.uint32(15))) * _MIX[3] + cp[at + k]
        h = (h ^ (h >> np.uint32(13))) * _MIX[0]
        yield own[at], (h >> np.uint32(32 - cfg.bits)).astype(np.int64), weight


def norms(strings: list[str], cfg: Settings) -> np.ndarray:
    """Root of the kernel of a string with itself, as if no letter were repeated: a function of the length."""
    length = np.array([len(s) for s in strings]) + 2
    total = np.zeros(len(strings))
    for (_, _, k), weight in steps(cfg):
        total += np.maximum(0, length - k) * weight**2
    return np.sqrt(total)


def project(strings: list[str], weights: np.ndarray, cfg: Settings) -> np.ndarray:
    """phi(s) . weights for each string of 3 or more letters."""
    out = np.zeros(len(strings))
    for at in range(0, len(strings), 8000):
        part = strings[at : at + 8000]
        for own, f, weight in features(part, cfg):
            out[at : at + len(part)] += weight * np.bincount(own, weights[f], minlength=len(part))
    return out / np.maximum(norms(strings, cfg), 1e-9)


class Landmarks:
    """Features of some strings by feature, so that others' kernels with them touch what they share alone."""

    def __init__(self, strings: list[str], cfg: Settings) -> None:
        self.cfg, self.n = cfg, len(strings)
        own, f, weight = (np.concatenate(x) for x in zip(*[(o, f, np.full(len(o), w)) for o, f, w in features(strings, cfg)]))
        weight = weight / norms(strings, cfg)[own]
        order = np.argsort(f, kind="stable")
        self.own, self.feature, self.weight = own[order], f[order], weight[order]
        self.first = np.searchsorted(self.feature, np.arange((1 << cfg.bits) + 1))

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.n), np.float32)
        for at in range(0, len(strings), 1000):
            part = strings[at : at + 1000]
            held = np.zeros(len(part) * self.n)
            for own, f, weight in features(part, self.cfg):
                count = self.first[f + 1] - self.first[f]
                row = np.repeat(np.arange(len(f)), count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.first[f[row]]
                held += np.bincount(own[row] * self.n + self.own[place], weight * self.weight[place], minlength=len(held))
            out[at : at + len(part)] = held.reshape(len(part), self.n) / norms(part, self.cfg)[:, None]
        return out

    def expand(self, alpha: np.ndarray) -> np.ndarray:
        """One weight a feature for a combination of the landmarks."""
        return np.bincount(self.feature, self.weight * alpha[self.own], minlength=1 << self.cfg.bits)


def solve(z: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float, part: int = 4096) -> np.ndarray:
    """Linear machine with bias (last) of the squared hinge by Newton steps; each row weighs ``bad`` as a case of label 1
    and ``good`` as one of label 0."""
    d = z.shape[1] + 1
    reg = np.eye(d) * ridge
    reg[-1, -1] = 1e-3
    w = np.zeros(d)
    for turn in range(40):
        left, right = reg.copy(), np.zeros(d)
        for at in range(0, len(z), part):
            x = np.hstack((z[at : at + part].astype(np.float64), np.ones((min(part, len(z) - at), 1))))
            f = x @ w
            up, down = bad[at : at + part] * (f < 1), good[at : at + part] * (f > -1)
            left += (x * (up + down)[:, None]).T @ x
            right += x.T @ (up - down)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6
        w = 0.5 * w + 0.5 * new if turn > 12 else new
        if done:
            break
    return w


# The model.


@dataclass
class Model:
    cfg: Settings
    base: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    fit: tuple[float, float, float] = (0.0, 0.0, 0.0)
    landmarks: list[str] = field(default_factory=list)
    key: str = ""

    def margins(self, strings: list[str]) -> np.ndarray:
        return project(strings, self.weights, self.cfg) + self.bias

    def score(self, seen: np.ndarray) -> np.ndarray:
        """Scores of documents from ``views`` rows."""
        if self.weights is None:
            return np.full(len(seen), self.base)
        x = _inputs(seen)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.fit), -40, 40)))


def _inputs(seen: np.ndarray) -> np.ndarray:
    return np.stack((np.clip(seen[:, 0], -2, 2), np.log(0.002 + np.minimum(seen[:, 1], 1.0)), np.ones(len(seen))), axis=1)


#: Margins of tokens by token hash, of the model whose key is given.
_known: dict[int, float] = {}
_known_of = [""]
_NONE = -2.0


def views(texts: list[bytes | None], model: Model, cache: int = 200_000) -> np.ndarray:
    """For each document its largest margin and the mean over its words of their margins above 0.

    Margins of tokens are kept between calls, up to ``cache`` of them; words without a unit, and texts without words,
    have margin -2."""
    if _known_of[0] != model.key:
        _known.clear()
        _known_of[0] = model.key
    out = []
    for block in blocks(texts):
        tokens, first, back = np.unique(block.hashes, return_index=True, return_inverse=True)
        if len(_known) > cache:
            _known.clear()
        parts, owner = [], []
        for h, a, b in zip(tokens.tolist(), block.starts[first].tolist(), block.ends[first].tolist()):
            if h not in _known:
                own = pieces(unit(block.buf[a:b].decode("utf-8", "replace")), model.cfg.longest)
                parts += own
                owner += [h] * len(own)
                _known[h] = _NONE
        for h, v in zip(owner, model.margins(parts).tolist() if parts else ()):
            _known[h] = max(_known[h], v)
        value = np.array([_known[h] for h in tokens.tolist()], np.float64)[back]
        bounds, n = block.bounds, len(block)
        most, total = np.full(n, _NONE), np.zeros(n)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            most[some] = np.maximum.reduceat(value, bounds[some])
            total[some] = np.add.reduceat(np.maximum(0.0, value), bounds[some])
        for d, letters in _spelt(block):
            own = pieces(letters, model.cfg.longest)
            if own:
                m = float(model.margins(own).max())
                most[d], total[d] = max(most[d], m), total[d] + max(0.0, m)
        out.append(np.stack((most, total / np.maximum(1, np.diff(bounds))), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2))


def _spelt(block) -> Iterator[tuple[int, str]]:
    """Document and letters of each run of three or more single characters that stand as words."""
    if not len(block.starts):
        return
    begun = np.concatenate(([0], np.cumsum((np.frombuffer(block.buf, np.uint8) & 0xC0) != 0x80)))
    single = begun[block.ends] - begun[block.starts] == 1
    doc = np.repeat(np.arange(len(block)), np.diff(block.bounds))
    joined = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= 2:
            yield int(doc[a]), "".join(unit(block.buf[s:e].decode("utf-8", "replace")) for s, e in zip(block.starts[a : b + 1].tolist(), block.ends[a : b + 1].tolist()))


# Training.


def variants(word: str, n: int, rs: np.random.RandomState) -> list[str]:
    """The word with letters inserted or doubled."""
    out = []
    for k in range(n):
        at = rs.randint(1, len(word))
        out.append(word[:at] + (word[at - 1] if k % 2 else chr(97 + rs.randint(26))) + word[at:])
    return out


def learn(bags: Iterable[tuple[int, int, list[str]]], cfg: Settings) -> tuple[np.ndarray, float, list[str]] | None:
    """Weights, bias and landmarks from (document, label, units of a sentence); nothing without units of both labels."""
    units: dict[int, set[str]] = {}
    label: dict[int, int] = {}
    for doc, y, own in bags:
        units.setdefault(doc, set()).update(own)
        label[doc] = y
    bad, good = {}, {}
    for doc, own in units.items():
        count = bad if label[doc] else good
        for u in own:
            count[u] = count.get(u, 0) + 1
    n_bad = sum(label.values())
    n_good = len(label) - n_bad
    if not bad or not good:
        return None
    rs = np.random.RandomState(29)
    words = sorted(bad.keys() | good.keys())
    a, b = np.array([bad.get(u, 0) for u in words], float), np.array([good.get(u, 0) for u in words], float)
    odds = a * np.log((a + 0.3) / n_bad / ((b + 1) / n_good))
    # Rows to train on: units of label 1 that are frequent or favour it first, then others by chance.
    order = np.lexsort((rs.rand(len(words)), -np.where(a > 0, a + b, 0.0)))
    keep = np.sort(order[: cfg.units])
    words, a, b, odds = [words[k] for k in keep], a[keep], b[keep], odds[keep]
    top = np.argsort(-odds, kind="stable")[: min(cfg.landmarks // 2, len(words) // 2)]
    rest = np.setdiff1d(np.arange(len(words)), top)
    chosen = np.concatenate((top, rs.permutation(rest)[: cfg.landmarks - len(top)]))
    marks = [words[k] for k in chosen]
    land = Landmarks(marks, cfg)
    gram = land.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    use = value > 1e-6 * value.max()
    root = (vector[:, use] / np.sqrt(value[use])).astype(np.float32)
    z = np.concatenate([land.kernel(words[at : at + 4000]) @ root for at in range(0, len(words), 4000)])
    place = {u: k for k, u in enumerate(words)}
    of_bad = [np.array(sorted(place[u] for u in own if u in place), np.int64) for doc, own in units.items() if label[doc]]
    of_bad = [k for k in of_bad if len(k)]
    blame, w = a.copy(), np.zeros(0)
    for turn in range(cfg.rounds + 1):
        price = cfg.cost if turn == 0 else cfg.cost * cfg.negative_cost
        up, down, rows = blame * (cfg.cost / blame.sum()), b * (price / max(1.0, b.sum())), z
        if turn == cfg.rounds and cfg.variants:
            best = [k for k in np.argsort(-f, kind="stable")[: cfg.landmarks // 2].tolist() if f[k] > 0.5 and blame[k] > 0]
            more = [v for k in best for v in variants(words[k], cfg.variants, rs)]
            if more:
                rows = np.vstack((z, land.kernel(more) @ root))
                each = np.repeat(up[best] / cfg.variants, cfg.variants)
                up, down = np.concatenate((up, each)), np.concatenate((down, np.zeros(len(more))))
        w = solve(rows, down, up, cfg.ridge)
        f = z @ w[:-1] + w[-1]
        blame = np.zeros(len(words))
        for own in of_bad:
            k = max(1, int(round(len(own) * cfg.share)))
            blame[own[np.argsort(-f[own], kind="stable")[:k]]] += 1.0 / k
    return land.expand(root.astype(np.float64) @ w[:-1]), float(w[-1]), marks


def _sentences_of(cfg: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, label, place, units = [], [], [], []
            for d, y, t in zip(*[c.to_pylist() for c in batch.columns]):
                own = sentences((t or b"").decode("utf-8", "replace"), cfg)
                doc += [d] * len(own)
                label += [y] * len(own)
                place += range(len(own))
                units += own
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(place, pa.int64()), pa.array(units, pa.list_(pa.string()))], ["doc", "label", "place", "units"])

    return run


def _learn(cfg: Settings):
    """``learn`` in one task, over sorted rows of bounded number: its matrices are no matter of the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, batch.num_rows, 2000) for r in zip(*[batch.slice(at, 2000).column(c).to_pylist() for c in ("doc", "label", "units")]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows, cfg), protocol=5)], pa.binary())], ["model"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    ready(spark, LITTLE)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter("label in (0, 1)")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(cfg, 0.0)
    base = sizes.get(1, 0) / sum(sizes.values())
    if len(sizes) < 2:
        return Model(cfg, base)
    share = {k: min(1.0, cfg.per_label / n) for k, n in sizes.items()}
    chosen = known.filter(uniform(29, F.col("doc_id")) < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).select(F.col("doc_id").alias("_id"), "label")
    # At most about 2 * per_label ids: small whatever the input.
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    sample = sample.select("label", F.xxhash64("text").alias("doc"), F.col("text").cast("binary").alias("text")).dropDuplicates(["label", "doc"])
    sample = table(spark, sample, "sample")
    kept = sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("doc & 3 = 0")).alias("apart")).collect()
    apart = len(kept) == 2 and all(r["apart"] >= 5 and r["n"] - r["apart"] >= 5 for r in kept)
    rows = sample.filter("doc & 3 <> 0") if apart else sample
    each = table(spark, rows.select("doc", "label", "text").mapInArrow(_sentences_of(cfg), "doc long, label int, place long, units array<string>"), "sentences")
    counts = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(cfg, base)
    part = F.when(F.col("label") == 1, min(1.0, cfg.sentences / counts[1])).otherwise(min(1.0, cfg.sentences / counts[0]))
    taken = each.filter(uniform(30, F.col("doc"), F.col("place")) < part).select("doc", "label", "place", "units").repartition(1).sortWithinPartitions("doc", "label", "place")
    row = taken.mapInArrow(_learn(cfg), "model binary").first()
    found = pickle.loads(row[0]) if row else None
    if found is None:
        return Model(cfg, base)
    weights, bias, marks = found
    model = Model(cfg, base, weights, bias, landmarks=marks, key=hashlib.sha1(weights.tobytes() + repr((bias, cfg)).encode()).hexdigest())
    _calibrate(model, sample.filter("doc & 3 = 0") if apart else sample, share)
    drop(spark, sample), drop(spark, each)
    return model


def _views(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = views(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen[:, 0]), pa.array(seen[:, 1])], ["label", "most", "mean"])

    return run


def _calibrate(model: Model, sample: DataFrame, share: dict[int, float]) -> None:
    """Logistic weights of the two views, rows weighed by what they stand for; both can only raise a score."""
    rows = sample.select("label", "text").mapInArrow(_views(model), "label int, most double, mean double").orderBy("label", "most", "mean").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = _inputs(np.stack((rows.column("most").to_numpy(), rows.column("mean").to_numpy()), axis=1))
    w = np.where(y == 1, 1 / share[1], 1 / share[0])
    w = w / w.mean()
    use = [0, 1, 2]
    while True:
        beta = _logistic(x[:, use], y, w)
        low = [u for u, v in zip(use[:-1], beta[:-1]) if v < 0]
        if not low:
            break
        use = [u for u in use if u not in low]
    out = [0.0, 0.0, 0.0]
    for u, v in zip(use, beta.tolist()):
        out[u] = v
    model.fit = (out[0], out[1], out[2])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x`` (the last is 1), by Newton steps on standardised columns, halved while they overshoot."""
    mean, wide = x[:, :-1].mean(axis=0), np.maximum(x[:, :-1].std(axis=0), 1e-9)
    u = np.hstack(((x[:, :-1] - mean) / wide, np.ones((len(x), 1))))
    reg = np.diag([0.5] * (u.shape[1] - 1) + [1e-6])
    beta = np.zeros(u.shape[1])

    def loss(b: np.ndarray) -> float:
        f = u @ b
        return float((w * (np.logaddexp(0, f) - y * f)).sum() + b @ reg @ b / 2)

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ beta, -40, 40)))
        step = np.linalg.solve((u * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ u + reg, u.T @ (w * (y - p)) - reg @ beta)
        size = 1.0
        while (new := loss(beta + size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-9:
            break
        beta, now = beta + size * step, new
    out = beta[:-1] / wide
    return np.append(out, beta[-1] - out @ mean)


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = views(batch.column(0).cast(pa.binary()).to_pylist(), model) if model.weights is not None else np.zeros((batch.num_rows, 2))
            kept = batch.columns[0 if batch.schema.names[0] == "text" else 1 :]
            yield pa.RecordBatch.from_arrays([pa.array(model.score(seen), pa.float64()), *kept], ["_gt_score", *batch.schema.names[-len(kept) :]] if kept else ["_gt_score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the score of its text as ``_gt_score``; a kept text goes to the workers once."""
    ready(spark, LITTLE)
    text = F.col("text") if "text" in keep else F.col("text").cast("binary").alias("_gt_b")
    rest = [c for c in keep if c != "text"]
    sent = ["text", *rest] if "text" in keep else rest
    schema = ", ".join(["_gt_score double", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in sent]])
    return docs.select(text, *rest).mapInArrow(_judge(model), schema).select("_gt_score", *keep)
