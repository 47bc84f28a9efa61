"""Vectorised word hashing over UTF-8 bytes.

A word is a run of bytes outside space and \\x09-\\x0D, with A-Z lower-cased; bytes of other characters
never fall in either range, so working on bytes equals working on characters. A word's 64-bit hash is a
polynomial over a random byte table, computed for all words of a piece at once from prefix sums, and finished
by a mixing step. Two different words share a hash with a chance of about 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd factors by which the words of a shingle are told apart by place.
_PLACE = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(64)], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _piece(raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _tables(max(len(raw) + 1, PIECE + 1))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts + at, ends + at


def hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of all words of ``buf``, which is already lower-cased."""
    raw = np.frombuffer(buf, np.uint8)
    if len(raw) <= PIECE + (PIECE >> 2):
        return _piece(raw, 0)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:  # never inside a word
            end += 1
        parts.append(_piece(raw[at:end], at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


class Block:
    """Some documents' words: hashes of all, and the words of document i at bounds[i]:bounds[i + 1]."""

    __slots__ = ("first", "buf", "hashes", "starts", "ends", "bounds", "offsets")

    def __init__(self, first: int, texts: list[bytes]) -> None:
        self.first = first
        self.buf = b"\n".join(texts).lower()
        self.hashes, self.starts, self.ends = hash_words(self.buf)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def blocks(texts: Iterable[bytes | None], size: int = PIECE) -> Iterator[Block]:
    """Documents in blocks of about ``size`` bytes; null texts are empty."""
    held: list[bytes] = []
    first = total = 0
    for text in texts:
        held.append(text or b"")
        total += len(held[-1])
        if total >= size or len(held) >= 4096:
            yield Block(first, held)
            first, held, total = first + len(held), [], 0
    if held:
        yield Block(first, held)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words, in order; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words[:0]
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m] * _PLACE[0]
    for k in range(1, n):
        h = h + words[k : k + m] * _PLACE[k]
    return mix(h + np.uint64(n))
