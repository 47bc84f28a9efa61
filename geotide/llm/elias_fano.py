"""Elias-Fano sequences over numpy arrays that may be memory-mapped.

A monotone sequence of n values below u keeps the low log2(u / n) bits of each value packed, and the high parts as
gaps in a bit vector with a one for each value. Counts of ones before every 128 bits make the k-th one or zero, and
with them access and successor search, a matter of a few vectorised steps.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 2  # words of 64 bits
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_B1, _B2, _B4 = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: The place of the k-th one in a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << off)
        over = off + np.uint64(width) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - off[over]))
    return out


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.width = (int(x) for x in arrays["head"][:2])
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.zeros = arrays.get("zeros")  # as the others, in the mapped file and not in each worker's memory

    @staticmethod
    def build(values: np.ndarray, universe: int, search: bool = True) -> dict[str, np.ndarray]:
        """Arrays for sorted unsigned values below ``universe``; without ``search``, they only serve access by place."""
        n = len(values)
        width = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = _pack(values & np.uint64((1 << width) - 1), width)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = n + (int(universe) >> width) + 2
        words = -(-size // (64 * _BLOCK)) * _BLOCK
        bits = np.zeros(words * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))))[:-1]
        arrays = {"head": np.array([n, width], np.int64), "low": low, "high": high, "ones": ones}
        return arrays | ({"zeros": np.arange(len(ones), dtype=np.int64) * (64 * _BLOCK) - ones} if search else {})

    def _word(self, word: np.ndarray, one: bool) -> np.ndarray:
        return self.high[word] if one else ~self.high[word]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[block]).astype(np.uint64)
        word = block * _BLOCK
        value = self._word(word, one)
        for _ in range(_BLOCK - 1):
            count = np.bitwise_count(value)
            on = count <= rest
            count *= on
            rest -= count
            word += on
            value = self._word(word, one)
        # Ones up to the end of each byte, all eight at once; bytes whose sum is not above ``rest`` are skipped.
        s = value - ((value >> np.uint64(1)) & _B1)
        s = (s & _B2) + ((s >> np.uint64(2)) & _B2)
        s = ((s + (s >> np.uint64(4))) & _B4) * _EACH
        skip = (((((rest * _EACH) | _TOP) - s) & _TOP) >> np.uint64(7)) * _EACH >> np.uint64(56) << np.uint64(3)
        rest -= ((s << np.uint64(8)) >> skip) & np.uint64(255)
        byte = (value >> skip) & np.uint64(255)
        return word * 64 + skip.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3) | rest).astype(np.int64)]

    def _next(self, place: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the one or zero after the k-th, which stands at ``place``: in most cases in the same word."""
        value = self._word(place >> 6, one)
        above = value & ~((np.uint64(2) << (place & 63).astype(np.uint64)) - np.uint64(1))
        out = (place & ~63) + np.bitwise_count((above & (~above + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(above == 0)
        if len(far):
            out[far] = self._select(k[far] + 1, one)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        off = (at & 63).view(np.uint64)
        at >>= 6
        out = self.low[at]
        out >>= off
        at += 1
        up = self.low[at]
        up <<= np.uint64(1)  # in two steps, as a shift by 64 is none
        up <<= np.uint64(63) - off
        out |= up
        out &= np.uint64((1 << self.width) - 1)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and i + 1, as signed numbers: the range of a pointer."""
        i = np.asarray(i, np.int64)
        place = self._select(i, True)
        after = self._next(place, i, True)
        value = lambda at, k: (((at - k) << self.width) | self._low(k).astype(np.int64))
        return value(place, i), value(after, i + 1)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the values with each high part."""
        begin, end = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        inner = np.flatnonzero(high > 0)
        k = high[inner] - 1
        place = self._select(k, False)
        begin[inner], end[inner] = place - k, self._next(place, k, False) - high[inner]
        if len(inner) < len(high):
            end[high == 0] = self._select(np.zeros(1, np.int64), False)[0]
        return begin, end

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value >= x (n where there is none), and whether that value is x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        x = x.astype(np.uint64)
        low = x & np.uint64((1 << self.width) - 1)
        at, end = self._bucket((x >> np.uint64(self.width)).astype(np.int64))
        stop = end.copy()
        todo = np.flatnonzero(at < stop)
        while len(todo):
            middle = (at[todo] + stop[todo]) >> 1
            under = self._low(middle) < low[todo]
            at[todo[under]] = middle[under] + 1
            stop[todo[~under]] = middle[~under]
            todo = todo[at[todo] < stop[todo]]
        equal = np.zeros(len(x), bool)
        some = np.flatnonzero(at < end)
        equal[some] = self._low(at[some]) == low[some]
        return at, equal

    def within(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the value x among those from ``begin`` on and before ``end``, where no value stands twice, and whether
        it is there. A range of one value is read; of a longer one, only the values with x's high part are searched, by halves
        of their low bits, so that no step but the first costs a selection."""
        at, equal = begin.copy(), np.zeros(len(x), bool)
        size = end - begin
        one = np.flatnonzero(size == 1)
        equal[one] = self.access(at[one]) == x[one].astype(np.uint64)
        many = np.flatnonzero(size > 1)
        if not len(many):
            return at, equal
        asked = x[many].astype(np.uint64)
        low = asked & np.uint64((1 << self.width) - 1)
        first, stop = self._bucket((asked >> np.uint64(self.width)).astype(np.int64))
        np.maximum(first, begin[many], out=first)
        np.minimum(stop, end[many], out=stop)
        some = np.flatnonzero(first < stop)
        many, low, first, stop = many[some], low[some], first[some], stop[some]
        todo = np.flatnonzero(stop - first > 1)
        here, till, sought = first[todo], stop[todo], low[todo]
        while len(todo):
            middle = (here + till) >> 1
            upper = self._low(middle) <= sought
            here = np.where(upper, middle, here)
            till = np.where(upper, till, middle)
            first[todo] = here
            on = np.flatnonzero(till - here > 1)
            todo, here, till, sought = todo[on], here[on], till[on], sought[on]
        at[many] = first
        equal[many] = self._low(first) == low
        return at, equal
