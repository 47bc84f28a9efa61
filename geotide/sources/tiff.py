"""TIFF files as pixels, for tasks: strips or tiles, plain, deflate, LZW or PackBits, chunky or planar, with or without
horizontal differences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..model import QueryError

# Fixed values of the format: sizes and codes of field types, and codes of sample types by bits and kind.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_SAMPLES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise QueryError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _CODES:
            continue
        size, place = _SIZES[kind] * n, at + 10 + 12 * k
        if size > 4:
            place = struct.unpack(order + "I", data[place : place + 4])[0]
        tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", data[place : place + size])
    return order, tags


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        last = entry
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def blocks(data: bytes, band: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Left column, top row and samples of each strip or tile of a band."""
    order, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, bands, planar = tags[256][0], tags[257][0], one(277, 1), one(284, 1) == 2
    if not 0 <= band < bands:
        raise QueryError(f"no band {band}")
    kind = _SAMPLES.get((one(258, 8), one(339, 1)))
    unpack = _UNPACK.get(one(259, 1))
    if kind is None or unpack is None:
        raise QueryError("a TIFF of unknown samples or compression")
    tiled = 324 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, min(h, one(278, h)))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-w // bw), -(-h // bh)
    per = 1 if planar else bands
    for k in range(across * down):
        n = k + (band * across * down if planar else 0)
        x, y = k % across * bw, k // across * bh
        rows = bh if tiled else min(bh, h - y)
        part = np.frombuffer(unpack(data[places[n] : places[n] + sizes[n]]), np.dtype(order + kind), rows * bw * per).reshape(rows, bw, per)
        if one(317, 1) == 2 and kind[0] != "f":
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        yield x, y, part[: h - y, : w - x, 0 if planar else band]


def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [_tags(d)[1] for d in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([t[tag][0] for t in sizes], pa.int64()) for tag in (256, 257)], ["width", "height"])


def decode(band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pixels of files, rows turned upward, a batch for each strip or tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                h = _tags(data)[1][257][0]
                for x, y, part in blocks(data, band):
                    py, px = np.divmod(np.arange(part.size, dtype=np.int64), part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(px + x), pa.array(h - 1 - y - py), pa.array(part.astype(np.float64).ravel())], ["px", "py", "value"])

    return run
