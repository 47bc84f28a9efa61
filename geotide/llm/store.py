"""Arrays that tasks write to the shared folder and other tasks read.

A file is written under a passing name and then moved, so a task may run twice. All arrays of a name are in one file: in a
local or mounted folder it is memory-mapped, one map a name and no file kept open where Python allows; from any other
store it is read into memory, at most ``MEMORY`` bytes at a time in a worker. At most ``MAPS`` names are held.
"""

from __future__ import annotations

import mmap
import pickle
import resource
import struct
import sys
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

MEMORY = 256 << 20
#: Maps kept need no open file from Python 3.13 on; a process may have 65,530 maps on Linux.
_FREE = sys.version_info >= (3, 13)
MAPS = 16384 if _FREE else max(16, min(4096, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 4))
_ALIGN = 64
_held: OrderedDict[tuple[str, str], tuple[object, int]] = OrderedDict()


def put(path: str, name: str, *data: memoryview | bytes) -> None:
    """Write a file whole or not at all."""
    store, at = fs.FileSystem.from_uri(path)
    folder = f"{at}/{name}".rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    passing = f"{at}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as out:
        for part in data:
            out.write(part)
    store.move(passing, f"{at}/{name}")


def _keep(key: tuple[str, str], value: object, size: int) -> None:
    _held[key] = value, size
    total = sum(n for _, n in _held.values()) if size else 0  # mapped files count nothing
    while len(_held) > 1 and (total > MEMORY or len(_held) > MAPS):
        _, (_, n) = _held.popitem(last=False)
        total -= n


def save(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a head, the head with each array's name, kind, shape and place, the arrays."""
    parts, places, at = [], [], 0
    for key, a in arrays.items():
        a = np.ascontiguousarray(a)
        places.append((key, a.dtype.str, a.shape, at))
        parts += [a.reshape(-1).view(np.uint8), bytes(-a.nbytes % _ALIGN)]
        at += a.nbytes + len(parts[-1])
    head = pickle.dumps(places)
    head += bytes(-(8 + len(head)) % _ALIGN)
    put(path, f"{name}.arrays", struct.pack("<q", len(head)), head, *[p for p in parts if len(p)])


def _arrays(data: mmap.mmap | bytes) -> dict[str, np.ndarray]:
    (size,) = struct.unpack("<q", data[:8])
    out = {}
    for key, kind, shape, at in pickle.loads(data[8 : 8 + size]):
        out[key] = np.frombuffer(data, kind, int(np.prod(shape, dtype=np.int64)), 8 + size + at).reshape(shape) if 0 not in shape else np.zeros(shape, kind)
    return out


def load(path: str, name: str) -> dict:
    """The arrays saved under a name; nothing where there are none. Callers may add what they derive from them."""
    if (path, name) in _held:
        _held.move_to_end((path, name))
        return _held[path, name][0]  # type: ignore[return-value]
    store, at = fs.FileSystem.from_uri(path)
    (found,) = store.get_file_info([f"{at}/{name}.arrays"])
    out, size = {}, 0
    if found.type == fs.FileType.File:
        if isinstance(store, fs.LocalFileSystem):
            with open(found.path, "rb") as s:
                out = _arrays(mmap.mmap(s.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if _FREE else {})))
        else:
            with store.open_input_file(found.path) as s:
                out = _arrays(s.read())
            size = found.size
    _keep((path, name), out, size)
    return out


def save_object(path: str, name: str, value: object) -> None:
    put(path, name, pickle.dumps(value, protocol=5))


def load_object(path: str, name: str) -> object:
    if (path, name) in _held:
        _held.move_to_end((path, name))
        return _held[path, name][0]
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{at}/{name}") as s:
        data = s.read()
    value = pickle.loads(data)
    _keep((path, name), value, 4 * len(data))
    return value
