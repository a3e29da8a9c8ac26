"""Numpy arrays as compressed binary cells, so that one row carries a batch of numbers."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 3


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as one compressed cell."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), a.size)], np.int64)
    body = b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return zstandard.ZstdCompressor(level=LEVEL).compress(body)


def unpack(cell: bytes) -> list[np.ndarray]:
    """The flat arrays of a cell."""
    body = zstandard.ZstdDecompressor().decompress(cell)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 2 * n, 8)
    arrays, at = [], 8 + 16 * n
    for kind, size in head.reshape(-1, 2).tolist():
        arrays.append(np.frombuffer(body, chr(kind), size, at))
        at += arrays[-1].nbytes
    return arrays
