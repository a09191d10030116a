"""Dealing sorted arrays of 64-bit keys to fragments of the key space and back, as binary blobs.

A row of Spark carries thousands of keys, so the shuffle costs no work for each key on the JVM. Keys are hashes, so a
fragment (a range of the key space) holds an even share; a task's repeats of a key are one entry before the shuffle.
"""

from __future__ import annotations

import numpy as np
import zstandard

FRAGMENT_KEYS = 1 << 19


def pack(values: np.ndarray) -> bytes:
    """An integer array as zstandard-compressed byte planes."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raw: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(kind.itemsize, -1).T).view(kind).ravel()


def fragment_bits(keys: int) -> int:
    """Bits of the key that name its fragment, so that one holds about FRAGMENT_KEYS keys: 3 at least."""
    return max(3, int(np.ceil(np.log2(max(1, keys) / FRAGMENT_KEYS))) if keys > FRAGMENT_KEYS else 3)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the 2 ** bits fragments begin in a sorted key array, with its end."""
    first = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, first), len(keys))
