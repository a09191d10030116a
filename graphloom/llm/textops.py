"""Texts as numpy arrays: Arrow string columns to bytes, words, lines and 64-bit hashes, without a Python loop over words.

All functions take whole texts; a batch is cut into slices of a bounded number of bytes between documents, never inside one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 2 << 20
U = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with at most that many bytes of text (one longer text alone) and rows."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(batch.schema.get_field_index(text)))[1][1:]
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, base + most, "right"))), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes: eight bytes of every span at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    out = mix(words[starts] & masks[np.minimum(length, 8)]) + length.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    at, rest = 8, np.flatnonzero(length > 8)
    while len(rest):
        part = words[starts[rest] + at] & masks[np.minimum(length[rest] - at, 8)]
        out[rest] = mix(out[rest] * U(0xD6E8FEB86659FD93) + part)
        at += 8
        rest = rest[length[rest] > at]
    return mix(out)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no text's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | border[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: starts, ends, and the n + 1 offsets of each text's words."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the offsets of each text's words."""
    low = LOWER[data]
    starts, ends, per = words(low, offsets)
    return hash_spans(low, starts, ends), per


def shingles(hashes: np.ndarray, per: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of a text, or of all its words where it has fewer; and the text each belongs to."""
    count = np.diff(per)
    owner = np.repeat(np.arange(len(count)), count)
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]
    odd = [odd[k % 5] * U(2 * (k // 5) + 1) for k in range(n)]
    if len(hashes) >= n:
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total += hashes[k : len(hashes) - n + 1 + k] * odd[k]
        whole = owner[: len(total)] == owner[n - 1 :]
        out, docs = [mix(total[whole])], [owner[: len(total)][whole]]
    else:
        out, docs = [], []
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            total = np.full(len(few), k * 0x51ED27, np.uint64)
            for j in range(k):
                total += hashes[per[few] + j] * odd[j]
            out.append(mix(total))
            docs.append(few)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs)


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return first + np.arange(total)
