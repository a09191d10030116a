"""A worker's bounded cache of token ids by chunk of text: every distinct chunk is encoded once, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from graphloom.llm import textops as T

CACHE_KEYS, CACHE_BYTES = 1 << 20, 1 << 25


class ChunkCache:
    """Ids by 64-bit chunk hash, in sorted arrays, each with the chunk's bytes: what a hash finds is held against them. When full it starts anew, so its size never follows the input."""

    def __init__(self, most: int = CACHE_KEYS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, raw: np.ndarray, lengths: np.ndarray) -> None:
        starts, begins = len(self.ids) + np.cumsum(sizes) - sizes, len(self.bytes) + np.cumsum(lengths) - lengths
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, raw])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        join = lambda a, b: np.concatenate([a, b.astype(np.int32)])[order]
        self.keys, self.starts, self.sizes = every[order], join(self.starts, starts), join(self.sizes, sizes)
        self.begins, self.lengths = join(self.begins, begins), join(self.lengths, lengths)

    def _strange(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Chunks whose bytes aren't those that the cache holds for their hash."""
        length = ends - starts
        bad = length != self.lengths[at]
        same = np.flatnonzero(~bad)
        mine, own = T.ranges(starts[same], length[same]), T.ranges(self.begins[at[same]].astype(np.int64), length[same])
        differ = data[mine] != self.bytes[own]
        if differ.any():
            bad[same[np.unique(np.repeat(np.arange(len(same)), length[same])[differ])]] = True
        return np.flatnonzero(bad)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solve: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has. solve(data, starts, ends) gives sizes and ids of chunks."""
        keys, first, inverse = np.unique(T.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            size = int((ends[first[new]] - starts[first[new]]).sum())
            if len(self.keys) + len(new) > self.most or len(self.bytes) + size > CACHE_BYTES:
                self.clear()
                new = np.arange(len(keys))
            begin, end = starts[first[new]], ends[first[new]]
            self._add(keys[new], *solve(data, begin, end), data[T.ranges(begin, end - begin)], end - begin)
            at, known = self._find(keys)
        at = at[inverse]
        sizes = self.sizes[at].astype(np.int64)
        ids = self.ids[T.ranges(self.starts[at].astype(np.int64), sizes)]
        strange = self._strange(data, starts, ends, at)
        if len(strange):  # another chunk with the same hash
            parts, (own, found) = np.split(ids, np.cumsum(sizes)[:-1]), solve(data, starts[strange], ends[strange])
            for k, part in zip(strange, np.split(found, np.cumsum(own)[:-1]), strict=True):
                parts[k] = part
            ids, sizes[strange] = np.concatenate(parts), own
        return ids, sizes
