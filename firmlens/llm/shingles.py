"""Hashed word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from firmlens.llm.tokens import _byte_groups

REMEMBER = 400_000


class _Hashes(dict):
    """Word (bytes) to its 64-bit hash; what is remembered is bounded."""

    def __missing__(self, word):
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_here = _Hashes()


def group_words(texts: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, hashes of their words one after another, where each row's words start). Words are runs
    of anything but space and 0x09 to 0x0D."""
    for i, j in _byte_groups(texts):
        words, starts = [], []
        for t in texts.slice(i, j - i).cast(pa.binary()).to_pylist():
            starts.append(len(words))
            words += (t or b"").split()
        yield range(i, j), np.fromiter(map(_here.__getitem__, words), np.uint64, len(words)), np.array(starts, np.int64)


def group_hashes(texts: pa.Array, n: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, hashes of their shingles of n words, where each row's shingles start). A row with 1 to n - 1 words has one shingle of them all."""
    step = np.uint64(0x9E3779B97F4A7C15)
    for rows, words, starts in group_words(texts):
        count = np.diff(np.append(starts, len(words)))
        # shorter rows are padded with zeros to n words
        pad = np.where((count > 0) & (count < n), n - count, 0)
        if pad.any():
            words = np.insert(words, np.repeat(starts + count, pad), np.uint64(0))
            count = count + pad
            starts = np.cumsum(count) - count
        if len(words) < n:
            yield rows, np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
            continue
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(32))) * step + words[k : len(words) - n + 1 + k]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        shingles = np.maximum(count - n + 1, 0)
        inside = np.ones(len(words), bool)
        ends = starts + count
        for k in range(1, n):  # windows that would begin in the last n - 1 words of a row
            at = ends[count >= n] - k
            inside[at] = False
        yield rows, h[inside[: len(h)]], np.cumsum(shingles) - shingles
