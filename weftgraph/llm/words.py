"""Words and word shingles of many texts at once, as numpy arrays.

A word is a run of bytes that are not one of blank, tab, line feed, vertical
tab, form feed and carriage return; A-Z may be lowered first.  Arrow finds the
distinct words of a block by their bytes, and each of them is hashed once with
64 bits of XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Bytes hashed in one pass; a longer text is a block of its own.
BLOCK = 1 << 18

_RANDOM = np.random.default_rng(20240917)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = 20240917
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that ends with a blank."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # Spans and the gaps between them share their edges, so one array of offsets names both.
    edges = np.stack((starts, ends), axis=1).ravel().astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode()
    values = np.fromiter(map(xxh3_64_intdigest, found.dictionary.to_pylist(), repeat(_SEED)), dtype=np.uint64, count=len(found.dictionary))
    return values[found.indices.to_numpy()[0::2]]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and where each begins, with the end."""
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), np.cumsum(np.array([0] + [len(t) + 1 for t in texts]))


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lowered, and the number of words before each text, with the total."""
    buf, place = joined(texts)
    buf = lowered(buf)
    starts, ends = spans(buf)
    return hash_spans(buf, starts, ends), np.searchsorted(starts, place)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; a shorter sequence is one run, an empty one none."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out += h[j : n - k + 1 + j] * _PLACE[j]
    return mixed(out + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles, with A-Z lowered."""
    for a, b in blocks(texts):
        h, at = hashed(texts[a:b])
        for i in range(b - a):
            yield np.unique(windows(h[at[i] : at[i + 1]], k))
