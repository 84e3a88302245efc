"""Hashes of words and of word n-grams, many texts at once and without a Python loop over words.

A word is a maximal run of bytes other than blank and \\x09-\\x0D; A-Z count as a-z.
Its hash is a polynomial of its bytes modulo 2**64, mixed: equal words have equal
hashes everywhere, and different ones differ but for a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
LOWER += np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are taken together up to this many bytes; a longer one is taken alone.
GROUP_BYTES = 1 << 18

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            every = np.full(size, b, dtype=np.uint64)
            every[0] = 1
            _powers[k : k + 1] = [np.cumprod(every)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grouped(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Slices of the list of at most GROUP_BYTES, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words end among them."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LOWER[data] * power[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.searchsorted(starts, edges)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word but the last n - 1."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def shingle_sets(texts: list[bytes | None], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; with fewer words the whole sequence as one, without words none."""
    for a, b in grouped(texts):
        hashes, ends = words(texts[a:b])
        all_ = ngrams(hashes, n)
        start = 0
        for end in ends.tolist():
            if end - start >= n:
                yield np.unique(all_[start : end - n + 1])
            elif end > start:
                yield ngrams(hashes[start:end], end - start)
            else:
                yield np.empty(0, dtype=np.uint64)
            start = end
