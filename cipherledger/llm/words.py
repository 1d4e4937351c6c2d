"""Words of UTF-8 texts and their hashes, many documents at a time, in numpy.

Two word rules are used, both after lower-casing A-Z:

* ``ALNUM``: runs of ASCII letters and digits and of everything beyond ASCII;
* ``SPACED``: runs of anything but space and the control characters 9 to 13.

A separator byte becomes a space, so ``bytes.split`` yields the words.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in _LOWER)
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in _LOWER)
SPACED_CASED = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # one odd factor for each word of a window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE[32] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(2 * n, _BASE, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS



def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and offsets: document i has words offsets[i]:offsets[i + 1]."""
    joined = b" ".join(texts).translate(table)
    b = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    inside = b != 32
    before = np.concatenate(([False], inside[:-1]))[: len(b)]
    starts = np.flatnonzero(inside & ~before)
    offsets = np.searchsorted(starts, edges)
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[b[at]] * _powers(int(lengths.max()))[place], first)
    return mix(h), offsets


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; windows may run over the end of a document."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += words[j : j + n] * _STEP[j]
    return mix(h + np.uint64(size))


def batches(texts: list[bytes], limit: int = 1 << 20):
    """Slices of the list with about ``limit`` bytes each, so that temporaries stay small."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def utf8(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes the empty text."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
