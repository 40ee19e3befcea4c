"""Content-defined anchors: every window of WINDOW bytes has one, and equal windows have it at the same offset.

The anchor of a window is the K-byte gram of least hash in it, the leftmost of equals.  Neighbouring windows mostly share
their anchor; the bytes of all windows of one anchor are its context.
"""

from __future__ import annotations

import numpy as np

from sphaera.llm.neardup import mix

WINDOW, K = 100, 24
_SPAN = WINDOW - K + 1
#: Longest piece handled at once: positions take the low 24 bits beside the hash.
PIECE = 1 << 23
#: Odd numbers whose powers weigh a context's bytes, one for each half of its 128-bit hash.
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def _power(half: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    if len(_powers[half][0]) < n:
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASES[half], np.uint64(pow(int(_BASES[half]), -1, 1 << 64)))):
                x = np.full(n, b)
                x[0] = 1
                _powers[half][i] = np.cumprod(x)
    return _powers[half][0][:n], _powers[half][1][:n]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position, by joining hashes of 8 and 16 bytes."""
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = _BYTE[b]
        for step in (1, 2, 4):
            h = h[:-step] * m + h[step:]
            h ^= h >> np.uint64(31)
        h16 = h[:-8] * m + h[8:]
        h16 ^= h16 >> np.uint64(29)
        return mix(h16[: len(b) - K + 1] * m + h[16 : 16 + len(b) - K + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, both halves of the context hash, first window, last window) of every anchor of the bytes b, in order."""
    parts = []
    starts = len(b) - WINDOW + 1
    for lo in range(0, max(starts, 0), PIECE):
        hi = min(starts, lo + PIECE)
        piece = b[lo : hi + WINDOW - 1]
        h = gram_hashes(piece)
        packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(packed, _SPAN) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        anchor = at[first]
        value, shape, halves = _BYTE[piece], mix((anchor - first).astype(np.uint64) * np.uint64(1024) + (last - first).astype(np.uint64)), []
        for half in range(2):
            up, down = _power(half, len(piece) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:-1])])
                halves.append(mix((total[last + WINDOW] - total[first]) * down[first] + shape))
        parts.append((h[anchor], *halves, first + lo, last + lo))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
