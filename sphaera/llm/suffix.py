"""Suffix arrays of many pieces at once: Larsson-Sadakane refinement and Kasai's common prefixes in numpy."""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of 9 bits in the first sort key


class Pieces:
    """Byte strings laid end to end, each closed by a mark of its own that sorts before all bytes, in piece order."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.length + 1) - self.length - 1
        n = int((self.length + 1).sum())
        self.piece = np.repeat(np.arange(len(pieces)), self.length + 1)
        self.offset = np.arange(n) - self.start[self.piece]
        self.rest = self.length[self.piece] - self.offset  # bytes from here to the mark
        self.sym = np.zeros(n, np.uint64)
        self.sym[self.rest > 0] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64) + np.uint64(1)


def suffix_ranks(t: Pieces) -> np.ndarray:
    """Rank of every suffix (a suffix ends at its piece's mark; equal ones rank in piece order)."""
    n = len(t.sym)
    if not n:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(_FIRST):
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - k, 0)] = t.sym[k:]
        key |= np.where(t.rest > k, ahead, 0).astype(np.uint64) << np.uint64(9 * (_FIRST - 1 - k))
    order = np.argsort(key)  # order among equals does not matter before the last step
    new = np.diff(key[order], prepend=key[order[0]] ^ np.uint64(1)) != 0
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[order] = head[np.cumsum(new) - 1]
    size = np.diff(np.append(head, n))
    todo = order[np.repeat(size > 1, size)]
    h, deepest = _FIRST, int(t.rest.max()) + 1
    while len(todo) and h < deepest:
        ahead = np.zeros(len(todo), np.int64)
        inside = t.rest[todo] >= h
        ahead[inside] = rank[todo[inside] + h] + 1
        pair = rank[todo].astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)
        place = np.argsort(pair)
        todo, pair = todo[place], pair[place]
        old = rank[todo]
        group = np.flatnonzero(np.diff(old, prepend=-1))
        first_in_old = np.repeat(group, np.diff(np.append(group, len(todo))))
        fresh = np.flatnonzero(np.diff(pair, prepend=pair[0] ^ np.uint64(1)) != 0)
        size = np.diff(np.append(fresh, len(todo)))
        lead = np.repeat(fresh, size)
        rank[todo] = old + lead - first_in_old
        todo = todo[np.repeat(size > 1, size)]
        h *= 2
    order = np.argsort(rank * n + np.arange(n))
    rank[order] = np.arange(n)
    return rank


def kasai(t: Pieces, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it in that order).

    Kasai's pass goes through a piece from left to right and keeps the common prefix less one; all pieces go side by
    side.  Bytes are compared seven at a time.
    """
    n = len(rank)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    if not n:
        return sa, lcp
    word = np.zeros(n, np.uint64)
    for k in range(_FIRST):
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - k, 0)] = t.sym[k:]
        word |= np.where(t.rest > k, ahead, 0).astype(np.uint64) << np.uint64(9 * (_FIRST - 1 - k))
    limit = np.array([1 << (9 * (_FIRST - k)) for k in range(_FIRST + 1)], np.uint64)  # equal symbols k: xor below limit[k]
    h = np.zeros(len(t.start), np.int64)
    for step in range(int(t.length.max()) + 1):
        lane = np.flatnonzero(t.length >= step)
        i = t.start[lane] + step
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        own = np.where(r > 0, np.maximum(h[lane] - 1, 0), 0)
        most = np.where(r > 0, np.minimum(t.rest[i], t.rest[j]), 0)
        own = np.minimum(own, most)
        go = np.flatnonzero(own < most)
        while len(go):
            x = word[i[go] + own[go]] ^ word[j[go] + own[go]]
            same = _FIRST - np.searchsorted(limit[::-1], x, side="right") + 0
            same = np.clip(same, 0, _FIRST)
            own[go] = np.minimum(own[go] + same, most[go])
            go = go[(same == _FIRST) & (own[go] < most[go])]
        h[lane] = own
        lcp[r] = own
    return sa, lcp


def least_of_equal(t: Pieces, width: int, order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions with width bytes ahead, the least order_key among the positions with the same width bytes)."""
    sa, lcp = kasai(t, suffix_ranks(t))
    keep = t.rest[sa] >= width
    # a suffix too short to count never shares width bytes, so runs of lcp >= width hold only full windows
    group, at = np.cumsum(lcp < width)[keep], sa[keep]
    head = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(head):
        return at, np.zeros(0, np.int64)
    return at, np.repeat(np.minimum.reduceat(order_key[at], head), np.diff(np.append(head, len(at))))
