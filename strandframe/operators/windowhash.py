"""Hashes of windows of texts laid end to end, by doubling, and what is found by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Candidates that are compared at a time.
MEETINGS = 1_000_000


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (x * _M[0]) ^ (y * _M[1] + _M[2])
    out ^= out >> np.uint64(32)
    out *= _M[3]
    out ^= out >> np.uint64(29)
    return out


def levels(text: bytes, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """1, 2, 4 ... up to `most`, each with the hashes of all windows of that size."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    h, size = mixed(x, x), 1
    while len(h) and size <= most:
        yield size, h
        h = mixed(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2


def fixed(text: bytes, size: int) -> np.ndarray:
    """Hashes of all windows of one size: of its two ends of a power of two, which cover it."""
    for p, h in levels(text, size):
        if 2 * p > size:
            n = len(text) - size + 1
            return mixed(h[:n], h[size - p : size - p + n]) if n > 0 else h[:0]
    return np.zeros(0, np.uint64)


class Filter:
    """A set of hashes of which one in a hundred others seems to be a member, in at most 32 MB."""

    def __init__(self, expected: int):
        self.bits = min(max(int(16 * expected).bit_length(), 16), 28)
        self.seen = np.zeros(1 << (self.bits - 3), np.uint8)

    def _bits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for m in (_M[0], _M[1]):
            b = (h * m) >> np.uint64(64 - self.bits)
            yield (b >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (b & np.uint64(7)).astype(np.uint8))

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._bits(h):
            np.bitwise_or.at(self.seen, at, bit)

    def may(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be members."""
        (at, bit), second = self._bits(h)
        here = np.flatnonzero(self.seen[at] & bit)
        return here[(self.seen[second[0][here]] & second[1][here]) > 0]


def ends_of(text: str) -> tuple[int, int, int]:
    """The largest power of two that fits into a text, and the hashes of its first and last window of that size."""
    b = text.encode()
    for p, h in levels(b, len(b)):
        if 2 * p > len(b):
            return p, int(h[0].view(np.int64)), int(h[len(b) - p].view(np.int64))
    return 0, 0, 0


class Inside:
    """Texts of which those are looked for that lie inside a longer one.

    A text's first and last window of the largest power of two that fits cover it whole. Texts with one first window and
    one length are met together, so that many texts with one beginning make no pairs.
    """

    def __init__(self, ids: np.ndarray, length: np.ndarray, size: np.ndarray, head: np.ndarray, tail: np.ndarray):
        head, tail = head.view(np.uint64), tail.view(np.uint64)
        self.level = {}
        for p in np.unique(size):
            of = np.flatnonzero(size == p)
            of = of[np.lexsort((length[of], head[of]))]
            h, n, t = head[of], length[of], tail[of]
            new = np.r_[True, (h[1:] != h[:-1]) | (n[1:] != n[:-1])]
            kind = np.cumsum(new) - 1
            heads, start = np.unique(h[new], return_index=True)
            key = mixed(kind.astype(np.uint64), t)
            order = np.argsort(key)
            seen = Filter(len(heads))
            seen.add(heads)
            self.level[int(p)] = (seen, heads, np.append(start, new.sum()), n[new], key[order], of[order])
        self.ids, self.by = ids, np.full(len(ids), -1, np.int64)

    def meet(self, ids: np.ndarray, texts: list[bytes]) -> None:
        """Notes in `by` the id of a text that holds each one, if any of these does."""
        length = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(length + 1) - 1
        owner = np.repeat(np.arange(len(texts)), length + 1)
        for p, h in levels(b"\n".join(texts), max(self.level, default=0)):
            if p not in self.level:
                continue
            seen, heads, start, lengths, keys, rows = self.level[p]
            at = seen.may(h)
            number = np.minimum(np.searchsorted(heads, h[at]), len(heads) - 1)
            at, number = (x[(heads[number] == h[at]) & (at + p <= end[owner[at]])] for x in (at, number))
            n = start[number + 1] - start[number]
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // MEETINGS)) + 1, len(n)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                m = n[a:b]
                kind = np.arange(m.sum()) + np.repeat(start[number[a:b]] - (np.cumsum(m) - m), m)
                place, size = np.repeat(at[a:b], m), lengths[kind]
                whose = owner[place]
                fits = (place + size <= end[whose]) & (size < length[whose])
                place, kind, size, whose = place[fits], kind[fits], size[fits], whose[fits]
                key = mixed(kind.astype(np.uint64), h[place + size - p])
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = keys[found] == key
                self.by[rows[found[same]]] = ids[whose[same]]
