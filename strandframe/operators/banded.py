"""Exact alignment of many pairs at once inside a band of diagonals.

A path that leaves a band pays for it with gaps, so its score has a bound; a pair whose score in the band is beyond that
bound is done. The others are tried in wider bands, and last over their whole tables. Rows of all pairs are worked off
together: a table's row is a column of arrays of (diagonal, pair).
"""

from __future__ import annotations

import numpy as np

#: Diagonals beside those that every pair needs, in turn; then the whole table. Cells of a row and of the tables that a group may hold.
WIDER, CELLS, HELD = (0, 8, 40), 1 << 15, 1 << 26


def aligned_in_bands(pairs: list, banded, whole, surely) -> list:
    """banded(group, hi, width) of all pairs (a, b), or whole(k) of the pairs k that no band settles.

    hi is the highest diagonal (place in a less place in b) for each pair; surely(result, m, n, s) tells whether no path
    that leaves the band, s diagonals wide on either side of those that every pair needs, is as good.
    """
    out, todo = [None] * len(pairs), list(range(len(pairs)))
    m, n = ([len(p[k]) for p in pairs] for k in (0, 1))
    for s in WIDER:
        width = {k: abs(m[k] - n[k]) + 2 * s + 1 for k in todo}
        kind = {k: max(width[k].bit_length(), 4) for k in todo}
        # similar widths and lengths together, long ones first; where a band is most of the table it is of no use
        fits = sorted((k for k in todo if width[k] < 16 or 4 * width[k] <= min(m[k], n[k])), key=lambda k: (-kind[k], -m[k]))
        while fits:
            most = max(1, min(CELLS >> kind[fits[0]], (HELD >> kind[fits[0]]) // (m[fits[0]] + 1)))
            group = [k for k in fits[:most] if kind[k] == kind[fits[0]]]
            fits = fits[len(group) :]
            hi = np.array([max(0, m[k] - n[k]) + s for k in group])
            for k, r in zip(group, banded([pairs[k] for k in group], hi, max(width[k] for k in group))):
                if s + max(0, m[k] - n[k]) >= m[k] and s + max(0, n[k] - m[k]) >= n[k] or surely(r, m[k], n[k], s):
                    out[k] = r
        todo = [k for k in todo if out[k] is None]
    for k in todo:
        out[k] = whole(k)
    return out


def _laid(group: list, hi: np.ndarray, width: int, fill, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns: x by place, y so that row i of x meets rows i to i + width of it; lengths; pairs left for each row."""
    m, n = (np.array([len(p[k]) for p in group]) for k in (0, 1))
    x = np.full((max(m.max(), 1), len(group)), fill, kind)
    y = np.full((len(x) + width + 1, len(group)), fill, kind)
    for k, (a, b) in enumerate(group):
        x[: len(a), k] = a
        end = min(len(y), hi[k] + len(b))
        y[hi[k] : end, k] = b[: max(end - hi[k], 0)]
    # groups come with the longest first
    left = len(group) - np.searchsorted(m[::-1], np.arange(1, m.max() + 1))
    return x, y, m, left


def _scan(f: np.ufunc, b: np.ndarray, step: float, at: np.ndarray) -> np.ndarray:
    """The best (by f) for each row w of b[v] + step * (w - v), v <= w."""
    if b.shape[1] < 300:
        return f.accumulate(b - step * at, axis=0) + step * at
    b = b.copy()
    for w in range(1, len(b)):
        f(b[w], b[w - 1] + step, out=b[w])
    return b


def affine(group: list, hi: np.ndarray, width: int, mismatch: int, opening: int, extend: int) -> list[int]:
    x, y, m, left = _laid(group, hi, width, -1, np.int16)
    big = 1 << 40
    at = np.arange(width)[:, None]
    j = at - hi
    best = np.where(j < 0, big, np.where(j == 0, 0, opening + extend * j))
    down = np.full((width + 1, len(group)), big, np.int64)
    for i, c in enumerate(left):
        b = best[:, :c]
        d = down[:, :c]
        np.minimum(d[1:-1], b[1:] + opening, out=d[:-2])
        d[:-2] += extend
        d[-2] = big
        b += np.where(y[i : i + width, :c] == x[i, :c], 0, mismatch)
        np.minimum(b, d[:-1], out=b)
        # a gap begins at a cell without one, or goes on
        np.minimum(b[1:], _scan(np.minimum, b[:-1] + (opening + extend), extend, at[:-1]), out=b[1:])
    n = np.array([len(p[1]) for p in group])
    return best[n - m + hi, np.arange(len(group))].tolist()


def local(group: list, hi: np.ndarray, width: int, match: int, mismatch: int, opening: int, extend: int) -> list[tuple]:
    x, y, m, left = _laid(group, hi, width, -1, np.int16)
    low = -(1 << 40)
    at, best = np.arange(width)[:, None], np.zeros((width, len(group)), np.int64)
    down = np.full((width + 1, len(group)), low, np.int64)
    top = np.zeros((3, len(group)), np.int64)
    for i, c in enumerate(left):
        b, d = best[:, :c], down[:, :c]
        np.maximum(d[1:-1] + extend, b[1:] + opening, out=d[:-2])
        d[-2] = low
        b += np.where(y[i : i + width, :c] == x[i, :c], match, mismatch)
        np.maximum(b, d[:-1], out=b)
        np.maximum(b, 0, out=b)
        np.maximum(b[1:], _scan(np.maximum, b[:-1] + opening, extend, at[:-1]), out=b[1:])
        most = b.max(axis=0)
        new = np.flatnonzero(most > top[0, :c])
        if len(new):
            top[0, new], top[1, new], top[2, new] = most[new], i + 1, i + 1 - hi[new] + b[:, new].argmax(axis=0)
    return [tuple(t) for t in top.T.tolist()]


def ends(group: list, hi: np.ndarray, width: int, match: int, mismatch: int, gap: int) -> list[tuple]:
    """Global score and the steps of its path from its end: 0 both, 1 only a, 2 only b."""
    x, y, m, left = _laid(group, hi, width, -1, np.int16)
    low = -(1 << 40)
    at = np.arange(width)[:, None]
    j = at - hi
    row = np.where(j < 0, low, j * gap)
    came = np.full((len(x) + 1, width, len(group)), 2, np.uint8)
    for i, c in enumerate(left):
        b = row[:, :c]
        diagonal = b + np.where(y[i : i + width, :c] == x[i, :c], match, mismatch)
        down = np.full_like(diagonal, low)
        down[:-1] = b[1:] + gap
        np.maximum(diagonal, down, out=b)
        b[:] = _scan(np.maximum, b, gap, at)
        came[i + 1, :, :c] = np.where(b == diagonal, 0, np.where(b == down, 1, 2))
    # all paths go back together
    cols = np.arange(len(group))
    i, n = m.copy(), np.array([len(p[1]) for p in group])
    j = n.copy()
    score = row[n - m + hi, cols]
    steps = np.full((int((m + n).max(initial=0)), len(group)), 3, np.uint8)
    for k in range(len(steps)):
        live = np.flatnonzero((i > 0) | (j > 0))
        if not len(live):
            break
        a, b = i[live], j[live]
        step = came[a, b - a + hi[live], live]
        step = np.where(a == 0, 2, np.where(b == 0, 1, step))
        steps[k, live] = step
        i[live] -= step < 2
        j[live] -= step != 1
    return [(s, p[p < 3]) for s, p in zip(score.tolist(), np.ascontiguousarray(steps.T))]


def values(group: list, hi: np.ndarray, width: int, near: float, gap: float) -> list[float]:
    x, y, m, left = _laid(group, hi, width, 1e300, np.float64)
    at, best, top = np.arange(width)[:, None], np.zeros((width, len(group))), np.zeros(len(group))
    for i, c in enumerate(left):
        b = best[:, :c]
        down = b[1:] - gap
        b += near - np.abs(y[i : i + width, :c] - x[i, :c])
        np.maximum(b[:-1], down, out=b[:-1])
        np.maximum(b, 0, out=b)
        b[:] = _scan(np.maximum, b, -gap, at)
        np.maximum(top[:c], b.max(axis=0), out=top[:c])
    return top.tolist()
