"""Local alignments of long sequences: seeds, stretches and chains in one scan of the targets, in numpy.

Both strands of the queries lie end to end, and so do a batch's targets. A seed's hit is a pair of places; hits on one
diagonal have one difference of places, so that sorting one number for each hit brings stretches together.
"""

from __future__ import annotations

import numpy as np

#: Hits that are held at a time.
HITS = 2_000_000
#: Bits of the table that tells most windows without a seed.
BITS = 22

_CODE = np.full(256, -1, np.int8)
_CODE[[65, 67, 71, 84]] = range(4)
_TURNED = bytes.maketrans(b"ACGT", b"TGCA")


def hashed(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def clean_codes(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and packed codes of the windows of k bases (31 at most) without other letters."""
    x = _CODE[np.frombuffer(text, np.uint8)]
    n = len(x) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(k):
        code <<= 2
        code |= np.maximum(x[j : j + n], 0)
    seen = np.concatenate([[0], np.cumsum(x < 0)])
    at = np.flatnonzero(seen[k:] == seen[:-k])
    return at, code[at]


def laid(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts end to end with a letter between that no window holds, where each begins and which one each place is of."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return b"\n".join(texts) + b"\n", np.cumsum(size) - size, np.repeat(np.arange(len(texts), dtype=np.int32), size)


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by keys, the first one foremost; as one number where they fit into it."""
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = keys[0]
    for k, n in zip(keys[1:], bits[1:]):
        one = one << n | k
    return np.argsort(one)


def chains(pair: np.ndarray, q: np.ndarray, t: np.ndarray, n: np.ndarray, max_gap: int) -> tuple[np.ndarray, ...]:
    """The best chain of each pair's stretches, which are ordered by pair, t and q: pair, score, t_start, t_end, blocks.

    A stretch scores its length; a step to a later one costs 5 plus 1 + gap // 10 (10 at most) and what they overlap.
    Pairs with nearly as many stretches are worked off together, filled up with stretches that no chain wants.
    """
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(pair)))
    order = np.argsort(count, kind="stable")
    first, count = first[order], count[order]
    q, t, n = (np.append(x, y).astype(np.int32) for x, y in ((q, 0), (t, 0), (n, NEVER)))
    out, a = [], 0
    while a < len(first):
        b = int(np.searchsorted(count, count[a] + count[a] // 6, "right"))
        b = min(b, a + max(1, TOGETHER // int(count[b - 1])))
        steps = np.arange(count[b - 1])
        at = np.where(steps < count[a:b, None], first[a:b, None] + steps, len(pair))
        out.append((pair[first[a:b]], *_chained(q[at], t[at], n[at], max_gap)))
        a = b
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 5))


#: The length of a stretch that only fills up, and how many stretches are chained together.
NEVER, TOGETHER = -(1 << 29), 40_000


def _chained(q: np.ndarray, t: np.ndarray, n: np.ndarray, max_gap: int) -> tuple[np.ndarray, ...]:
    rows = np.arange(len(q))
    best, start, size = n.copy(), t.copy(), np.ones_like(n)
    q_end, t_end = q + n, t + n
    x, y, z = (np.empty_like(n) for _ in range(3))
    u = np.empty(n.shape, bool)
    for i in range(1, q.shape[1]):
        near, far, cost, off = x[:, :i], y[:, :i], z[:, :i], u[:, :i]
        np.subtract(t[:, i, None], t_end[:, :i], out=cost)
        np.subtract(q[:, i, None], q_end[:, :i], out=far)
        np.minimum(cost, far, out=near)
        np.maximum(cost, far, out=far)
        # min(1 + far // 10, 10) + 5, without a division; nothing if no gap is left
        np.minimum(far, 90, out=cost)
        np.multiply(cost, 205, out=cost)
        np.right_shift(cost, 11, out=cost)
        np.add(cost, 6, out=cost)
        np.greater(far, 0, out=off)
        np.multiply(cost, off, out=cost)
        np.subtract(best[:, :i], cost, out=cost)
        # too far apart or too much in common
        np.greater(far, max_gap, out=off)
        np.copyto(cost, NEVER, where=off)
        np.less(near, -8, out=off)
        np.copyto(cost, NEVER, where=off)
        np.minimum(near, 0, out=near)
        np.add(cost, near, out=cost)
        j = cost.argmax(axis=1)
        top = cost[rows, j]
        on = np.flatnonzero(top > 0)
        best[on, i] += top[on]
        start[on, i], size[on, i] = start[on, j[on]], size[on, j[on]] + 1
    i = best.argmax(axis=1)
    return tuple(v.astype(np.int64) for v in (best[rows, i], start[rows, i], t_end[rows, i] - 1, size[rows, i]))


class Queries:
    """An index of the windows of queries on both strands, every `step`-th."""

    def __init__(self, ids: list, texts: list[bytes], k: int, step: int = 1):
        self.k, self.ids = k, ids
        # query i is at 2i, its other strand behind it
        text, self.begin, self.owner = laid([s for x in texts for s in (x, x[::-1].translate(_TURNED))])
        at, code = clean_codes(text, k)
        if step > 1:
            here = (at - self.begin[self.owner[at]]) % step == 0
            at, code = at[here], code[here]
        order = np.argsort(code, kind="stable")
        self.places = at[order]
        self.codes, start = np.unique(code[order], return_index=True)
        self.start = np.append(start, len(order)).astype(np.int64)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[hashed(self.codes)] = True

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes are seeds, and their numbers."""
        here = np.flatnonzero(self.seen[hashed(code)])
        if not len(self.codes):
            return here[:0], here[:0]
        number = np.searchsorted(self.codes, code[here])
        same = self.codes[np.minimum(number, len(self.codes) - 1)] == code[here]
        return here[same], number[same]

    def counted(self, texts: list[bytes], counts: np.ndarray) -> None:
        """Adds how often the texts have each code."""
        counts += np.bincount(self.found(clean_codes(laid(texts)[0], self.k)[1])[1], minlength=len(counts))


def sliced(texts: list[bytes], most: int = 1_000_000):
    """Ranges of texts with about `most` bases at most."""
    a = total = 0
    for b, x in enumerate(texts):
        if total and total + len(x) > most:
            yield slice(a, b)
            a, total = b, 0
        total += len(x)
    if a < len(texts):
        yield slice(a, len(texts))


class Scan:
    """Chains of targets with a block of queries; of each query the `top` best, by score, then target and strand.

    Codes whose number is in `often` are no seeds.
    """

    def __init__(self, queries: Queries, often: np.ndarray, max_gap: int, least: int, top: int):
        self.q, self.max_gap, self.top = queries, max_gap, top
        self.rare = np.ones(len(queries.codes), bool)
        self.rare[often] = False
        #: What a chain must reach to be among its query's best.
        self.need = np.full(len(queries.ids), least, np.int64)
        self.kept, self.held = [], 0

    def meet(self, ids: np.ndarray, texts: list[bytes]) -> None:
        q = self.q
        text, begin, owner = laid(texts)
        at, code = clean_codes(text, q.k)
        here, number = q.found(code)
        rare = self.rare[number]
        at, number = at[here[rare]], number[rare]
        n = q.start[number + 1] - q.start[number]
        whose = owner[at]
        hits = np.bincount(whose, weights=n, minlength=len(texts)).astype(np.int64)
        edge = np.searchsorted(whose, np.arange(len(texts) + 1))
        most = max(1, HITS // (2 * max(len(q.ids), 1)))
        a = 0
        while a < len(texts):
            b, total = a + 1, hits[a]
            while b < len(texts) and total + hits[b] <= HITS and b - a < most:
                total += hits[b]
                b += 1
            if total:
                w = slice(edge[a], edge[b])
                self._pairs(at[w], number[w], n[w], int(total), begin, owner, ids, a, b)
            a = b

    def _pairs(self, at, number, n, total, begin, owner, ids, a, b) -> None:
        """All hits of targets a to b; more than HITS are of one target, and so are taken for some queries at a time."""
        q, parts = self.q, -(-total // HITS)
        if parts == 1:
            return self._hits(*self._places(at, number, n), begin, owner, ids, a, b)
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1, len(n)]
        for part in range(parts):
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                tg, gp = self._places(at[lo:hi], number[lo:hi], n[lo:hi])
                here = (q.owner[gp] >> 1) % parts == part
                found.append((tg[here], gp[here]))
            self._hits(*(np.concatenate(x) for x in zip(*found)), begin, owner, ids, a, b)

    def _places(self, at, number, n) -> tuple[np.ndarray, np.ndarray]:
        q, before = self.q, np.cumsum(n) - n
        return np.repeat(at, n), q.places[np.arange(n.sum()) + np.repeat(q.start[number] - before, n)]

    def _hits(self, tg, gp, begin, owner, ids, a, b) -> None:
        q, k = self.q, self.q.k
        if not len(tg):
            return
        bits, off = int(len(q.owner)).bit_length(), len(q.owner)
        key = ((tg - gp + off) << bits) | gp
        key.sort()
        diagonal, gp = key >> bits, key & ((1 << bits) - 1)
        new = np.ones(len(key), bool)
        whose = q.owner[gp]
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (gp[1:] - gp[:-1] > k) | (whose[1:] != whose[:-1])
        tg = diagonal - off + gp
        target = owner[tg]
        new[1:] |= target[1:] != target[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        size = gp[last] - gp[first] + k
        gp, tg, whose, target = gp[first], tg[first], whose[first].astype(np.int64), target[first].astype(np.int64)
        pair = (target - a) * len(q.begin) + whose
        # no chain scores more than all stretches of its pair
        most = np.bincount(pair, weights=size, minlength=(b - a) * len(q.begin))
        here = np.flatnonzero(most[pair] >= self.need[whose >> 1])
        pair, whose, target, size = pair[here], whose[here], target[here], size[here]
        qs, ts = gp[here] - q.begin[whose], tg[here] - begin[target]
        order = ordered(pair, ts, qs)
        pair, score, start, end, blocks = chains(pair[order], qs[order], ts[order], size[order], self.max_gap)
        whose = pair % len(q.begin)
        good = score >= self.need[whose >> 1]
        if good.any():
            self.kept.append([x[good] for x in (whose, ids[a + pair // len(q.begin)], score, start, end, blocks)])
            self.held += int(good.sum())
            if self.held > 4 * self.top * len(q.ids) + 10_000:
                self.best()

    def best(self) -> list[np.ndarray]:
        """whose, target, score, t_start, t_end and blocks of the best so far; from now on only what may be among them is kept."""
        if not self.kept:
            return [np.zeros(0, np.int64)] * 6
        cols = [np.concatenate(x) for x in zip(*self.kept)]
        query = cols[0] >> 1
        order = np.lexsort((cols[0], cols[1], -cols[2], query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.top - 1
        self.need[query[last]] = np.maximum(self.need[query[last]], cols[2][order][last])
        cols = [x[order][rank < self.top] for x in cols]
        self.kept, self.held = [cols], len(cols[0])
        return cols
