"""Local alignments against plain Python that lists every hit."""

import random
from collections import Counter, defaultdict

import numpy as np

from strandframe.operators import alignment as al
from strandframe.operators import seeding


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def best_chain(blocks, max_gap):
    blocks = sorted(blocks)
    best, back = [], []
    for i, (t, q, n) in enumerate(blocks):
        top, j_ = 0, -1
        for j in range(i):
            gt, gq = t - blocks[j][0] - blocks[j][2], q - blocks[j][1] - blocks[j][2]
            if min(gt, gq) < -8 or max(gt, gq) > max_gap:
                continue
            got = best[j] - (5 + min(1 + max(gt, gq) // 10, 10) if max(gt, gq) > 0 else 0) + min(0, gt, gq)
            if got > top:
                top, j_ = got, j
        best.append(n + top)
        back.append(j_)
    i = best.index(max(best))
    last, size, score = i, 1, best[i]
    while back[i] >= 0:
        i, size = back[i], size + 1
    return score, blocks[i][0], blocks[last][0] + blocks[last][2] - 1, size


def plain(queries, targets, k, step, most, max_gap, least, top):
    places = defaultdict(list)
    for i, s in targets:
        for t in range(len(s) - k + 1):
            if set(s[t : t + k]) <= set("ACGT"):
                places[s[t : t + k]].append((i, t))
    out = []
    for i, s in queries:
        found = []
        for strand, x in (("+", s), ("-", rc(s))):
            hits = defaultdict(list)
            for q in range(0, len(x) - k + 1, step):
                at = places.get(x[q : q + k], [])
                for j, t in at if len(at) <= most else []:
                    hits[j, t - q].append(q)
            blocks = defaultdict(list)
            for (j, d), qs in hits.items():
                run = [qs[0]]
                for q in [*qs[1:], None]:
                    if q is None or q - run[-1] > k:
                        blocks[j].append((run[0] + d, run[0], run[-1] - run[0] + k))
                        run = []
                    run.append(q)
            found += [(-score, j, strand, a, b, n) for j, x_ in blocks.items() for score, a, b, n in [best_chain(x_, max_gap)] if score >= least]
        out += [(i, j, strand, float(-score), a, b, n, r) for r, (score, j, strand, a, b, n) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def sequences(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("ACGT") for _ in range(r.choice((6, 9, 14)))) for _ in range(12)]
    made = ["".join(r.choice([*words, "AC" * 6, r.choice("ACGT") * 9, "N"]) for _ in range(r.randrange(0, 22))) for _ in range(n)]
    made[3] = made[4] = rc(made[5])
    return [(7 * i, s) for i, s in enumerate(made)]


def test_local_alignments_equal_all_hits(spark):
    rows = sequences(3, 60)
    frame = spark.createDataFrame(rows, "read_id long, seq string")
    for k, step, most, max_gap, least, top in ((8, 1, 1000, 100_000, 20, 5), (6, 2, 40, 30, 12, 3)):
        got = al.local_alignments(frame.where("read_id % 35 = 0"), frame, k, step, most, max_gap, least, top)
        assert got.columns == ["query_id", "target_id", "strand", "score", "t_start", "t_end", "blocks", "rank"]
        want = plain([x for x in rows if x[0] % 35 == 0], rows, k, step, most, max_gap, least, top)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20 and {x[2] for x in want} == {"+", "-"} and max(x[6] for x in want) > 2


def test_few_hits_at_a_time_and_several_blocks_of_queries(spark, monkeypatch):
    rows = sequences(4, 50)
    queries, want = rows[::3], plain(rows[::3], rows, 6, 1, 60, 100_000, 12, 4)
    monkeypatch.setattr(seeding, "HITS", 50)
    monkeypatch.setattr(seeding, "TOGETHER", 30)
    index = seeding.Queries([i for i, _ in queries], [s.encode() for _, s in queries], 6)
    texts = [s.encode() for _, s in rows]
    counts = np.zeros(len(index.codes), np.int64)
    for x in seeding.sliced(texts, 100):
        index.counted(texts[x], counts)
    scan = seeding.Scan(index, np.flatnonzero(counts > 60), 100_000, 12, 4)
    for x in seeding.sliced(texts, 300):
        scan.meet(np.array([i for i, _ in rows[x]]), texts[x])
        scan.best()
    rank, got = Counter(), []
    for whose, target, score, start, end, size in zip(*scan.best()):
        rank[whose >> 1] += 1
        got.append((index.ids[whose >> 1], target, "+-"[whose & 1], score, start, end, size, rank[whose >> 1]))
    assert sorted(got) == want
    monkeypatch.setattr(al, "QUERY_BASES", 500)
    frame = spark.createDataFrame(rows, "read_id long, seq string")
    found = al.local_alignments(frame.where("read_id % 21 = 0"), frame, 6, most=60, least=12, n=4)
    assert sorted(map(tuple, found.collect())) == want


def test_nothing_to_align(spark):
    none = spark.createDataFrame([(1, ""), (2, None), (3, "ACGTNACGT")], "read_id long, seq string")
    assert al.local_alignments(none, none, 8).collect() == []
