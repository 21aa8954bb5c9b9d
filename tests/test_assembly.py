"""Steps of the assembly against plain Python over all pairs."""

import random
from collections import Counter

import pytest

from strandframe.operators import discovery as dc
from strandframe.operators import graph as gr
from strandframe.operators import kmers as km
from strandframe.operators import windowhash


def reads_of(spark, rows):
    return spark.createDataFrame(rows, "read_id long, seq string")


def sequences(seed, n, longest):
    r = random.Random(seed)
    base = "".join(r.choice("ACGT") for _ in range(120))
    out = []
    for i in range(n):
        a = r.randrange(110)
        piece = base[a : a + r.randrange(0, longest)]
        out.append((3 * i + 1, r.choice([piece, piece, piece + r.choice("ACGTN"), "AC" * r.randrange(1, 20), "A" * r.randrange(0, 25)])))
    return [*out, (9001, None)]


def test_contained_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(km, "INSIDE", 40)
    monkeypatch.setattr(windowhash, "MEETINGS", 3)
    rows = sequences(1, 250, 70)
    for k in (4, 16):
        got = [r.read_id for r in km.contained(reads_of(spark, rows), k).collect()]
        want = {i for i, s in rows if s and len(s) >= k and any(t and s in t and (len(t) > len(s) or j < i) for j, t in rows if j != i)}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert km.contained(reads_of(spark, [(1, ""), (2, None)]), 4).collect() == []


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_best_links_equal_all_pairs(spark, seed):
    rows = sequences(seed, 14, 60) + [(2, "GTGTGTGTG"), (500, "TTTTTCCCGG"), (501, "CCCGGAAAAA"), (502, "CCCGGAAATA"), (503, "GATTACAGATTACA"), (504, "TACAGATTACAT")]
    for least, most in ((3, 9), (5, 200)):
        edges = {}
        for a, s in rows:
            for b, t in rows:
                fits = [n for n in range(least, min(most, len(s or "") - 1, len(t or "") - 1) + 1) if s[-n:] == t[:n]]
                if a != b and fits:
                    edges[a, b] = max(fits)
        out, into = ({x: max(n for e, n in edges.items() if e[side] == x) for x in {e[side] for e in edges}} for side in (0, 1))
        best = {e: n for e, n in edges.items() if out[e[0]] == n == into[e[1]]}
        once = [Counter(e[side] for e in best) for side in (0, 1)]
        want = {(u, v, n) for (u, v), n in best.items() if once[0][u] == 1 == once[1][v]}
        got = [tuple(x) for x in km.best_links(reads_of(spark, rows), least, most).select("u", "v", "overlap").collect()]
        assert set(got) == want and len(got) == len(want) and want


def test_chains_of_any_length_without_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 37)] + [(100, 101), (201, 202), (202, 203), (203, 201)]
    got = {r.node: (r.head, r.place) for r in gr.chains(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: (0, i) for i in range(38)} | {100: (100, 0), 101: (100, 1)}


def test_assembly_with_a_common_beginning(spark):
    """Many reads with one beginning, inside others or not: no pairs of them are formed."""
    r = random.Random(8)
    common = "ACGTTGCATGCCATAGGCTA"
    rows = [(i, common + "".join(r.choice("ACGT") for _ in range(40))) for i in range(1500)]
    rows += [(2000 + i, s[: 30 + i % 20]) for i, s in rows]
    got = {(x.read_id, x.seq) for x in dc.assembled(reads_of(spark, rows), [25]).collect()}
    assert got == set(rows[:1500])
