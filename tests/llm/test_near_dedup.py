"""Near-duplicate detection against all pairs."""

import random

import numpy as np
import pytest

from strandframe.llm import near_dedup as nd


def expected(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[find(i)] = min(groups.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, len(sets[i]), groups.get(find(i))) for i, r in enumerate(rows))


def got(docs, size, percent):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in nd.classes(docs, size, percent).collect())


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, prose, size, percent):
    docs, _ = prose
    assert got(docs, size, percent) == expected([tuple(r) for r in docs.collect()], size, percent)


def test_odd_rows(odd, none):
    assert got(odd, 3, 85) == expected([tuple(r) for r in odd.collect()], 3, 85)
    assert nd.classes(none).count() == 0 and nd.first_of_each(none).count() == 0
    kept = nd.first_of_each(odd, 3, 85)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_first_rows_are_named_by_id_and_text(spark):
    """Rows of one id with different texts are judged apart; null ids too; columns may be called what helpers are."""
    a, b = ("some words that are said here " * 3).strip(), ("quite another text about other things " * 3).strip()
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (None, b, "u"), (None, "a third text which nobody has copied yet", "v"), (None, "a third text which nobody has copied yet", "v"), (3, "", "w"), (3, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth string").repartition(3)
    kept = nd.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r["_nth"]) for r in kept.collect()) == sorted([(1, a, "x"), (2, b, "z"), (0, "a third text which nobody has copied yet", "v"), (3, "", "w"), (3, "", "w")])


def test_many_borderline_copies_need_the_block_stage(spark, monkeypatch):
    """Copies of one text with their own random changes: about a fifth of all pairs is linked."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nd, "BLOCK", 64)
    assert got(docs, 3, 85) == expected(rows, 3, 85)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(5)
    a, b = (np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (900, 700))
    both = np.union1d(a, b)
    assert (nd.merge(nd.registers(a), nd.registers(b)) == nd.registers(both)).all()
    for shared, want in ((0, 0.0), (500, 500 / 1500), (950, 950 / 1050)):
        x, y = both[:1000], np.r_[both[1000 - shared : 1000], both[1000 : 2000 - shared]]
        n = len(np.union1d(x, y))
        truth = len(np.intersect1d(x, y)) / n
        est, _ = nd.estimate(nd.registers(x)[None, :], nd.registers(y)[None, :], np.array([float(len(x))]), np.array([float(len(y))]))
        assert abs(est[0] - truth) < 0.15, (want, truth, est)
    assert nd.possible(nd.registers(both)[None, :], nd.registers(both)[None, :], [len(both)], [len(both)], 85)[0]
    assert not nd.possible(nd.registers(a)[None, :], nd.registers(b)[None, :], [len(a)], [len(b)], 85)[0]
