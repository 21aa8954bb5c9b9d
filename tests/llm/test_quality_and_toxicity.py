"""Rules, classifier and toxicity: counts against plain Python, verdicts against known labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandframe.llm import quality_qda, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))


def test_counts(spark, odd):
    more = spark.createDataFrame([(20, "a b c a b c\nx\nx\n\n \n#$"), (21, "a a a a"), (22, "q\u00a0r s\x85t"), (23, "a b a b a b")], "doc_id long, text string")
    for df in (odd, more):
        rows = quality_rules.report(df).collect()
        assert len(rows) == df.count()
        want = sorted((r.doc_id or -1, *plain(r.text)) for r in df.collect())
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_rules_find_junk_and_keep_the_rest(prose):
    docs, labels = prose
    rows = quality_rules.report(docs).join(labels, "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)
    kept = quality_rules.keep_good(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_rules_on_nothing(none, odd):
    assert quality_rules.report(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {r.counts for r in kept.collect()} <= {1}
    assert quality_rules.report(odd.select("doc_id", F.lit(None).cast("string").alias("text"))).where("kept").count() == 0


def test_estimate_learns_accuracies():
    good, bad = [2, 2, 1], [2, 0, 1]
    code = lambda v: v[0] * 9 + v[1] * 3 + v[2]
    m = quality_rules.estimate([(code(good), 900), (code(bad), 100)], 3)
    assert m["weights"][1][0] < -3 < 0 < m["weights"][1][2] and m["weights"][2] == [m["weights"][2][0], 0.0, m["weights"][2][2]]
    assert abs(m["prior"] - math.log(9)) < 0.5
    assert quality_rules.estimate([], 3)["prior"] == 0.0


def folds(df, modulus, held):
    return {r.doc_id for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % modulus == held}


def test_classifier_on_held_out_rows(prose):
    docs, labels = prose
    held = folds(docs, 4, 2)
    assert {r.doc_id for r in docs.where(~quality_qda.learns(F.col("doc_id"))).collect()} == held
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_qda.report(docs, labels).collect()
    right = [(r.score >= 0.7) == (truth[r.doc_id] == 1) for r in rows if r.doc_id in held]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    # labels of the held-out fold change nothing
    other = labels.withColumn("quality", F.when(F.col("doc_id").isin(list(held)), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_qda.report(docs, other).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, abs_tol=1e-9) for r in rows)


def test_classifier_on_odd_tables(spark, odd, none, prose):
    labels = prose[1]
    rows = quality_qda.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_qda.report(none, labels).count() == 0
    assert {r.score for r in quality_qda.report(odd, labels.where("doc_id < 0")).collect()} == {0.5}


def test_toxicity_on_held_out_rows(prose):
    docs, labels = prose
    held = folds(docs, 5, 0)
    assert {r.doc_id for r in docs.where(~toxicity.learns(F.col("doc_id"))).collect()} == held
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.report(docs, labels).collect()
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id in held)
    assert all(r.neighbours for r in rows if r.score >= 0.5)
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows if r.score < 0.5}


def test_block_index_equals_brute_force():
    r = np.random.default_rng(8)

    def make():
        # a few terms are common, so that both the dense blocks and the postings are used
        t = np.unique(np.r_[r.integers(0, 12, 5), r.integers(12, 4000, r.integers(1, 9))])
        return t.astype(np.int64), r.integers(1, 4, len(t)).astype(float)

    examples = [(i, i % 2, *make()) for i in range(700)]
    weight = 1 + r.random(4000)
    index = toxicity.BlockMaxIndex(examples, weight)
    assert 0 < index.dense.shape[1] < 40

    def unit(t, n):
        w = dict(zip(t.tolist(), ((1 + np.log(n)) * weight[t]).tolist()))
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / norm for k, x in w.items()}

    units = {e[0]: unit(e[2], e[3]) for e in examples}
    queries = [make() for _ in range(60)]
    for q, (near, cosines) in zip(queries, index.nearest(toxicity.Bags.of(queries), 15)):
        u = unit(*q)
        cos = {i: sum(w * v.get(t, 0) for t, w in u.items()) for i, v in units.items()}
        best = sorted(cos.values(), reverse=True)[:15]
        assert np.allclose(cosines, best, atol=1e-5) and all(abs(cos[int(index.ids[n])] - c) < 1e-5 for n, c in zip(near, cosines))


def test_toxicity_equals_brute_force(prose):
    """Words, weights, neighbours, votes and calibration again, by dictionaries and loops."""
    docs, labels = prose[0].where("doc_id < 150"), prose[1].where("doc_id < 140")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    bag = {i: Counter(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.lower())) for i, t in text.items()}
    seen, first = set(), []
    for i in sorted(toxic):
        w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", text[i].lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if 2 * len(own & seen) < len(own):
            first.append(i)
            seen |= own
    vocabulary = {w for i in first for w in bag[i]}
    n = [sum(toxic[i] == y for i in first) for y in (0, 1)]

    def weight(w):
        df = sum(w in b for b in bag.values())
        table = [[0, 0], [0, 0]]
        for i in first:
            table[toxic[i]][w in bag[i]] += 1
        g = sum(2 * x * math.log(x * sum(n) / (n[y] * (table[0][has] + table[1][has]))) for y in (0, 1) for has, x in enumerate(table[y]) if x)
        return (math.log((1 + len(text)) / (1 + df)) + 1) * (1 + math.sqrt(max(0.0, g)))

    weights = {w: weight(w) for w in vocabulary}

    def unit(b):
        v = {w: (1 + math.log(c)) * weights[w] for w, c in b.items() if w in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {i: unit(b) for i, b in bag.items()}
    share = sum(toxic.values()) / len(toxic)
    by = [(1 - share) * sum(n) / n[0], share * sum(n) / n[1]]

    def near(i, others):
        cos = sorted(((sum(x * units[o].get(w, 0) for w, x in units[i].items()), o) for o in others), reverse=True)[: toxicity.NEIGHBOURS]
        top = sum(c * c * by[toxic[o]] * toxic[o] for c, o in cos)
        return (toxicity.PRIOR_WEIGHT * share + top) / (toxicity.PRIOR_WEIGHT + sum(c * c * by[toxic[o]] for c, o in cos)), [c for c, _ in cos if c > 1e-7]

    pools = []
    for v, y in sorted((near(i, [o for o in first if o != i])[0], toxic[i]) for i in first):
        pools.append([v * by[y], y * by[y], by[y]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    level = np.maximum.accumulate([(p[1] + share) / (p[2] + 1) for p in pools])
    scores = set()
    for r in toxicity.report(docs, labels).collect():
        v, cosines = near(r.doc_id, first)
        assert np.allclose(r.cosines, cosines, atol=1e-5), r.doc_id
        assert abs(r.score - np.interp(v, [0, *(p[0] / p[2] for p in pools), 1], [0, *level, 1])) < 1e-3
        scores.add(round(r.score, 6))
    assert len(scores) > 50


def test_toxicity_on_odd_tables(odd, none, prose):
    labels = prose[1]
    rows = toxicity.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.report(none, labels).count() == 0 and toxicity.keep_clean(none, labels).count() == 0
    assert {r.score for r in toxicity.report(odd, labels.where("doc_id < 0")).collect()} == {0.0}
