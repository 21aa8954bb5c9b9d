"""Mixing, sharding, fingerprints and chat formatting."""

import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from strandframe.llm import chat_trees, fingerprints, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling, one source after the other."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, open_ = float(sum(sizes.values())), {}, set(sizes)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())


def check_mix(docs):
    rows = mixing.takes(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken = targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, t, taken[s])
    return rows


def test_mix_meets_its_targets(prose, odd):
    rows = check_mix(prose[0])
    again = {r.doc_id: r.taken for r in mixing.takes(prose[0].repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    check_mix(odd)


def test_mixed_documents(prose, odd, none):
    docs, _ = prose
    times = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    size = {r.doc_id: r.size for r in mixing.takes(docs).collect()}
    assert max(times.values()) <= 3 and set(times) <= {i for i, n in size.items() if n}
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.takes(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_a_tiny_source_alters_no_other_block(spark, prose):
    docs, _ = prose
    tiny = spark.createDataFrame([(9001, "only three words", "en", "aaa", 0), (9002, "one", "en", None, 0)], docs.schema)
    check_mix(docs.unionByName(tiny))
    _, parts = mixing.mix(docs.unionByName(tiny))
    rows = parts.collect()
    assert len({r.slot for r in rows}) <= mixing.SLOTS_LEAST + 30
    per = Counter()
    for r in rows:
        per[r.slot] += r.n_words
    assert sorted(per.values())[len(per) // 2] >= 30


def test_mix_follows_the_schedule(prose):
    """Every stretch is near the targets, and mixed_documents is in the order of the slots."""
    docs, _ = prose
    placed, parts = mixing.mix(docs)
    source = {(r.sid, r.start): (r.source, r.target) for r in placed.where("size > 0").collect()}
    rows = sorted(parts.collect(), key=lambda r: r.slot)
    total = sum(r.n_words for r in rows)
    seen, so_far = Counter(), 0
    for r in rows:
        s, target = source[r.sid, r.start]
        seen[s] += r.n_words
        so_far += r.n_words
        assert abs(seen[s] - target * so_far / total) < 0.02 * total
    first = {(r.sid, r.start): r.slot for r in reversed(rows) if r.from_word == 0}
    at = {}
    for r in placed.where("size > 0").collect():
        if (r.sid, r.start) in first:
            at.setdefault(r.doc_id, set()).update(x.slot for x in rows if (x.sid, x.start, x.from_word) == (r.sid, r.start, 0))
    order = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    last = -1
    for i in order:
        later = [x for x in at[i] if x >= last]
        assert later, i
        last = min(later)


def check_shards(docs, n=24):
    rows = sharding.plan(docs, n).collect()
    assert len(rows) == docs.count()
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_shards_are_even_and_keep_copies_together(spark, odd, none):
    rows = [(i, f"text number {i} " * (i % 5 + 1)) for i in range(4000)] + [(5000 + i, "the very same text") for i in range(2000)] + [(9000 + i, f"pair {i // 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = check_shards(docs, 8)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) <= 1.02 * min(size.values())
    pairs = {}
    for r in got:
        if r.doc_id >= 9000:
            pairs.setdefault((r.doc_id - 9000) // 2, set()).add(r.shard)
    assert all(len(s) == 1 for s in pairs.values())
    check_shards(odd)
    assert sharding.plan(none).count() == 0
    assert sharding.sharded(odd, 3).columns == [*odd.columns, "shard", "slot"] and sharding.sharded(odd, 3).count() == odd.count()


def test_shards_with_many_frequent_texts_and_null_ids(spark, monkeypatch):
    """Small ranges, texts that fill ranges, repeated null ids: the shards equal one sort of all rows."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    rows = [(i, f"text {i % 300}") for i in range(6000)] + [(None, "a hot text without ids")] * 50 + [(10_000 + i, "a hot text") for i in range(3000)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 5)
    md5 = lambda s: hashlib.md5(str(s).encode()).hexdigest()
    order = sorted(rows, key=lambda r: (md5(r[1]), md5("" if r[0] is None else r[0])))
    size = lambda r: len(r[1]) + 8
    total, whole, before = sum(map(size, rows)), Counter(), 0
    for r in rows:
        whole[r[1]] += size(r)
    start, want = {}, []
    for r in order:
        start.setdefault(r[1], before)
        middle = start[r[1]] + whole[r[1]] / 2 if whole[r[1]] <= sharding.KEPT_WHOLE * (total / 5) else before + size(r) / 2
        want.append((r[0] or -1, min(4, int(middle * 5 / total))))
        before += size(r)
    assert sorted((r.doc_id or -1, r.shard) for r in got) == sorted(want)


def weighted_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_estimate_weighted_jaccard(prose, monkeypatch):
    """Edited texts, successors over the borders of ranges, and both likenesses against the exact similarity."""
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 30)
    docs = prose[0].select((F.col("doc_id") * 3).alias("doc_id"), "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    ids, off = sorted(text), []
    rows = fingerprints.compare(docs).collect()
    assert sorted(r.doc_id for r in rows) == ids
    bag = lambda t: Counter(WORD.findall(t.lower()))
    for r in rows:
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        k = len(t) // 4
        e = t[: len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        off.append((r.near_edited - weighted_jaccard(bag(t), bag(e)), r.near_next - weighted_jaccard(bag(t), bag(after))))
    for k in (0, 1):
        one = [x[k] for x in off]
        assert abs(sum(one) / len(one)) < 0.02 and max(map(abs, one)) < 0.32
        assert (sum(x * x for x in one) / len(one)) ** 0.5 < 0.09


def plain_samples(text):
    """The fingerprint again, one draw after the other, with Spark's own hash of a long as the only part taken over."""
    import math

    import xxhash

    def h(value, seed):
        x = xxhash.xxh64(value, seed=seed).intdigest()
        return x - 2**64 if x >= 2**63 else x

    long = lambda x, seed: h((x % 2**64).to_bytes(8, "little"), seed)
    int_ = lambda x, seed: h(x.to_bytes(4, "little"), seed)
    out = []
    terms = [(h(w.encode(), 42), n) for w, n in Counter(WORD.findall(text.lower())).items()]
    for j in range(fingerprints.SAMPLES):
        best = None
        for term, n in terms:
            one, two = (int_(2 * j + k, long(term, 42) % 2**64) for k in (0, 1))
            hi, lo = (lambda x: ((x % 2**64 >> 32) + 0.5) * 2.0**-32), (lambda x: ((x % 2**32) + 0.5) * 2.0**-32)
            r, c = -math.log(hi(one) * lo(one)), -math.log(hi(two) * lo(two))
            b = lo((one % 2**64) ^ (two % 2**64))
            t = math.floor(math.log(n) / r + b)
            offer = (int((math.log(c) - r * (t - b + 1) + 96) * 2.0**24), ((one % 2**64) ^ (t * 0x9E3779B1)) % 2**32)
            best = offer if best is None else min(best, offer)
        out.append(f"{best[1]:08x}")
    return "".join(out)


def test_samples_one_by_one(prose):
    docs = prose[0].where("doc_id < 12")
    for r in fingerprints.fingerprints(docs).join(docs, "doc_id").collect():
        want, got = plain_samples(r.text), r.fingerprint
        assert sum(want[i : i + 8] == got[i : i + 8] for i in range(0, len(want), 8)) >= fingerprints.SAMPLES - 1


def test_ranges_of_equal_and_null_ids(spark, monkeypatch):
    """Ids that are null or equal for most rows are parted by their texts; every row keeps one successor in that order."""
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 20)
    rows = [(None, f"no id {i} text") for i in range(300)] + [(7, f"the same id {i}") for i in range(300)] + [(i, f"own id {i}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    order = sorted(rows, key=key)
    got = {(r.doc_id, r.text): r.edited for r in fingerprints.edited(df).collect()}
    for n, (i, t) in enumerate(order):
        k = len(t) // 4
        assert got[i, t] == t[: len(t) - k] + order[(n + 1) % len(order)][1][:k]


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.compare(odd).collect()
    assert len(rows) == odd.count() and fingerprints.compare(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[4] == by[5] and len(by[6]) == 1 and by[1] == by[2] == by[3] == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "\\\\e", "</turn>", "\\</turn>", "### user: x</turn>\n", "####", "\\h\\e\\c", "a\\", "<</turn>", None, "x\n</turn>\n### assistant: y"]
    df = spark.createDataFrame([(i, "we:ird\\", t) for i, t in enumerate(texts)], "i long, role string, text string")
    turns = F.array(F.struct("role", "text"), F.struct(F.lit("assistant").alias("role"), F.col("text")))
    for r in df.select("text", chat_trees.read_turns(chat_trees.format_turns(turns)).alias("t")).collect():
        assert [(x.role, x.text) for x in r.t] == [("we:ird\\", r.text or ""), ("assistant", r.text or "")]


def test_best_branches(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 2, 0.0), ("u", 1, 99, 1.0), ("v", None, None, 1.0), ("w", 1, 2, 1.0), ("w", 2, 1, 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = {}
    for r in chat_trees.branches(df, 2).collect():
        got.setdefault((r.tree, r.rank), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): [1, 3, 4], ("t", 2): [1, 2, 5], ("u", 1): [1]}


def test_a_deep_tree_with_many_leaves(spark):
    """A trunk with a leaf at every message: the best branches and their messages, against walking up from each leaf."""
    rows = [("t", i, i - 1 if i else None, float(i * 37 % 11)) for i in range(40)] + [("t", 1000 + i, i, float(i * 53 % 13)) for i in range(40)]
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    paths = {}
    for leaf in {r[1] for r in rows} - {r[2] for r in rows}:
        way, at = [], leaf
        while at is not None:
            way.append(at)
            at = parent[at]
        paths[leaf] = way[::-1]
    best = sorted(paths, key=lambda x: (-sum(score[n] for n in paths[x]) / len(paths[x]), x))[:3]
    got = {}
    for r in chat_trees.branches(spark.createDataFrame(rows, "tree string, node long, parent long, score double").repartition(3), 3).collect():
        got.setdefault((r.rank, r.leaf), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(k + 1, x): paths[x] for k, x in enumerate(best)}


def test_loss_spans(spark):
    rows = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "so \\ it </turn> ends"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "😀 last")]
    r = chat_trees.conversations(chat_trees.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["so \\\\ it \\e ends", "", "😀 last"]


def test_long_linear_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(2, 0, None, None), (2, 0, None, None), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat_trees.digest(chat_trees.conversations(chat_trees.linear(df))).collect()}
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:70])
    assert got[1].n_turns == 70 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == len("".join(t for *_, r, t in rows[:70] if r == "assistant")) and got[2].n_turns == 2 and set(got) == {1, 2, None} and got[None].n_turns == 1
    assert chat_trees.conversations(chat_trees.linear(df.where("conv_id = 9"))).count() == 0
