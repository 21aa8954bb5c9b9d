"""Sequence functions, alignments and statistics against plain Python."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.functions import stats as st
from strandframe.operators import alignment as al
from strandframe.operators import discovery as dc
from strandframe.operators import kmers as km
from strandframe.operators import reads as rd

DNA = hs.text("ACGT", max_size=14)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_reverse_complement_twice_is_the_same(spark):
    rows = [("acGTN",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(sq.reverse_complement(sq.reverse_complement(F.col("s")))).collect()] == [r[0] for r in rows]
    assert df.select(sq.reverse_complement(F.col("s"))).first()[0] == "NACgt"


def test_small_functions(spark):
    r = one(spark, code=sq.kmer_code(F.lit("ACGT")), bad=sq.kmer_code(F.lit("ACNT")), back=sq.kmer_from_code(F.lit(27), 4), ham=sq.hamming(F.lit("ACGT"), F.lit("AGGA")), homo=sq.homopolymer_reduced(F.lit("AAACCGTT")), n=sq.count_n(F.lit("aNnG")))
    assert (r.code, r.bad, r.back, r.ham, r.homo, r.n) == (27, -1, "ACGT", 2, "ACGT", 2)


def test_cigars(spark):
    at = lambda c: [tuple(x) for x in one(spark, b=sq.cigar_blocks(F.lit(c), F.lit(100))).b]
    assert at("10M") == [(100, 109)] and at("5S10M") == [(100, 109)] and at("4M100N6M") == [(100, 103), (204, 209)]
    assert at("5M2D5M") == [(100, 104), (107, 111)] and at("5M2I5M") == [(100, 109)] and at("10=2X") == [(100, 111)] and at("*") == []


def test_sam_bins(spark):
    r = one(spark, a=sq.sam_bin(F.lit(0), F.lit(1)), b=sq.sam_bin(F.lit(16383), F.lit(16385)), c=sq.sam_bin(F.lit(0), F.lit(1 << 29)), all=sq.sam_bins(F.lit(0), F.lit(1)))
    assert (r.a, r.b, r.c) == (4681, 585, 0) and r.all == [0, 1, 9, 73, 585, 4681]


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_edit_costs(a, b):
    def cost(mm, ins, dele):
        t = [[j * ins for j in range(len(b) + 1)]]
        for i in range(1, len(a) + 1):
            row = [i * dele]
            for j in range(1, len(b) + 1):
                row.append(min(t[-1][j - 1] + (a[i - 1] != b[j - 1]) * mm, t[-1][j] + dele, row[-1] + ins))
            t.append(row)
        return t[-1][-1]

    assert al.edit_cost(a, b) == cost(1, 1, 1) and al.edit_cost(a, b, 3, 2, 1) == cost(3, 2, 1)


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_affine_and_local(a, b):
    inf = 10**9
    m, n, o, x, mm = len(a), len(b), 5, 1, 10
    M = [[inf] * (n + 1) for _ in range(m + 1)]
    D = [[inf] * (n + 1) for _ in range(m + 1)]
    R = [[inf] * (n + 1) for _ in range(m + 1)]
    M[0][0] = 0
    S = [[0] * (n + 1) for _ in range(m + 1)]
    SD = [[-inf] * (n + 1) for _ in range(m + 1)]
    SR = [[-inf] * (n + 1) for _ in range(m + 1)]
    top = 0
    for i in range(m + 1):
        for j in range(n + 1):
            if i:
                D[i][j] = min(min(M[i - 1][j], D[i - 1][j] - o, R[i - 1][j]) + o, inf) + x
                SD[i][j] = max(S[i - 1][j] - 3, SD[i - 1][j] - 1)
            if j:
                R[i][j] = min(min(M[i][j - 1], R[i][j - 1] - o, D[i][j - 1]) + o, inf) + x
                SR[i][j] = max(S[i][j - 1] - 3, SR[i][j - 1] - 1)
            if i and j:
                same = a[i - 1] == b[j - 1]
                M[i][j] = min(M[i - 1][j - 1], D[i - 1][j - 1], R[i - 1][j - 1]) + (0 if same else mm)
                S[i][j] = max(0, S[i - 1][j - 1] + (1 if same else -1), SD[i][j], SR[i][j])
                top = max(top, S[i][j])
    assert al.affine_cost(a, b) == min(M[m][n], D[m][n], R[m][n])
    assert al.local_score(a, b)[0] == top


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_global_alignment_is_consistent(a, b):
    score, p, q = al.global_alignment(a, b)
    assert p.replace("-", "") == a and q.replace("-", "") == b
    assert score == sum(-2 if "-" in (x, y) else 1 if x == y else -1 for x, y in zip(p, q))


@settings(max_examples=80, deadline=None)
@given(hs.text("ACN", max_size=24))
def test_tandem_repeats_are_repeats(s):
    taken = set()
    for start, k, n, unit in dc.repeats_of(s, 1, 4, 2, 50):
        assert s[start : start + k * n] == unit * n and n >= 2 and "N" not in unit
        places = set(range(start, start + k * n))
        assert not places & taken
        taken |= places


def test_tandem_repeats_at_the_ends():
    assert dc.repeats_of("ATATATGG", 2, 4, 3, 50) == [(0, 2, 3, "AT")]
    assert dc.repeats_of("GGATATAT", 2, 4, 3, 50) == [(2, 2, 3, "AT")]
    assert dc.repeats_of("AAAAAA", 2, 4, 2, 50) == [] and dc.repeats_of("ATATATAT", 4, 4, 2, 50) == []


def test_statistics(spark):
    r = one(spark, chi=st.chi_square_2x2(F.lit(20), F.lit(30), F.lit(30), F.lit(20)), few=st.chi_square_2x2(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), fisher=st.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3)), tail=st.binomial_tail(F.lit(3), F.lit(10), F.lit(0.5)), big=st.log_factorial(F.lit(100)), zero=st.fold_change(F.lit(0), F.lit(7)), low=st.fold_change(F.lit(100), F.lit(1)), high=st.fold_change(F.lit(1), F.lit(90)))
    assert math.isclose(r.chi, 4.0) and r.few == -1 and math.isclose(r.fisher, 34 / 70, rel_tol=1e-9)
    assert math.isclose(r.tail, 1 - 56 / 1024, rel_tol=1e-9) and math.isclose(r.big, math.lgamma(101), rel_tol=1e-12)
    assert math.isclose(r.zero, 7.0007) and r.low == 0.0 and r.high == 25.0


def test_shifted_pearson(spark):
    def plain(xs, ys):
        used = [(x, y) for x, y in zip(xs, ys) if x or y]
        if not used:
            return 0.0
        n = len(used)
        mx, my = sum(x + 1 for x, _ in used) / n, sum(y + 1 for _, y in used) / n
        sxy = sum((x - mx) * (y - my) for x, y in used)
        return sxy / max(math.sqrt(sum((x - mx) ** 2 for x, _ in used) * sum((y - my) ** 2 for _, y in used)), 1e-5)

    for xs, ys in [([1, 2, 3], [2, 4, 7]), ([0, 0], [0, 0]), ([5, 5, 5], [5, 5, 5]), ([3], [9]), ([0, 4, 0], [1, 0, 0])]:
        df = spark.createDataFrame(list(zip(xs, ys)), "x long, y long")
        assert math.isclose(df.agg(st.shifted_pearson("x", "y")).first()[0], plain(xs, ys), abs_tol=1e-9)


def test_length_statistics(spark):
    rows = [(1, "A" * 100), (2, "A" * 10), (3, "A" * 10), (4, "")]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    got = {r.n_percent: r.n_length for r in rd.length_statistics(df, F.length("seq")).collect()}
    assert got[50] == 100 and got[80] == 100 and got[90] == 10 and got[100] == 10 and len(got) == 10


def test_dedupe_only_on_the_other_strand(spark):
    df = spark.createDataFrame([(3, "AACC"), (1, "GGTT"), (2, "ACGT"), (4, "")], "read_id long, seq string")
    got = {r.read_id: r.dup for r in rd.dedupe(df).collect()}
    assert got == {1: "1stDup", 3: "NthDup", 2: "Unique", 4: "Unique"}
    assert {r.dup for r in rd.dedupe(df, either_strand=False).collect()} == {"Unique"}


def test_seeded_hits_find_all_places(spark):
    r = random.Random(5)
    genome = "".join(r.choice("ACGT") for _ in range(400))
    probes = []
    for i in range(8):
        p = list(genome[i * 40 : i * 40 + 24])
        for j in r.sample(range(24), i % 3):
            p[j] = "ACGT"[("ACGT".index(p[j]) + 1) % 4]
        probes.append((i, "".join(p)))
    got = {(x.probe_id, x.ofs, x.strand, x.mm) for x in km.seeded_hits(spark.createDataFrame(probes, "probe_id long, probe string"), spark.createDataFrame([(0, genome)], "read_id long, seq string"), 24, 2).collect()}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {(i, o, d, m) for i, p in probes for d, s in (("+", p), ("-", rc(p))) for o in range(377) if (m := sum(a != b for a, b in zip(s, genome[o : o + 24]))) <= 2}
    assert got == want and len(want) >= 8


def test_simulated_reads_come_from_their_source(spark):
    seqs = spark.createDataFrame([(7, "ACGTTGCAAC" * 20), (9, "A" * 30)], "read_id long, seq string")
    rows = dc.simulated_reads(seqs, 40, 25).collect()
    assert len(rows) == 40
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for r in rows:
        src = ("ACGTTGCAAC" * 20 if r.source == 7 else "A" * 30)[r.start : r.start + 25]
        assert r.seq == (src if r.strand == "+" else rc(src))


def test_paired_merge_recovers_the_fragment(spark):
    frag = "ACGTTGCAACGGATTACAGATTACCAGGTTAACCGGTTACGATCGATCG"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, frag[:35], "I" * 35, rc(frag[15:]), "H" * (len(frag) - 15)), (2, "A" * 20, "I" * 20, "A" * 20, "I" * 20), (3, "", "", "", "")]
    got = {r.pair_id: (r.overlap, r.merged) for r in al.merged_pairs(spark.createDataFrame(rows, "pair_id long, seq1 string, qual1 string, seq2 string, qual2 string")).collect()}
    assert got[1] == (20, frag) and got[2] == (None, None) and got[3] == (None, None)


def test_assembly_joins_overlapping_pieces(spark):
    r = random.Random(9)
    genome = "".join(r.choice("ACGT") for _ in range(200))
    rows = [(i, genome[i * 30 : i * 30 + 60]) for i in range(5)]
    got = [x.seq for x in dc.assembled(spark.createDataFrame(rows, "read_id long, seq string"), [25]).collect()]
    assert got == [genome[:180]]


@settings(max_examples=60, deadline=None)
@given(hs.text("AC", min_size=1, max_size=20), hs.text("AC", min_size=1, max_size=20))
def test_trimmed_match_is_the_longest(a, b):
    from strandframe.operators.longread import trimmed_match

    n = min(len(a), len(b))
    wrong = [x != y for x, y in zip(a, b)]
    want = next(((i, s) for s in range(n, 0, -1) for i in range(n - s + 1) if sum(wrong[i : i + s]) * 100 <= 20 * s), (0, 0))
    assert trimmed_match(a, b, 20, 1) == want


def test_random_draws_have_their_moments(spark):
    from strandframe.functions import random as rn

    k = F.col("id")
    r = spark.range(20000).agg(F.avg(rn.normal(k)).alias("m"), F.stddev(rn.normal(k)).alias("s"), F.avg(rn.poisson(k, 4.0)).alias("p"), F.avg(rn.gamma(k, 3)).alias("g"), F.avg(rn.beta(k, 2, 2)).alias("b")).first()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.03 and abs(r.p - 4) < 0.08 and abs(r.g - 3) < 0.08 and abs(r.b - 0.5) < 0.02


@given(hs.lists(hs.integers(0, 6), max_size=8), hs.lists(hs.integers(0, 6), max_size=8))
def test_value_score_equals_the_table(a, b):
    from strandframe.operators.alignment import value_score

    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = max(0.0, best[i - 1][j - 1] + 2.0 - abs(x - y), best[i - 1][j] - 3.0, best[i][j - 1] - 3.0)
    assert value_score(a, b, 2.0, 3.0) == max(map(max, best))


def test_chains_equal_all_subsets(spark):
    """The best chain of a few stretches against every ordered subset of them."""
    import itertools
    import random

    from strandframe.operators import alignment as al

    r = random.Random(6)
    groups = {(q, t): sorted({(r.randrange(300), r.randrange(300), r.randrange(15, 40)) for _ in range(6)}, key=lambda x: (x[1], x[0])) for q in range(4) for t in range(2)}
    rows = [(q, t, "+", a, b, n, 1) for (q, t), blocks in groups.items() for a, b, n in blocks]
    df = spark.createDataFrame(rows, "query_id long, target_id long, strand string, q_start long, t_start long, len long, seeds long")
    got = {(x.query_id, x.target_id): x.score for x in al.chained(df, least=0).collect()}

    def score(chain):
        total = chain[0][2]
        for (q0, t0, n0), (q1, t1, n1) in zip(chain, chain[1:]):
            gq, gt = q1 - q0 - n0, t1 - t0 - n0
            if gq < -8 or gt < -8:
                return -1
            total += n1 + min(0, gq, gt) - (5 + min(1 + max(gq, gt) // 10, 10) if max(gq, gt) > 0 else 0)
        return total

    for k, blocks in groups.items():
        assert got[k] == max(score(c) for m in range(1, 7) for c in itertools.combinations(blocks, m))


def test_simulated_indels(spark):
    seqs = spark.createDataFrame([(1, "ACGT" * 200)], "read_id long, seq string")
    rows = dc.simulated_reads(seqs, 60, 100, deleted=0.1, inserted=0.05).collect()
    mean = sum(len(r.seq) for r in rows) / len(rows)
    assert 92 < mean < 98 and all(len(r.true_seq) == 100 for r in rows)
    assert rows == dc.simulated_reads(seqs, 60, 100, deleted=0.1, inserted=0.05).collect()


def test_seeded_hits_of_packed_and_other_letters_equal_brute_force(spark):
    import random

    from strandframe.operators import kmers as km

    r = random.Random(12)
    # few letters, so that most places share several parts
    texts = [(i, "".join(r.choice("AAC" if i % 2 else "ACGTN") for _ in range(60))) for i in range(12)]
    asked = [(i, "".join(r.choice("AAC" if i % 3 else "ACN") for _ in range(20))) for i in range(9)]
    turn = str.maketrans("ACGT", "TGCA")
    want = []
    for i, p in asked:
        for strand, q in (("+", p), ("-", p.translate(turn)[::-1])):
            for j, t in texts:
                for at in range(len(t) - 19):
                    mm = sum(x != y for x, y in zip(q, t[at : at + 20]))
                    if mm <= 2:
                        want.append((i, j, at, strand, mm))
    got = km.seeded_hits(spark.createDataFrame(asked, "probe_id long, probe string"), spark.createDataFrame(texts, "read_id long, seq string"), 20, 2).collect()
    assert want and sorted(tuple(x) for x in got) == sorted(want)


def test_contained_copies_and_long_colours(spark):
    from strandframe.functions import sequence as sq
    from strandframe.operators import kmers as km

    long = "ACGTTGCAAC" * 3
    rows = [(1, long), (2, long), (3, long[3:25]), (4, long[3:25]), (5, "ACG"), (6, "ACG"), (7, "T" * 30)]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    assert sorted(r.read_id for r in km.contained(df, 16).collect()) == [2, 3, 4]
    big = spark.createDataFrame([("ACGGT" * 200_000,), ("A",), ("",), (None,)], "s string")
    assert all(r.s == r.t for r in big.select("s", sq.from_colour_space(sq.colour_space(big.s)).alias("t")).collect())


def test_packed_windows_equal_clean_kmers(spark):
    from strandframe.functions import sequence as sq
    from strandframe.operators import kmers as km

    df = spark.createDataFrame([(1, "ACGTNACGTACGT"), (2, "AC"), (3, ""), (4, None), (5, "TTTTTTéACGTT")], "read_id long, seq string")
    got = {(r.read_id, r.w) for r in km.packed_windows(df, "read_id", "seq", 4, once=True, clean=True).select("read_id", sq.kmer_from_code(F.col("code"), 4).alias("w")).collect()}
    assert got == {(r.read_id, r.w) for r in df.select("read_id", F.explode(sq.clean_kmers(F.col("seq"), 4)).alias("w")).collect()}


def test_contaminant_trim_of_any_number_of_adaptors(spark):
    r = random.Random(11)
    word = lambda n, of="ACGT": "".join(r.choice(of) for _ in range(n))
    # more than the list that was once the limit, and a few whose starts the reads end with
    known = [word(30) for _ in range(20)] + [word(12) + "N" + word(15)]
    adaptors = spark.createDataFrame([(a,) for a in known] + [(f"{word(5)}{i:06d}",) for i in range(10_100)], "seq string")
    reads = []
    for i in range(200):
        a, n = r.choice(known), r.randrange(6, 31)
        tail = list(a[:n])
        for _ in range(r.randrange(3)):
            tail[r.randrange(len(tail))] = r.choice("ACGTN")
        reads.append((i, word(r.randrange(20)) + "".join(tail)))
    reads += [(900, ""), (901, None), (902, "ACG")]

    def trim(s):
        best = 0
        for a in known:
            for n in range(8, min(len(s), len(a)) + 1):
                wrong = sum(x == "N" or x != y and y != "N" for x, y in zip(s[len(s) - n :], a))
                if wrong <= (0 if n < 15 else n // 25):
                    best = max(best, n)
        return best

    got = {x.read_id: x.trim for x in al.contaminant_trim(spark.createDataFrame(reads, "read_id long, seq string"), adaptors, 8).collect()}
    assert got == {i: trim(s or "") for i, s in reads} and max(got.values()) > 25


def test_overlaps_of_copies_equal_brute_force(spark):
    r = random.Random(17)
    word = lambda n: "".join(r.choice("AC") for _ in range(n))
    rows = [(i, word(r.randrange(3, 12))) for i in range(60)]
    rows += [(100 + i, s) for i, (_, s) in enumerate(rows[:15])]
    want = {}
    for a, s in rows:
        for b, t in rows:
            n = max((n for n in range(4, 8) if n < len(s) and n < len(t) and s[-n:] == t[:n]), default=0)
            if n and a != b:
                want[a, b] = n
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    got = [tuple(x) for x in km.read_overlaps(reads, 4, 7).collect()]
    assert sorted(got) == sorted((a, b, n) for (a, b), n in want.items())
    ends = {x.read_id for x in km.overlapping_ends(reads, 4, 7).where("is_a and is_b").collect()}
    assert ends == {a for a, _ in want} & {b for _, b in want}


def test_overlap_evidence_forms_no_pairs(spark):
    # 200 000 copies: 40 billion pairs
    reads = spark.range(200_000).select(F.col("id").alias("read_id"), F.lit("ACACACACACAC").alias("seq"))
    assert dc.overlap_evidence(reads, 4, 7, 2).count() == 200_000


def test_micro_indels_equal_brute_force(spark):
    from strandframe.operators import longread as lr

    r = random.Random(18)
    word = lambda n, of: "".join(r.choice(of) for _ in range(n))
    targets = [(i, word(r.randrange(60), "AC" if i % 2 else "ACN")) for i in range(30)] + [(90, "A" * 80), (91, "A" * 80), (92, None)]
    probes = [(i, word(8, "AC" if i % 3 else "ACN")) for i in range(40)] + [(50, "AAAAAAAA"), (51, "AAAAAAAA"), (52, "AC")]
    want = []
    for p, x in probes:
        for t, s in targets:
            at = lambda k, s=s: [i for i in range(len(s or "") - 3) if s[i : i + 4] == k]
            want += [(p, t, a, b - a - 4) for a in at(x[:4]) for b in at(x[4:]) if b > a and 0 < abs(b - a - 4) <= 5]
    got = lr.micro_indels(spark.createDataFrame(probes, "probe_id long, probe string"), spark.createDataFrame(targets, "read_id long, seq string"), 4, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
