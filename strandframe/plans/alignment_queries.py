"""Queries of alignment, repeat discovery, consensus, simulation and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.functions import stats as st
from strandframe.operators import alignment as al
from strandframe.operators import discovery as dc
from strandframe.operators import features as ft

from .analysis_queries import BITS
from .shapes import shape, sql

Q: dict = {}
SQL: dict = {}


def query(name: str, *shapes: str, oracle: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(*[shape(spark, sf_dir, s) for s in shapes])
        if oracle:
            head = sql(*shapes).rstrip()
            if oracle.startswith("WITH RECURSIVE "):
                head, oracle_ = head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n", oracle[15:]
            else:
                head, oracle_ = (head + ",\n", oracle[5:]) if oracle.startswith("WITH ") else (head + "\n", oracle)
            SQL[name] = head + oracle_
        return f

    return add




def _halves(reads):
    return reads.select("read_id", F.col("seq").alias("x"), F.expr("substring(seq, 11)").alias("y"))


@query("x5_weighted_levenshtein", "reads", oracle="SELECT read_id, levenshtein(seq, substring(seq, 11)) AS cost FROM reads")
def _(reads):
    return _halves(reads).select("read_id", al.edit_cost_udf()("x", "y").alias("cost"))


@query("x6_affine_levenshtein", "reads")
def _(reads):
    return _halves(reads).select("read_id", al.affine_cost_udf()("x", "y").alias("cost"))


@query("x7_smith_waterman", "reads")
def _(reads):
    return _halves(reads).select("read_id", al.local_score_udf()("x", "y").alias("s")).select("read_id", "s.*")


@query("x8_needleman_wunsch", "reads")
def _(reads):
    return _halves(reads).select("read_id", al.global_alignment_udf()("x", "y").alias("s")).select("read_id", "s.*")


@query("x29_structure_profile", "reads", oracle="""SELECT read_id, CAST(i - 1 AS INTEGER) AS pos, (strpos('ACGT', substring(seq, CAST(i AS BIGINT), 1)) * 10 + strpos('ACGT', substring(seq, CAST(i + 1 AS BIGINT), 1))) * 1.0::DOUBLE AS value FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 1, 0) AS BIGINT) + 1)) AS i FROM reads)""")
def _(reads):
    pairs = reads.sparkSession.range(16).select(F.concat(F.substring(F.lit("ACGT"), F.floor(F.col("id") / 4).cast("int") + 1, F.lit(1)), F.substring(F.lit("ACGT"), (F.col("id") % 4).cast("int") + 1, F.lit(1))).alias("kmer"), ((F.floor(F.col("id") / 4) + 1) * 10 + F.col("id") % 4 + 1).cast("double").alias("value"))
    return dc.lookup_profile(reads, pairs, 2)


def _mates(reads):
    src = reads.where("length(seq) >= 90")
    return src.select("read_id", F.substring("seq", 1, 60).alias("seq1"), F.repeat(F.lit("H"), F.lit(60)).alias("qual1"), sq.reverse_complement(F.substring("seq", 31, 60)).alias("seq2"), F.repeat(F.lit("I"), F.lit(60)).alias("qual2"), F.substring("seq", 1, 90).alias("true_seq"))


@query("t6_paired_end_merge", "reads")
def _(reads):
    return al.merged_pairs(_mates(reads)).select("read_id", "overlap", "merged", "true_seq")


@query("t6_barcode_wells", "reads", oracle="""SELECT read_id, CASE substring(seq, 1, 2) WHEN 'AC' THEN 'w1' WHEN 'CA' THEN 'w2' WHEN 'TA' THEN CASE WHEN substring(seq, 1, 3) = 'TAT' THEN 'w4' ELSE 'w3' END END AS well FROM reads""")
def _(reads):
    codes = reads.sparkSession.range(4).select(F.element_at(F.array(*[F.lit(x) for x in ("AC", "CA", "TA", "TAT")]), F.col("id").cast("int") + 1).alias("barcode"), F.concat(F.lit("w"), (F.col("id") + 1).cast("string")).alias("well"))
    return al.barcode_wells(reads, codes).select("read_id", "well")


@query("j16_proper_pairs", "loci", oracle="""WITH m AS (SELECT el_id // 20000000000 AS pair_id, CAST((el_id // 10000000000) % 2 + 1 AS INTEGER) AS mate, * FROM loci)
SELECT a.pair_id, a.chrom, greatest(a."end", b."end") - least(a.start, b.start) + 1 AS insert_size, count(*) AS n FROM m a JOIN m b ON a.pair_id = b.pair_id AND a.chrom = b.chrom AND a.mate = 1 AND b.mate = 2 WHERE a.strand <> b.strand AND CASE WHEN a.strand = '+' THEN a.start <= b.start ELSE b.start <= a.start END AND greatest(a."end", b."end") - least(a.start, b.start) + 1 BETWEEN 20 AND 400 GROUP BY ALL""")
def _(loci):
    m = loci.withColumn("pair_id", F.expr("el_id div 20000000000")).withColumn("mate", (F.expr("el_id div 10000000000") % 2 + 1).cast("int"))
    return al.proper_pairs(m, 20, 400).groupBy("pair_id", "chrom", F.col("insert").alias("insert_size")).agg(F.count(F.lit(1)).alias("n"))


@query("j17_multi_loci_resolution", "loci", oracle="SELECT el_id // 80000000000 AS read_id, min(el_id) AS el_id FROM loci GROUP BY 1")
def _(loci):
    hits = loci.withColumn("read_id", F.expr("el_id div 80000000000"))
    return al.resolved_multi(hits, "best", ["el_id"]).select("read_id", "el_id")


@query("o7_hit_cap", "loci", oracle="SELECT read_id, count(*) AS n FROM (SELECT el_id // 80000000000 AS read_id FROM loci) GROUP BY read_id HAVING count(*) <= 3")
def _(loci):
    from strandframe.operators.filters import hit_cap

    return hit_cap(loci.withColumn("read_id", F.expr("el_id div 80000000000")), "read_id", 3, False, []).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))


@query("j14_splice_junctions", "loci", oracle="""WITH h AS (SELECT el_id // 80000000000 AS read_id, chrom, strand, start, 'x' AS x FROM loci WHERE sample = 'N') SELECT a.read_id, a.chrom, a.start AS t1, b.start AS t2, count(*) AS n FROM h a JOIN h b ON a.read_id = b.read_id AND a.chrom = b.chrom AND a.strand = b.strand AND a.start % 2 = 0 AND b.start % 2 = 1 WHERE b.start - a.start - 20 BETWEEN 25 AND 100000 GROUP BY ALL""")
def _(loci):
    h = loci.where("sample = 'N'").select(F.expr("el_id div 80000000000").alias("read_id"), "chrom", "strand", (F.col("start") % 2 * 20).alias("read_start"), F.lit(20).alias("len"), "start")
    return al.splice_junctions(h, 40).groupBy("read_id", "chrom", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))


@query("j18_contaminant_trim", "reads", oracle="""WITH a AS (SELECT DISTINCT substring(seq, 21, 30) AS ad FROM reads WHERE length(seq) >= 80 AND read_id % 20 = 0), r AS (SELECT read_id, seq AS s FROM reads), h AS (SELECT read_id, max(n) AS n FROM r, a, range(8, 31) AS q(n) WHERE n <= length(s) AND hamming(right(s, CAST(n AS BIGINT)), left(ad, CAST(n AS BIGINT))) <= CASE WHEN n < 15 THEN 0 ELSE n // 25 END GROUP BY read_id) SELECT r.read_id, CAST(coalesce(h.n, 0) AS INTEGER) AS trim FROM r LEFT JOIN h ON h.read_id = r.read_id""")
def _(reads):
    adaptors = reads.where("length(seq) >= 80 AND read_id % 20 = 0").select(F.substring("seq", 21, 30).alias("seq"))
    return al.contaminant_trim(reads, adaptors, 8).select("read_id", "trim")


@query("j18_vector_containment", "reads", oracle="SELECT DISTINCT r.read_id FROM (SELECT read_id, seq AS s FROM reads WHERE length(seq) >= 12) r JOIN (SELECT seq AS v FROM reads WHERE read_id % 20 = 0 UNION SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads WHERE read_id % 20 = 0) ON contains(v, r.s)")
def _(reads):
    return al.vector_contained(reads, reads.where("read_id % 20 = 0").select("seq"))


@query("j23_t7_t24_local_alignment", "reads")
def _(reads):
    queries = reads.where("read_id % 20 = 0")
    return al.local_alignments(queries, reads, 14, least=30).select("query_id", "target_id", "strand", "score", "t_start", "t_end", "blocks", "rank")


@query("j19_reciprocal_alignments", "edges", oracle="""WITH p AS (SELECT DISTINCT a, a % 100 AS a_start, a % 100 + 20 AS a_end, b - 1000000 AS b, b % 90 AS b_start, b % 90 + 20 AS b_end FROM edges) SELECT DISTINCT p.* FROM p JOIN p o ON o.a = p.b AND o.b = p.a AND p.b_start <= o.a_end AND p.b_end >= o.a_start AND p.a_start <= o.b_end AND p.a_end >= o.b_start""")
def _(edges):
    p = edges.select(F.col("a"), (F.col("a") % 100).alias("a_start"), (F.col("a") % 100 + 20).alias("a_end"), (F.col("b") - 1_000_000).alias("b"), (F.col("b") % 90).alias("b_start"), (F.col("b") % 90 + 20).alias("b_end")).distinct()
    return al.reciprocal(p)


@query("j20_lift_over", "features", oracle="""SELECT feat_id AS el_id, 'rel' AS chrom, 7000 + greatest(p, 4) - 2 AS start, 7000 + p + 1 - 2 AS "end" FROM (SELECT feat_id, feat_id % 14 AS p FROM features) WHERE p BETWEEN 4 AND 8 UNION ALL SELECT feat_id, 'rel', 7000 + least(p, 1), 7000 + CASE WHEN p + 1 <= 1 THEN p + 1 WHEN p = 1 THEN 1 ELSE 1 END FROM (SELECT feat_id, feat_id % 14 AS p FROM features) WHERE p < 2 UNION ALL SELECT feat_id, 'rel', 7002, 7002 FROM features WHERE feat_id % 14 = 3 UNION ALL SELECT feat_id, 'rel', 7007, 7007 FROM features WHERE feat_id % 14 = 9""")
def _(features):
    loci = features.select(F.col("feat_id").alias("el_id"), F.lit("chr1").alias("chrom"), (F.col("feat_id") % 14).alias("start"), (F.col("feat_id") % 14 + 1).alias("end"))
    # ten reference bases; the third and fourth have no counterpart
    block = features.sparkSession.range(1).select(F.lit("chr1").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), F.lit("rel").alias("rel_chrom"), F.lit(7000).cast("long").alias("rel_start"), F.lit("ACGTACGTAC").alias("ref_seq"), F.lit("AC--ACGTAC").alias("rel_seq"))
    return al.lift_over(loci, block)


@query("t2_tandem_repeats", "reads")
def _(reads):
    return dc.tandem_repeats(reads, 1, 5, 3)


@query("a34_repeat_frequencies", "reads")
def _(reads):
    return dc.repeat_frequencies(dc.tandem_repeats(reads, 2, 5, 3))


COLUMNS = "SELECT read_id AS block_id, CAST(i - 1 AS INTEGER) AS pos, substring(seq, CAST(i AS BIGINT), 1) AS ref, substring(seq, CAST(i + 7 AS BIGINT), 1) AS rel FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 7, 0) AS BIGINT) + 1)) AS i FROM reads)"


def _columns(reads):
    cols = reads.select(F.col("read_id").alias("block_id"), F.posexplode(F.split(F.expr("substring(seq, 1, length(seq) - 7)"), "")).alias("pos", "ref"), "seq").where("ref <> ''")
    return cols.select("block_id", "pos", "ref", F.substring("seq", F.col("pos") + 8, F.lit(1)).alias("rel"))


def _shifted(reads):
    """The rows of _columns as two strings for each block."""
    return reads.select(F.col("read_id").alias("block_id"), F.expr("substring(seq, 1, length(seq) - 7)").alias("ref"), F.expr("substring(seq, 8)").alias("rel"))


@query("t15_match_run_distribution", "reads", oracle=f"WITH c AS ({COLUMNS}), g AS (SELECT block_id, pos - row_number() OVER (PARTITION BY block_id ORDER BY pos) AS k FROM c WHERE ref = rel), n AS (SELECT count(*) AS len FROM g GROUP BY block_id, k) SELECT len, count(*) AS n FROM n GROUP BY len")
def _(reads):
    return dc.runs_of_rows(_shifted(reads)).groupBy("len").agg(F.count(F.lit(1)).alias("n"))


@query("t20_conserved_runs", "reads", oracle=f"WITH c AS ({COLUMNS}), g AS (SELECT block_id, pos, pos - row_number() OVER (PARTITION BY block_id ORDER BY pos) AS k FROM c WHERE ref = rel) SELECT block_id, min(pos) AS start, count(*) AS len FROM g GROUP BY block_id, k HAVING count(*) >= 5")
def _(reads):
    return dc.runs_of_rows(_shifted(reads), 5)


@query("a41_column_statistics", "reads", oracle=f"WITH c AS ({COLUMNS}) SELECT ref, rel, count(*) AS n FROM c GROUP BY ref, rel")
def _(reads):
    return dc.column_statistics(_columns(reads))


VOTES = "WITH v AS (SELECT read_id // 20 * 20 AS read_id, CAST(i - 1 AS INTEGER) AS pos, substring(seq, CAST(i AS BIGINT), 1) AS base FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq), 0) AS BIGINT) + 1)) AS i FROM reads)), n AS (SELECT read_id, pos, base, count(*) AS n FROM v GROUP BY ALL), k AS (SELECT read_id, pos, base, CAST(floor(100 * n / sum(n) OVER (PARTITION BY read_id, pos)) AS INTEGER) AS confidence, row_number() OVER (PARTITION BY read_id, pos ORDER BY n DESC, base) AS r FROM n)"


def _votes(reads):
    return reads.select(F.expr("read_id div 20 * 20").alias("read_id"), F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")


@query("t13_consensus", "reads", oracle=VOTES + " SELECT read_id, pos, base, confidence FROM k WHERE r = 1")
def _(reads):
    return dc.consensus(_votes(reads))


@query("w9_confidence_windows", "reads", oracle=VOTES + " SELECT read_id, pos, avg(confidence) OVER (PARTITION BY read_id ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mean FROM k WHERE r = 1")
def _(reads):
    return dc.confidence_windows(_votes(reads), 5).select("read_id", "pos", "mean")


@query("t14_error_correction", "reads", oracle=VOTES + ", m AS (SELECT read_id, pos, base FROM k WHERE r = 1 AND confidence >= 45), s AS (SELECT r.read_id, i, coalesce(m.base, substring(seq, CAST(i AS BIGINT), 1)) AS b FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq), 0) AS BIGINT) + 1)) AS i FROM reads) r LEFT JOIN m ON m.read_id = r.read_id AND m.pos = i - 1 WHERE r.read_id % 20 = 0) SELECT read_id, string_agg(b, '' ORDER BY i) AS seq FROM s GROUP BY read_id")
def _(reads):
    short = reads.where("read_id % 20 = 0 AND length(seq) > 0")
    return dc.corrected(short, _votes(reads), 45).select("read_id", "seq")


def _u(what: str, *keys: str) -> str:
    """The draw of discovery in SQL, seed 1."""
    return f"((CAST('0x' || substring(md5(concat_ws(':', '1:0:{what}', {', '.join(keys)})), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


@query("t18_simulated_reads", "reads", oracle=f"""WITH p AS (SELECT row_number() OVER (ORDER BY read_id) AS number, read_id, seq, count(*) OVER () AS size FROM reads WHERE length(seq) >= 50),
d AS (SELECT i AS sim_id, CAST(floor({_u("which", "i")} * (SELECT max(size) FROM p)) + 1 AS BIGINT) AS number FROM range(500) AS r(i)),
g AS (SELECT sim_id, read_id, CAST(floor({_u("at", "sim_id")} * (length(seq) - 49)) AS INTEGER) AS start, CASE WHEN {_u("strand", "sim_id")} < 0.5 THEN '+' ELSE '-' END AS strand, seq FROM d JOIN p USING (number)),
t AS (SELECT sim_id, read_id, start, strand, CASE strand WHEN '+' THEN substring(seq, start + 1, 50) ELSE reverse(translate(substring(seq, start + 1, 50), 'ACGT', 'TGCA')) END AS s FROM g)
SELECT sim_id, read_id AS source, start, strand, array_to_string(list_transform(range(50), lambda i: CASE WHEN {_u("err", "sim_id", "i")} < list_extract([0.0, 0.02, 0.05], least(i + 1, 3)) THEN translate(substring(s, i + 1, 1), 'ACGT', 'CGTA') ELSE substring(s, i + 1, 1) END), '') AS seq, s AS true_seq FROM t""")
def _(reads):
    return dc.simulated_reads(reads, 500, 50, profile=[0.0, 0.02, 0.05])


@query("t18_simulated_counts", "features", oracle=f"""SELECT feat_id, control, CAST(floor(CASE WHEN changed THEN control * 2.0::DOUBLE ELSE control END) AS BIGINT) AS experiment, changed FROM (SELECT feat_id, CAST(floor(-ln({_u("count", "feat_id")}) * 100) AS BIGINT) AS control, {_u("changed", "feat_id")} * 100 < 10 AS changed FROM features)""")
def _(features):
    return dc.simulated_counts(features, 100, 2.0, 10)


@query("t18_fragmentation", "reads", oracle="SELECT read_id, CAST(length(seq) AS BIGINT) AS bases FROM reads WHERE length(seq) > 0")
def _(reads):
    return dc.fragments(reads, 80).groupBy("read_id").agg(F.sum("len").alias("bases"))


@query("a42_bootstrap_hits", "reads", oracle=f"""WITH p AS (SELECT read_id AS probe_id, substring(seq, 21, 20) AS k FROM reads WHERE length(seq) >= 60), w AS (SELECT DISTINCT substring(seq, i, 20) AS k FROM (SELECT seq, unnest(range(1, CAST(greatest(length(seq) - 19, 0) AS BIGINT) + 1)) AS i FROM reads)),
h AS (SELECT probe_id FROM p WHERE k IN (SELECT k FROM w) OR reverse(translate(k, 'ACGT', 'TGCA')) IN (SELECT k FROM w)), d AS (SELECT round, {_u("boot", "probe_id", "round")} AS u FROM h, range(1, 21) AS r(round))
SELECT CAST(round AS INTEGER) AS round, CAST(sum(len(list_filter([0.36788, 0.73576, 0.9197, 0.98101, 0.99634, 0.99941], lambda x: u > x))) AS BIGINT) AS hit, sum(len(list_filter([0.36788, 0.73576, 0.9197, 0.98101, 0.99634, 0.99941], lambda x: u > x))) * 1.0::DOUBLE / (SELECT count(*) FROM p) AS share FROM d GROUP BY round""")
def _(reads):
    from strandframe.operators.kmers import probes_found

    probes = reads.where("length(seq) >= 60").select(F.col("read_id").alias("probe_id"), F.substring("seq", 21, 20).alias("probe"))
    return dc.bootstrap_hits(probes_found(probes, reads, 20), probes.count(), 20)


@query("t22_rad_stacks", "reads", oracle="SELECT substring(seq, 1, 5) AS site, count(*) AS reads, min(read_id) AS first, count(DISTINCT seq) AS kinds FROM reads WHERE length(seq) >= 5 GROUP BY 1 HAVING count(*) >= 3")
def _(reads):
    return dc.stacks(reads, 5, 3)


@query("a24_overlap_evidence", "reads", oracle="""WITH e AS (SELECT read_id, n, right(seq, n) AS s, left(seq, n) AS p FROM reads, range(8, 21) AS r(n) WHERE length(seq) > 20 AND n < length(seq)), x AS (SELECT DISTINCT a.read_id AS a, b.read_id AS b FROM e a JOIN e b ON a.n = b.n AND a.s = b.p AND a.read_id <> b.read_id) SELECT read_id FROM reads WHERE read_id IN (SELECT a FROM x) AND read_id IN (SELECT b FROM x)""")
def _(reads):
    return dc.overlap_evidence(reads.where("length(seq) > 20"), 8, 20, 1).select("read_id")


@query("t9_t10_assembly", "reads")
def _(reads):
    # pieces of 100 bases, 60 apart, to the end of every read
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("seq") - 100) / 60), F.lit(0)).cast("int"))
    pieces = reads.where("length(seq) > 0").select("read_id", "seq", F.explode(starts).alias("i"))
    return dc.assembled(pieces.select((F.col("read_id") * 1_000_000 + F.col("i")).alias("read_id"), F.expr("substring(seq, 1 + 60 * i, 100)").alias("seq")), [35, 25])


@query("t21_homozygous_reduction", "reads", oracle="""WITH k AS (SELECT DISTINCT read_id, length(seq) AS l, unnest(list_transform(range(1, CAST(greatest(length(seq) - 12 + 2, 1) AS BIGINT)), lambda i: substring(seq, i, 12))) AS kmer FROM reads), n AS (SELECT read_id, count(*) AS n FROM k GROUP BY read_id), s AS (SELECT a.read_id, b.read_id AS o, count(*) AS s FROM k a JOIN k b ON a.kmer = b.kmer AND a.read_id <> b.read_id AND (b.l > a.l OR b.l = a.l AND b.read_id < a.read_id) GROUP BY 1, 2)
SELECT read_id FROM reads WHERE read_id NOT IN (SELECT s.read_id FROM s JOIN n ON n.read_id = s.read_id WHERE s.s * 100 >= n.n * 60)""")
def _(reads):
    return dc.homozygous_reduced(reads, 12, 60).select("read_id")


@query("f8_region_filter", "sparse", "exons", oracle=BITS + "SELECT el_id, bits FROM (SELECT el_id, bit_or(bits) AS bits FROM b GROUP BY el_id) WHERE bits IN (1, 8)")
def _(loci, exons):
    from strandframe.operators.filters import region

    bits = ft.bits_of_loci(loci, ft.with_exons(exons), 150)
    all_ = loci.join(bits, "el_id", "left").fillna(0, ["bits"])
    return region(all_, "bits", include=ft.CDS | ft.INTRON).select("el_id", "bits")


@query("a30_benjamini_hochberg", "features", oracle="SELECT feat_id, p, least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM (SELECT feat_id, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM (SELECT feat_id, (score + 1) / 1001.0::DOUBLE AS p FROM features))")
def _(features):
    return st.benjamini_hochberg(features.select("feat_id", ((F.col("score") + 1) / F.lit(1001.0)).alias("p")), "p").select("feat_id", "p", "q")


@query("t12_highest_scoring_paths", "edges", oracle="""WITH RECURSIVE g AS (SELECT a AS u, 2 * a + b - 1000000 AS v, max(b % 5 + 1) AS s FROM edges GROUP BY 1, 2), p AS (SELECT u AS node, CAST(0 AS BIGINT) AS s FROM g UNION SELECT v, 0 FROM g UNION SELECT g.v, p.s + g.s FROM p JOIN g ON g.u = p.node) SELECT node, CAST(max(s) AS DOUBLE) AS best FROM p GROUP BY node""")
def _(edges):
    from strandframe.operators.graph import highest_scoring_paths

    # every edge leads to a greater number, so the graph is acyclic
    graph = edges.select(F.col("a").alias("u"), (2 * F.col("a") + F.col("b") - 1_000_000).alias("v"), (F.col("b") % 5 + 1).cast("double").alias("score"))
    return highest_scoring_paths(graph.groupBy("u", "v").agg(F.max("score").alias("score")))


@query("t10_pair_scaffolds", "features", oracle="""WITH RECURSIVE l AS (SELECT feat_id AS u, feat_id + 1 AS v, CASE WHEN feat_id % 3 = 0 THEN 1 ELSE 0 END AS turn FROM features WHERE feat_id % 4 + 1 >= 2 AND feat_id % 6 <> 5), w AS (SELECT u AS contig, u AS scaffold, CAST(0 AS BIGINT) AS place, 0 AS turns FROM l WHERE u NOT IN (SELECT v FROM l) UNION ALL SELECT l.v, w.scaffold, w.place + 1, w.turns + l.turn FROM w JOIN l ON l.u = w.contig) SELECT contig, scaffold, place, turns % 2 = 1 AS flipped FROM w""")
def _(features):
    from strandframe.operators.graph import pair_scaffolds

    # one to four pairs from each contig to the next, a third of the links between opposite strands
    pairs = features.where("feat_id % 6 <> 5").select(F.col("feat_id").alias("c1"), (F.col("feat_id") + 1).alias("c2"), F.lit("+").alias("s1"), F.when(F.col("feat_id") % 3 == 0, "-").otherwise("+").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("feat_id") % 4)))
    return pair_scaffolds(pairs.select("c1", "s1", "c2", "s2"), 2)
