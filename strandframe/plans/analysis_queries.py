"""Queries of feature counting, expression, variants, k-mer joins and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.functions import stats as st
from strandframe.operators import expression as ex
from strandframe.operators import features as ft
from strandframe.operators import graph as gr
from strandframe.operators import kmers as km
from strandframe.operators import variants as va
from strandframe.operators.intervals import overlap_totals

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
            elif oracle.startswith("WITH "):
                head, oracle_ = head + ",\n", oracle[5:]
            else:
                head, oracle_ = head + "\n", oracle
            SQL[name] = head + oracle_
        return f

    return add


PAIR = 'l.chrom = f.chrom AND f.start <= l."end" AND f."end" >= l.start'
#: Region bits of locus l and exon-bearing gene f, as counts over its exons (e) and introns (i).
DIST = 150
BITS = f"""WITH p AS (SELECT l.el_id, l.start AS ls, l."end" AS le, f.feat_id, f.start AS fs, f."end" AS fe, f.strand, f.cds_start AS cs, f.cds_end AS ce FROM sparse l JOIN genes f ON l.chrom = f.chrom AND f.start <= l."end" + {DIST} AND f."end" >= l.start - {DIST}),
x AS (SELECT p.*, EXISTS (SELECT 1 FROM exons e WHERE e.feat_id = p.feat_id AND greatest(e.start, cs) <= least(e."end", ce) AND ls <= least(e."end", ce) AND le >= greatest(e.start, cs)) AS cds,
 EXISTS (SELECT 1 FROM exons e WHERE e.feat_id = p.feat_id AND e.start < cs AND ls <= least(e."end", cs - 1) AND le >= e.start) AS lft,
 EXISTS (SELECT 1 FROM exons e WHERE e.feat_id = p.feat_id AND e."end" > ce AND ls <= e."end" AND le >= greatest(e.start, ce + 1)) AS rgt,
 EXISTS (SELECT 1 FROM (SELECT feat_id, start, lag("end") OVER (PARTITION BY feat_id ORDER BY start) AS pe FROM exons) i WHERE i.feat_id = p.feat_id AND pe IS NOT NULL AND ls < i.start AND le > pe) AS intron,
 ls < fs AND le >= fs - {DIST} AS bef, le > fe AND ls <= fe + {DIST} AS aft FROM p),
b AS (SELECT el_id, feat_id, (CASE WHEN cds THEN 1 ELSE 0 END) + (CASE WHEN strand = '+' AND lft OR strand = '-' AND rgt THEN 2 ELSE 0 END) + (CASE WHEN strand = '+' AND rgt OR strand = '-' AND lft THEN 4 ELSE 0 END)
 + (CASE WHEN intron THEN 8 ELSE 0 END) + (CASE WHEN strand = '+' AND bef OR strand = '-' AND aft THEN 16 ELSE 0 END) + (CASE WHEN strand = '+' AND aft OR strand = '-' AND bef THEN 32 ELSE 0 END) AS bits FROM x)
"""


@query("x10_region_bits", "sparse", "exons", oracle=BITS + "SELECT el_id, feat_id, bits FROM b")
def _(loci, exons):
    return ft.pair_bits(loci, ft.with_exons(exons), DIST, with_splice=False).select("el_id", "feat_id", "bits")


REGION = "CASE WHEN r & 1 <> 0 THEN 'CDS' WHEN r & 2 <> 0 THEN '5UTR' WHEN r & 4 <> 0 THEN '3UTR' WHEN r & 8 <> 0 THEN 'Intron' WHEN r & 16 <> 0 THEN 'Up' WHEN r & 32 <> 0 THEN 'Down' ELSE 'IG' END"


@query("x12_x13_functional_region", "sparse", "exons", oracle=BITS + f"SELECT el_id, {REGION} AS region FROM (SELECT l.el_id, coalesce(bit_or(b.bits), 0) AS r FROM sparse l LEFT JOIN b ON b.el_id = l.el_id GROUP BY l.el_id)")
def _(loci, exons):
    bits = ft.bits_of_loci(loci, ft.with_exons(exons), DIST).withColumnRenamed("bits", "r")
    return loci.select("el_id").distinct().join(bits, "el_id", "left").select("el_id", ft.region_of(F.coalesce("r", F.lit(0))).alias("region"))


@query("x14_structure_lengths", "exons", oracle="""SELECT feat_id, CAST(sum("end" - start + 1) AS BIGINT) AS transcribed, CAST(sum(greatest(0, least("end", cds_end) - greatest(start, cds_start) + 1)) AS BIGINT) AS coding, CAST(count(*) AS INTEGER) AS n FROM exons GROUP BY feat_id""")
def _(exons):
    g = ft.with_exons(exons)
    return g.select("feat_id", ft.transcript_length(F.col("exons")).alias("transcribed"), ft.coding_length(F.col("exons"), F.col("cds_start"), F.col("cds_end")).alias("coding"), F.size("exons").alias("n"))


@query("x15_transcript_to_locus", "exons", oracle="""SELECT feat_id, max(CASE WHEN 37 >= before AND 37 < before + len THEN start + 37 - before END) AS locus FROM (SELECT feat_id, start, "end" - start + 1 AS len, sum("end" - start + 1) OVER (PARTITION BY feat_id ORDER BY start ROWS UNBOUNDED PRECEDING) - ("end" - start + 1) AS before FROM exons) GROUP BY feat_id""")
def _(exons):
    return ft.with_exons(exons).select("feat_id", ft.transcript_to_locus(F.col("exons"), F.lit(37)).alias("locus"))


@query("a3_feature_region_counts", "sparse", "exons", oracle=BITS + "SELECT feat_id, " + ", ".join(f"count(*) FILTER (bits & {b} <> 0) AS {n}" for n, b in [("cds", 1), ("utr5", 2), ("utr3", 4), ("introns", 8), ("up", 16), ("dn", 32)]) + " FROM b GROUP BY feat_id")
def _(loci, exons):
    return ft.feature_counts(loci, ft.with_exons(exons), DIST).drop("splice5", "splice3")


@query("a3_one_count_per_read", "sparse", "exons", oracle=BITS + "SELECT bits & -bits AS bit, count(*) AS n FROM b GROUP BY 1")
def _(loci, exons):
    return ft.lowest_bit_totals(loci, ft.with_exons(exons), DIST)


@query("x11_splice_sites", "sparse", "exons", oracle="""SELECT l.el_id, e.feat_id, count(*) FILTER (nxt IS NOT NULL AND l.start <= e."end" - 1 AND l."end" >= e."end" + 2) > 0 AS donor FROM sparse l JOIN (SELECT *, lead(start) OVER (PARTITION BY feat_id ORDER BY start) AS nxt FROM exons) e ON l.chrom = e.chrom JOIN genes f ON f.feat_id = e.feat_id AND f.start <= l."end" AND f."end" >= l.start GROUP BY l.el_id, e.feat_id""")
def _(loci, exons):
    df = ft.pair_bits(loci, ft.with_exons(exons))
    own = F.when(F.col("plus"), F.lit(ft.SPLICE5)).otherwise(F.lit(ft.SPLICE3))
    return df.select("el_id", "feat_id", (F.col("bits").bitwiseAND(own) != 0).alias("donor"))


@query("a4_feature_rpkm", "loci", "features", oracle=f"""SELECT f.feat_id, count(*) AS reads, count(DISTINCT l.start) AS uniq_loci, count(*) * 1000.0::DOUBLE / max(f."end" - f.start + 1) * 1e6 / (SELECT count(*) FROM loci) AS rpkm FROM loci l JOIN features f ON {PAIR} GROUP BY f.feat_id""")
def _(loci, features):
    total = loci.agg(F.count(F.lit(1)).alias("total"))
    # of the loci with one start, a feature meets any if it meets the longest
    longest = loci.groupBy("chrom", "start").agg(F.max("end").alias("end")).select("*", F.lit(0).alias("_n"), F.lit(1).alias("_u"))
    found = overlap_totals(loci.select("chrom", "start", "end", F.lit(1).alias("_n"), F.lit(0).alias("_u")).unionByName(longest), features, {"n": F.col("_n"), "u": F.col("_u")}).where("n_n > 0")
    counted = found.groupBy("feat_id").agg(F.sum("n_n").alias("reads"), F.max("n_u").alias("uniq_loci"), F.max(F.col("end") - F.col("start") + 1).alias("len"))
    # one row
    return ft.rpkm(counted.crossJoin(F.broadcast(total)), "reads", "len", F.col("total")).select("feat_id", "reads", "uniq_loci", "rpkm")


@query("a5_best_isoform", "features", oracle="SELECT feat_id, gene, score FROM (SELECT feat_id, feat_id // 4 AS gene, score, row_number() OVER (PARTITION BY feat_id // 4 ORDER BY score DESC, feat_id) AS n FROM features) WHERE n = 1")
def _(features):
    df = features.withColumn("gene", F.expr("feat_id div 4"))
    return ft.best_isoform(df, F.col("gene"), "score").select("feat_id", "gene", "score")


@query("a6_chrom_region_summary", "sparse", "exons", oracle=BITS + """SELECT l.chrom, count(*) FILTER (r & 1 <> 0) AS cds, count(*) FILTER (r & 8 <> 0) AS introns, count(*) FILTER (r = 0) AS ig FROM (SELECT l.el_id, l.chrom, coalesce(bit_or(b.bits), 0) AS r FROM sparse l LEFT JOIN b ON b.el_id = l.el_id GROUP BY l.el_id, l.chrom) l GROUP BY l.chrom""")
def _(loci, exons):
    bits = ft.bits_of_loci(loci, ft.with_exons(exons), DIST).withColumnRenamed("bits", "r")
    r = F.coalesce("r", F.lit(0))
    return loci.select("el_id", "chrom").distinct().join(bits, "el_id", "left").groupBy("chrom").agg(F.sum((r.bitwiseAND(F.lit(1)) != 0).cast("long")).alias("cds"), F.sum((r.bitwiseAND(F.lit(8)) != 0).cast("long")).alias("introns"), F.sum((r == 0).cast("long")).alias("ig"))


@query("j27_priority_association", "sparse", "features", oracle="""SELECT el_id, feat_id, weight, gap FROM (SELECT *, row_number() OVER (PARTITION BY el_id ORDER BY weight DESC, CASE WHEN weight = 5 THEN fe - fs ELSE gap END, feat_id) AS n FROM (SELECT l.el_id, f.feat_id, f.start AS fs, f."end" AS fe,
 CASE WHEN l.start >= f.start AND l."end" <= f."end" THEN 5 WHEN (f.strand = '+') = (l.start < f.start) THEN 4 ELSE 3 END AS weight, greatest(f.start - l."end", l.start - f."end", 0) AS gap FROM sparse l JOIN features f ON l.chrom = f.chrom AND f.start <= l."end" + 1000 AND f."end" >= l.start - 1000)) WHERE n = 1""")
def _(loci, features):
    return ft.priority_association(loci, features, 1000)


BINS = """WITH RECURSIVE bins AS (SELECT feat_id, chrom, start, "end" - start + 1 AS size, 0 AS bin, CAST(0 AS BIGINT) AS lo, ("end" - start + 1) // 10 AS hi FROM features UNION ALL SELECT feat_id, chrom, start, size, bin + 1, hi, hi + (size - hi) // (10 - bin - 1) FROM bins WHERE bin < 9),
h AS (SELECT b.feat_id, b.bin, count(*) FILTER (l.cond = 'F' AND l.start >= b.start + lo AND l.start < b.start + hi) AS ctrl_cnt, count(*) FILTER (l.cond = 'O' AND l.start >= b.start + lo AND l.start < b.start + hi) AS expr_cnt,
 coalesce(sum(least(l."end", b.start + hi - 1) - greatest(l.start, b.start + lo) + 1) FILTER (l.cond = 'F'), 0) AS ctrl_cov, coalesce(sum(least(l."end", b.start + hi - 1) - greatest(l.start, b.start + lo) + 1) FILTER (l.cond = 'O'), 0) AS expr_cov
 FROM bins b LEFT JOIN loci l ON l.chrom = b.chrom AND l.start <= b.start + hi - 1 AND l."end" >= b.start + lo WHERE hi > lo GROUP BY b.feat_id, b.bin)
"""


def _binned(loci, features):
    return ex.binned_counts(loci.withColumn("cond", (F.col("cond") == "O").cast("int")), features, 10)


@query("a7_binned_counts", "loci", "features", oracle=BINS + "SELECT feat_id, bin, ctrl_cnt, expr_cnt, CAST(ctrl_cov AS BIGINT) AS ctrl_cov, CAST(expr_cov AS BIGINT) AS expr_cov FROM h")
def _(loci, features):
    return _binned(loci, features)


@query("a8_library_scaling", "snps", oracle="SELECT locus, n, CAST(floor(s + 0.5) - coalesce(floor(lag(s) OVER (ORDER BY locus) + 0.5), 0) AS BIGINT) AS scaled FROM (SELECT locus, n, sum(n * 0.37::DOUBLE) OVER (ORDER BY locus ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT locus, count(*) AS n FROM snps GROUP BY locus))")
def _(snps):
    counted = snps.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))
    return ex.scaled_counts(counted, "n", F.lit(0.37), (), ["locus"]).select("locus", "n", "scaled")


@query("a9_artefact_reduction", "loci", oracle="""SELECT chrom, pos, n, CAST(floor(CASE WHEN n <= 3 THEN n WHEN o = 0 THEN 3 + sqrt(n - 3) WHEN n > m THEN m + sqrt(n - m) ELSE n END + 0.5) AS BIGINT) AS reduced FROM (SELECT *, CASE WHEN o = 0 THEN NULL ELSE (s - n) * 1.0::DOUBLE / o * 3 END AS m FROM
 (SELECT *, sum(n) OVER w AS s, count(*) OVER w - 1 AS o FROM (SELECT chrom, start AS pos, count(*) AS n FROM loci GROUP BY chrom, start) WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)))""")
def _(loci):
    counted = loci.groupBy("chrom", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return ex.artefacts_reduced(counted, "n", 3, 10)


@query("a10_coalesced_reads", "sparse", oracle="""WITH RECURSIVE c AS (SELECT chrom, strand, start, count(*) AS n, row_number() OVER (PARTITION BY chrom, strand ORDER BY start) AS rn FROM sparse GROUP BY chrom, strand, start), g AS (SELECT chrom, strand, rn, n, start AS anchor FROM c WHERE rn = 1
 UNION ALL SELECT c.chrom, c.strand, c.rn, c.n, CASE WHEN c.start < g.anchor + 20 THEN g.anchor ELSE c.start END FROM g JOIN c ON c.chrom = g.chrom AND c.strand = g.strand AND c.rn = g.rn + 1) SELECT chrom, strand, anchor AS start, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY chrom, strand, anchor""")
def _(loci):
    return ex.coalesced(loci, 20)


PEARSON = "CASE WHEN n > 0 THEN (sxy - mx * sy - my * sx + n * mx * my) / greatest(sqrt((sxx - 2 * mx * sx + n * mx * mx) * (syy - 2 * my * sy + n * my * my)), 1e-5) ELSE 0.0 END"


@query("a11_shifted_pearson", "loci", "features", oracle=BINS + f", g AS (SELECT feat_id, count(*) FILTER (u) * 1.0::DOUBLE AS n, coalesce(sum(x) FILTER (u), 0)::DOUBLE AS sx, coalesce(sum(y) FILTER (u), 0)::DOUBLE AS sy, coalesce(sum(x * y) FILTER (u), 0)::DOUBLE AS sxy, coalesce(sum(x * x) FILTER (u), 0)::DOUBLE AS sxx, coalesce(sum(y * y) FILTER (u), 0)::DOUBLE AS syy FROM (SELECT feat_id, ctrl_cnt AS x, expr_cnt AS y, ctrl_cnt <> 0 OR expr_cnt <> 0 AS u FROM h) GROUP BY feat_id) SELECT feat_id, round({PEARSON}, 6) AS r FROM (SELECT *, sx / nullif(n, 0) + 1 AS mx, sy / nullif(n, 0) + 1 AS my FROM g)")
def _(loci, features):
    return _binned(loci, features).groupBy("feat_id").agg(F.round(st.shifted_pearson("ctrl_cnt", "expr_cnt"), 6).alias("r"))


@query("a12_fold_change_classes", "loci", "features", oracle=BINS + """, t AS (SELECT feat_id, sum(ctrl_cnt) AS c, sum(expr_cnt) AS e FROM h GROUP BY feat_id), r AS (SELECT feat_id, CASE WHEN c = 0 THEN e * 1.0001::DOUBLE ELSE e * 1.0::DOUBLE / c END AS q FROM t), f AS (SELECT feat_id, CASE WHEN q < 0.02 THEN 0.0::DOUBLE ELSE greatest(least(q, 25.0::DOUBLE), 0.04::DOUBLE) END AS fold FROM r)
 SELECT feat_id, fold, (CASE WHEN fold >= 1.25 THEN 1 ELSE 0 END) + (CASE WHEN fold >= 1.5 THEN 1 ELSE 0 END) + (CASE WHEN fold >= 1.75 THEN 1 ELSE 0 END) - (CASE WHEN fold <= 0.8 THEN 1 ELSE 0 END) - (CASE WHEN fold <= 0.5 THEN 1 ELSE 0 END) - (CASE WHEN fold <= 0.3 THEN 1 ELSE 0 END) AS class FROM f""")
def _(loci, features):
    totals = _binned(loci, features).groupBy("feat_id").agg(F.sum("ctrl_cnt").alias("c"), F.sum("expr_cnt").alias("e"))
    return totals.withColumn("fold", st.fold_change(F.col("c"), F.col("e"))).select("feat_id", "fold", st.fold_class(F.col("fold")).alias("class"))


@query("a13_bootstrap_p", "loci", "features")
def _(loci, features):
    return st.bootstrap_p(_binned(loci, features), "feat_id", "ctrl_cnt", "expr_cnt", 200, order="bin")


@query("a14_correlation_interval", "features", oracle="SELECT feat_id, (exp(2 * (m - w)) - 1) / (exp(2 * (m - w)) + 1) AS low, (exp(2 * (m + w)) - 1) / (exp(2 * (m + w)) + 1) AS high FROM (SELECT feat_id, ln((1 + r) / (1 - r)) / 2 AS m, 1.96 / sqrt(greatest(n, 4) - 3.0) AS w FROM (SELECT feat_id, (score - 500) / 600.0::DOUBLE AS r, feat_id % 40 AS n FROM features))")
def _(features):
    low, high = st.correlation_interval((F.col("score") - 500) / F.lit(600.0), F.col("feat_id") % 40)
    return features.select("feat_id", low.alias("low"), high.alias("high"))


@query("a15_count_matrix", "loci", "features", oracle=f"""SELECT feat_id, "A", "N", "R" FROM (SELECT f.feat_id, count(*) FILTER (l.sample = 'A') AS "A", count(*) FILTER (l.sample = 'N') AS "N", count(*) FILTER (l.sample = 'R') AS "R" FROM loci l JOIN features f ON {PAIR} GROUP BY f.feat_id) WHERE "A" > 0 AND "N" > 0 AND "R" > 0 AND "A" + "N" + "R" >= 20""")
def _(loci, features):
    samples = ["A", "N", "R"]
    found = overlap_totals(loci, features, {s: (F.col("sample") == s).cast("int") for s in samples})
    return ex.seen_in_all(found.groupBy("feat_id").agg(*[F.sum(f"n_{s}").alias(s) for s in samples]), samples, 20)


@query("j8_contig_remap", "features", oracle="""SELECT feat_id, concat('super', CAST(n % 2 AS VARCHAR)) AS chrom, start + n * 50000 AS start, "end" + n * 50000 AS "end" FROM features JOIN (SELECT concat('chr', CAST(i AS VARCHAR)) AS c, i AS n FROM range(4) AS r(i)) ON lower(c) = lower(chrom)""")
def _(features):
    contigs = features.sparkSession.range(4).select(F.concat(F.lit("CHR"), F.col("id").cast("string")).alias("contig"), F.concat(F.lit("super"), (F.col("id") % 2).cast("string")).alias("chrom"), (F.col("id") * 50000).alias("offset"))
    from strandframe.operators.remap import remapped

    return remapped(features, contigs).select("feat_id", "chrom", "start", "end")


LC = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@query("a30_snp_candidates", "snps", oracle="""WITH b AS (SELECT locus, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM snps GROUP BY locus), d AS (SELECT locus, a + c + g + t AS cov, a + c + g + t - greatest(a, c, g, t) AS alt FROM b), r AS (SELECT *, greatest(0.01, sum(alt) OVER () * 1.0::DOUBLE / sum(cov) OVER ()) AS rate FROM d),
 p AS (SELECT locus, cov, alt, CASE WHEN alt <= 0 THEN 1.0 ELSE least(1.0::DOUBLE, list_sum(list_transform(range(alt, cov + 1), lambda i: exp(""" + LC.format(n="cov", k="i") + """ + i * ln(rate) + (cov - i) * ln(1 - rate))))) END AS p FROM r WHERE cov >= 5 AND alt >= 0.25 * cov)
 SELECT locus, cov, alt, round(p, 6) AS p, round(least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM p)""")
def _(snps):
    return va.snp_candidates(va.base_counts(snps, ("locus",)), 5, 0.25).withColumn("p", F.round("p", 6)).withColumn("q", F.round("q", 6))


@query("a31_cultivar_markers", "snps", oracle="""WITH c AS (SELECT locus, cultivar, base, count(*) AS cnt FROM snps GROUP BY ALL), t AS (SELECT *, sum(cnt) OVER (PARTITION BY locus, cultivar) AS tot, strpos('ACGTN', base) AS nth FROM c),
 o AS (SELECT t.*, coalesce((SELECT max(u.cnt) FROM c u WHERE u.locus = t.locus AND u.base = t.base AND u.cultivar <> t.cultivar), 0) AS other FROM t)
 SELECT locus, cultivar, base, cnt, CAST(floor(100.0::DOUBLE * cnt / tot) AS INTEGER) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY locus, cultivar ORDER BY cnt DESC, nth) AS n FROM o WHERE tot >= 5 AND cnt >= 2 AND cnt * 100.0 / tot >= 10 AND other < 20) WHERE n = 1""")
def _(snps):
    return va.cultivar_markers(va.base_counts(snps, ("locus", "cultivar")), 5, 2, 10.0, 20)


@query("a32_drop_shared_base", "snps", oracle="""WITH c AS (SELECT locus, cultivar, base, count(*) AS cnt FROM snps GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus, cultivar ORDER BY cnt DESC, strpos('ACGTN', base)) AS n FROM c) WHERE n = 1)
 SELECT locus, cultivar, base, cnt FROM m WHERE locus IN (SELECT locus FROM m GROUP BY locus HAVING count(DISTINCT base) > 1)""")
def _(snps):
    return va.shared_base_dropped(va.major_base(va.base_counts(snps, ("locus", "cultivar"))))


@query("j24_cultivar_loci", "snps", oracle="SELECT locus, cultivar, count(*) AS tot, count(*) FILTER (base = 'A') AS a, count(DISTINCT cultivar) OVER (PARTITION BY locus) AS n_cultivars FROM snps GROUP BY locus, cultivar".replace("count(DISTINCT cultivar) OVER (PARTITION BY locus)", "count(*) OVER (PARTITION BY locus)"))
def _(snps):
    c = va.base_counts(snps, ("locus", "cultivar"))
    return c.select("locus", "cultivar", "tot", "a", F.count(F.lit(1)).over(Window.partitionBy("locus")).alias("n_cultivars"))


@query("a33_counts_from_alignments", "reads", oracle="""WITH al AS (SELECT read_id, concat('chr', CAST(read_id % 3 AS VARCHAR)) AS chrom, (read_id * 31) % 2000 AS start, seq FROM reads WHERE length(seq) > 0), lo AS (SELECT concat('chr', CAST(i % 3 AS VARCHAR)) AS chrom, i * 7 AS pos FROM range(300) AS r(i)),
 h AS (SELECT l.chrom, l.pos, substring(seq, l.pos - start + 1, 1) AS base FROM lo l JOIN al ON al.chrom = l.chrom AND l.pos >= start AND l.pos < start + length(seq)) SELECT chrom, pos AS start, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base = 'N') AS n, count(*) AS tot FROM h GROUP BY chrom, pos""")
def _(reads):
    al = reads.where("length(seq) > 0").select(F.concat(F.lit("chr"), (F.col("read_id") % 3).cast("string")).alias("chrom"), (F.col("read_id") * 31 % 2000).alias("start"), "seq").withColumn("end", F.col("start") + F.length("seq") - 1)
    lo = reads.sparkSession.range(300).select(F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("chrom"), (F.col("id") * 7).alias("start"), (F.col("id") * 7).alias("end"))
    return va.counts_from_alignments(al, lo)


@query("t5_marker_sequences", "reads", oracle="""SELECT seq_id, locus, marker_start, marker FROM (SELECT read_id AS seq_id, read_id % 50 AS locus, greatest(read_id % 50 - 20, 0) AS marker_start, substring(seq, greatest(read_id % 50 - 20, 0) + 1, least(read_id % 50 + 20, length(seq) - 1) - greatest(read_id % 50 - 20, 0) + 1) AS marker FROM reads WHERE length(seq) > 50) WHERE length(marker) >= 30""")
def _(reads):
    loci = reads.where("length(seq) > 50").select(F.col("read_id").alias("seq_id"), (F.col("read_id") % 50).alias("locus"))
    return va.marker_sequences(loci, reads.withColumnRenamed("read_id", "seq_id"), 20, 20, 0, 30).select("seq_id", "locus", "marker_start", "marker")


@query("a40_density_windows", "features", oracle='SELECT chrom, start // 5000 AS win, count(*) AS n, count(DISTINCT cls) AS classes FROM features GROUP BY 1, 2')
def _(features):
    return features.groupBy("chrom", F.expr("start div 5000").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cls").alias("classes"))


@query("a37_length_class_rollup", "features", oracle="""SELECT length_class, chrom, strand, n, bases FROM (SELECT CASE WHEN len < 200 THEN 'short' WHEN len < 600 THEN 'medium' ELSE 'long' END AS length_class, chrom, strand, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM (SELECT *, "end" - start + 1 AS len FROM features) GROUP BY CUBE (1, 2, 3))""".replace("GROUP BY CUBE (1, 2, 3)", "GROUP BY CUBE (length_class, chrom, strand)"))
def _(features):
    size = F.col("end") - F.col("start") + 1
    cls = F.when(size < 200, "short").when(size < 600, "medium").otherwise("long")
    return features.withColumn("len", size).withColumn("length_class", cls).cube("length_class", "chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query("a36_element_profile", "sparse", "features", oracle=f"""SELECT (l.start - f.start) // 50 AS offset_bin, count(*) AS n FROM sparse l JOIN features f ON {PAIR} WHERE l.start >= f.start GROUP BY 1""")
def _(loci, features):
    places = features.where("end >= start").groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("m"))
    steps = places.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "m", F.explode(F.expr("sequence(0L, (end - start) div 50)")).alias("offset_bin"))
    steps = steps.select("chrom", (F.col("s") + 50 * F.col("offset_bin")).alias("start"), F.least(F.col("s") + 50 * F.col("offset_bin") + 49, "e").alias("end"), "m", "offset_bin")
    steps = steps.groupBy("chrom", "start", "end", "offset_bin").agg(F.sum("m").alias("m"))
    return overlap_totals(loci, steps, {"all": F.lit(1)}).where("starts_all > 0").groupBy("offset_bin").agg(F.sum(F.col("starts_all") * F.col("m")).alias("n"))


FISHER = "exp(" + LC.format(n="(a + b)", k="{x}") + " + " + LC.format(n="(c + d)", k="(a + c - {x})") + " - (" + LC.format(n="(a + b + c + d)", k="(a + c)") + "))"


@query("a43_exact_tests", "features", oracle="""WITH v AS (SELECT feat_id, feat_id % 17 + 1 AS a, feat_id % 23 + 1 AS b, feat_id % 29 + 1 AS c, feat_id % 31 + 1 AS d FROM features), m AS (SELECT *, (a + b + c + d) * 1.0::DOUBLE AS n FROM v)
 SELECT feat_id, CASE WHEN least((a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n) < 5 THEN -1000000 ELSE CAST(floor(n * pow(a * d - b * c, 2.0) / ((a + b) * 1.0::DOUBLE * (c + d) * (a + c) * (b + d)) * 1e6 + 0.25) AS BIGINT) END AS chi2,
 CAST(floor(least(1.0::DOUBLE, list_sum(list_transform(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1), lambda x: CASE WHEN """ + FISHER.format(x="x") + " <= " + FISHER.format(x="a") + " * (1 + 1e-7) THEN " + FISHER.format(x="x") + """ ELSE 0 END))) * 1e6 + 0.25) AS BIGINT) AS fisher,
 CAST(floor(least(1.0::DOUBLE, list_sum(list_transform(range(a, a + b + 1), lambda i: exp(""" + LC.format(n="(a + b)", k="i") + """ + i * ln(0.3) + (a + b - i) * ln(0.7))))) * 1e6 + 0.25) AS BIGINT) AS tail FROM m""")
def _(features):
    names = ["a", "b", "c", "d"]
    tables = features.select("feat_id", *[(F.col("feat_id") % m + 1).alias(k) for k, m in zip(names, (17, 23, 29, 31))])
    a, b, c, d = (F.col(k) for k in names)
    # millionths, rounded off the half so that exact ties agree
    millionths = lambda x: F.floor(x * 1e6 + 0.25).cast("long")
    # each different table is tested once
    tested = tables.select(*names).distinct().select(*names, millionths(st.chi_square_2x2(a, b, c, d)).alias("chi2"), millionths(st.fisher_exact(a, b, c, d)).alias("fisher"), millionths(st.binomial_tail(a, a + b, F.lit(0.3))).alias("tail"))
    return tables.join(tested, names).select("feat_id", "chi2", "fisher", "tail")


KM = "unnest(list_transform(range(1, CAST(greatest(length({s}) - {k} + 2, 1) AS BIGINT)), lambda i: substring({s}, i, {k})))"
RC = "reverse(translate({c}, 'ACGT', 'TGCA'))"


@query("t3_unique_kmer_markers", "reads", oracle="WITH k AS (SELECT cultivar, " + KM.format(s="seq", k=10) + " AS w FROM reads), c AS (SELECT cultivar, least(w, " + RC.format(c="w") + ") AS kmer FROM k) SELECT kmer, count(*) AS n FROM c WHERE cultivar = 'fr' AND kmer NOT IN (SELECT kmer FROM c WHERE cultivar <> 'fr') GROUP BY kmer")
def _(reads):
    return km.unique_markers(reads, 10, "cultivar", "fr")


@query("t3_separated_markers", "reads", oracle="WITH k AS (SELECT cultivar, " + KM.format(s="seq", k=10) + " AS w FROM reads), c AS (SELECT cultivar, least(w, " + RC.format(c="w") + ") AS kmer FROM k), m AS (SELECT kmer, count(*) AS n FROM c WHERE cultivar = 'fr' AND kmer NOT IN (SELECT kmer FROM c WHERE cultivar <> 'fr') GROUP BY kmer), o AS (SELECT w FROM k WHERE cultivar <> 'fr' UNION SELECT " + RC.format(c="w") + " FROM k WHERE cultivar <> 'fr'), v AS (SELECT kmer, concat(substring(kmer, 1, i - 1), x, substring(kmer, i + 1)) AS w FROM m, range(1, 11) AS r(i), (VALUES ('A'), ('C'), ('G'), ('T')) AS b(x)) SELECT kmer, n FROM m WHERE kmer NOT IN (SELECT kmer FROM v JOIN o ON v.w = o.w)")
def _(reads):
    return km.separated_markers(reads, 10, "cultivar", "fr", 2)


@query("t4_prefix_markers", "reads", oracle="WITH k AS (SELECT cultivar, " + KM.format(s="seq", k=9) + " AS w FROM reads), s AS (SELECT cultivar, substring(w, 1, 6) AS p, 1 AS f FROM k UNION ALL SELECT cultivar, substring(" + RC.format(c="w") + ", 1, 6), 0 FROM k) SELECT p AS prefix, count(DISTINCT CASE WHEN f = 1 THEN cultivar END) AS groups, CAST(sum(f) AS BIGINT) AS sense, CAST(sum(1 - f) AS BIGINT) AS antisense FROM s GROUP BY p HAVING sum(f) > 0")
def _(reads):
    return km.prefix_markers(reads, 9, 6, "cultivar")


@query("t4_overlapping_markers_dropped", "reads", oracle="WITH k AS (SELECT DISTINCT " + KM.format(s="seq", k=9) + " AS kmer FROM reads), a AS (SELECT kmer FROM k WHERE substring(kmer, 1, 8) NOT IN (SELECT substring(kmer, 2) FROM k)) SELECT kmer FROM a WHERE NOT (kmer > " + RC.format(c="kmer") + " AND " + RC.format(c="kmer") + " IN (SELECT kmer FROM a))")
def _(reads):
    return km.overlaps_dropped(km.packed_windows(reads, "read_id", "seq", 9, once=True, clean=True).select("code").distinct().select(sq.kmer_from_code(F.col("code"), 9).alias("kmer")))


def _probes(reads, length: int = 20):
    return reads.where("length(seq) >= 60 AND read_id % 20 = 0").select(F.col("read_id").alias("probe_id"), F.substring("seq", 21, length).alias("probe"))


PROBES = "p AS (SELECT read_id AS probe_id, substring(seq, 21, 20) AS probe FROM reads WHERE length(seq) >= 60 AND read_id % 20 = 0), b AS (SELECT probe_id, probe AS q, '+' AS strand FROM p UNION ALL SELECT probe_id, " + RC.format(c="probe") + ", '-' FROM p), w AS (SELECT read_id, i - 1 AS ofs, substring(seq, CAST(i AS BIGINT), 20) AS k FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 19, 0) AS BIGINT) + 1)) AS i FROM reads))"


@query("j10_exact_kmer_join", "reads", oracle="WITH " + PROBES + " SELECT probe_id, read_id, CAST(ofs AS INTEGER) AS ofs, strand FROM b JOIN w ON q = k")
def _(reads):
    return km.exact_hits(_probes(reads), reads, 20)


@query("j11_seeded_mismatch_join", "reads", oracle="WITH " + PROBES + " SELECT probe_id, read_id, CAST(ofs AS INTEGER) AS ofs, strand, CAST(hamming(q, k) AS INTEGER) AS mm FROM b JOIN w ON hamming(q, k) <= 2")
def _(reads):
    return km.seeded_hits(_probes(reads), reads, 20, 2)


@query("j12_best_hit_acceptance", "reads", oracle="WITH " + PROBES + ", h AS (SELECT probe_id, hamming(q, k) AS mm, count(*) AS n FROM b JOIN w ON hamming(q, k) <= 2 GROUP BY 1, 2), f AS (SELECT *, lead(mm) OVER (PARTITION BY probe_id ORDER BY mm) AS next_mm, row_number() OVER (PARTITION BY probe_id ORDER BY mm) AS r FROM h) SELECT probe_id, CAST(mm AS INTEGER) AS mm, n, CAST(next_mm AS INTEGER) AS next_mm, CASE WHEN next_mm - mm < 2 THEN 'MMDelta' WHEN n > 3 THEN 'HitInsts' ELSE 'OK' END AS code FROM f WHERE r = 1")
def _(reads):
    return km.accepted(km.seeded_hits(_probes(reads), reads, 20, 2), 2, 3)


@query("j21_read_overlaps", "reads", oracle="WITH e AS (SELECT read_id, n, right(seq, n) AS s, left(seq, n) AS p FROM reads, range(12, 41) AS r(n) WHERE length(seq) > 30 AND n < length(seq)) SELECT a.read_id AS a, b.read_id AS b, CAST(max(a.n) AS INTEGER) AS overlap FROM e a JOIN e b ON a.n = b.n AND a.s = b.p AND a.read_id <> b.read_id GROUP BY 1, 2")
def _(reads):
    return km.read_overlaps(reads.where("length(seq) > 30"), 12, 40)


@query("j22_containment", "reads", oracle="SELECT DISTINCT a.read_id FROM reads a JOIN reads b ON a.read_id <> b.read_id AND length(a.seq) >= 16 AND contains(b.seq, a.seq) AND (length(b.seq) > length(a.seq) OR (a.seq = b.seq AND b.read_id < a.read_id))")
def _(reads):
    return km.contained(reads, 16)


@query("t19_window_hamming", "reads", oracle="WITH k AS (SELECT " + KM.format(s="substring(seq, 1, 40)", k=12) + " AS kmer FROM reads WHERE read_id < 100), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT kmer, CASE WHEN n > 1 THEN 0 ELSE CAST(least(coalesce((SELECT min(hamming(c.kmer, d.kmer)) FROM c d WHERE d.kmer <> c.kmer), 3), 3) AS INTEGER) END AS distance FROM c")
def _(reads):
    return km.window_hamming(reads.where("read_id < 100").withColumn("seq", F.substring("seq", 1, 40)), 12, 2)


@query("a28_cultivar_kmer_counts", "reads", oracle="SELECT k AS kmer, count(DISTINCT cultivar) AS cultivars, count(*) AS n FROM (SELECT cultivar, " + KM.format(s="seq", k=7) + " AS k FROM reads) GROUP BY k")
def _(reads):
    return reads.select("cultivar", F.explode(sq.clean_kmers(F.col("seq"), 7)).alias("kmer")).groupBy("kmer").agg(F.count_distinct("cultivar").alias("cultivars"), F.count(F.lit(1)).alias("n"))


@query("t8_contig_clusters", "edges", oracle="""WITH RECURSIVE bb AS (SELECT DISTINCT e.b AS x, f.b AS y FROM edges e JOIN edges f USING (a)), r AS (SELECT DISTINCT b AS x, b AS y FROM edges UNION SELECT r.x, bb.y FROM r JOIN bb ON bb.x = r.y), m AS (SELECT r.x AS b, min(e.a) AS cluster FROM r JOIN edges e ON e.b = r.y GROUP BY 1) SELECT b AS node, cluster FROM m UNION SELECT a, cluster FROM edges JOIN m USING (b)""")
def _(edges):
    return gr.connected_components(edges)


@query("a35_pair_correlation", "edges", oracle="SELECT a % 50 AS c1, b % 50 AS c2, count(*) AS pairs, count(*) FILTER (a % 2 = b % 2) AS same_sense FROM edges GROUP BY 1, 2")
def _(edges):
    return edges.groupBy((F.col("a") % 50).alias("c1"), (F.col("b") % 50).alias("c2")).agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("a") % 2 == F.col("b") % 2).cast("long")).alias("same_sense"))


@query("t11_transitive_reduction", "edges", oracle="""WITH d AS (SELECT a AS u, b - 1000000 AS v, min(a + b) AS ofs FROM edges WHERE a < b - 1000000 GROUP BY 1, 2) SELECT u, v, ofs FROM d WHERE NOT EXISTS (SELECT 1 FROM d x JOIN d y ON x.v = y.u WHERE x.u = d.u AND y.v = d.v)""")
def _(edges):
    small = edges.select(F.col("a").alias("u"), (F.col("b") - 1_000_000).alias("v"), (F.col("a") + F.col("b")).alias("ofs")).where("u < v")
    return gr.reduced(small)


def _nations(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("term"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    top = n.select(F.col("parent").alias("term")).distinct().withColumn("parent", F.lit("root"))
    genes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("gene"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("term"))
    return gr.propagated_counts(genes, n.unionByName(top))


Q["a39_ontology_propagation"] = _nations
SQL["a39_ontology_propagation"] = """WITH p AS (SELECT c_custkey AS gene, concat('n', CAST(c_nationkey AS VARCHAR)) AS term FROM customer UNION SELECT c_custkey, concat('r', CAST(n_regionkey AS VARCHAR)) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT c_custkey, 'root' FROM customer)
SELECT term, count(DISTINCT gene) AS genes FROM p GROUP BY term"""
