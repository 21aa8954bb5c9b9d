"""Round trips of formats: rows are written as lines and parsed again; the oracle is the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.sources import readers as rd
from strandframe.sources import writers as wr

from .shapes import shape, sql

Q: dict = {}
SQL: dict = {}


def query(name: str, *shapes: str, oracle: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(*[shape(spark, sf_dir, s) for s in shapes])
        if oracle:
            SQL[name] = sql(*shapes) + oracle
        return f

    return add


@query("s1_k1_fasta", "reads", oracle="SELECT CAST(read_id AS VARCHAR) AS name, seq FROM reads")
def _(reads):
    return rd.parse_fasta(wr.fasta(reads, "read_id")).select("name", "seq")


@query("s2_s3_fastq", "quals", oracle="SELECT CAST(read_id AS VARCHAR) AS descr, seq, qual FROM quals WHERE length(seq) > 0")
def _(quals):
    one = wr.fastq(quals.where("length(seq) > 0"), "read_id")
    return rd.parse_fastq(one).select("descr", "seq", "qual")


@query("s5_k2_bed", "features", oracle='SELECT chrom, start, "end", name, CAST(score AS INTEGER) AS score, strand FROM features')
def _(features):
    return rd.parse_bed(wr.bed(features)).select("chrom", "start", "end", "name", "score", "strand")


@query("s6_s7_gff3", "features", oracle="""SELECT chrom AS seqname, 'gene' AS feature, start, "end", strand, CAST(feat_id AS VARCHAR) AS id, name FROM features""")
def _(features):
    return rd.of_types(rd.parse_gff3(wr.gff3(features)), ["gene"]).select("seqname", "feature", "start", "end", "strand", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Name"].alias("name"))


@query("s8_gtf", "features", oracle="""SELECT chrom AS seqname, start, "end", CAST(score AS DOUBLE) AS score, strand, CAST(feat_id AS VARCHAR) AS gene_id, name AS gene_name FROM features""")
def _(features):
    return rd.parse_gtf(wr.gtf(features)).select("seqname", "start", "end", "score", "strand", F.col("attrs")["gene_id"].alias("gene_id"), F.col("attrs")["gene_name"].alias("gene_name"))


@query("s10_s11_k6_csv_loci", "loci", oracle="""SELECT el_id, 'read' AS el_type, 'sp "1", a' AS species, chrom, start, "end", "end" - start + 1 AS len, strand FROM loci WHERE "end" - start + 1 BETWEEN 10 AND 40""")
def _(loci):
    return rd.parse_csv_loci(wr.csv_loci(loci, "read", 'sp "1", a'), 10, 40)


CIGAR = "CASE el_id % 4 WHEN 0 THEN '10M' WHEN 1 THEN '5S10M2I3M' WHEN 2 THEN '4M100N6M' ELSE '5=2X3D4M1H' END"


def _sam(loci):
    cigar = F.expr(CIGAR)
    flag = F.when(F.col("el_id") % 9 == 0, 4).when(F.col("strand") == "-", 16).otherwise(0)
    return wr.sam(loci.select(F.col("el_id").cast("string").alias("qname"), flag.alias("flag"), F.col("chrom").alias("rname"), F.col("start").alias("pos"), F.lit(30).alias("mapq"), cigar.alias("cigar"), F.lit("*").alias("seq"), F.lit("*").alias("qual")))


@query("s13_s14_k3_sam_elements", "loci", oracle=f"""WITH_ SELECT CAST(el_id AS VARCHAR) AS qname, chrom, start + o AS start, start + o + n - 1 AS "end", strand, b AS block FROM loci JOIN (VALUES ('10M', 0, 10, 0), ('5S10M2I3M', 0, 13, 0), ('4M100N6M', 0, 4, 0), ('4M100N6M', 104, 6, 1), ('5=2X3D4M1H', 0, 7, 0), ('5=2X3D4M1H', 10, 4, 1)) AS v(c, o, n, b) ON c = {CIGAR} WHERE el_id % 9 <> 0""".replace("WITH_ ", ""))
def _(loci):
    return rd.alignment_elements(rd.parse_sam(_sam(loci)))


@query("s13_k3_bam_records", "loci", oracle=f"""SELECT CAST(el_id AS VARCHAR) AS qname, CASE WHEN el_id % 9 = 0 THEN 4 WHEN strand = '-' THEN 16 ELSE 0 END AS flag, chrom AS rname, start AS pos, {CIGAR} AS cigar, CASE el_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'ACGTN' ELSE 'GATTAC' END AS seq, CASE el_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'IIII#' ELSE '*' END AS qual FROM loci""")
def _(loci):
    from strandframe.sources import bam

    third = F.col("el_id") % 3
    seq = F.when(third == 0, "*").when(third == 1, "ACGTN").otherwise("GATTAC")
    flag = F.when(F.col("el_id") % 9 == 0, 4).when(F.col("strand") == "-", 16).otherwise(0)
    rows = loci.select(F.col("el_id").cast("string").alias("qname"), flag.alias("flag"), F.col("chrom").alias("rname"), F.col("start").alias("pos"), F.lit(30).alias("mapq"), F.expr(CIGAR).alias("cigar"), F.lit("*").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"), seq.alias("seq"), F.when(third == 1, "IIII#").otherwise("*").alias("qual"), F.concat_ws(":", "chrom", F.expr("start div 2000").cast("string")).alias("file"))
    files = bam.encoded(rows, loci.select(F.col("chrom").alias("name"), F.lit(100_000).alias("len")).distinct(), "file")
    return bam.decoded(files).select("qname", "flag", "rname", "pos", "cigar", "seq", "qual")


@query("x16_cigar_lengths", "loci", oracle=f"""SELECT el_id, CASE {CIGAR} WHEN '10M' THEN 10 WHEN '5S10M2I3M' THEN 13 WHEN '4M100N6M' THEN 10 ELSE 11 END AS aligned, CASE {CIGAR} WHEN '10M' THEN 10 WHEN '5S10M2I3M' THEN 13 WHEN '4M100N6M' THEN 110 ELSE 14 END AS spanned FROM loci""")
def _(loci):
    c = F.expr(CIGAR)
    return loci.select("el_id", sq.cigar_aligned(c).alias("aligned"), sq.cigar_reference(c).alias("spanned"))


@query("x17_sam_bins", "features", oracle="""SELECT feat_id, CASE WHEN s >> 14 = e >> 14 THEN 4681 + (s >> 14) WHEN s >> 17 = e >> 17 THEN 585 + (s >> 17) WHEN s >> 20 = e >> 20 THEN 73 + (s >> 20) WHEN s >> 23 = e >> 23 THEN 9 + (s >> 23) WHEN s >> 26 = e >> 26 THEN 1 + (s >> 26) ELSE 0 END AS bin FROM (SELECT feat_id, start * 1000 AS s, start * 1000 + ("end" - start) * 100 AS e FROM features)""")
def _(features):
    s = F.col("start") * 1000
    return features.select("feat_id", sq.sam_bin(s, s + (F.col("end") - F.col("start")) * 100 + 1).cast("long").alias("bin"))


def _psl(features):
    n = F.col("feat_id").cast("int")
    z = F.lit(0)
    return features.select((n % 90 + 10).alias("matches"), (n % 7).alias("mismatches"), (n % 5).alias("rep_matches"), z.alias("ncount"), (n % 3).alias("q_num_ins"), (n % 4).alias("q_base_ins"), (n % 2).alias("t_num_ins"), (n % 6).alias("t_base_ins"), F.col("strand"), F.concat(F.lit("q"), n.cast("string")).alias("q_name"), F.lit(200).alias("q_size"), z.alias("q_start"), (n % 90 + 20).alias("q_end"), F.col("chrom").alias("t_name"), F.lit(90000).alias("t_size"), F.col("start").alias("t_start"), (F.col("start") + n % 90 + 22).alias("t_end"), F.lit(1).alias("block_count"), F.array(n % 90 + 10).alias("block_sizes"), F.array(z).alias("q_starts"), F.array(F.col("start").cast("int")).alias("t_starts"))


@query("s15_k4_x18_psl_scores", "features", oracle="""SELECT q_name, t_name, score, millibad, CAST(floor(100.0 - millibad * 0.1) AS INTEGER) AS identity FROM (SELECT concat('q', CAST(n AS VARCHAR)) AS q_name, chrom AS t_name, m + floor(rep / 2.0) - mm - qi - ti AS score, CAST(floor(1000 * (mm + qi + round(3 * ln(1.0 + CASE WHEN qs - ts < 0 THEN 0 ELSE qs - ts END))) / (m + rep + mm)) AS BIGINT) AS millibad FROM
 (SELECT chrom, n, n % 90 + 10 AS m, n % 7 AS mm, n % 5 AS rep, n % 3 AS qi, n % 2 AS ti, n % 90 + 20 AS qs, n % 90 + 22 AS ts FROM (SELECT chrom, feat_id AS n FROM features)))""")
def _(features):
    p = rd.parse_psl(wr.psl(_psl(features)))
    bad = sq.psl_millibad(F.col("matches"), F.col("rep_matches"), F.col("mismatches"), F.col("q_num_ins"), F.col("t_num_ins"), F.col("q_end") - F.col("q_start"), F.col("t_end") - F.col("t_start"))
    score = sq.psl_score(F.col("matches"), F.col("rep_matches"), F.col("mismatches"), F.col("q_num_ins"), F.col("t_num_ins"))
    return p.select("q_name", "t_name", score.cast("double").alias("score"), bad.alias("millibad"), sq.psl_identity(bad).alias("identity"))


@query("f18_psl_acceptance", "features", oracle="""SELECT q_name FROM (SELECT concat('q', CAST(n AS VARCHAR)) AS q_name, n % 90 + 10 AS m, n % 90 + 10 + floor((n % 5) / 2.0) - n % 7 - n % 3 - n % 2 AS score FROM (SELECT feat_id AS n FROM features)) WHERE score >= 60 AND m >= 65""")
def _(features):
    from strandframe.operators.filters import psl

    p = rd.parse_psl(wr.psl(_psl(features)))
    score = sq.psl_score(F.col("matches"), F.col("rep_matches"), F.col("mismatches"), F.col("q_num_ins"), F.col("t_num_ins"))
    return psl(p.withColumn("score", score).withColumn("identity", F.lit(100)), 60, 0, 65).select("q_name")


@query("s16_blast_tab", "features", oracle="""SELECT CAST(feat_id AS VARCHAR) AS query, chrom, start, "end", strand FROM features""")
def _(features):
    lo, hi = (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string")
    plus = F.col("strand") == "+"
    line = F.concat_ws("\t", F.col("feat_id").cast("string"), "chrom", F.lit("98.5"), (F.col("end") - F.col("start") + 1).cast("string"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("9"), F.when(plus, lo).otherwise(hi), F.when(plus, hi).otherwise(lo), F.lit("1e-9"), F.lit("77.0"))
    return rd.parse_blast(features.select(line.alias("value"))).select("query", "chrom", "start", "end", "strand")


@query("s17_k10_maf_phylip", "reads", oracle="""SELECT concat(rpad(cultivar, 10, ' '), string_agg(substring(seq, 1, 12), '' ORDER BY read_id)) AS value FROM reads WHERE length(seq) >= 12 GROUP BY cultivar""")
def _(reads):
    rows = reads.where("length(seq) >= 12")
    blocks = wr.maf(rows.select(F.col("read_id").cast("double").alias("score"), F.array(F.struct(F.col("cultivar").alias("species"), F.lit("chr1").alias("chrom"), F.lit(0).cast("long").alias("ofs"), F.lit(12).cast("long").alias("len"), F.lit("+").alias("strand"), F.substring("seq", 1, 12).alias("seq"))).alias("rows")))
    parsed = rd.parse_maf(blocks).select(F.col("score").cast("long").alias("block_id"), F.inline("rows"))
    return wr.phylip(parsed)


@query("s18_s19_snp_csv", "snps", oracle="""SELECT concat('s', CAST(locus % 5 AS VARCHAR)) AS seq, locus AS loci, cov AS coverage, 'A' AS ref_base, cov - mm AS a, mm AS c FROM (SELECT locus, count(*) AS cov, count(*) FILTER (base <> 'A') AS mm FROM snps GROUP BY locus)""")
def _(snps):
    g = snps.groupBy("locus").agg(F.count(F.lit(1)).alias("cov"), F.sum((F.col("base") != "A").cast("long")).alias("mm"))
    f = [F.lit("x")] * 23
    f[3], f[4], f[9], f[10], f[11], f[12], f[13], f[14] = F.concat(F.lit('"s'), (F.col("locus") % 5).cast("string"), F.lit('"')), F.col("locus").cast("string"), F.lit("0.01"), F.col("cov").cast("string"), F.col("mm").cast("string"), F.lit('"a"'), F.lit("0"), F.col("mm").cast("string")
    return rd.parse_snp_csv(g.select(F.concat_ws(",", *f).alias("value"))).select("seq", "loci", "coverage", "ref_base", "a", "c")


@query("s21_obo_terms", "features", oracle="""SELECT concat('GO:', CAST(feat_id AS VARCHAR)) AS go_id, name, 'process' AS ontology, concat('GO:', CAST(feat_id // 2 AS VARCHAR), ' GO:', CAST(feat_id // 3 AS VARCHAR)) AS parents FROM features WHERE feat_id // 2 <> feat_id // 3""")
def _(features):
    f = features.where("feat_id div 2 <> feat_id div 3")
    text = F.concat(F.lit("[Term]\nid: GO:"), F.col("feat_id").cast("string"), F.lit("\nname: "), F.col("name"), F.lit("\nnamespace: process\nis_a: GO:"), F.expr("feat_id div 2").cast("string"), F.lit(" ! x\nrelationship: part_of GO:"), F.expr("feat_id div 3").cast("string"), F.lit(" ! y"))
    return rd.parse_obo(f.select(text.alias("value"))).withColumn("parents", F.array_join("parents", " "))


@query("s22_j26_associations", "features", oracle="SELECT name AS gene, concat('GO:', CAST(score AS VARCHAR)) AS go_id, 'P' AS aspect, 'IEA' AS evidence FROM features")
def _(features):
    e = F.lit("")
    line = F.concat_ws("\t", F.lit("db"), F.lit("id"), "name", F.lit("q"), F.concat(F.lit("GO:"), F.col("score").cast("string")), F.lit("r"), F.lit("IEA"), e, F.lit("P"), e)
    return rd.parse_associations(features.select(line.alias("value"))).select("gene", "go_id", "aspect", "evidence")


@query("s23_gene_filter_list", "features", oracle="SELECT feat_id FROM features WHERE lower(name) IN (SELECT lower(name) FROM features WHERE score < 100)")
def _(features):
    keep = features.where("score < 100").select(F.lower("name").alias("k")).distinct()
    return features.withColumn("k", F.lower("name")).join(keep, "k", "left_semi").select("feat_id")


def _agp(reads):
    piece = reads.where("length(seq) BETWEEN 1 AND 500").select("read_id", F.length("seq").alias("n"), (F.col("read_id") % 7).alias("o"))
    gap = F.concat_ws("\t", F.concat(F.lit("obj"), F.col("o").cast("string")), F.lit("1"), F.lit("10"), (F.col("read_id") * 2 + 1).cast("string"), F.lit("N"), F.lit("10"), F.lit("fragment"), F.lit("yes"))
    part = F.concat_ws("\t", F.concat(F.lit("obj"), F.col("o").cast("string")), F.lit("1"), F.lit("1"), (F.col("read_id") * 2).cast("string"), F.lit("W"), F.col("read_id").cast("string"), F.lit("1"), F.col("n").cast("string"), F.when(F.col("read_id") % 2 == 0, "+").otherwise("-"))
    return piece.select(F.explode(F.array(part, gap)).alias("value"))


@query("s24_t17_agp_assembly", "reads", oracle="""SELECT concat('obj', CAST(read_id % 7 AS VARCHAR)) AS object, string_agg(concat(CASE WHEN read_id % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END, 'NNNNNNNNNN'), '' ORDER BY read_id) AS seq FROM reads WHERE length(seq) BETWEEN 1 AND 500 GROUP BY 1""")
def _(reads):
    agp = rd.parse_agp(_agp(reads))
    comp = reads.select(F.col("read_id").cast("string").alias("comp_id"), F.col("seq").alias("_seq"))
    piece = F.substring("_seq", F.col("comp_start") + 1, F.col("comp_end") - F.col("comp_start") + 1)
    text = F.when(F.col("is_gap"), F.repeat(F.lit("N"), F.col("gap_len").cast("int"))).when(F.col("orientation") == "-", sq.reverse_complement(piece)).otherwise(piece)
    parts = agp.join(comp, "comp_id", "left").select("object", "part", text.alias("text"))
    return parts.groupBy("object").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("seq"))


@query("s27_contaminants", "features", oracle="""SELECT concat('c', CAST(feat_id AS VARCHAR)) AS name, CAST(CASE feat_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_overlays, feat_id % 3 = 2 AS is_vector FROM features""")
def _(features):
    name = F.concat(F.lit("c"), F.col("feat_id").cast("string"), F.when(F.col("feat_id") % 3 == 0, "").when(F.col("feat_id") % 3 == 1, "@14").otherwise("&1"))
    fa = features.select(F.concat(F.lit(">"), name, F.lit(" d\nacgt\nTTT")).alias("value"))
    return rd.parse_contaminants(rd.parse_fasta(fa)).select("name", F.size("overlays").alias("n_overlays"), "is_vector")


@query("s28_f17_loci_constraints", "reads", oracle="""SELECT read_id AS el_id FROM reads WHERE length(seq) > 30 AND read_id % 40 <= 10 AND (substring(seq, 11 - read_id % 40, 1) IN ('A', 'C')) UNION ALL SELECT read_id FROM reads WHERE length(seq) > 30 AND read_id % 40 > 10""")
def _(reads):
    from strandframe.operators.filters import constrained

    al = reads.where("length(seq) > 30").select(F.col("read_id").alias("el_id"), F.lit("chr1").alias("chrom"), (F.col("read_id") % 40).alias("start"), F.col("seq"), F.translate("seq", "ACGT", "CCTT").alias("ref_seq")).withColumn("end", F.col("start") + F.length("seq") - 1)
    lines = reads.sparkSession.range(1).select(F.lit('"chr1",10,10,"AC"').alias("value"))
    return constrained(al, rd.parse_constraints(lines)).select("el_id")


@query("k5_wiggle_bedgraph", "sparse", oracle="""SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), CAST(nxt AS VARCHAR), CAST(d AS VARCHAR)) AS value FROM (SELECT chrom, pos, lead(pos) OVER w AS nxt, CAST(sum(d) OVER w AS BIGINT) AS d FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM sparse UNION ALL SELECT chrom, "end" + 1, -1 FROM sparse) GROUP BY chrom, pos) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE nxt IS NOT NULL AND d <> 0""")
def _(loci):
    from strandframe.operators.intervals import depth

    return wr.bedgraph(depth(loci))


@query("k7_star_schema", "snps", oracle="SELECT cultivar, count(*) AS n FROM snps GROUP BY cultivar")
def _(snps):
    t = wr.star_schema(snps, {"cultivar": ["cultivar"], "locus": ["locus"]})
    return t["fact"].join(t["cultivar"], "cultivar_id").groupBy("cultivar").agg(F.count(F.lit(1)).alias("n"))


@query("k8_graph_dump", "edges", oracle="""SELECT concat('<edge source="', CAST(a AS VARCHAR), '" target="', CAST(b AS VARCHAR), '" />') AS value FROM edges""")
def _(edges):
    return wr.graphml_edges(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


@query("k11_split_by_size", "reads", oracle="SELECT read_id, CAST((sum(length(seq)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) - length(seq)) // 20000 AS BIGINT) AS file FROM reads")
def _(reads):
    return wr.split_by_size(reads.withColumn("n", F.length("seq").cast("long")), "n", 20000).select("read_id", "file")


@query("x30_xml_safe", "features", oracle="SELECT feat_id, replace(replace(replace(concat(name, '<&>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM features")
def _(features):
    return features.select("feat_id", sq.xml_safe(F.concat("name", F.lit("<&>"))).alias("safe"))


@query("x22_x24_names", "features", oracle="SELECT feat_id, name AS bare, name AS gene FROM features")
def _(features):
    return features.select("feat_id", sq.unquoted(F.concat(F.lit(" '"), "name", F.lit("' "))).alias("bare"), sq.isoform_trimmed(F.concat("name", F.lit("."), (F.col("feat_id") % 90).cast("string"))).alias("gene"))
