"""Queries of the remaining scalar functions, long-read operators and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import random as rn
from strandframe.functions import sequence as sq
from strandframe.operators import longread as lr
from strandframe.sources import readers as rd

from .shapes import shape, sql

Q: dict = {}
SQL: dict = {}


def query(name: str, *shapes: str, oracle: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(*[shape(spark, sf_dir, s) for s in shapes])
        if oracle:
            head = sql(*shapes).rstrip()
            SQL[name] = head + (",\n" + oracle[5:] if oracle.startswith("WITH ") else "\n" + oracle)
        return f

    return add


@query("j13_micro_indels", "reads", oracle="""WITH p AS (SELECT read_id AS probe_id, substring(seq, 21, 12) AS a, substring(seq, 38, 12) AS b FROM reads WHERE length(seq) >= 80 AND read_id % 20 = 0), w AS (SELECT read_id, i - 1 AS pos, substring(seq, i, 12) AS k FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 11, 0) AS BIGINT) + 1)) AS i FROM reads)),
l AS (SELECT probe_id, read_id, pos FROM p JOIN w ON k = a), r AS (SELECT probe_id, read_id, pos FROM p JOIN w ON k = b)
SELECT probe_id, read_id, CAST(l.pos AS INTEGER) AS ofs, CAST(r.pos - l.pos - 12 AS INTEGER) AS shift FROM l JOIN r USING (probe_id, read_id) WHERE r.pos > l.pos AND r.pos - l.pos - 12 <> 0 AND abs(r.pos - l.pos - 12) <= 20""")
def _(reads):
    probes = reads.where("length(seq) >= 80 AND read_id % 20 = 0").select(F.col("read_id").alias("probe_id"), F.concat(F.substring("seq", 21, 12), F.substring("seq", 38, 12)).alias("probe"))
    return lr.micro_indels(probes, reads, 12)


@query("j15_chimeric_trim", "reads")
def _(reads):
    pairs = reads.where("length(seq) >= 60").select("read_id", "seq", F.expr("concat(substring(seq, 1, length(seq) * 3 div 4), reverse(substring(seq, 1 + length(seq) * 3 div 4)))").alias("ref_seq"))
    return lr.chimeric(pairs).select("read_id", "start", "len")


@query("x32_hairpin_passes", "reads", oracle="SELECT read_id, seq AS first, CAST(2 AS INTEGER) AS n FROM reads WHERE length(seq) >= 30")
def _(reads):
    adaptor = "NNGGCCNNGGCCNNGGCC"
    two = reads.where("length(seq) >= 30").select("read_id", F.concat("seq", F.lit(adaptor), sq.reverse_complement(F.col("seq"))).alias("seq"))
    return lr.hairpins(two, adaptor, 1).select("read_id", F.get("passes", F.lit(0)).alias("first"), F.size("passes").alias("n"))


@query("x9_structural_alignment", "reads")
def _(reads):
    return lr.value_alignment(reads.select("read_id", F.col("seq").alias("a"), F.expr("substring(seq, 6)").alias("b"))).select("read_id", "score")


@query("t23_dyad_scan", "reads", oracle="""WITH v AS (SELECT read_id, CAST(i - 1 AS INTEGER) AS pos, strpos('ACGT', substring(seq, CAST(i AS BIGINT), 1)) * 1.0::DOUBLE AS value FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq), 0) AS BIGINT) + 1)) AS i FROM reads)), s AS (SELECT *, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS around FROM v WINDOW w AS (PARTITION BY read_id ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT read_id, pos, value, around FROM s WHERE around > 0 AND value >= 1.5 * around""")
def _(reads):
    v = reads.where("length(seq) > 1").select("read_id", F.posexplode(F.split("seq", "")).alias("pos", "b")).where("b <> ''").select("read_id", "pos", (F.when(F.col("b") == "A", 1).when(F.col("b") == "C", 2).when(F.col("b") == "G", 3).otherwise(4)).cast("double").alias("value"))
    return lr.dyads(v, 5, 1.5)


@query("x20_quality_dialect", "quals", oracle="SELECT CASE WHEN lo < 59 THEN 4 WHEN lo < 64 THEN 1 WHEN lo < 66 THEN 2 ELSE 3 END AS dialect FROM (SELECT min(list_min(list_transform(range(1, length(qual) + 1), lambda i: ascii(substring(qual, i, 1))))) AS lo FROM quals)")
def _(quals):
    return rd.phred_dialect(quals)


@query("x21_name_hash", "features", oracle="SELECT feat_id, CASE h16 WHEN 0 THEN 19937 ELSE h16 END AS h16, CASE h24 WHEN 0 THEN 1 ELSE h24 END AS h24 FROM (SELECT feat_id, list_reduce(list_prepend(CAST(19937 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substring(lower(name), i, 1)) AS BIGINT))), lambda h, c: xor(((xor(h, c) * 3119) & 4294967295) - CASE WHEN ((xor(h, c) * 3119) & 2147483648) <> 0 THEN 4294967296 ELSE 0 END, (((xor(h, c) * 3119) & 4294967295) - CASE WHEN ((xor(h, c) * 3119) & 2147483648) <> 0 THEN 4294967296 ELSE 0 END) >> 13) & 65535) AS h16, list_reduce(list_prepend(CAST(37199 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substring(lower(name), i, 1)) AS BIGINT))), lambda h, c: xor(((xor(h, c) * 19937) & 4294967295) - CASE WHEN ((xor(h, c) * 19937) & 2147483648) <> 0 THEN 4294967296 ELSE 0 END, (((xor(h, c) * 19937) & 4294967295) - CASE WHEN ((xor(h, c) * 19937) & 2147483648) <> 0 THEN 4294967296 ELSE 0 END) >> 21) & 16777215) AS h24 FROM features)")
def _(features):
    return features.select("feat_id", sq.name_hash(F.col("name"), 16).alias("h16"), sq.name_hash(F.col("name"), 24).alias("h24"))


@query("f20_field_projection", "features", oracle="SELECT concat(chr(34), name, ', ', chr(34), chr(34), 'x', chr(34), chr(34), chr(34), ',', CAST(feat_id AS VARCHAR), ',', CAST(score AS VARCHAR)) AS value FROM features")
def _(features):
    from strandframe.operators.filters import fields

    line = F.concat_ws(",", F.col("feat_id").cast("string"), F.col("chrom"), F.concat(F.lit('"'), "name", F.lit(', ""x"""')), F.col("score").cast("string"), F.lit(""))
    return fields(features.select(line.alias("value")), [3, 1, 4, 9])


@query("j9_chrom_lookup", "loci", "features", oracle="""WITH i AS (SELECT name, row_number() OVER (ORDER BY name) AS chrom_id FROM (SELECT DISTINCT lower(chrom) AS name FROM features WHERE chrom <> 'chr5')) SELECT el_id, CAST(chrom_id AS INTEGER) AS chrom_id FROM loci LEFT JOIN i ON name = lower(chrom)""")
def _(loci, features):
    from strandframe.operators.features import chrom_ids, with_chrom_id

    return with_chrom_id(loci.withColumn("chrom", F.upper("chrom")), chrom_ids(features.where("chrom <> 'chr5'"))).select("el_id", "chrom_id")


@query("j9_ith_feature", "features", oracle="""SELECT chrom, CAST(n AS BIGINT) AS ith, feat_id FROM (SELECT chrom, feat_id, row_number() OVER (PARTITION BY chrom ORDER BY start, "end", feat_id) AS n FROM features) WHERE n IN (1, 7, 50)""")
def _(features):
    from strandframe.operators.features import ith_features

    wanted = features.select("chrom").distinct().withColumn("ith", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 7, 50, 10**9)])))
    return ith_features(features, wanted).select("chrom", "ith", "feat_id")


@query("x23_common_subsequences", "reads", oracle="SELECT read_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(translate(replace(seq, 'A', '1'), 'CGT', '000'), '1+'), lambda x: length(x))), 0) AS INTEGER) AS longest FROM reads")
def _(reads):
    same = F.transform(F.filter(F.split("seq", ""), lambda b: b != ""), lambda b: b == "A")
    return reads.select("read_id", F.coalesce(F.array_max(sq.windows_in_common(same)), F.lit(0)).alias("longest"))


def _u(seed: int, draw: int, key: str = "feat_id") -> str:
    """The uniform draw of functions.random in SQL."""
    return f"((CAST('0x' || substring(md5('{seed}:{draw}:' || {key}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


def _e(seed: int, draw: int) -> str:
    return f"(-ln({_u(seed, draw)}))"


def _z(seed: int) -> str:
    return f"(sqrt(-2 * ln({_u(seed, 1)})) * cos(2 * pi() * {_u(seed, 2)}))"


def _g(shape: int, seed: int = 0) -> str:
    return "(" + " + ".join(_e(seed, 10 + i) for i in range(shape)) + ")"


@query("x28_random_draws", "features", oracle=f"""SELECT feat_id, {_u(0, 0)} AS u, {_z(0)} AS z, {_e(0, 0)} AS e, {_g(3)} AS g, {_g(2)} / ({_g(2)} + {_g(3, 1)}) AS b, {_z(0)} / sqrt(2 * {_g(2, 7)} / 4) AS t,
 CAST(len(list_filter(list_transform(range(34), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(i * ln(4.0) - lgamma(i + 1) - 4.0)))), lambda x: x < {_u(0, 3)})) AS INTEGER) AS p FROM features""")
def _(features):
    k = F.col("feat_id")
    return features.select("feat_id", rn.uniform(k).alias("u"), rn.normal(k).alias("z"), rn.exponential(k).alias("e"), rn.gamma(k, 3).alias("g"), rn.beta(k, 2, 3).alias("b"), rn.student_t(k, 4).alias("t"), rn.poisson(k, 4.0).alias("p"))


@query("s4_size_estimate", "reads", oracle=f"SELECT CAST(floor(count(*) / 0.5) AS BIGINT) AS n, avg(length(seq)) AS mean, CAST(max(length(seq)) AS INTEGER) AS longest FROM reads WHERE {_u(1, 0, 'read_id')} < 0.5")
def _(reads):
    return lr.size_estimate(reads, 0.5)


@query("s9_s12_core_elements", "features", oracle='SELECT feat_id AS el_id, chrom, start, "end" FROM features WHERE "end" - start + 1 >= 300')
def _(features):
    line = F.concat_ws(",", F.col("feat_id").cast("string"), F.lit('"core"'), F.lit('"sp"'), F.concat(F.lit('"'), "chrom", F.lit('"')), F.col("start").cast("string"), F.col("end").cast("string"), (F.col("end") - F.col("start") + 1).cast("string"))
    return rd.parse_csv_loci(features.select(line.alias("value")), 300).select("el_id", "chrom", "start", "end")


@query("s20_read_starts", "loci", oracle="""SELECT chrom, CASE WHEN strand = '+' THEN start ELSE "end" END AS pos, strand, count(*) AS n FROM loci GROUP BY ALL""")
def _(loci):
    return loci.groupBy("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("pos"), "strand").agg(F.count(F.lit(1)).alias("n"))


@query("a19_kmers_by_offset", "reads", oracle="SELECT k, ofs, count(DISTINCT kmer) AS kinds, count(*) AS n FROM (SELECT k, i - 1 AS ofs, substring(seq, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS kmer FROM reads, range(1, 31) AS r(i), range(1, 5) AS q(k) WHERE i <= length(seq) - k + 1) GROUP BY k, ofs")
def _(reads):
    out = None
    for k in (1, 2, 3, 4):
        part = reads.select(F.lit(k).cast("long").alias("k"), F.posexplode(sq.kmers(F.substring("seq", 1, 29 + k), k)).alias("ofs", "kmer"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("k", F.col("ofs").cast("long").alias("ofs")).agg(F.count_distinct("kmer").alias("kinds"), F.count(F.lit(1)).alias("n"))


@query("t3_extended_markers", "reads", oracle="WITH w AS (SELECT read_id, i - 1 AS ofs, substring(seq, CAST(i AS BIGINT), 8) AS k FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 7, 0) AS BIGINT) + 1)) AS i FROM reads)), u AS (SELECT k FROM w GROUP BY k HAVING count(*) = 1), m AS (SELECT read_id, ofs, ofs - row_number() OVER (PARTITION BY read_id ORDER BY ofs) AS g FROM w WHERE k IN (SELECT k FROM u)) SELECT read_id, CAST(min(ofs) AS INTEGER) AS ofs, count(*) AS n FROM m GROUP BY read_id, g")
def _(reads):
    from strandframe.operators.kmers import extended_markers, kmer_table

    w = kmer_table(reads, "read_id", 8).select("read_id", "ofs", "kmer")
    unique = w.groupBy("kmer").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("kmer")
    return extended_markers(w.join(unique, "kmer", "left_semi"))


@query("t5_snp_variants", "reads", oracle="WITH m AS (SELECT read_id AS seq_id, substring(seq, 11, 21) AS marker FROM reads WHERE length(seq) > 40) SELECT seq_id, alt, concat(substring(marker, 1, 10), alt, substring(marker, 12)) AS variant FROM m, (VALUES ('A'), ('C'), ('G'), ('T')) AS v(alt) WHERE alt <> substring(marker, 11, 1)")
def _(reads):
    from strandframe.operators.variants import marker_sequences, snp_variants

    loci = reads.where("length(seq) > 40").select(F.col("read_id").alias("seq_id"), F.lit(20).alias("locus"))
    return snp_variants(marker_sequences(loci, reads.withColumnRenamed("read_id", "seq_id"), 10, 10, 0, 5)).select("seq_id", "alt", "variant")


@query("k3_bin_index", "features", oracle="""SELECT chrom, 4681 + (start >> 14) AS bin, count(*) AS n, min(start) AS first FROM features WHERE start >> 14 = "end" >> 14 GROUP BY 1, 2""")
def _(features):
    from strandframe.sources.writers import sam_index

    return sam_index(features.where("start div 16384 = `end` div 16384"))


@query("w11_percentile_bounds", "loci", oracle='SELECT sample, quantile_cont("end" - start, 0.5) AS median, quantile_cont("end" - start, 0.025) AS low, quantile_cont("end" - start, 0.975) AS high FROM loci GROUP BY sample')
def _(loci):
    size = F.col("end") - F.col("start")
    return loci.groupBy("sample").agg(F.percentile(size, F.lit(0.5)).alias("median"), F.percentile(size, F.lit(0.025)).alias("low"), F.percentile(size, F.lit(0.975)).alias("high"))


@query("o5_marker_order", "snps", oracle="SELECT locus, count(DISTINCT cultivar) AS cultivars, count(*) AS n FROM snps GROUP BY locus ORDER BY cultivars DESC, n DESC, locus LIMIT 25")
def _(snps):
    return snps.groupBy("locus").agg(F.count_distinct("cultivar").alias("cultivars"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("cultivars"), F.desc("n"), "locus").limit(25)

