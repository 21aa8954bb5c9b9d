"""Queries of the sequence functions and read statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.operators import reads as rd

from .shapes import shape, sql

Q: dict = {}
SQL: dict = {}


def query(name: str, *shapes: str, oracle: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(*[shape(spark, sf_dir, s) for s in shapes])
        if oracle:
            head = sql(*shapes)
            SQL[name] = head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + oracle[15:] if oracle.startswith("WITH RECURSIVE ") else head + oracle
        return f

    return add


def columns(name: str, shape_name: str, key: str, oracle: dict[str, str], make) -> None:
    """A projection query: Spark columns and their SQL, by alias."""
    where = oracle.pop("_where", None)

    @query(name, shape_name, oracle=f"SELECT {key}, " + ", ".join(f"{v} AS {k}" for k, v in oracle.items()) + f" FROM {shape_name}" + (f" WHERE {where}" if where else ""))
    def _(df):
        return (df.where(where) if where else df).select(key, *[c.alias(k) for k, c in make().items()])


RC = "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))"
KMERS = "list_transform(range(1, CAST(greatest(length({s}) - {k} + 2, 1) AS BIGINT)), lambda i: substring({s}, i, {k}))"

columns("x1_reverse_complement", "reads", "read_id", {"rc": RC, "comp": "translate(seq, 'ACGTacgt', 'TGCAtgca')", "rev": "reverse(seq)"}, lambda: dict(rc=sq.reverse_complement(F.col("seq")), comp=sq.complement(F.col("seq")), rev=F.reverse(F.col("seq"))))
columns("x2_base_maps", "reads", "read_id", {"lowered": "lower(seq)", "masked": "CAST(len(regexp_extract_all(lower(seq), '[acgtn]')) AS INTEGER)", "raised": "upper(lower(seq))"}, lambda: dict(lowered=F.lower(F.col("seq")), masked=sq.masked_bases(F.lower(F.col("seq"))), raised=sq.unmasked(F.lower(F.col("seq")))))
columns("x3_kmer_codes", "reads", "read_id", {"code": "CASE WHEN length(seq) < 8 THEN -1 ELSE CAST(list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: strpos('ACGT', substring(seq, i, 1)) - 1)), lambda a, b: a * 4 + b) AS BIGINT) END", "back": "CASE WHEN length(seq) >= 8 THEN substring(seq, 1, 8) END"}, lambda: dict(code=F.when(F.length(F.col("seq")) < 8, F.lit(-1).cast("long")).otherwise(sq.kmer_code(F.substring(F.col("seq"), 1, 8))), back=F.when(F.length(F.col("seq")) >= 8, sq.kmer_from_code(sq.kmer_code(F.substring(F.col("seq"), 1, 8)), 8))))
columns("x4_hamming_distance", "reads", "read_id", {"d": f"hamming(seq, {RC})", "_where": "length(seq) > 0"}, lambda: dict(d=sq.hamming(F.col("seq"), sq.reverse_complement(F.col("seq")))))
columns("x5_levenshtein", "reads", "read_id", {"d": "CAST(levenshtein(seq, substring(seq, 11)) AS INTEGER)"}, lambda: dict(d=F.levenshtein(F.col("seq"), F.expr("substring(seq, 11)"))))
columns("x19_phred_error_free", "quals", "read_id", {"p": "list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, length(qual) + 1), lambda i: 1 - pow(10.0, -(ascii(substring(qual, i, 1)) - 33) / 10.0))), lambda a, b: a * b)", "total": "CAST(coalesce(list_sum(list_transform(range(1, length(qual) + 1), lambda i: ascii(substring(qual, i, 1)) - 33)), 0) AS INTEGER)", "_where": "length(seq) BETWEEN 1 AND 400"}, lambda: dict(p=sq.error_free(F.col("qual")), total=F.aggregate(sq.phred(F.col("qual")), F.lit(0), lambda a, x: a + x)))
columns("x26_bisulfite_collapse", "reads", "read_id", {"plus": "translate(seq, 'C', 'T')", "minus": "translate(seq, 'G', 'A')"}, lambda: dict(plus=sq.bisulfite(F.col("seq")), minus=sq.bisulfite(F.col("seq"), "-")))
columns("x31_homopolymer_reduction", "reads", "read_id", {"reduced": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')", "longest": "CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS INTEGER)"}, lambda: dict(reduced=sq.homopolymer_reduced(F.col("seq")), longest=sq.longest_homopolymer(F.col("seq"))))
columns("f11_indeterminate_filter", "reads", "read_id", {"n_gap": "CAST(len(regexp_extract_all(replace(seq, 'GA', 'NN'), '[Nn]')) AS INTEGER)", "clipped": "regexp_replace(replace(seq, 'GA', 'NN'), 'N{3,}', 'NN', 'g')", "_where": "length(seq) > 20"}, lambda: dict(n_gap=sq.count_n(F.replace(F.col("seq"), F.lit("GA"), F.lit("NN"))), clipped=F.regexp_replace(F.replace(F.col("seq"), F.lit("GA"), F.lit("NN")), "N{3,}", "NN")))
columns("f12_end_trim", "reads", "read_id", {"trimmed": "CASE WHEN length(seq) > 8 THEN substring(seq, 6, length(seq) - 8) ELSE '' END", "_where": "length(seq) >= 5"}, lambda: dict(trimmed=sq.trimmed(F.col("seq"), 5, 3)))
columns("f15_low_complexity", "reads", "read_id", {"score": "greatest(0, 3 - " + " - ".join(f"(CASE WHEN len(regexp_extract_all(seq, '{b}')) * 10 < length(seq) THEN 1 ELSE 0 END)" for b in "ACGT") + ")"}, lambda: dict(score=sq.low_complexity(F.col("seq"))))
columns("f10_mean_phred_filter", "quals", "read_id", {"passes": "length(qual) > 0 AND NOT coalesce(list_min(list_transform(range(1, length(qual) + 1), lambda i: ascii(substring(qual, i, 1)) - 33)) < 10, false) AND (1 + coalesce(list_sum(list_transform(range(1, length(qual) + 1), lambda i: ascii(substring(qual, i, 1)) - 33)), 0)) * 1.0::DOUBLE / length(qual) >= 25"}, lambda: dict(passes=sq.mean_phred_passes(F.col("qual"), 25)))


@query("x25_colour_space", "reads", oracle="SELECT read_id, seq AS restored FROM reads WHERE length(seq) >= 2")
def _(reads):
    return reads.where("length(seq) >= 2").select("read_id", sq.from_colour_space(sq.colour_space(F.col("seq"))).alias("restored"))


@query("x27_composition_shuffle", "reads", oracle="SELECT read_id, " + ", ".join(f"CAST(len(regexp_extract_all(seq, '{b}')) AS INTEGER) AS {b.lower()}" for b in "ACGT") + ", CAST(length(seq) AS INTEGER) AS len FROM reads WHERE length(seq) < 600")
def _(reads):
    df = reads.where("length(seq) < 600").withColumn("s", rd.shuffled(F.col("seq"), F.col("read_id")))
    return df.select("read_id", *[F.regexp_count("s", F.lit(b)).alias(b.lower()) for b in "ACGT"], F.length("s").alias("len"))


PARTS = 16


def _embedding_pairs(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    b = v.select("vec_id", "label", bits.alias("bits"))
    other = b.select(F.col("vec_id").alias("other"), "label", F.col("bits").alias("obits"))
    # compared within a label only; a label's pairs are dealt over PARTS x PARTS tasks, each row copied PARTS times
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    left = b.withColumn("_i", own("vec_id")).withColumn("_j", every)
    right = other.withColumn("_j", own("other")).withColumn("_i", every)
    return left.join(right, ["label", "_i", "_j"]).where("vec_id < other").select("vec_id", "other", sq.bit_hamming(F.col("bits"), F.col("obits")).cast("int").alias("d"))


Q["x4_bit_hamming"] = _embedding_pairs
SQL["x4_bit_hamming"] = """SELECT a.vec_id, b.vec_id AS other, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS d
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"""


@query("f13_every_nth", "reads", oracle="SELECT read_id FROM (SELECT read_id, row_number() OVER (ORDER BY read_id) AS n FROM reads) WHERE n % 7 = 0")
def _(reads):
    return rd.nth_records(reads, 7, "read_id").select("read_id")


def _features_like(spark, sf_dir):
    return shape(spark, sf_dir, "features").where(F.substring_index("name", " ", 1).rlike("[02468]$")).select("feat_id", "name")


Q["f14_descriptor_extract"] = _features_like
SQL["f14_descriptor_extract"] = sql("features") + "SELECT feat_id, name FROM features WHERE regexp_matches(split_part(name, ' ', 1), '[02468]$')"


@query("f1_chrom_include_exclude", "loci", oracle="SELECT chrom, count(*) AS n FROM loci WHERE NOT regexp_matches(chrom, '[45]$') AND regexp_matches(chrom, '^chr[0-4]$') GROUP BY chrom")
def _(loci):
    from strandframe.operators.filters import chroms

    return chroms(loci, include=["^chr[0-4]$"], exclude=["[45]$"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("f2_f3_f4_range_strand_score", "features", oracle="""SELECT feat_id FROM features WHERE "end" - start + 1 BETWEEN 200 AND 600 AND strand = '-' AND score BETWEEN 100 AND 800""")
def _(features):
    from strandframe.operators.filters import elements

    return elements(features, length=(200, 600), strand="-", score=(100, 800)).select("feat_id")


@query("f5_flag_filter", "features", oracle="SELECT feat_id FROM features WHERE (score & 6) = 6 AND (score & 8) = 0")
def _(features):
    from strandframe.operators.filters import flags

    return flags(features, "score", required=6, forbidden=8).select("feat_id")


@query("f6_refid_lists", "features", "sparse", oracle="SELECT feat_id FROM features WHERE feat_id IN (SELECT el_id % 2000 FROM sparse) AND feat_id NOT IN (SELECT el_id % 1999 FROM sparse WHERE start < 60000)")
def _(features, loci):
    from strandframe.operators.filters import listed

    return listed(features, "feat_id", loci.select((F.col("el_id") % 2000).alias("feat_id")), loci.where("start < 60000").select((F.col("el_id") % 1999).alias("feat_id"))).select("feat_id")


@query("f9_filter_with_reasons", "loci", oracle="""SELECT r AS reasons, count(*) AS n FROM (SELECT (CASE WHEN "end" - start + 1 < 10 THEN 1 ELSE 0 END) + (CASE WHEN strand <> '+' THEN 2 ELSE 0 END) + (CASE WHEN sample = 'R' THEN 4 ELSE 0 END)
 + (CASE WHEN coalesce(max("end") OVER (PARTITION BY chrom ORDER BY start, "end", el_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start, false) OR coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start, "end", el_id) <= "end", false) THEN 8 ELSE 0 END) AS r FROM loci) GROUP BY r""")
def _(loci):
    w = Window.partitionBy("chrom").orderBy("start", "end", "el_id")
    over = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(w) <= F.col("end"), F.lit(False))
    df = loci.withColumn("_over", over)
    size = F.col("end") - F.col("start") + 1
    return rd.filtered_with_reasons(df, {"short": size < 10, "strand": F.col("strand") != "+", "sample": F.col("sample") == "R", "overlap": F.col("_over")}).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("f19_greedy_non_overlapping", "sparse", oracle="""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, "end", el_id) AS rn FROM sparse), g AS (SELECT el_id, chrom, start, "end", rn, "end" AS reached, true AS kept FROM o WHERE rn = 1
 UNION ALL SELECT o.el_id, o.chrom, o.start, o."end", o.rn, CASE WHEN o.start > g.reached THEN o."end" ELSE g.reached END, o.start > g.reached FROM g JOIN o ON o.chrom = g.chrom AND o.rn = g.rn + 1) SELECT el_id, chrom, start, "end" FROM g WHERE kept""")
def _(loci):
    from strandframe.operators.intervals import greedy_non_overlapping

    return greedy_non_overlapping(loci).select("el_id", "chrom", "start", "end")


@query("f16_duplicate_start_cap", "loci", oracle="SELECT el_id FROM (SELECT el_id, row_number() OVER (PARTITION BY chrom, strand, start // 5 ORDER BY start, el_id) AS n FROM loci) WHERE n <= 2")
def _(loci):
    from strandframe.operators.filters import start_cap

    return start_cap(loci, 5, 2).select("el_id")


@query("a16_nxx_lengths", "reads", oracle="""SELECT i * 10 AS n_percent, max(len) AS n_length FROM (SELECT length(seq) AS len, sum(length(seq)) OVER (ORDER BY length(seq) DESC, read_id ROWS UNBOUNDED PRECEDING) AS s, sum(length(seq)) OVER () AS t FROM reads WHERE length(seq) > 0), range(1, 11) AS r(i) WHERE s >= (t * i) // 10 GROUP BY i""")
def _(reads):
    return rd.length_statistics(reads, F.length("seq"))


@query("a17_length_histogram", "reads", oracle="SELECT least(length(seq) // 100, 20) AS bin, count(*) AS n FROM reads GROUP BY 1")
def _(reads):
    return rd.length_histogram(reads, F.length("seq"), 100, 20)


def _pos(k: int, most: int) -> str:
    return f"SELECT ofs, kmer, n, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY ofs) AS share FROM (SELECT i - 1 AS ofs, substring(seq, CAST(i AS BIGINT), {k}) AS kmer, count(*) AS n FROM reads, range(1, {most + 1}) AS r(i) WHERE i <= length(seq) - {k} + 1 GROUP BY 1, 2)"


for _k in (1, 2, 3, 4):

    def _positional(reads, k=_k):
        return rd.positional_kmers(reads, k, 100)

    query(f"a18_positional_{_k}mers", "reads", oracle=_pos(_k, 100))(_positional)


@query("a20_kmer_concordance", "reads", oracle="""SELECT ofs, (sxy - mx * sy - my * sx + 16 * mx * my) / greatest(sqrt((sxx - 2 * mx * sx + 16 * mx * mx) * (syy - 2 * my * sy + 16 * my * my)), 1e-6) AS r FROM (SELECT ofs, sx, sxx, sxy, sy, syy, (sx + 16) / 16.0::DOUBLE AS mx, (sy + 16) / 16.0::DOUBLE AS my FROM
 (SELECT c.ofs, sum(c.n) AS sx, sum(c.n * c.n) AS sxx, sum(c.n * coalesce(g.n, 0)) AS sxy FROM c LEFT JOIN (SELECT * FROM c WHERE ofs = 33) g ON g.kmer = c.kmer GROUP BY c.ofs), (SELECT sum(n) AS sy, sum(n * n) AS syy FROM c WHERE ofs = 33))""")
def _(reads):
    return rd.kmer_concordance(reads, 2, 100)


SQL["a20_kmer_concordance"] = SQL["a20_kmer_concordance"].replace("\nSELECT ofs, (sxy", ", c AS (SELECT i - 1 AS ofs, substring(seq, CAST(i AS BIGINT), 2) AS kmer, count(*) AS n FROM reads, range(1, 101) AS r(i) WHERE i <= length(seq) - 1 GROUP BY 1, 2)\nSELECT ofs, (sxy", 1)


@query("a21_phred_by_offset", "quals", oracle="SELECT i - 1 AS ofs, least(greatest(ascii(substring(qual, CAST(i AS BIGINT), 1)) - 33, 0), 41) AS score, count(*) AS n FROM (SELECT *, unnest(range(1, CAST(greatest(length(qual), 0) AS BIGINT) + 1)) AS i FROM quals) GROUP BY 1, 2")
def _(quals):
    return rd.quality_distribution(quals)


@query("a21_error_free_histogram", "quals", oracle="SELECT least(CAST(floor(list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, length(qual) + 1), lambda i: 1 - pow(10.0, -(ascii(substring(qual, i, 1)) - 33) / 10.0))), lambda a, b: a * b) * 100) AS INTEGER), 99) AS bin, count(*) AS n FROM quals GROUP BY 1")
def _(quals):
    return rd.error_free_histogram(quals)


@query("a22_duplicate_distribution", "reads", oracle=f"SELECT instances, count(*) AS sequences FROM (SELECT least(seq, {RC}) AS k, count(*) AS instances FROM reads GROUP BY 1) GROUP BY 1")
def _(reads):
    return rd.duplicate_distribution(reads)


@query("a23_exact_dedupe", "reads", oracle=f"SELECT read_id, CASE WHEN count(*) OVER w = 1 THEN 'Unique' WHEN read_id = min(read_id) OVER w THEN '1stDup' ELSE 'NthDup' END AS dup FROM reads WINDOW w AS (PARTITION BY least(seq, {RC}))")
def _(reads):
    return rd.dedupe(reads).select("read_id", "dup")


@query("a25_read_kmer_multiplicity", "reads", oracle="SELECT kmer, count(*) AS n FROM (SELECT unnest(" + KMERS.format(s="seq", k=16) + ") AS kmer FROM reads) GROUP BY kmer HAVING count(*) > 3")
def _(reads):
    return rd.overrepresented(reads, 16, 3)


@query("a26_nmer_frequency", "reads", oracle="SELECT kmer, count(*) AS n FROM (SELECT unnest(" + KMERS.format(s="seq", k=6) + ") AS kmer FROM reads) GROUP BY kmer")
def _(reads):
    return rd.kmer_frequencies(reads, 6)


@query("a26_nmer_by_group", "reads", oracle="SELECT cultivar, kmer, count(*) AS n FROM (SELECT cultivar, unnest(" + KMERS.format(s="seq", k=4) + ") AS kmer FROM reads) GROUP BY cultivar, kmer")
def _(reads):
    return rd.kmer_frequencies(reads, 4, ("cultivar",))


@query("a26_nmer_normalised", "reads", oracle="SELECT kmer, avg(f) AS mean, stddev_pop(f) AS sd, count(*) AS n, stddev_pop(f) / avg(f) AS cov FROM (SELECT read_id, kmer, count(*) * 1.0::DOUBLE / max(len) AS f FROM (SELECT read_id, length(seq) AS len, unnest(" + KMERS.format(s="seq", k=3) + ") AS kmer FROM reads) GROUP BY read_id, kmer) GROUP BY kmer")
def _(reads):
    return rd.normalised_kmers(reads, 3)


for _k in (1, 2, 3):

    def _composition(reads, k=_k):
        return rd.kmer_frequencies(reads, k)

    query(f"a27_composition_{_k}", "reads", oracle="SELECT kmer, count(*) AS n FROM (SELECT unnest(" + KMERS.format(s="seq", k=_k) + ") AS kmer FROM reads) GROUP BY kmer")(_composition)


@query("a29_over_occurring_kmers", "reads", oracle="SELECT kmer, count(*) AS n FROM (SELECT unnest(" + KMERS.format(s="seq", k=8) + ") AS kmer FROM reads) GROUP BY kmer HAVING count(*) > 20")
def _(reads):
    return rd.overrepresented(reads, 8, 20)


@query("a38_kmer_element_statistics", "reads", oracle="SELECT kmer, avg(n) AS mean, var_pop(n) AS variance, CAST(floor(log2(max(n))) AS BIGINT) AS log2_bucket FROM (SELECT read_id, kmer, count(*) AS n FROM (SELECT read_id, unnest(" + KMERS.format(s="seq", k=4) + ") AS kmer FROM reads) GROUP BY read_id, kmer) GROUP BY kmer")
def _(reads):
    return rd.kmer_element_statistics(reads, 4)


@query("t1_kmer_explode", "reads", oracle="SELECT read_id, CAST(i - 1 AS INTEGER) AS ofs, substring(seq, CAST(i AS BIGINT), 12) AS kmer FROM (SELECT *, unnest(range(1, CAST(greatest(length(seq) - 11, 0) AS BIGINT) + 1)) AS i FROM reads)")
def _(reads):
    return reads.select("read_id", F.posexplode(sq.kmers(F.col("seq"), 12)).alias("ofs", "kmer"))


@query("t16_pseudo_genome", "reads", oracle="SELECT read_id, CAST(sum(length(seq) + 100) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) - length(seq) - 100 AS BIGINT) AS start, CAST(length(seq) AS BIGINT) AS len FROM reads WHERE length(seq) > 0")
def _(reads):
    from strandframe.operators.assembly import pseudo_genome_offsets

    return pseudo_genome_offsets(reads.where("length(seq) > 0"), "read_id", 100)


@query("w10_moving_average", "snps", oracle="SELECT locus, avg(n) OVER (ORDER BY locus ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM (SELECT locus, count(*) AS n FROM snps GROUP BY locus)")
def _(snps):
    counted = snps.groupBy("locus").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("locus", F.avg("n").over(Window.partitionBy().orderBy("locus").rowsBetween(-2, 2)).alias("smooth"))


@query("w6_name_instances", "features", oracle="SELECT feat_id, row_number() OVER (PARTITION BY lower(cls) ORDER BY chrom, start, feat_id) AS instance FROM features")
def _(features):
    return features.select("feat_id", F.row_number().over(Window.partitionBy(F.lower("cls")).orderBy("chrom", "start", "feat_id")).alias("instance"))


@query("o3_top_n_per_query", "sparse", "features", oracle="""SELECT el_id, feat_id, o FROM (SELECT el_id, feat_id, o, row_number() OVER (PARTITION BY el_id ORDER BY o DESC, feat_id) AS n FROM (SELECT l.el_id, f.feat_id, least(l."end", f."end") - greatest(l.start, f.start) + 1 AS o FROM sparse l JOIN features f ON l.chrom = f.chrom AND f.start <= l."end" AND f."end" >= l.start)) WHERE n <= 3""")
def _(loci, features):
    from strandframe.operators.intervals import most_overlapping

    return most_overlapping(loci, features, 3)


@query("o4_o6_random_sample", "features", oracle="SELECT feat_id, chrom, start, \"end\" FROM features ORDER BY md5(concat('1|', CAST(feat_id AS VARCHAR))), feat_id LIMIT 100")
def _(features):
    return rd.random_sample(features, 100, "feat_id").select("feat_id", "chrom", "start", "end")
