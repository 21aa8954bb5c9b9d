"""Variant loci: base counts, candidate tests and cultivar markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.stats import benjamini_hochberg, binomial_tail

BASES = ("A", "C", "G", "T", "N")


def base_counts(df: DataFrame, by: tuple) -> DataFrame:
    """Counts of each base by locus: columns a, c, g, t, n and tot."""
    return df.groupBy(*by).agg(*[F.sum((F.col("base") == b).cast("long")).alias(b.lower()) for b in BASES], F.count(F.lit(1)).alias("tot"))


def _unpivoted(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each base in the order A, C, G, T, N."""
    items = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(b).alias("base"), F.col(b.lower()).alias("cnt")) for i, b in enumerate(BASES)])
    return counts.select(*keys, "tot", F.inline(items))


def cultivar_markers(counts: DataFrame, min_total: int, min_count: int, min_percent: float, alt_most: int) -> DataFrame:
    """locus, cultivar, base, cnt, conf: bases that set one cultivar apart at a locus.

    The total must reach min_total, the base min_count and min_percent of the total, and no other cultivar may have
    alt_most or more of it (if alt_most > 0). The largest share wins, on ties the first of A, C, G, T, N.
    """
    rows = _unpivoted(counts, ["locus", "cultivar"])
    others = Window.partitionBy("locus", "base")
    high = F.max("cnt").over(others)
    second = F.max(F.when(F.col("_n") == 2, F.col("cnt"))).over(others)
    ranked = rows.withColumn("_n", F.row_number().over(others.orderBy(F.desc("cnt"), "cultivar"))).withColumn("_high", high).withColumn("_second", second)
    other = F.when(F.col("_n") == 1, F.coalesce("_second", F.lit(0))).otherwise(F.col("_high"))
    ok = (F.col("tot") >= min_total) & (F.col("cnt") >= min_count) & (F.col("cnt") * 100.0 / F.col("tot") >= min_percent) & ((F.lit(alt_most) == 0) | (other < alt_most))
    best = ranked.where(ok).withColumn("_b", F.row_number().over(Window.partitionBy("locus", "cultivar").orderBy(F.desc("cnt"), "nth"))).where("_b = 1")
    return best.select("locus", "cultivar", "base", "cnt", F.floor(100.0 * F.col("cnt") / F.col("tot")).cast("int").alias("conf"))


def shared_base_dropped(called: DataFrame) -> DataFrame:
    """Only loci at which cultivars differ."""
    keep = called.groupBy("locus").agg(F.count_distinct("base").alias("_n")).where("_n > 1").select("locus")
    return called.join(keep, "locus", "left_semi")


def major_base(counts: DataFrame) -> DataFrame:
    rows = _unpivoted(counts, ["locus", "cultivar"])
    return rows.withColumn("_b", F.row_number().over(Window.partitionBy("locus", "cultivar").orderBy(F.desc("cnt"), "nth"))).where("_b = 1").select("locus", "cultivar", "base", "cnt")


def snp_candidates(counts: DataFrame, min_coverage: int, min_share: float, floor_rate: float = 0.01) -> DataFrame:
    """Loci whose share of bases other than the major one is `min_share` or more, with binomial and adjusted p values.

    The error rate is the observed share of such bases over all loci, at least `floor_rate`. `counts` has locus,
    a, c, g, t, n and tot.
    """
    tot = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    df = counts.withColumn("cov", tot).withColumn("alt", tot - F.greatest("a", "c", "g", "t"))
    # one row
    rate = df.agg(F.greatest(F.lit(floor_rate), F.sum("alt") / F.sum("cov")).alias("rate"))
    tested = df.where((F.col("cov") >= min_coverage) & (F.col("alt") >= min_share * F.col("cov"))).crossJoin(F.broadcast(rate))
    return benjamini_hochberg(tested.withColumn("p", binomial_tail(F.col("alt"), F.col("cov"), F.col("rate"))), "p").select("locus", "cov", "alt", "p", "q")


def counts_from_alignments(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """Base counts at loci (chrom, start = end = locus) from aligned reads (chrom, start, end, seq)."""
    from .intervals import overlap_join

    hits = overlap_join(loci, reads).select("chrom", "start", F.substring("b_seq", F.col("start") - F.col("b_start") + 1, F.lit(1)).alias("base"))
    return base_counts(hits, ("chrom", "start"))


def marker_sequences(loci: DataFrame, seqs: DataFrame, flank5: int, flank3: int, max_n: int, min_length: int) -> DataFrame:
    """Sequence around each locus, clipped to its contig, with at most max_n Ns in either case."""
    joined = loci.join(seqs.select("seq_id", "seq"), "seq_id")
    lo = F.greatest(F.col("locus") - flank5, F.lit(0))
    hi = F.least(F.col("locus") + flank3, F.length("seq") - 1)
    out = joined.withColumn("marker", F.substring("seq", lo + 1, hi - lo + 1)).withColumn("marker_start", lo).drop("seq")
    return out.where((F.length("marker") >= min_length) & (F.regexp_count("marker", F.lit("[Nn]")) <= max_n))


def snp_variants(markers: DataFrame) -> DataFrame:
    """A row for each alternative base of a marker's locus, substituted into its sequence."""
    at = F.col("locus") - F.col("marker_start")
    alts = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.substring("marker", at + 1, F.lit(1)))
    df = markers.withColumn("alt", F.explode(alts))
    return df.withColumn("variant", F.concat(F.substring("marker", F.lit(1), at), F.col("alt"), F.substring("marker", at + 2, F.length("marker"))))
