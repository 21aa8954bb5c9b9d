"""Read quality control and deduplication as Structured Streaming. Input: a streaming DataFrame of read_id, seq, qual, ts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq


def windowed_quality(reads: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Reads, bases, GC share and mean error-free probability by event-time window; data later than `late` is dropped."""
    w = reads.withWatermark("ts", late).groupBy(F.window("ts", window))
    return w.agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"), (F.sum(F.regexp_count("seq", F.lit("[GC]"))) / F.greatest(F.sum(F.length("seq")), F.lit(1))).alias("gc"), F.avg(sq.error_free(F.col("qual"))).alias("error_free")).select(F.col("window.start").alias("start"), "reads", "bases", "gc", "error_free")


def first_reads(reads: DataFrame, late: str = "1 hour", either_strand: bool = True) -> DataFrame:
    """The first read of every sequence; state is forgotten once the watermark has passed."""
    key = sq.canonical(F.col("seq")) if either_strand else F.col("seq")
    return reads.withColumn("_key", F.xxhash64(key)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running counts of k-mers (complete or update mode)."""
    return reads.select(F.explode(sq.clean_kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
