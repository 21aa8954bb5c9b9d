"""Concatenation and reconstruction of longer sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import numbered


def pseudo_genome_offsets(seqs: DataFrame, key: str, separator: int) -> DataFrame:
    """key, start and len of each sequence in the concatenation of all, `separator` Ns apart, in order of a numeric key.

    Offsets are summed in two levels: by blocks of rows, then within each.
    """
    df = numbered(seqs.select(key, F.length("seq").cast("long").alias("len")), key).withColumn("_b", F.floor(F.col("number") / 10_000))
    size = F.col("len") + separator
    before = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_b").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(F.broadcast(base), "_b").select(key, (F.col("_base") + F.col("_in")).alias("start"), "len")
