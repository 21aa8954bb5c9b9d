"""Coordinate remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remapped(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Loci on contigs moved to chromosomes: names compare without case, unmatched loci go.

    `contigs` has contig, chrom and offset.
    """
    to = contigs.select(F.lower("contig").alias("_key"), F.col("chrom").alias("_to"), "offset")
    out = df.withColumn("_key", F.lower("chrom")).join(to, "_key")
    return out.withColumn("chrom", F.col("_to")).withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset")).drop("_key", "_to", "offset")
