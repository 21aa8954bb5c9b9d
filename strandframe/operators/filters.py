"""Row filters of elements and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chroms(df: DataFrame, include: list[str] = (), exclude: list[str] = (), column: str = "chrom") -> DataFrame:
    """Exclusion comes first; with any include pattern, names that match none go."""
    keep: Column = F.lit(True)
    for p in exclude:
        keep = keep & ~F.col(column).rlike(p)
    if include:
        any_: Column = F.lit(False)
        for p in include:
            any_ = any_ | F.col(column).rlike(p)
        keep = keep & any_
    return df.where(keep)


def elements(df: DataFrame, length: tuple | None = None, strand: str = "*", score: tuple | None = None) -> DataFrame:
    if length:
        df = df.where((F.col("end") - F.col("start") + 1).between(*length))
    if strand != "*":
        df = df.where(F.col("strand") == strand)
    return df.where(F.col("score").between(*score)) if score else df


def flags(df: DataFrame, column: str, required: int = 0, forbidden: int = 0) -> DataFrame:
    c = F.col(column)
    return df.where((c.bitwiseAND(F.lit(required)) == required) & (c.bitwiseAND(F.lit(forbidden)) == 0))


def listed(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in the include list and not in the exclude list."""
    if include is not None:
        df = df.join(include.select(key), key, "left_semi")
    return df.join(exclude.select(key), key, "left_anti") if exclude is not None else df


def region(df: DataFrame, bits: str, include: int = 0, exclude: int = 0) -> DataFrame:
    """No excluded region bit (0 stands for intergenic, bit 256); of the low six exactly one included bit, if any is asked."""
    c = F.when(F.col(bits) == 0, F.lit(256)).otherwise(F.col(bits))
    df = df.where(c.bitwiseAND(F.lit(exclude)) == 0)
    if not include:
        return df
    low = c.bitwiseAND(F.lit(0x13F))
    return df.where((F.bit_count(low) == 1) & (low.bitwiseAND(F.lit(include)) != 0))


def start_cap(df: DataFrame, window: int, most: int) -> DataFrame:
    """At most `most` reads starting in the same window of a strand."""
    w = Window.partitionBy("chrom", "strand", F.floor(F.col("start") / window)).orderBy("start", "el_id")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hit_cap(df: DataFrame, key: str, most: int, clamp: bool, order: list) -> DataFrame:
    """Reads with more than `most` hits go entirely, or with `clamp` keep their first ones."""
    w = Window.partitionBy(key)
    if clamp:
        return df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") <= most).drop("_n")


def psl(df: DataFrame, score: int, identity: int, matches: int) -> DataFrame:
    return df.where((F.col("score") >= score) & (F.col("identity") >= identity) & (F.col("matches") >= matches))


def constrained(reads: DataFrame, constraints: DataFrame) -> DataFrame:
    """Aligned reads (chrom, start, end, seq, ref_seq) whose base at every constrained locus they cover is accepted.

    `constraints` has chrom, start, end, accept: letters, R for the reference base.
    """
    from .intervals import overlap_join

    hits = overlap_join(reads, constraints).withColumn("_at", F.explode(F.sequence(F.greatest("start", "b_start"), F.least("end", "b_end"))))
    base = F.substring("seq", F.col("_at") - F.col("start") + 1, F.lit(1))
    ref = F.substring("ref_seq", F.col("_at") - F.col("start") + 1, F.lit(1))
    wrong = hits.where(~(F.col("b_accept").contains(base) | (F.col("b_accept").contains("R") & (base == ref)))).select("el_id").distinct()
    return reads.join(wrong, "el_id", "left_anti")


def fields(df: DataFrame, numbers: list[int], column: str = "value") -> DataFrame:
    """Lines of comma-separated fields with those of the given 1-based numbers, in that order; quotes stay as they are.

    A number beyond a line's last field is left out of that line.
    """
    parts = F.regexp_extract_all(F.col(column), F.lit(r'(?:^|,)((?:"(?:[^"]|"")*"|[^,"])*)'), F.lit(1))
    picked = F.filter(F.array(*[F.get(parts, F.lit(n - 1)) for n in numbers]), lambda x: x.isNotNull())
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.array_join(picked, ",")))
