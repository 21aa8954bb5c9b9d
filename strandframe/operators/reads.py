"""Read and sequence statistics, filters and deduplication. Columns: read_id, seq, and qual where qualities matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq


def nth_records(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every n-th record in order of a key, counted in two levels so that no task sees all rows.

    Rows are ranged by the key; the counts of earlier ranges offset the numbers within each.
    """
    return df.join(numbered(df.select(order), order).where(F.col("number") % n == 0).select(order), order, "left_semi")


def numbered(df: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """Adds number (from 1) by a unique numeric key."""
    bounds = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    # one row
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("_r", F.least(F.floor((F.col(order) - F.col("lo")) * ranges / (F.col("hi") - F.col("lo") + 1)), F.lit(ranges - 1))).drop("lo", "hi")
    before = Window.partitionBy().orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_r").orderBy(order)))
    return inside.join(F.broadcast(base), "_r").withColumn("number", F.col("_base") + F.col("_in")).drop("_r", "_base", "_in")


def length_statistics(df: DataFrame, length: Column) -> DataFrame:
    """N10 to N100: for each i the first length, longest first, at which the running sum reaches (total * i) div 10.

    Lengths are counted first, so the running sum is over distinct lengths, not rows.
    """
    counted = df.select(length.cast("long").alias("len")).where("len > 0").groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy().orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("sum", F.sum(F.col("len") * F.col("n")).over(w)).withColumn("total", F.sum(F.col("len") * F.col("n")).over(Window.partitionBy()))
    steps = running.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).where(F.col("sum") >= F.expr("(total * i) div 10"))
    return steps.groupBy((F.col("i") * 10).alias("n_percent")).agg(F.max("len").alias("n_length"))


def length_histogram(df: DataFrame, length: Column, width: int, bins: int) -> DataFrame:
    """Counts by least(length div width, bins); the last bin holds all longer ones."""
    return df.groupBy(F.least(F.floor(length / width), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def positional_kmers(df: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """Counts and shares of every k-mer at every offset."""
    counted = df.select(F.posexplode(sq.kmers(F.col("seq") if most is None else F.substring("seq", 1, most + k - 1), k)).alias("ofs", "kmer")).groupBy("ofs", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ofs")))


def kmer_concordance(df: DataFrame, k: int, most: int) -> DataFrame:
    """Pearson correlation of each offset's k-mer counts with those at a third of the longest offset, over all 4^k.

    Means count one more for every k-mer while deviations use the bare counts; denominators are at least 1e-6.
    """
    counted = df.select(F.posexplode(sq.clean_kmers(F.substring("seq", 1, most + k - 1), k)).alias("ofs", "kmer")).groupBy("ofs", "kmer").agg(F.count(F.lit(1)).alias("n"))
    cells = 4**k
    gold_at = most // 3
    gold = counted.where(F.col("ofs") == gold_at).select("kmer", F.col("n").alias("g"))
    sums = counted.groupBy("ofs").agg(F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"))
    both = counted.join(gold, "kmer").groupBy("ofs").agg(F.sum(F.col("n") * F.col("g")).alias("sxy"))
    all_gold = gold.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("sy"), F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).alias("syy"))
    mx, my = (F.col("sx") + cells) / float(cells), (F.col("sy") + cells) / float(cells)
    sxy = F.coalesce("sxy", F.lit(0)) - mx * F.col("sy") - my * F.col("sx") + cells * mx * my
    vx = F.col("sxx") - 2 * mx * F.col("sx") + cells * mx * mx
    vy = F.col("syy") - 2 * my * F.col("sy") + cells * my * my
    # one row
    return sums.join(both, "ofs", "left").crossJoin(F.broadcast(all_gold)).select("ofs", (sxy / F.greatest(F.sqrt(vx * vy), F.lit(1e-6))).alias("r"))


def quality_distribution(df: DataFrame) -> DataFrame:
    """Counts of Phred scores (clamped to 0..41) by offset."""
    q = F.transform(sq.phred(F.col("qual")), lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(41)))
    return df.select(F.posexplode(q).alias("ofs", "score")).groupBy("ofs", "score").agg(F.count(F.lit(1)).alias("n"))


def error_free_histogram(df: DataFrame) -> DataFrame:
    """Reads by their probability of holding no error, in 100 bins."""
    p = F.least(F.floor(sq.error_free(F.col("qual")) * 100), F.lit(99)).cast("int")
    return df.groupBy(p.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def indeterminate_by_offset(df: DataFrame) -> DataFrame:
    """Ns at each offset."""
    return df.select(F.posexplode(F.split("seq", "")).alias("ofs", "base")).where("base = 'N'").groupBy("ofs").agg(F.count(F.lit(1)).alias("n"))


def dedupe(df: DataFrame, either_strand: bool = True, mate: str | None = None) -> DataFrame:
    """Adds dup: Unique, 1stDup (the least read_id of its group) or NthDup. Pairs are equal if both mates are."""
    key = sq.canonical(F.col("seq")) if either_strand else F.col("seq")
    if mate:
        there, back = F.concat_ws("|", "seq", mate), F.concat_ws("|", sq.reverse_complement(F.col(mate)), sq.reverse_complement(F.col("seq")))
        key = F.least(there, back) if either_strand else there
    groups = df.groupBy(key.alias("_key")).agg(F.min("read_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = df.withColumn("_key", key).join(groups, "_key")
    return joined.withColumn("dup", F.when(F.col("_n") == 1, "Unique").when(F.col("read_id") == F.col("_first"), "1stDup").otherwise("NthDup")).drop("_key", "_first", "_n")


def duplicate_distribution(df: DataFrame, either_strand: bool = True) -> DataFrame:
    """How many different sequences occur how often."""
    key = sq.canonical(F.col("seq")) if either_strand else F.col("seq")
    return df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("instances")).groupBy("instances").agg(F.count(F.lit(1)).alias("sequences"))


def kmer_frequencies(df: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    """Counts of k-mers over A, C, G, T."""
    return df.select(*by, F.explode(sq.clean_kmers(F.col("seq"), k)).alias("kmer")).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def normalised_kmers(df: DataFrame, k: int) -> DataFrame:
    """Mean, deviation and coefficient of variation, over sequences, of a k-mer's occurrences per base."""
    per = df.withColumn("_len", F.length("seq")).select("read_id", "_len", F.explode(sq.clean_kmers(F.col("seq"), k)).alias("kmer")).groupBy("read_id", "_len", "kmer").agg((F.count(F.lit(1)) / F.first("_len")).alias("f"))
    out = per.groupBy("kmer").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cov", F.col("sd") / F.col("mean"))


def kmer_element_statistics(df: DataFrame, k: int) -> DataFrame:
    """Mean, population variance and log2 bucket of k-mer counts by sequence."""
    per = df.select("read_id", F.explode(sq.clean_kmers(F.col("seq"), k)).alias("kmer")).groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kmer").agg(F.avg("n").alias("mean"), F.var_pop("n").alias("variance"), F.floor(F.log2(F.max("n"))).alias("log2_bucket"))


def overrepresented(df: DataFrame, k: int, most: int) -> DataFrame:
    """k-mers that occur more than `most` times."""
    return kmer_frequencies(df, k).where(F.col("n") > most)


def filtered_with_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Adds one bit for each failed test to `reasons` (a bit mask in the order given) and kept."""
    mask = sum((F.when(test, F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(reasons.values())), F.lit(0))
    return df.withColumn("reasons", mask).withColumn("kept", F.col("reasons") == 0)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows drawn without replacement by the order of a seeded hash of their key; reruns agree."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def shuffled(seq: Column, key: Column, seed: int = 0) -> Column:
    """The bases of a sequence in a random order that depends on the key and seed only."""
    ranked = F.array_sort(F.transform(F.filter(F.split(seq, ""), lambda b: b != ""), lambda b, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), b.alias("b"))))
    return F.array_join(F.transform(ranked, lambda x: x["b"]), "")
