"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the cluster's shared checkpoint folder so that lineage ends here.

    A session on this machine alone (master local) that names no folder gets one; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandframe-"))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Rows of text go to Python workers 1000 at a time: where the session has Spark's default (10000), it is lowered.

    Long texts and several workers share an executor's memory beside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a Generate node, so that no later filter or projection computes them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as decimal text; folds are its remainders. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def at_most(col: Column, bounds: list) -> Column:
    """How many of the sorted `bounds` (long values) are at or under `col`; two-level search in literal arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(longs([g[0] for g in groups]), lambda x: x <= col))
    inside = F.size(F.filter(F.get(F.array(*[longs(g) for g in groups]), first - 1), lambda x: x <= col))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + inside)


def running(df: DataFrame, within: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one within `within`, ordered by `bucket`, then `order`.

    Two levels: buckets (which must follow the order) are summed first, and only those sums meet in one window.
    """
    sums = df.groupBy(*within, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*within, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    inside = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return placed.join(base, [*within, bucket]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


#: Ranges that sampled boundaries make at most (twice that where values repeat), and sampled values for each.
COARSE, DRAWS = 1024, 16


def spread(df: DataFrame, value: str, tie: str, weight: Column, rows_a_range: int) -> DataFrame:
    """Adds _coarse and _fine: ranges, in this order, of rows ordered by `value` (a long, nulls first), then `tie` (md5 hex).

    Coarse ranges come from sampled splitters, drawn with a chance in proportion to `weight`: quantiles of the sample
    are the boundaries, at most COARSE of them, whatever the table's size. A value on which several boundaries fall has a
    range of its own. A coarse range with more than `rows_a_range` rows is then subdivided evenly: by place between its
    least and greatest value, or by tie where it has one value only. So the number of ranges grows with the table.
    `df` is read four times: it should be a written table. Also adds _low, _high (values of the coarse range), _rows.
    """
    total = df.agg(F.sum(weight).alias("w")).first()["w"] or 0
    chance = weight * float(COARSE * DRAWS) / float(max(1, total))
    # which rows are drawn decides about work only, never about results
    drawn = df.where(F.rand(11) < chance).select(value)
    nth = F.row_number().over(Window.partitionBy().orderBy(F.col(value).asc_nulls_first()))
    found = [r[value] for r in drawn.withColumn("_n", nth).where(F.col("_n") % DRAWS == 0).orderBy("_n").collect()]
    known = [x for x in found if x is not None]
    bounds = sorted({*known, *(a + 1 for a, b in zip(known, known[1:]) if a == b)})
    ranged = df.withColumn("_coarse", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(at_most(F.col(value), bounds)).cast("int"))
    # one row for each coarse range
    table = ranged.groupBy("_coarse").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_rows"))
    parts = F.ceil(F.col("_rows") / rows_a_range)
    between = (F.col(value) - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1)
    by_tie = F.conv(F.substring(tie, 1, 8), 16, 10).cast("double") / 2.0**32
    place = F.when(F.col("_low") < F.col("_high"), between).otherwise(by_tie)
    return ranged.join(F.broadcast(table), "_coarse").withColumn("_fine", F.least(F.floor(place * parts), parts - 1).cast("long"))
