"""Sharding by sampled splitters, for shards of near equal bytes.

Records are ordered by the md5 of their text, then by that of their id, so equal texts are neighbours. A sample of keys,
drawn with a chance in proportion to size, gives quantile boundaries of ranges; overfull ranges are subdivided, a text
so frequent that it fills a range by the ids of its rows. Each range is summed apart, which gives every record the exact
number of bytes and rows before it, hence its shard and its slot. Equal texts stay in one shard unless together they
have over KEPT_WHOLE of a shard's bytes; such a group is cut where the bytes ask for it.

Defined results: a null text has no bytes (size 8, the crc32 of the empty text); a null id counts as an empty one;
repeated rows (equal id and text) get slots of their own in any order; an empty table gives an empty table; extra
columns, whatever their names, are kept by `sharded`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running, spread

LAW = "bytes"
RANGE_ROWS = 2000
KEPT_WHOLE = 0.005


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns `more`, size, text_crc32 and the keys: md5 of text and id, and the text's first 60 bits."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    df = docs.select("doc_id", *more, (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("_md5"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_id"))
    return df.withColumn("_h", F.conv(F.substring("_md5", 1, 15), 16, 10).cast("long"))


def assign(records: DataFrame, n_shards: int) -> DataFrame:
    """`records` (a written table with the columns of `keyed`) with shard and slot."""
    df = spread(records, "_h", "_id", F.col("size"), RANGE_ROWS).withColumn("_one", F.lit(1))
    order = ["_md5", "_id"]
    df = running(df, ["_coarse"], "_fine", order, "size", "_bytes_in")
    df = running(df, ["_coarse"], "_fine", order, "_one", "_rows_in")
    # one row for each coarse range
    sums = df.groupBy("_coarse").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy().orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_coarse", "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_bytes_base"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_base"), F.sum("_size").over(Window.partitionBy()).alias("_total"))
    df = df.join(F.broadcast(base), "_coarse").withColumn("_before", F.col("_bytes_base") + F.col("_bytes_in")).withColumn("_rank", F.col("_rows_base") + F.col("_rows_in"))
    # a text is within one range, or fills a coarse range whose sums are then its own
    group = Window.partitionBy("_coarse", "_fine", "_md5")
    alone = F.col("_low") == F.col("_high")
    whole = F.when(alone, F.col("_size")).otherwise(F.sum("size").over(group))
    start = F.when(alone, F.col("_bytes_base")).otherwise(F.min("_before").over(group))
    share = F.col("_total") / F.lit(float(n_shards))
    middle = F.when(whole <= KEPT_WHOLE * share, start + whole / 2).otherwise(F.col("_before") + F.col("size") / 2)
    df = df.withColumn("shard", F.least(F.floor(middle * n_shards / F.col("_total")), F.lit(n_shards - 1)).cast("int"))
    firsts = df.groupBy("shard").agg(F.min("_rank").alias("_first"))
    # one row for each shard
    return df.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))


def plan(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row; only narrow rows are shuffled."""
    return assign(cut(keyed(docs)), n_shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """All columns of `docs` with shard and slot, to be written with partitionBy("shard").

    Keys are placed without the texts; rows meet their place by keys, and equal rows by their number among their equals.
    """
    number = Window.partitionBy("_md5", "_id").orderBy("size")
    placed = assign(cut(keyed(docs)), n_shards).select("_md5", "_id", "shard", "slot").withColumn("_nth", F.row_number().over(Window.partitionBy("_md5", "_id").orderBy("slot")))
    whole = keyed(docs.select("doc_id", "text", F.struct("*").alias("_doc")), "_doc").withColumn("_nth", F.row_number().over(number))
    return whole.join(placed, ["_md5", "_id", "_nth"]).select("_doc.*", "shard", "slot")
