"""Mixing sources to target weights on a low-discrepancy schedule.

The mix is a row of slots of about BLOCK_WORDS words. Slot i asks the golden-ratio point frac((i + 1/2) * phi) which
source it draws from: the points are mapped through the cumulative target weights, so that every stretch of the mix is
near its targets. A source whose target is too small for any point gets one slot of its own at the end. A source's
target is then parted into equal blocks, one for each of its slots (the last one may be shorter): a slot's rank among
its source's slots names its block. Each source's documents are shuffled by a hash, laid end to end and read again from
the start, at most three times. So every source gives its target to the word, and a tiny source alters no other's blocks.

Weights are 1, 2, 3, repeating, by code point of the source, null last. A target stops at three times its source's
size; the excess goes to the others by weight.

Defined results: null or empty texts have size 0 and are never taken; rows with equal ids are separate documents;
an empty table gives an empty table; the order depends on ids and texts only, so reruns agree; extra columns, whatever
their names, are ignored by `takes` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import barrier, cut, n_words, running

MOST_REPEATS = 3
#: Words in a slot, about; in a small corpus fewer, so that there are SLOTS_LEAST slots.
BLOCK_WORDS, SLOTS_LEAST = 4096, 1000
GOLDEN = 0.6180339887498949
ROWS_A_BUCKET, SLOTS_A_CHUNK, CELLS_LEAST = 1000, 65_536, 1024
#: Up to so many sources their table is broadcast; beyond that it is joined.
SOURCES_BROADCAST = 10_000


def _sized(docs: DataFrame, cols: list[str]) -> DataFrame:
    """doc_id, source and `cols` with size, the source's name without null, and the key that shuffles documents."""
    text_key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_key).cast("binary"))
    df = barrier(docs.select("doc_id", "source", *cols), size=n_words(F.col("text")), _key=key)
    return df.withColumn("_name", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())


def _targets(sized: DataFrame) -> DataFrame:
    """One row for each source: _name, _null, sid, source_size, target, lo and hi (its part of the unit interval)."""
    per = sized.groupBy("_name", "_null").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    per = per.withColumn("sid", F.row_number().over(Window.partitionBy().orderBy("_null", "_name"))).withColumn("w", (F.col("sid") - 1) % 3 + 1).withColumn("total", F.sum("source_size").over(all_)).withColumn("rows", F.sum("n").over(all_))
    rising = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), "sid")
    per = per.withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("_before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    capped = F.col("cap") * F.col("_left") <= (F.col("total") - F.col("_before")) * F.col("w")
    per = per.withColumn("_capped", capped)
    free = F.col("total") - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0)).over(all_)
    weight = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("w"))).over(all_)
    per = per.withColumn("target", F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(free * F.col("w") / weight))
    hi = F.sum("target").over(Window.partitionBy().orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")
    per = per.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy().orderBy("sid")), F.lit(0.0)))
    return per.select("_name", "_null", "sid", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"), "lo", "hi", "total", "rows")


def _points(sources: DataFrame, n: int, slots: int) -> DataFrame:
    """slot and sid of every point. Points meet their source by cells of the unit interval, more than there are sources."""
    cells = max(CELLS_LEAST, 4 * n)
    point = (F.col("id") + 0.5) * GOLDEN
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    parts = sources.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells)))).alias("cell"))
    # rounding can leave the last sum a little under 1: its source takes the rest
    last = F.col("hi") >= 1 - 1e-9
    return points.join(F.broadcast(parts) if n <= SOURCES_BROADCAST else parts, "cell").where((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | last)).select("slot", "sid")


def schedule(sources: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(slot, sid and rank of every slot; `sources` with slots and block, the words in a block; sources; rows)."""
    r = sources.agg(F.max("total").alias("total"), F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n")).first()
    total, rows, n = int(r["total"] or 0), int(r["rows"] or 0), r["n"]
    slots = -(-total // max(1, min(BLOCK_WORDS, total // SLOTS_LEAST)))
    drawn = _points(sources, n, slots)
    counted = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("slots"))
    known = sources.join(counted, "sid", "left").withColumn("_late", F.col("slots").isNull() & (F.col("words") > 0)).withColumn("slots", F.coalesce("slots", F.col("_late").cast("long")))
    known = cut(known.withColumn("block", F.when(F.col("slots") > 0, F.ceil(F.col("words") / F.greatest(F.col("slots"), F.lit(1)))).otherwise(1).cast("long")))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / SLOTS_A_CHUNK)).withColumn("one", F.lit(1))
    ranked = running(drawn, ["sid"], "chunk", ["slot"], "one", "rank").select("slot", "sid", "rank")
    late = known.where("_late").select((F.lit(slots) + F.col("sid")).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    return ranked.unionByName(late), known.drop("_late"), n, rows


def _placed(sized: DataFrame, sources: DataFrame, n: int, rows: int) -> DataFrame:
    """Adds its source's columns and `start`: the words of its source before the document, in shuffled order."""
    known = sources.select("_name", "_null", "sid", "source_size", "target", "words", "block")
    df = sized.join(F.broadcast(known) if n <= SOURCES_BROADCAST else known, ["_name", "_null"])
    df = df.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * max(1, rows // ROWS_A_BUCKET) / F.lit(2.0**32)))
    return running(df, ["sid"], "_bucket", ["_key"], "size", "start")


def _readings(placed: DataFrame) -> DataFrame:
    """A row for each time that a document is read, as far as its source's target goes: `at` is its first word's place."""
    turns = placed.where("size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)))).withColumn("at", F.col("start") + F.col("_turn") * F.col("source_size"))
    return turns.where("at < words")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed documents, parts taken): the second has slot, sid, start (naming a document), from_word and n_words."""
    sized = cut(_sized(docs, ["text"]).drop("text"))
    slots, sources, n, rows = schedule(cut(_targets(sized)))
    placed = _placed(sized, sources, n, rows)
    end = F.least(F.col("at") + F.col("size"), F.col("words"))
    parts = _readings(placed).withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((end - 1) / F.col("block")))))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * F.col("block")), F.least(end, (F.col("rank") + 1) * F.col("block"))
    return placed, slots.join(parts.select("sid", "rank", "start", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("n_words")), ["sid", "rank"])


def takes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words in the mix, repeats counted) of every document."""
    placed, parts = mix(docs)
    taken = parts.groupBy("sid", "start").agg(F.sum("n_words").alias("taken"))
    size = F.col("size") > 0
    joined = placed.where(size).join(taken, ["sid", "start"], "left").unionByName(placed.where(~size).withColumn("taken", F.lit(0).cast("long")))
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as whole documents in the order of the schedule: a row for each time that a document's first word is in
    a slot, with all its columns; within a slot they follow their places in the source.

    The text crosses the network twice, to its place in its source and to its slot.
    """
    slots, sources, n, rows = schedule(cut(_targets(cut(_sized(docs, ["text"]).drop("text")))))
    whole = _sized(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")), ["text", "_doc"]).drop("text")
    read = _readings(_placed(whole.where("size > 0"), sources, n, rows)).select("sid", "at", F.floor(F.col("at") / F.col("block")).alias("rank"), "_doc")
    return read.join(slots, ["sid", "rank"]).orderBy("slot", "at").select("_doc.*")
