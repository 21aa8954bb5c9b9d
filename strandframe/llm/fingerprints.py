"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, weighted by how often they occur. For each of SAMPLES samples every term
draws, from hashes of itself and the sample's number, two gamma(2, 1) variables r and c and a uniform b;
t = floor(ln(weight) / r + b), and the term with the least ln(c) - r (t - b + 1) is the sample, named together with its t.
Two texts agree in a sample with the probability of their generalised Jaccard similarity (sum of lesser weights over sum
of greater ones).

Documents are dealt out by ranges of their ids, so one shuffle of the text brings each next to its successor, and all
counting and sampling happens in the partitions made then.

Defined results: texts without words (null, empty, white space) have the fingerprint "" and are alike only among
themselves; a null id comes first; equal ids go by the md5 of the text; a lone document's successor is itself; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread, words

SAMPLES = 48
ROWS_A_RANGE = 250


def _sample(term: Column, log_weight: Column, j: int) -> Column:
    """What the term offers in sample j, as one number: what has to be least (31 bits), then its name (32 bits)."""
    one, two = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    part = 2.0**-32
    uniform = lambda h, high: ((F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(0xFFFFFFFF))) + 0.5) * part
    # a gamma(2, 1) variable is minus the logarithm of a product of two uniforms
    r = -F.log(uniform(one, True) * uniform(one, False))
    ln_c = F.log(-F.log(uniform(two, True) * uniform(two, False)))
    b = uniform(one.bitwiseXOR(two), False)
    t = F.floor(log_weight / r + b)
    least = ((ln_c - r * (t - b + 1) + 96) * 2.0**24).cast("long")
    name = one.bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(least, 32).bitwiseOR(name)


#: What no sample is; any offer or-ed with it is it.
_NONE = 2**63 - 1


def _signatures(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a and b: the fingerprints of the texts with `which` 0 and 1; expects equal keys to be in one partition.

    A term that both texts have with one weight draws its samples once for both.
    """
    said = texts.select(*keys, "which", F.explode(words(F.lower("text"))).alias("word"))
    weight = lambda k: F.count(F.when(F.col("which") == k, True))
    counted = said.groupBy(*keys, F.xxhash64("word").alias("term")).agg(weight(0).alias("w0"), weight(1).alias("w1"))
    each = counted.select(*keys, "term", "w0", "w1", F.explode(F.array_distinct(F.array("w0", "w1"))).alias("w")).where("w > 0")
    mask = lambda k: F.when(F.col("w") == F.col(k), F.lit(0)).otherwise(F.lit(_NONE))
    each = each.select(*keys, "term", F.log(F.col("w")).alias("lw"), mask("w0").alias("m0"), mask("w1").alias("m1"))
    offers = [_sample(F.col("term"), F.col("lw"), j) for j in range(SAMPLES)]
    least = [F.min(x.bitwiseOR(F.col(m))).alias(f"{m}_{j}") for m in ("m0", "m1") for j, x in enumerate(offers)]
    name = lambda c: F.lpad(F.lower(F.hex(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    sign = lambda m: F.when(F.col(f"{m}_0") == _NONE, "").otherwise(F.concat(*[name(f"{m}_{j}") for j in range(SAMPLES)]))
    return each.groupBy(*keys).agg(*least).select(*keys, sign("m0").alias("a"), sign("m1").alias("b"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """id and fingerprint of every row that has words, for any table with doc_id (unique) and text."""
    return _signatures(docs.repartition("doc_id").withColumn("which", F.lit(0)), ["doc_id"]).select("doc_id", F.col("a").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree."""
    at = F.sequence(F.lit(1), F.lit(8 * SAMPLES - 7), F.lit(8))
    same = F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(8)) == F.substring(b, i, F.lit(8))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / float(SAMPLES))


RANGE = ["_coarse", "_fine"]


def _following(firsts: DataFrame, value: str) -> DataFrame:
    """For each range the `value` of the next range's first row, the last one gets the first one's: RANGE and after.

    Two levels: first within a coarse range, whose last one looks at the first of the next coarse range.
    """
    within = Window.partitionBy("_coarse").orderBy("_fine")
    heads = firsts.groupBy("_coarse").agg(F.min_by(value, "_fine").alias("_head"))
    # one row for each coarse range
    order = Window.partitionBy().orderBy("_coarse")
    next_ = heads.select("_coarse", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_after"))
    return firsts.withColumn("_lead", F.lead(value).over(within)).join(next_, "_coarse").select(*RANGE, F.coalesce("_lead", "_after").alias("after"))


def edited(docs: DataFrame) -> DataFrame:
    """Each text, its successor's and its edited text, in the ranges of their ids: RANGE, nth, doc_id, text, edited."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    df = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_md5", key), "doc_id", "_md5", F.lit(1), ROWS_A_RANGE).select(*RANGE, "doc_id", "_md5", "text")
    firsts = df.groupBy(*RANGE).agg(F.min_by("text", F.struct("doc_id", "_md5")).alias("text"))
    order = Window.partitionBy(*RANGE).orderBy(F.col("doc_id").asc_nulls_first(), "_md5")
    placed = df.withColumn("nth", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order))
    joined = placed.join(_following(firsts, "text"), RANGE).withColumn("_next", F.coalesce("_next", "after"))
    size = F.length("text")
    take = F.floor(size / 4).cast("int")
    return joined.select(*RANGE, "nth", "doc_id", "text", F.concat(F.substring("text", F.lit(1), size - take), F.substring("_next", F.lit(1), take)).alias("edited"))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    pairs = edited(docs)
    both = pairs.select(*RANGE, "nth", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    signed = _signatures(both, [*RANGE, "nth"])
    base = pairs.select(*RANGE, "nth", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    whole = cut(base.join(signed, [*RANGE, "nth"], "left").select(*RANGE, "nth", "doc_id", "n_chars", "edited_sha256", F.coalesce("a", F.lit("")).alias("fingerprint"), F.coalesce("b", F.lit("")).alias("edited_fingerprint")))
    after = _following(whole.where("nth = 1").select(*RANGE, "fingerprint"), "fingerprint")
    next_ = F.coalesce(F.lead("fingerprint").over(Window.partitionBy(*RANGE).orderBy("nth")), F.col("after"))
    return whole.join(after, RANGE).withColumn("_next", next_).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
