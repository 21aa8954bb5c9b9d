"""The queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, chat_trees, fingerprints, mixing, near_dedup, quality_qda, quality_rules, sharding, token_counts, toxicity
from .common import cut, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    messages = cut(chat_trees.linear(rows.unionByName(control)))
    return chat_trees.digest(chat_trees.conversations(messages))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_tree.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), ["doc_id"]))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_qda.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~quality_qda.learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= quality_qda.THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~toxicity.learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_source_mixing": op3_source_mixing,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
}

_SHARDS = """
WITH t AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS v FROM range(256) AS r(i)),
e AS (SELECT DISTINCT md5(coalesce(text, '')) AS m, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
crc AS (SELECT m, CAST(xor(list_reduce(list_transform(range(n), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda a, b: xor(a // 256, t.v[1 + CAST(xor(a % 256, b) AS BIGINT)]), 4294967295), 4294967295) AS BIGINT) AS crc FROM e, t),
k AS (SELECT doc_id, md5(coalesce(text, '')) AS m, strlen(coalesce(text, '')) + 8 AS size FROM documents),
o AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS rank, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY m) AS whole
      FROM k WINDOW w AS (ORDER BY m, md5(coalesce(CAST(doc_id AS VARCHAR), '')) ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, min(before) OVER (PARTITION BY m) AS start FROM o),
s AS (SELECT *, CAST(least(floor((CASE WHEN whole <= 0.005 * (total / 24.0::DOUBLE) THEN start + whole / 2.0::DOUBLE ELSE before + size / 2.0::DOUBLE END) * 24 / total), 23) AS INTEGER) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN crc USING (m)
"""

_NEAR = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS x FROM t),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 85 * (u.n + v.n - i)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON node = doc_id
"""

_CHAT = """
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
             length('### ' || replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '\\e'), '###', '\\h'), ':', '\\c') || ': '
                    || replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\e'), '###', '\\h') || '</turn>' || chr(10)) AS chars FROM m),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said,
             coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid - 1) % 3 + 1 AS w, size * 3 AS cap, sum(size) OVER () AS total FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, cap * rest <= (total - before) * w AS capped FROM r),
t AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM c),
o AS (SELECT d.doc_id, d.source, d.size, t.size AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words, sum(d.size) OVER (PARTITION BY t.sid ORDER BY k ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(words - start, size)) + greatest(0, least(words - start - source_size, size)) + greatest(0, least(words - start - 2 * source_size, size)) AS BIGINT) AS taken
FROM o
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": _NEAR,
    "op2_chat_formatting": _CHAT,
    "op3_source_mixing": _MIX.replace("\\\\", "\\"),
    "op10_sharding": _SHARDS,
}
