"""From raw documents to encoded training text, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() feeds each with what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import bpe_tree, mixing, near_dedup, quality_rules, toxicity
from strandframe.llm.common import cut, table
from strandframe.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the weakly supervised rules reject go."""
    return quality_rules.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose nearest labelled examples make toxicity at least as likely as not go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group at a similarity of 0.8 or more on five words, the least id stays."""
    return near_dedup.first_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a row for each time that the mix draws a document."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of each text and the text decoded from them."""
    return bpe_tree.encode_decode(docs, tokenizer("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", no_near_copies), ("mix", mixed), ("encode", encoded)]

#: Expectation-maximisation and byte-pair encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
