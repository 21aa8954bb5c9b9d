"""Genomic shapes of the driver's tables, as DataFrames and, for the oracles, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEATURES = """SELECT p_partkey AS feat_id, p_name AS name, concat('chr', CAST(p_partkey % 6 AS VARCHAR)) AS chrom, (p_partkey * 97) % 50000 AS start,
  (p_partkey * 97) % 50000 + CAST(p_size AS BIGINT) * 20 - 1 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey % 1000 AS score, p_type AS cls FROM part"""

LOCI = """SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS el_id, concat('chr', CAST(l_partkey % 6 AS VARCHAR)) AS chrom, (l_orderkey * 37 + l_linenumber * 11) % 50000 AS start,
  (l_orderkey * 37 + l_linenumber * 11) % 50000 + CAST(l_quantity AS BIGINT) - 1 AS "end", CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_returnflag AS sample, l_linestatus AS cond FROM lineitem"""

#: All loci, spread over forty times the length, so that gaps remain.
SPARSE = """SELECT el_id, chrom, start * 40 AS start, start * 40 + ("end" - start) AS "end", strand FROM loci"""

READS = """SELECT doc_id AS read_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq, lang AS cultivar, source AS sample FROM documents"""

QUALS = """SELECT read_id, seq, cultivar, sample, rpad(substring(regexp_replace(coalesce(text, ''), '[^!-I]', '', 'g'), 1, CAST(length(seq) AS INTEGER)), CAST(length(seq) AS INTEGER), 'I') AS qual
  FROM reads JOIN documents ON doc_id = read_id"""

#: One to four exons; the coding part leaves five bases at either end.
GENES = """SELECT *, 1 + feat_id % 4 AS n_exons, ("end" - start + 1) // (1 + feat_id % 4) AS seg, start + 5 AS cds_start, "end" - 5 AS cds_end FROM features"""

EXONS = """SELECT feat_id, name, chrom, strand, cds_start, cds_end, n_exons, i AS exon, start + i * seg AS start, CASE WHEN i = n_exons - 1 THEN "end" ELSE start + i * seg + seg // 2 END AS "end"
  FROM genes, range(4) AS r(i) WHERE i < n_exons"""

SNPS = """SELECT event_id, user_id AS locus, CAST(event_id % 4 AS INTEGER) AS cultivar, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END AS base FROM events"""

EDGES = """SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, CAST(1000000 + l_suppkey AS BIGINT) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

ALL = {"features": FEATURES, "loci": LOCI, "sparse": SPARSE, "reads": READS, "quals": QUALS, "genes": GENES, "exons": EXONS, "snps": SNPS, "edges": EDGES}
TABLES = {"features": ["part"], "loci": ["lineitem"], "reads": ["documents"], "quals": ["documents"], "snps": ["events"], "edges": ["orders", "lineitem"]}
NEEDS = {"sparse": ["loci"], "quals": ["reads"], "genes": ["features"], "exons": ["genes"]}


def sql(*names: str) -> str:
    """WITH clause for DuckDB holding the named shapes and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({ALL[n]})" for n in order) + "\n"


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same shape in Spark: the SQL above in Spark's dialect over the parquet files."""
    # whole runs of letters at once: the same result with fewer matches
    text = ALL[name].replace("]', '', 'g')", "]+', '')").replace(", 'g')", ")").replace("AS VARCHAR", "AS STRING").replace('"end"', "`end`").replace("//", "div").replace("range(4) AS r(i)", "(SELECT id AS i FROM range(4)) AS r")
    args = {m: shape(spark, sf_dir, m) for m in NEEDS.get(name, [])}
    for t in TABLES.get(name, []):
        args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for k in args:
        text = _named(text, k)
    return spark.sql(text, **args)


def _named(text: str, table: str) -> str:
    """`table` after FROM or JOIN as a parameter of spark.sql."""
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
