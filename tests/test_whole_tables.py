"""Queries without a SQL oracle see every row of their tables."""

import random

import pytest

from strandframe.operators import kmers as km
from strandframe.plans import alignment_queries, analysis_queries


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at, r = tmp_path_factory.mktemp("whole"), random.Random(5)
    texts = [(i, "".join(r.choice("ACGT") for _ in range(n)), "en", "s") for i, n in ((3, 230), (201, 90), (902, 700), (903, 1500))]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    parts = [(i, f"part {i}", 10, "cls") for i in (5, 199, 200, 777)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{at}/part.parquet")
    # loci begin at l_orderkey * 37 + l_linenumber * 11, in the chromosome of l_partkey
    lines = [(i * 97 // 37 + 1, 1, i, 1, 30.0, "F" if i % 2 else "O", "N") for i, *_ in parts]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_assembly_uses_every_read_to_its_end(spark, sf_dir):
    got = {r.seq for r in alignment_queries.Q["t9_t10_assembly"](spark, sf_dir).collect()}
    assert got == {r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_bootstrap_counts_every_probe(spark, sf_dir):
    rows = alignment_queries.Q["a42_bootstrap_hits"](spark, sf_dir).collect()
    assert len(rows) == 20 and all(abs(r.share - r.hit / 4) < 1e-12 for r in rows) and max(r.hit for r in rows) > 1


def test_bootstrap_p_has_every_feature_with_loci(spark, sf_dir):
    got = {r.feat_id for r in analysis_queries.Q["a13_bootstrap_p"](spark, sf_dir).collect()}
    want = {r.feat_id for r in analysis_queries.Q["a7_binned_counts"](spark, sf_dir).collect()}
    assert got == want and {200, 777} <= got


def test_probes_found_equals_exact_hits(spark, sf_dir):
    r = random.Random(6)
    seqs = [(i, "".join(r.choice("AC") for _ in range(40))) for i in range(30)]
    reads = spark.createDataFrame(seqs, "read_id long, seq string")
    probes = spark.createDataFrame([(i, "".join(r.choice("ACGT"[:2] if i % 2 else "GT") for _ in range(12))) for i in range(60)], "probe_id long, probe string")
    found = {r.probe_id for r in km.probes_found(probes, reads, 12).collect()}
    assert found == {r.probe_id for r in km.exact_hits(probes, reads, 12).select("probe_id").distinct().collect()} and 0 < len(found) < 60
