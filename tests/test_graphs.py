"""Graphs, expression and markers against plain Python."""

import random

from strandframe.operators import expression as ex
from strandframe.operators import graph as gr
from strandframe.operators import variants as va


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.cluster for x in gr.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(70)]
    assert {x.cluster for x in gr.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
    placed = {x.node: (x.head, x.place) for x in gr.chains(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert placed == {i: (0, i) for i in range(71)}


def test_components_of_no_edges(spark):
    assert gr.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert gr.connected_components(spark.createDataFrame([(4, 4)], "a long, b long").union(spark.createDataFrame([(5, 5)], "a long, b long"))).count() == 2


def test_scaling_carries_the_remainder(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(9)) for i in range(60)]
    got = {x.pos: x.scaled for x in ex.scaled_counts(spark.createDataFrame(rows, "pos long, n long"), "n", __import__("pyspark").sql.functions.lit(0.61), (), ["pos"]).collect()}
    carry = 0.0
    for i, n in rows:
        v = n * 0.61 + carry
        whole = int(v + 0.5) if v + 0.5 >= 0 else 0
        carry = v - whole
        assert abs(got[i] - whole) <= 0


def test_coalescing_is_greedy(spark):
    rows = [("c", "+", s) for s in (1, 5, 9, 11, 30, 31, 50)]
    got = sorted((x.start, x.n) for x in ex.coalesced(spark.createDataFrame(rows, "chrom string, strand string, start long"), 10).collect())
    assert got == [(1, 3), (11, 1), (30, 2), (50, 1)]


def test_count_matrix_drops_absent_features(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a")]
    got = [tuple(x) for x in ex.count_matrix(spark.createDataFrame(rows, "f long, s string"), "f", "s", ["a", "b"]).collect()]
    assert got == [(1, 1, 2)]


def test_marker_thresholds(spark):
    rows = [(1, 0, 5, 5, 0, 0, 0, 10), (1, 1, 0, 0, 9, 0, 0, 9), (2, 0, 4, 0, 0, 0, 0, 4), (2, 1, 2, 8, 0, 0, 0, 10)]
    counts = spark.createDataFrame(rows, "locus long, cultivar int, a long, c long, g long, t long, n long, tot long")
    got = {(x.locus, x.cultivar): (x.base, x.cnt, x.conf) for x in va.cultivar_markers(counts, 5, 2, 50.0, 3).collect()}
    assert got == {(1, 0): ("A", 5, 50), (1, 1): ("G", 9, 100), (2, 1): ("C", 8, 80)}
    # a base of another cultivar exactly at the limit rejects
    assert (2, 1) in {(x.locus, x.cultivar) for x in va.cultivar_markers(counts, 5, 2, 10.0, 5).collect()}


def test_ontology_reaches_all_ancestors(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "d")], "term string, parent string")
    genes = spark.createDataFrame([(1, "a"), (2, "e"), (1, "e")], "gene long, term string")
    got = {x.term: x.genes for x in gr.propagated_counts(genes, parents).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2}
