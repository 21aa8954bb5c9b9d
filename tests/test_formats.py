"""Parsers on the edge cases of each format, from files and from lines."""

import gzip

from pyspark.sql import functions as F

from strandframe.sources import readers as rd
from strandframe.sources import writers as wr


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n>s2\n\n>s3 x\nGG")
    got = sorted((r.name, r.descr, r.seq) for r in rd.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("s1", "s1 first one", "ACGTAC"), ("s2", "s2", ""), ("s3", "s3 x", "GG")]
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\r\nAA\r\nCC\r\n")
    assert [(r.name, r.seq) for r in rd.read_fasta(spark, str(tmp_path / "b.fa.gz")).collect()] == [("z", "AACC")]


def test_fastq_with_at_signs_in_qualities(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 d\nACGT\n+\n@@@@\n@r2\nA\n+r2\n+\n")
    got = sorted((r.descr, r.seq, r.qual) for r in rd.read_fastq(spark, str(tmp_path / "a.fq")).collect())
    assert got == [("r1 d", "ACGT", "@@@@"), ("r2", "A", "+")]
    assert rd.phred_dialect(spark.createDataFrame([("5I",)], "qual string")).first()[0] == 4


def test_fastq_in_many_blocks(spark, tmp_path):
    want = []
    for f in range(2):
        rows = [(f"r{f}_{i}", "ACGT"[i % 4] * (i % 37 + 1), "@+I#"[i % 4] * (i % 37 + 1)) for i in range(300)]
        want += rows
        (tmp_path / f"{f}.fq").write_text("".join(f"@{d}\n{s}\n+\n{q}\n" for d, s, q in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("150b", "700b", "5000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = sorted((r.descr, r.seq, r.qual) for r in rd.read_fastq(spark, str(tmp_path)).collect())
            assert got == sorted(want), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_bed_columns_and_defaults(spark):
    df = rd.parse_bed(lines(spark, "track x", "c1\t0\t10", "c1,5,6,nm,7,-", "c2\t3\t3", "c2\t1\t9\tn\t1\tx", "c3\t0\t100\tg\t0\t.\t10\t90\t0\t2\t10,20,\t0,80,", "junk"))
    got = {(r.chrom, r.start, r.end): (r.name, r.score, r.strand, r.thick_start, r.thick_end, [tuple(e) for e in r.exons]) for r in df.collect()}
    assert got == {("c1", 0, 9): (None, 0, "+", 0, 9, [(0, 9)]), ("c1", 5, 5): ("nm", 7, "-", 5, 5, [(0, 0)]), ("c2", 1, 8): ("n", 1, "?", 1, 8, [(0, 7)]), ("c3", 0, 99): ("g", 0, "+", 10, 89, [(0, 9), (80, 99)])}


def test_gff_and_gtf(spark):
    g = rd.parse_gff3(lines(spark, "##gff", "c\ts\tgene\t1\t10\t.\t+\t.\tID=a;Name=b c", "c\ts\tmiRNA\t5\t6\t1.5\t-\t0\tID=d")).collect()
    assert [(r.start, r.end, r.score, r.attrs["ID"]) for r in g] == [(0, 9, None, "a"), (4, 5, 1.5, "d")]
    t = rd.parse_gtf(lines(spark, 'c\ts\texon\t3\t4\t.\t+\t.\tgene_id "x"; n 5;')).first()
    assert t.attrs == {"gene_id": "x", "n": "5"}


def test_csv_quotes_and_headers(spark):
    r = rd.parse_csv(lines(spark, '1, "a,b" ,"q""q",,5'), ["a", "b", "c", "d", "e"]).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("1", "a,b", 'q"q', None, "5")
    heads = [x[0] for x in lines(spark, "id,name,pos", "1,a,b", "a,,,b", "a,,,,b").select(rd.is_header(F.col("value"))).collect()]
    assert heads == [True, False, True, False]


def test_unmapped_reads_give_no_elements(spark):
    sam = rd.parse_sam(lines(spark, "@HD\tVN:1", "r1\t0\tc\t5\t9\t3M2N3M\t*\t0\t0\tACGTAC\t*\tNM:i:0", "r2\t4\tc\t5\t9\t3M\t*\t0\t0\tA\t*", "r3\t16\tc\t0\t9\t3M\t*\t0\t0\tA\t*", "r4\t0\tc\t7\t9\t*\t*\t0\t0\tA\t*"))
    assert [(r.qname, r.start, r.end, r.block) for r in rd.alignment_elements(sam).collect()] == [("r1", 4, 6, 0), ("r1", 9, 11, 1)]
    assert sam.first().tags == {"NM": "0"}


def test_contaminants_maf_and_sniffing(spark):
    fa = spark.createDataFrame([("p@13", "ac"), ("v&", "gg"), ("d", "tt")], "name string, seq string")
    got = {r.name: (r.overlays, r.is_vector) for r in rd.parse_contaminants(fa).collect()}
    assert got == {"p": ([1, 3], False), "v": ([], True), "d": ([1, 2, 5, 6], False)}
    m = rd.parse_maf(lines(spark, "a score=5.5\ns hg.chr1 3 4 + 100 AC-GT\ns mm.chr2 0 5 - 90 ACGGT\n", "# c")).collect()
    assert len(m) == 1 and m[0].score == 5.5 and [x.species for x in m[0].rows] == ["hg", "mm"]
    assert rd.sniffed(lines(spark, "c\t1\t5")) == "bed" and rd.sniffed(lines(spark, "@HD\tx")) == "sam" and rd.sniffed(lines(spark, "1,a,b,c")) == "csv" and rd.sniffed(lines(spark, "x")) == "unknown"


def test_fasta_wrapping(spark):
    df = spark.createDataFrame([("a", "ACGTAC"), ("b", "ACGT"), ("c", "")], "n string, seq string")
    assert [r.value for r in wr.fasta(df, "n", width=4).collect()] == [">a\nACGT\nAC", ">b\nACGT", ">c\n"]


def test_star_schema_keeps_all_facts(spark):
    rows = spark.createDataFrame([("x", 1, 5), ("x", 2, 6), ("y", 1, 7)], "cult string, loc long, n long")
    t = wr.star_schema(rows, {"cult": ["cult"]})
    assert t["cult"].count() == 2 and t["fact"].join(t["cult"], "cult_id").count() == 3


def test_bam_round_trip_through_files(spark, tmp_path):
    from strandframe.sources import bam

    rows = [("a", 0, "c1", 5, 30, "4M1I2M", "=", 50, 60, "ACGTNAC", "IIII#!I"), ("b", 16, "c2", 0, 0, "3S4M", "c1", 7, -9, "GATTACA", "*"), ("c", 4, "*", -1, 0, "*", "*", -1, 0, "*", "*"), ("d" * 200, 0, "c1", 2**28, 60, "9=1X", "*", -1, 0, "*", "*")]
    sent = spark.createDataFrame(rows, bam.RECORD)
    targets = spark.createDataFrame([("c1", 2**29), ("c2", 1000)], "name string, len long")
    files = bam.encoded(sent.selectExpr("*", "length(qname) % 2 AS part"), targets, "part").collect()
    for f in files:
        (tmp_path / f"{f.part}.bam").write_bytes(bytes(f.content))
    got = sorted(tuple(r) for r in bam.read_bam(spark, str(tmp_path / "*.bam")).collect())
    assert got == sorted(rows)


def test_bgzf_blocks_are_checked():
    import pytest

    from strandframe.sources import bam

    data = bytes(range(256)) * 1000
    packed = bam.compressed(data)
    assert bam.inflated(packed) == data and bam.inflated(bam.compressed(b"")) == b""
    with pytest.raises(Exception):
        bam.inflated(packed[:30] + b"\x00" + packed[31:])


def test_fields_keep_their_quotes(spark):
    from strandframe.operators.filters import fields

    df = spark.createDataFrame([('a,"b ""x"", y",,d',), ("",), (None,), ("only",)], "value string")
    assert [r.value for r in fields(df, [2, 4, 3, 1, 9]).collect()] == ['"b ""x"", y",d,,a', "", None, "only"]


def test_repeated_tags_count_once(spark):
    from strandframe.sources.readers import parse_sam

    line = "\t".join(["q", "0", "c", "1", "0", "1M", "*", "0", "0", "A", "I", "NM:i:1", "NM:i:2", "XX:Z:a:b"])
    assert parse_sam(spark.createDataFrame([(line,)], "value string")).first().tags == {"NM": "1", "XX": "a:b"}
