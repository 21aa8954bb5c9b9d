"""Streaming results equal the batch results of the same rows."""

from pyspark.sql import functions as F

from strandframe.streaming import qc


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "read_id long, seq string, qual string, t long").select("read_id", "seq", "qual", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


ROWS = [(1, "ACGT", "IIII", 0), (2, "ACGG", "IIII", 10), (3, "CCGT", "!!!!", 20), (4, "ACGT", "IIII", 4000), (5, "GGTT", "IIII", 4100)]


def test_windowed_quality(spark, tmp_path):
    got = {r.start.timestamp(): (r.reads, r.bases) for r in run(spark, qc.windowed_quality(stream(spark, tmp_path, ROWS)), "w", "complete", tmp_path)}
    assert got == {0.0: (3, 12), 3600.0: (2, 8)}


def test_first_reads_and_kmers(spark, tmp_path):
    src = stream(spark, tmp_path, ROWS)
    got = {r.seq for r in run(spark, qc.first_reads(src), "d", "append", tmp_path)}
    assert got == {"ACGT", "ACGG", "GGTT"}  # CCGT is ACGG read backwards
    counts = {r.kmer: r.n for r in run(spark, qc.kmer_counts(src, 3), "k", "complete", tmp_path)}
    assert counts["ACG"] == 3 and counts["CGT"] == 3
