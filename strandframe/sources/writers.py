"""Writers: each format as a DataFrame of lines (column `value`), to be written with df.write.text(path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import sam_bin


def fasta(df: DataFrame, name: str, seq: str = "seq", width: int = 70) -> DataFrame:
    """Records wrapped at `width` columns; 0 leaves sequences on one line."""
    body = F.col(seq) if not width else F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), body).alias("value"))


def fastq(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col(name).cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))


def _tabs(df: DataFrame, cols: list[Column]) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cols]).alias("value"))


def bed(df: DataFrame) -> DataFrame:
    return _tabs(df, [F.col("chrom"), F.col("start"), F.col("end") + 1, F.col("name"), F.col("score"), F.col("strand")])


def gff3(df: DataFrame, feature: str = "gene") -> DataFrame:
    return _tabs(df, [F.col("chrom"), F.lit("strandframe"), F.lit(feature), F.col("start") + 1, F.col("end") + 1, F.col("score"), F.col("strand"), F.lit("."), F.concat(F.lit("ID="), F.col("feat_id").cast("string"), F.lit(";Name="), F.col("name"))])


def gtf(df: DataFrame, feature: str = "exon") -> DataFrame:
    return _tabs(df, [F.col("chrom"), F.lit("strandframe"), F.lit(feature), F.col("start") + 1, F.col("end") + 1, F.col("score"), F.col("strand"), F.lit("."), F.concat(F.lit('gene_id "'), F.col("feat_id").cast("string"), F.lit('"; gene_name "'), F.col("name"), F.lit('";'))])


def sam(df: DataFrame) -> DataFrame:
    """Records of qname, flag, rname, pos (0-based), mapq, cigar, seq, qual."""
    return _tabs(df, [F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos") + 1, F.col("mapq"), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.col("seq"), F.col("qual")])


def sam_header(targets: DataFrame) -> DataFrame:
    """@SQ lines of name and len."""
    return targets.select(F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))


def sam_index(df: DataFrame) -> DataFrame:
    """Alignments of each target and bin: what a BAI index groups by."""
    return df.groupBy("chrom", sam_bin(F.col("start"), F.col("end") + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def csv_loci(df: DataFrame, kind: str, species: str) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select(F.concat_ws(",", F.col("el_id").cast("string"), quoted(F.lit(kind)), quoted(F.lit(species)), quoted(F.col("chrom")), F.col("start").cast("string"), F.col("end").cast("string"), (F.col("end") - F.col("start") + 1).cast("string"), quoted(F.col("strand"))).alias("value"))


def psl(df: DataFrame) -> DataFrame:
    names = ["matches", "mismatches", "rep_matches", "ncount", "q_num_ins", "q_base_ins", "t_num_ins", "t_base_ins", "strand", "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "block_count"]
    lists = [F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(",")) for c in ("block_sizes", "q_starts", "t_starts")]
    return _tabs(df, [*[F.col(n) for n in names], *lists])


def maf(df: DataFrame) -> DataFrame:
    """Blocks of score and rows (species, chrom, ofs, len, strand, seq)."""
    row = lambda r: F.concat_ws(" ", F.lit("s"), F.concat_ws(".", r["species"], r["chrom"]), r["ofs"].cast("string"), r["len"].cast("string"), r["strand"], (r["ofs"] + r["len"]).cast("string"), r["seq"])
    return df.select(F.concat(F.lit("a score="), F.col("score").cast("string"), F.lit("\n"), F.array_join(F.transform("rows", row), "\n"), F.lit("\n")).alias("value"))


def bedgraph(depth: DataFrame) -> DataFrame:
    return _tabs(depth.where("depth <> 0"), [F.col("chrom"), F.col("start"), F.col("end") + 1, F.col("depth")])


def wiggle(depth: DataFrame) -> DataFrame:
    """Variable-step wiggle: each stretch is a declaration with its span and one value."""
    return depth.where("depth <> 0").select(F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(" span="), (F.col("end") - F.col("start") + 1).cast("string"), F.lit("\n"), (F.col("start") + 1).cast("string"), F.lit(" "), F.col("depth").cast("string")).alias("value"))


def phylip(seqs: DataFrame, name: str = "species") -> DataFrame:
    """One line for each species: its aligned parts in block order. Names are padded to ten characters."""
    joined = seqs.groupBy(name).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "seq"))), lambda x: x["seq"]), "").alias("s"))
    return joined.select(F.concat(F.rpad(name, 10, " "), F.col("s")).alias("value"))


def gexf_edges(edges: DataFrame) -> DataFrame:
    number = F.xxhash64("u", "v").cast("string")
    return edges.select(F.concat(F.lit('<edge id="'), number, F.lit('" source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" />')).alias("value"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" />')).alias("value"))


def star_schema(rows: DataFrame, dims: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Dimension tables with surrogate keys and the fact table that refers to them.

    A key is a hash of the natural key, so dimensions can be built and appended to without numbering all rows.
    """
    out, fact = {}, rows
    for name, cols in dims.items():
        key = F.xxhash64(*cols).alias(f"{name}_id")
        out[name] = rows.select(key, *cols).dropDuplicates([f"{name}_id"])
        fact = fact.withColumn(f"{name}_id", F.xxhash64(*cols))
    used = {c for cols in dims.values() for c in cols}
    return out | {"fact": fact.select(*[c for c in fact.columns if c not in used])}


def split_by_size(df: DataFrame, size: str, most: int) -> DataFrame:
    """Adds file: numbers of output files of at most about `most` in `size`, in order of key; blocks keep it parallel."""
    from strandframe.operators.reads import numbered

    n = numbered(df, "read_id").withColumn("_b", F.floor(F.col("number") / 10_000))
    before = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = n.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_b").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = n.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(F.broadcast(base), "_b")
    return placed.withColumn("file", F.floor((F.col("_base") + F.col("_in")) / most)).drop("_b", "_base", "_in", "number")
