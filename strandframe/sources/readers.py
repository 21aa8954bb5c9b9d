"""Readers: each format is parsed from a DataFrame of lines or records (column `value`), so that Spark's own text source
does the scanning, splitting and decompression on any file system. `read_*` functions take a session and a path.

Coordinates come out 0-based and closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq

TAB = "\t"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _field(parts: Column, i: int, kind: str = "string") -> Column:
    return F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).try_cast(kind)


# --- sequences -------------------------------------------------------------------------------------------------------


def parse_fasta(records: DataFrame) -> DataFrame:
    """name (up to the first blank), descr and seq of records that begin after a `>`."""
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head = F.substring_index(text, "\n", 1)
    seq = F.when(F.locate("\n", text) > 0, F.regexp_replace(F.expr("substring(_t, instr(_t, '\n') + 1)"), r"\s", "")).otherwise("")
    return records.withColumn("_t", text).where(F.trim("_t") != "").select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.trim(head).alias("descr"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA, plain or gzip: records end where a line begins with `>`, so plain files are split between tasks."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def parse_fastq(blocks: DataFrame) -> DataFrame:
    """read_id, descr, seq, qual of texts that hold whole records (column `value`), by position within each group of four lines."""
    text = F.regexp_replace("value", "\r", "")
    parts = F.split(F.regexp_replace(text, "\n+$", ""), "\n")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(parts) / 4) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.substring(F.get(parts, i * 4), F.lit(2), F.lit(1 << 30)).alias("descr"), F.get(parts, i * 4 + 1).alias("seq"), F.get(parts, i * 4 + 3).alias("qual")))
    return blocks.where(F.length(F.trim("value")) > 0).select(F.posexplode(groups).alias("read_id", "_r")).select("read_id", "_r.descr", "_r.seq", "_r.qual").where("qual is not null")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line FASTQ of any size, plain or gzip: descr, seq, qual (and the file and block they came from).

    Files are read in Spark's own blocks. Within a block the first line that begins with @ and has a + line two below is a
    header (no other line can look so), which gives the phase; the incomplete records at the ends of a block go on as
    fragments, and each block's tail is joined with the heads of the blocks after it up to the next header.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kinds = "file string, block long, part int, descr string, seq string, qual string, rest array<string>"
    parts = text.mapInPandas(_fastq_blocks, kinds)
    ready = parts.where("part = 0").select("file", "block", "descr", "seq", "qual")
    order = Window.partitionBy("file").orderBy("block", "part")
    loose = parts.where("part <> 0").withColumn("_start", (F.col("part") == 2).cast("int")).withColumn("_g", F.sum("_start").over(order))
    # a few lines for each block and file
    joined = loose.groupBy("file", "_g").agg(F.min("block").alias("block"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "rest"))), lambda x: x["rest"])).alias("r"))
    records = joined.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.size("r") / 4) - 1, F.lit(0)).cast("int")))).where(F.size("r") >= 4)
    at = lambda k: F.get("r", F.col("_i") * 4 + k)
    return ready.unionByName(records.select("file", "block", F.substring(at(0), 2, 1 << 30).alias("descr"), at(1).alias("seq"), at(3).alias("qual")))


def _fastq_blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of blocks (part 0), lines before a block's first header (part 1) and after its last whole record (part 2)."""
    held: list[str] = []
    now: tuple | None = None
    phased = False

    def flush(last: bool) -> list[tuple]:
        nonlocal held, phased
        rows = []
        if not phased:
            found = next((i for i in range(len(held) - 2) if held[i][:1] == "@" and held[i + 2][:1] == "+"), None)
            if found is None:
                if last and held:
                    rows.append((*now, 1, None, None, None, held))
                    held = []
                return rows
            if found:
                rows.append((*now, 1, None, None, None, held[:found]))
            held, phased = held[found:], True
        whole = len(held) // 4 * 4
        rows += [(*now, 0, held[i][1:], held[i + 1], held[i + 3], None) for i in range(0, whole, 4)]
        held = held[whole:]
        if last and held:
            rows.append((*now, 2, None, None, None, held))
            held = []
        return rows

    names = ["file", "block", "part", "descr", "seq", "qual", "rest"]
    for pdf in it:
        rows: list[tuple] = []
        for (file, block), part in pdf.groupby(["file", "block"], sort=False):
            if now is not None and (file, block) != now:
                rows += flush(True)
                phased = False
            now = (file, block)
            held += part["value"].str.rstrip("\r").tolist()
            rows += flush(False)
        yield pd.DataFrame(rows, columns=names)
    if now is not None:
        yield pd.DataFrame(flush(True), columns=names)


def phred_dialect(df: DataFrame, sample: int = 10_000) -> DataFrame:
    """0 none, 1 Solexa, 2 Illumina 1.3, 3 Illumina 1.5, 4 Sanger, guessed from the range of characters of a sample."""
    codes = df.select("qual").limit(sample).select(F.explode(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), F.ascii)).alias("c"))
    lo = F.min("c")
    return codes.agg(F.when(lo.isNull(), 0).when(lo < 59, 4).when(lo < 64, 1).when(lo < 66, 2).otherwise(3).alias("dialect"))


def parse_contaminants(fasta: DataFrame) -> DataFrame:
    """name, overlays, is_vector and seq: `name@12` lists overlays 1 to 8, `name&` marks a vector, neither means 1, 2, 5, 6."""
    digits = F.regexp_extract("name", r"@([1-8]+)", 1)
    listed = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("int"))
    vector = F.col("name").contains("&")
    default = F.array(*[F.lit(x) for x in (1, 2, 5, 6)])
    overlays = F.when(vector, F.array().cast("array<int>")).when(digits == "", default).otherwise(listed)
    return fasta.select(F.regexp_extract("name", r"^([^@&]*)", 1).alias("name"), overlays.alias("overlays"), vector.alias("is_vector"), F.upper("seq").alias("seq"))


# --- intervals -------------------------------------------------------------------------------------------------------


def parse_bed(df: DataFrame) -> DataFrame:
    """BED of 3 to 12 columns, tab or comma apart; track, browser and comment lines go, as do rows without numbers."""
    text = F.col("value")
    parts = F.split(text, F.when(text.contains(TAB), F.lit(TAB)).otherwise(F.lit(",")))
    strand = F.coalesce(_field(parts, 5), F.lit("+"))
    ints = lambda i: F.transform(F.filter(F.split(F.coalesce(_field(parts, i), F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: x.cast("int"))
    start, end = _field(parts, 1, "long"), _field(parts, 2, "long") - 1
    rows = df.where(~text.rlike(r"^\s*(#|track|browser)")).select(
        _field(parts, 0).alias("chrom"), start.alias("start"), end.alias("end"), _field(parts, 3).alias("name"), F.coalesce(_field(parts, 4, "int"), F.lit(0)).alias("score"),
        F.when(strand.isin("+", "."), "+").when(strand == "-", "-").otherwise("?").alias("strand"), F.coalesce(_field(parts, 6, "long"), start).alias("thick_start"), F.coalesce(_field(parts, 7, "long") - 1, end).alias("thick_end"),
        ints(10).alias("_sizes"), ints(11).alias("_starts"),
    )
    exons = F.when(F.size("_sizes") > 0, F.zip_with("_starts", "_sizes", lambda s, n: F.struct(s.cast("long").alias("start"), (s + n - 1).cast("long").alias("end")))).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("end") - F.col("start")).alias("end"))))
    ok = rows.where("chrom is not null and start is not null and end is not null and end >= start")
    return ok.withColumn("exons", exons).drop("_sizes", "_starts")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(lines(spark, path))


def _nine(df: DataFrame, attrs: Column) -> DataFrame:
    parts = F.split("value", TAB)
    rows = df.where(~F.col("value").rlike(r"^\s*(#|$)")).select(
        _field(parts, 0).alias("seqname"), _field(parts, 1).alias("source"), _field(parts, 2).alias("feature"), (_field(parts, 3, "long") - 1).alias("start"), (_field(parts, 4, "long") - 1).alias("end"),
        _field(parts, 5, "double").alias("score"), F.coalesce(_field(parts, 6), F.lit(".")).alias("strand"), _field(parts, 7, "int").alias("frame"), attrs.alias("attrs"),
    )
    return rows.where("start is not null and end is not null")


def parse_gff3(df: DataFrame) -> DataFrame:
    """GFF3 records with attrs as a map."""
    raw = F.get(F.split("value", TAB), F.lit(8))
    pairs = F.filter(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: x.contains("="))
    return _nine(df, F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.regexp_extract(x, "=(.*)$", 1))))))


def parse_gtf(df: DataFrame) -> DataFrame:
    """GTF records; attributes are `key "value"` pairs."""
    raw = F.coalesce(F.get(F.split("value", TAB), F.lit(8)), F.lit(""))
    keys, values = F.regexp_extract_all(raw, F.lit(r'(\w+)\s+"?([^";]*)"?'), F.lit(1)), F.regexp_extract_all(raw, F.lit(r'(\w+)\s+"?([^";]*)"?'), F.lit(2))
    return _nine(df, F.map_from_entries(F.array_distinct(F.arrays_zip(keys, values))))


def of_types(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Records of the asked features (gene, transposable_element, miRNA, snoRNA, tRNA, pseudogene, ncRNA, exon ...)."""
    return df.where(F.lower("feature").isin([k.lower() for k in kinds]))


#: Position of each field (from 0) in the dialects of element CSV files.
LOCI_FIELDS = ["el_id", "el_type", "species", "chrom", "start", "end", "len"]


def parse_csv(df: DataFrame, names: list[str]) -> DataFrame:
    """Quote-aware fields by name: blanks around fields go, doubled quotes are one, missing fields are null."""
    parsed = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)), {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return df.where(F.trim("value") != "").select(parsed.alias("_r"), "value").select("_r.*", "value")


def is_header(value: Column) -> Column:
    """No unquoted field is a number and at most two are empty."""
    fields = F.transform(F.split(value, ","), F.trim)
    return ~F.exists(fields, lambda x: x.try_cast("double").isNotNull()) & (F.size(F.filter(fields, lambda x: x == "")) <= 2)


def parse_csv_loci(df: DataFrame, least: int = 0, most: int = 1 << 40) -> DataFrame:
    """Elements of the default dialect: id, type, species, chrom, start, end, length and, if given, strand."""
    rows = parse_csv(df.where(~is_header(F.col("value"))), [*LOCI_FIELDS, "strand"]).drop("value")
    for c in ("el_id", "start", "end", "len"):
        rows = rows.withColumn(c, F.col(c).try_cast("long"))
    return rows.withColumn("strand", F.coalesce("strand", F.lit("+"))).where(F.col("len").between(least, most))


def parse_psl(df: DataFrame) -> DataFrame:
    """PSL rows of 21 columns; header lines go."""
    names = ["matches", "mismatches", "rep_matches", "ncount", "q_num_ins", "q_base_ins", "t_num_ins", "t_base_ins", "strand", "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "block_count", "block_sizes", "q_starts", "t_starts"]
    parts = F.split("value", TAB)
    cols = []
    for i, n in enumerate(names):
        if n in ("strand", "q_name", "t_name"):
            cols.append(_field(parts, i).alias(n))
        elif i >= 18:
            cols.append(F.transform(F.filter(F.split(F.coalesce(_field(parts, i), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("int")).alias(n))
        else:
            cols.append(_field(parts, i, "int").alias(n))
    return df.where(F.col("value").rlike(r"^\d+\t\d+\t")).select(*cols)


def parse_blast(df: DataFrame) -> DataFrame:
    """Tabular BLAST (-m8, -m9) as loci on the subject: start and end in order, strand from their order."""
    parts = F.split("value", TAB)
    a, b = _field(parts, 8, "long"), _field(parts, 9, "long")
    rows = df.where(~F.col("value").rlike(r"^\s*(#|$)")).select(_field(parts, 0).alias("query"), _field(parts, 1).alias("chrom"), _field(parts, 2, "double").alias("identity"), _field(parts, 3, "int").alias("len"), (F.least(a, b) - 1).alias("start"), (F.greatest(a, b) - 1).alias("end"), F.when(a <= b, "+").otherwise("-").alias("strand"), _field(parts, 10, "double").alias("evalue"), _field(parts, 11, "double").alias("bits"))
    return rows.where("start is not null")


# --- alignments ------------------------------------------------------------------------------------------------------

SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def parse_sam(df: DataFrame) -> DataFrame:
    """SAM records; pos becomes 0-based, tags a map (the first of a repeated tag counts); header lines go."""
    parts = F.split("value", TAB)
    kinds = {"flag": "int", "mapq": "int", "pos": "long", "pnext": "long", "tlen": "long"}
    cols = [_field(parts, i, kinds.get(n, "string")).alias(n) for i, n in enumerate(SAM)]
    pairs = F.transform(F.slice(parts, F.lit(12), F.greatest(F.size(parts) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, 6, 1 << 20).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    tags = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs, lambda x: x["k"] == k), F.lit(0))["v"]))
    return df.where(~F.col("value").startswith("@")).select(*cols, tags.alias("tags")).withColumn("pos", F.col("pos") - 1).withColumn("pnext", F.col("pnext") - 1)


def alignment_elements(sam: DataFrame) -> DataFrame:
    """An element for each contiguous aligned run of a mapped read: qname, chrom, start, end, strand, block."""
    mapped = sam.where((F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("pos") >= 0) & (F.col("cigar") != "*"))
    strand = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")
    blocks = mapped.select("qname", F.col("rname").alias("chrom"), strand.alias("strand"), F.posexplode(sq.cigar_blocks(F.col("cigar"), F.col("pos"))).alias("block", "_b"))
    return blocks.select("qname", "chrom", F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), "strand", "block")


def parse_snp_csv(df: DataFrame) -> DataFrame:
    """Aligner SNP rows of at least 23 fields: locus, coverage, reference base and base counts.

    The reference base's count is the coverage without mismatches.
    """
    names = [f"f{i}" for i in range(1, 24)]
    rows = parse_csv(df.where(~is_header(F.col("value"))), names)
    n = lambda i: F.coalesce(F.col(f"f{i}").try_cast("long"), F.lit(0))
    ref = F.upper("f13")
    out = rows.where(F.col("f23").isNotNull()).select(F.col("f4").alias("seq"), n(5).alias("loci"), F.col("f10").try_cast("double").alias("p_value"), n(11).alias("coverage"), n(12).alias("mismatches"), ref.alias("ref_base"), *[F.when(ref == b, n(11) - n(12)).otherwise(n(14 + i)).alias(b.lower()) for i, b in enumerate("ACGTN")])
    return out


def parse_maf(df: DataFrame) -> DataFrame:
    """Alignment blocks from paragraphs (read with lineSep a blank line): score and rows of species, chrom and sequence."""
    s = F.filter(F.split("value", "\n"), lambda x: x.startswith("s "))

    def row(x: Column) -> Column:
        p = F.split(F.trim(x), r"\s+")
        src = F.get(p, F.lit(1))
        return F.struct(F.substring_index(src, ".", 1).alias("species"), F.regexp_replace(src, r"^[^.]*\.", "").alias("chrom"), F.get(p, F.lit(2)).cast("long").alias("ofs"), F.get(p, F.lit(3)).cast("long").alias("len"), F.get(p, F.lit(4)).alias("strand"), F.get(p, F.lit(6)).alias("seq"))

    score = F.regexp_extract("value", r"score=([-\d.]+)", 1).try_cast("double")
    return df.where(F.col("value").rlike(r"(?m)^a\b")).select(score.alias("score"), F.transform(s, row).alias("rows"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    return parse_maf(spark.read.option("lineSep", "\n\n").text(path))


# --- ontologies, assemblies, lists -----------------------------------------------------------------------------------


def parse_obo(df: DataFrame) -> DataFrame:
    """Terms of an OBO file read with lineSep a blank line: go_id, name, ontology, parents (is_a and part_of)."""
    one = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}:\s*(.*?)\s*(?:!.*)?$", 1), F.lit(""))
    parents = F.array_distinct(F.concat(F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), F.lit(1)), F.regexp_extract_all("value", F.lit(r"(?m)^relationship:\s*part_of\s+(\S+)"), F.lit(1))))
    return df.where(F.col("value").contains("[Term]")).select(one("id").alias("go_id"), one("name").alias("name"), one("namespace").alias("ontology"), parents.alias("parents"))


#: Columns (from 0) of gene, GO id, aspect, qualifier and evidence by dialect.
ASSOCIATIONS = {"gaf": (2, 4, 8, 3, 6), "tair": (0, 5, 7, 3, 9), "flybase": (2, 4, 8, 3, 6), "ucsc": (0, 1, 2, 3, 4)}


def parse_associations(df: DataFrame, dialect: str = "gaf") -> DataFrame:
    parts = F.split("value", TAB)
    names = ("gene", "go_id", "aspect", "qualifier", "evidence")
    return df.where(~F.col("value").startswith("!")).select(*[_field(parts, i).alias(n) for i, n in zip(ASSOCIATIONS[dialect], names)])


def parse_agp(df: DataFrame) -> DataFrame:
    """AGP 1.1 and 2.0: components have comp_id, beg, end and orientation; gaps (types N and U) have a length."""
    parts = F.split("value", TAB)
    gap = F.get(parts, F.lit(4)).isin("N", "U")
    return df.where(~F.col("value").rlike(r"^\s*(#|$)")).select(
        _field(parts, 0).alias("object"), (_field(parts, 1, "long") - 1).alias("start"), (_field(parts, 2, "long") - 1).alias("end"), _field(parts, 3, "int").alias("part"), gap.alias("is_gap"),
        F.when(gap, _field(parts, 5, "long")).alias("gap_len"), F.when(~gap, _field(parts, 5)).alias("comp_id"), F.when(~gap, _field(parts, 6, "long") - 1).alias("comp_start"), F.when(~gap, _field(parts, 7, "long") - 1).alias("comp_end"), F.when(~gap, _field(parts, 8)).alias("orientation"),
    )


def parse_constraints(df: DataFrame) -> DataFrame:
    """Loci constraints: chrom, start, end and accepted bases (R for the reference base)."""
    rows = parse_csv(df.where(~is_header(F.col("value"))), ["chrom", "start", "end", "accept"])
    return rows.select("chrom", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), F.upper("accept").alias("accept")).where("start is not null")


def sniffed(df: DataFrame, sample: int = 50) -> str:
    """csv, bed, sam or unknown, by what most of the first lines look like. Reads `sample` lines."""
    votes = {"csv": 0, "bed": 0, "sam": 0}
    for r in df.limit(sample).collect():
        t = (r["value"] or "").strip()
        parts = t.split("\t")
        if t.startswith("@") or len(parts) >= 11 and parts[1].isdigit():
            votes["sam"] += 1
        elif len(parts) >= 3 and parts[1].isdigit() and parts[2].isdigit():
            votes["bed"] += 1
        elif t.count(",") >= 3:
            votes["csv"] += 1
    best = max(votes, key=votes.get)
    return best if votes[best] else "unknown"

