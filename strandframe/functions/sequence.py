"""Column functions on sequences, qualities, CIGARs and alignment records. All but colour space (Arrow batches) stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def complement(seq: Column) -> Column:
    """A and T, C and G change places, letters keep their case; everything else stays."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def unmasked(seq: Column) -> Column:
    """Upper case; what is no base becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def masked_bases(seq: Column) -> Column:
    """How many bases are soft-masked (lower case)."""
    return F.regexp_count(seq, F.lit("[acgtn]"))


def count_n(seq: Column) -> Column:
    """Indeterminate bases in either case."""
    return F.regexp_count(seq, F.lit("[Nn]"))


def gc_content(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.regexp_count(seq, F.lit("[GCgc]")) / F.length(seq)).otherwise(0.0)


def kmers(seq: Column, k: int) -> Column:
    """All windows of length k, in order."""
    last = F.length(seq) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(seq, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def clean_kmers(seq: Column, k: int) -> Column:
    """Windows of length k over A, C, G and T only."""
    return F.filter(kmers(seq, k), lambda w: ~w.rlike("[^ACGT]"))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, A=0 to T=3; -1 if any other letter occurs."""
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def kmer_from_code(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two equally long sequences; null when lengths differ."""
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, F.lit(0)).otherwise(F.size(differ)))


def bit_hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def homopolymer_reduced(seq: Column) -> Column:
    """Runs of one base become a single base."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def longest_homopolymer(seq: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(r"(A+|C+|G+|T+)"), F.lit(1)), F.length)), F.lit(0))


def bisulfite(seq: Column, strand: str = "+") -> Column:
    """C read as T on the plus strand, G read as A on the minus strand."""
    return F.translate(seq, "C", "T") if strand == "+" else F.translate(seq, "G", "A")


def colour_space(seq: Column) -> Column:
    """First base, then a colour (0 to 3) for each step: the exclusive or of the two bases' codes."""

    def run(texts: pd.Series) -> pd.Series:
        def one(s):
            if s is None or len(s) < 2:
                return s
            x = BASE_CODE[np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 255)]
            return s[0] + (48 + (x[1:] ^ x[:-1])).astype(np.uint8).tobytes().decode()

        return pd.Series([one(s) for s in texts], dtype=object)

    return F.pandas_udf(run, "string")(seq)


#: Codes of A, C, G and T; other letters count as A.
BASE_CODE = np.zeros(256, np.uint8)
BASE_CODE[[65, 67, 71, 84]] = range(4)


def from_colour_space(colours: Column) -> Column:
    """Bases from a first base and colours: codes are running exclusive ors."""

    def run(texts: pd.Series) -> pd.Series:
        def one(s):
            if s is None or len(s) < 2:
                return s
            x = np.frombuffer(s[1:].encode("ascii"), np.uint8) - 48
            if (x > 3).any():
                raise ValueError("a colour is 0, 1, 2 or 3")
            start = BASE_CODE[min(ord(s[0]), 255)]
            return s[0] + np.frombuffer(b"ACGT", np.uint8)[np.bitwise_xor.accumulate(np.r_[start, x])[1:]].tobytes().decode()

        return pd.Series([one(s) for s in texts], dtype=object)

    return F.pandas_udf(run, "string")(colours)


def low_complexity(seq: Column) -> Column:
    """3 less the bases under a tenth of the sequence, at least 0; 0 with any N."""
    rare = sum((F.regexp_count(seq, F.lit(b)) * 10 < F.length(seq)).cast("int") for b in "ACGT")
    return F.when(F.upper(seq).contains("N"), F.lit(0)).otherwise(F.greatest(F.lit(0), 3 - rare))


def phred(qual: Column, offset: int = 33) -> Column:
    """Scores of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def error_free(qual: Column, offset: int = 33) -> Column:
    """Probability that no base is wrong: the product of 1 - 10^(-q/10)."""
    return F.aggregate(phred(qual, offset), F.lit(1.0), lambda acc, q: acc * (1 - F.pow(F.lit(10.0), -q / 10.0)))


def mean_phred_passes(qual: Column, least: int, floor: int = 10, offset: int = 33) -> Column:
    """No base under `floor`, and (1 + sum) / length at least `least`; thresholds under 20 let all pass."""
    if least < 20:
        return F.lit(True)
    q = phred(qual, offset)
    total = F.aggregate(q, F.lit(1), lambda acc, x: acc + x)
    return (F.length(qual) > 0) & ~F.exists(q, lambda x: x < floor) & (total / F.length(qual) >= least)


def trimmed(seq: Column, five: int, three: int) -> Column:
    return F.substring(seq, F.lit(five + 1), F.greatest(F.length(seq) - (five + three), F.lit(0)))


CIGAR = r"(\d+)([MIDNSHP=X])"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n:int,op:string>>"""
    return F.arrays_zip(F.transform(F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(1)), lambda x: x.cast("int")).alias("n"), F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(2)).alias("op"))


def cigar_aligned(cigar: Column) -> Column:
    """Aligned bases: the sum of M, = and X."""
    return _cigar_sum(cigar, ("M", "=", "X"))


def cigar_reference(cigar: Column) -> Column:
    """Reference bases spanned: M, =, X, D and N."""
    return _cigar_sum(cigar, ("M", "=", "X", "D", "N"))


def _cigar_sum(cigar: Column, ops: tuple) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops)), F.lit(0), lambda acc, x: acc + x["n"])


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """array<struct<start:long,end:long>> of contiguous M, =, X runs from 0-based `pos`, as the SAM specification has it.

    Neighbouring M, = and X run together; D and N advance the reference; I, S, H and P do not.
    """
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"].cast("long")
        aligned = x["op"].isin("M", "=", "X")
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = last["end"] + 1 == acc["at"]
        block = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n - 1).alias("end")))
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (acc["at"] + n - 1).alias("end"))))
        out = F.when(aligned & F.coalesce(joins, F.lit(False)), longer).when(aligned, F.concat(acc["out"], block)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.when(aligned | x["op"].isin("D", "N"), n).otherwise(F.lit(0))).alias("at"), out.alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda acc: acc["out"])


def sam_bin(start: Column, end: Column) -> Column:
    """UCSC bin of the 0-based half-open interval [start, end): the smallest of five levels that holds it."""
    last, out = end - 1, F.lit(0)
    for shift in (26, 23, 20, 17, 14):
        offset = ((1 << (29 - shift)) - 1) // 7
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.lit(offset) + F.shiftright(start, shift)).otherwise(out)
    return out


def sam_bins(start: Column, end: Column) -> Column:
    """All bins that a 0-based half-open region can meet."""
    last, parts = end - 1, [F.array(F.lit(0).cast("long"))]
    for shift in (26, 23, 20, 17, 14):
        offset = ((1 << (29 - shift)) - 1) // 7
        parts.append(F.sequence((F.shiftright(start, shift) + offset).cast("long"), (F.shiftright(last, shift) + offset).cast("long")))
    return F.concat(*parts)


def psl_score(matches: Column, rep: Column, mismatches: Column, q_inserts: Column, t_inserts: Column, protein: bool = False) -> Column:
    m = 3 if protein else 1
    return m * (matches + F.floor(rep / 2)) - m * mismatches - q_inserts - t_inserts


def psl_millibad(matches: Column, rep: Column, mismatches: Column, q_inserts: Column, t_inserts: Column, q_span: Column, t_span: Column, mrna: bool = True) -> Column:
    """Badness in thousandths: mismatches, inserts and the size difference over the aligned bases."""
    size_dif = q_span - t_span
    size_dif = F.when(size_dif < 0, F.lit(0) if mrna else -size_dif).otherwise(size_dif)
    inserts = q_inserts if mrna else q_inserts + t_inserts
    total = matches + rep + mismatches
    bad = (1000 * (mismatches + inserts + F.round(3 * F.log(1.0 + size_dif)))) / total
    return F.when(F.least(q_span, t_span) <= 0, F.lit(0)).when(total == 0, F.lit(0)).otherwise(F.floor(bad)).cast("long")


def psl_identity(millibad: Column) -> Column:
    return F.floor(100.0 - millibad * 0.1).cast("int")


def xml_safe(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unquoted(text: Column) -> Column:
    """Without surrounding white space and one pair of matching quotes."""
    return F.regexp_replace(F.trim(text), r"""^(["'])(.*)\1$""", "$2")


def isoform_trimmed(name: Column) -> Column:
    """Gene name without an isoform suffix of one or two digits after the last point."""
    return F.regexp_replace(name, r"\.\d{1,2}$", "")


def windows_in_common(columns: Column) -> Column:
    """Lengths of gap-free stretches in an array of booleans (aligned columns)."""
    return F.transform(F.regexp_extract_all(F.array_join(F.transform(columns, lambda c: F.when(c, "1").otherwise("0")), ""), F.lit("(1+)"), F.lit(1)), F.length)


#: Fixed values of name hashes: bits, seed, factor, shift and what stands for a hash of 0.
NAME_HASHES = {16: (19937, 3119, 13, 19937), 24: (37199, 19937, 21, 1)}


def name_hash(name: Column, bits: int) -> Column:
    """16- or 24-bit hash of a name, lower-cased; 0 only for a null or empty one. Products wrap at 32 bits, signed."""
    seed, factor, shift, instead = NAME_HASHES[bits]
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")

    def step(h: Column, c: Column) -> Column:
        x = (h.bitwiseXOR(F.ascii(c).cast("long")) * factor).bitwiseAND(F.lit(0xFFFFFFFF))
        signed = x.bitwiseXOR(F.lit(1 << 31)) - (1 << 31)
        return signed.bitwiseXOR(F.shiftright(signed, shift)).bitwiseAND(F.lit((1 << bits) - 1))

    found = F.aggregate(chars, F.lit(seed).cast("long"), step)
    return F.when(F.coalesce(name, F.lit("")) == "", 0).when(found == 0, instead).otherwise(found).cast("long")
