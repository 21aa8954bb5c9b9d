"""BAM files: records to BGZF blocks and back.

A file is one row (path, content), as Spark's binaryFile source reads it, so storage is reached through Spark only; a
file is decoded by one task and may have 2 GB at most, which is Spark's bound for a value. Many files, or one for each
target (`encoded` makes one for each value of `by`), spread over the cluster. Numbers are little-endian as the format's
specification has them; CIGAR operations and bases are coded by their place in OPS and BASES.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.sequence import sam_bin

#: Fixed values of the format.
OPS, BASES, MAGIC = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", b"BAM\x01"
BGZF_HEAD, BGZF_END = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 60_000
RECORD = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def compressed(data: bytes) -> bytes:
    """BGZF blocks of the data with the end marker."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(BGZF_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join([*out, BGZF_END])


def inflated(content: bytes) -> bytes:
    """The data of all blocks, each checked against its length and checksum."""
    out, at = [], 0
    while at < len(content):
        extra = struct.unpack_from("<H", content, at + 10)[0]
        field, size = at + 12, None
        while field < at + 12 + extra:
            kind, n = content[field : field + 2], struct.unpack_from("<H", content, field + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", content, field + 4)[0] + 1
            field += 4 + n
        if content[at : at + 2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a BGZF block")
        part = zlib.decompress(content[at + 12 + extra : at + size - 8], -15)
        if (zlib.crc32(part), len(part)) != struct.unpack_from("<II", content, at + size - 8):
            raise ValueError("a BGZF block is damaged")
        out.append(part)
        at += size
    return b"".join(out)


def _record(r, number: dict[str, int]) -> bytes:
    cigar, n = [], ""
    for c in "" if r.cigar in (None, "*") else r.cigar:
        if c.isdigit():
            n += c
        else:
            cigar.append(int(n) << 4 | OPS.index(c))
            n = ""
    seq = "" if r.seq in (None, "*") else r.seq
    codes = [BASES.find(b) if b in BASES else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = b"\xff" * len(seq) if r.qual in (None, "*") else bytes(ord(q) - 33 for q in r.qual)
    name = (r.qname or "*").encode() + b"\x00"
    mate = r.rname if r.rnext == "=" else r.rnext
    fixed = struct.pack("<iiBBHHHiiii", number.get(r.rname, -1), int(r.pos), len(name), int(r.mapq), int(r.bin), len(cigar), int(r.flag), len(seq), number.get(mate, -1), int(r.pnext), int(r.tlen))
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual
    return struct.pack("<i", len(body)) + body


def encoded(records: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """(`by`, content): a BAM file for each value of the column `by`, its records in order of target, place and name.

    `records` has the columns of parsed SAM (pos and pnext 0-based, -1 for none); `targets` (name, len) are the
    references, 100 000 at most, which go into every header.
    """
    refs = [(r["name"], r["len"]) for r in targets.orderBy("name").limit(100_001).collect()]
    if len(refs) > 100_000:
        raise ValueError("a header has 100 000 references at most")
    number = {n: i for i, (n, _) in enumerate(refs)}
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in refs).encode()
    head = MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\x00" + struct.pack("<i", size) for n, size in refs)
    end = F.col("pos") + F.greatest(F.coalesce(F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")), F.lit(0)), F.lit(1))
    full = records.withColumn("bin", F.when(F.col("pos") < 0, 4680).otherwise(sam_bin(F.col("pos"), end)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_t=pdf["rname"].map(number).fillna(len(refs))).sort_values(["_t", "pos", "qname"], kind="stable")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [compressed(head + b"".join(_record(r, number) for r in pdf.itertuples(index=False)))]})

    kind = dict(records.dtypes)[by]
    return full.groupBy(by).applyInPandas(run, f"`{by}` {kind}, content binary")


def _rows(content: bytes) -> Iterator[tuple]:
    data = inflated(content)
    if data[:4] != MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    refs = []
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        refs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    name = lambda i: refs[i] if i >= 0 else "*"
    while at < len(data):
        size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, pnext, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        p, end = at + 36, at + 4 + size
        qname = data[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, p)) or "*"
        p += 4 * n_ops
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in data[p : p + (l_seq + 1) // 2])[:l_seq] or "*"
        p += (l_seq + 1) // 2
        raw = data[p : p + l_seq]
        qual = "*" if not raw or raw[0] == 255 else bytes(q + 33 for q in raw).decode("latin-1")
        yield qname, flag, name(ref), pos, mapq, cigar, "=" if mate >= 0 and mate == ref else name(mate), pnext, tlen, seq, qual
        at = end


def decoded(files: DataFrame, rows: int = 10_000) -> DataFrame:
    """The records of BAM files (column content), as parsed SAM without tags."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                held = []
                for r in _rows(bytes(content)):
                    held.append(r)
                    if len(held) == rows:
                        yield pd.DataFrame(held, columns=NAMES)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=NAMES)

    return files.select("content").mapInPandas(run, RECORD)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))
