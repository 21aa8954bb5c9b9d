"""Near-duplicate detection with SetSketch registers.

A text's set holds its distinct shingles of `size` words (lower-cased A-Z, words apart by ASCII white space); a text
with fewer words is one shingle. Equal sets become one node. Each node gets SetSketch registers: for each register the
least of exponentially distributed hashes of the shingles, kept as its exponent floor(1 - log_b x), truncated; the
registers of a union are the larger of each pair (`merge`). Bands of registers put similar nodes in common buckets:
at 84.9 % similarity and above all but some 3 in a million pairs meet. A pair that meets is first judged by the joint
maximum-likelihood estimate from its registers and sizes (it goes only if the threshold is less likely than the
estimate by a factor of e^25), then confirmed on the full sets.

Buckets are never expanded into all their pairs. First every node is compared with one centre, the member of its
buckets with the most company. What that links is one component. Only buckets that still hold several components are
compared further, in blocks of BLOCK members on as many tasks as there are pairs of blocks, and a block hands on only
links that join components. Components come from hooking to the least neighbour and pointer jumping.

Defined results: null or empty texts have an empty set and are linked with nothing; rows with equal ids are judged by
their own text; a row with a null id takes part and its component is the least id of its group (null if it has none);
an empty table gives an empty table; extra columns, whatever their names, are ignored by `classes` and kept by
`first_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

ROWS, BANDS = 5, 22
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base, rate, largest exponent.
BASE, RATE, LARGEST = 1.001, 20.0, 65_534
BLOCK = 256
REMEMBERED = 60_000
UNLIKELY = 25.0
_draw = np.random.default_rng(20240229)
_LOW = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_HIGH = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_MIX = [np.uint64(x) for x in _draw.integers(0, 2**63, 3, dtype=np.uint64) | np.uint64(1)]


class Words(dict):
    """64-bit hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, known: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the text's set."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set as uint16."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        x = low[i : i + 1024, None] * _LOW
        x += high[i : i + 1024, None] * _HIGH
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(above, below, equal, n_a, n_b, similarity):
    """Of a Jaccard similarity, from how many registers of a are above, below and equal to those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def part(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    p, q = part(u - v * similarity), part(v - u * similarity)
    return above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))


_GRID = np.linspace(0.0, 0.995, 40)


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of rows of registers (on a grid) and its log likelihood."""
    above, below = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = a.shape[-1] - above - below
    best, at = np.full(np.shape(above), -np.inf), np.zeros(np.shape(above))
    for s in _GRID:
        found = log_likelihood(above, below, equal, n_a, n_b, s)
        found = np.where(s <= np.minimum(n_a / n_b, n_b / n_a) + 0.03, found, -np.inf)
        at, best = np.where(found > best, s, at), np.maximum(found, best)
    return at, best


def possible(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """False where the sizes rule the threshold out, or the registers make it unlikelier than the estimate by e^UNLIKELY."""
    s = percent / 100
    n_a, n_b, equal = np.broadcast_arrays(np.asarray(n_a, np.float64), np.asarray(n_b, np.float64), (a == b).sum(axis=-1))
    may = np.minimum(n_a, n_b) >= s * np.maximum(n_a, n_b) - 1e-9
    # only registers with fewer equal values than the threshold lets expect can speak against it
    asked = np.flatnonzero(may & (equal < s * REGISTERS))
    if len(asked):
        x, y = (np.broadcast_to(r, (len(may), REGISTERS))[asked] for r in (a, b))
        est, best = estimate(x, y, n_a[asked], n_b[asked])
        above, below = (x > y).sum(axis=-1), (x < y).sum(axis=-1)
        at = log_likelihood(above, below, REGISTERS - above - below, n_a[asked], n_b[asked], s)
        may[asked] = (est >= s) | (at >= best - UNLIKELY)
    return may


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _col(b, name: str) -> list:
    return b.column(b.schema.names.index(name)).to_pylist()


def _sketch(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                n, keys, regs = [], [], []
                for t in b.column(1).to_pylist():
                    s = shingles(t, size, known)
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    regs.append(registers(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_key", "n", "key", "regs"])

    return run


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key (names the text), n (set size), key (names the set) and regs of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key"))
    return named.mapInArrow(_sketch(size), "doc_id long, text_key string, n long, key binary, regs binary")


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sets(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                sets = [shingles(t, size, known) for t in _col(b, "text")]
                same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, _col(b, "key"))], pa.bool_())
                out = pa.RecordBatch.from_arrays([b.column(b.schema.names.index("node")), pa.array([s.tobytes() for s in sets], pa.binary()), b.column(b.schema.names.index("regs"))], ["node", "items", "regs"])
                yield out.filter(same)

    return run


def _confirm(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            a, c = ([np.frombuffer(x, np.uint64) for x in _col(b, n)] for n in ("items", "other_items"))
            ra, rc = (np.array([np.frombuffer(x, np.uint16) for x in _col(b, n)]) for n in ("regs", "other_regs"))
            may = possible(ra, rc, np.array([len(x) for x in a]), np.array([len(x) for x in c]), percent)
            yield b.select(["a", "b"]).filter(pa.array([bool(m) and linked(x, y, percent) for m, x, y in zip(may, a, c)], pa.bool_()))

    return run


class Union(dict):
    def find(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _block(percent: int):
    """Links that join components among the members of one or two blocks of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["node", "comp", "block", "lo", "hi", "items", "regs"]).to_pylist()
        sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
        regs = np.array([np.frombuffer(r["regs"], np.uint16) for r in rows])
        sizes = np.array([len(s) for s in sets], np.float64)
        comp, block = np.array([r["comp"] for r in rows]), np.array([r["block"] for r in rows])
        up, links = Union(), []
        across = rows[0]["lo"] != rows[0]["hi"]
        for i in range(len(rows)):
            later = np.arange(i + 1, len(rows))
            later = later[comp[later] != comp[i]]
            if across:
                later = later[block[later] != block[i]]
            if not len(later):
                continue
            may = later[possible(regs[i][None, :], regs[later], sizes[i], sizes[later], percent)]
            for j in may:
                a, b = up.find(int(comp[i])), up.find(int(comp[j]))
                if a != b and linked(sets[i], sets[int(j)], percent):
                    up[max(a, b)] = min(a, b)
                    links.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp (least node that links reach) of every node in a link (columns a and b)."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = cut(parent.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.drop("moved")
            if not moved:
                break
        if found is None:
            found = parent
        else:
            step = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            found = cut(found.join(step, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
        a, b = (parent.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_")) for x in ("a", "b"))
        edges = cut(edges.join(a, "a").join(b, "b").where("a_ <> b_").select(F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if found is None else found


def _component_of_nodes(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """node and comp of every node that is linked with another."""
    bands = nodes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = cut(bands.join(shared, "band"))
    company = met.groupBy("node").agg(F.sum("c").alias("company"))
    centre = met.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("centre"))
    pairs = cut(met.join(centre, "band").groupBy("node").agg(F.max("centre").alias("centre")).where("centre.node <> node").select(F.col("node").alias("a"), F.col("centre.node").alias("b")))

    # the texts of all nodes that share a bucket, read once more by the least id that has them
    wanted = nodes.join(company.select("node"), "node").select("node", "key", "regs", F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    known = wanted.where("doc_id is not null").join(texts, "doc_id").select("node", "key", "regs", "text")
    bare = wanted.where("doc_id is null").join(texts.where("doc_id is null").withColumn("text_key", F.md5(F.col("text").cast("binary"))).dropDuplicates(["text_key"]).select("text").mapInArrow(_keyed(size), "key binary, text string"), "key").select("node", "key", "regs", "text")
    sets = cut(known.unionByName(bare).mapInArrow(_sets(size), "node long, items binary, regs binary").dropDuplicates(["node"]))

    left = pairs.join(sets.withColumnRenamed("node", "a"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("other_items"), F.col("regs").alias("other_regs")), "b")
    links = cut(both.mapInArrow(_confirm(percent), "a long, b long"))
    comps = components(links)

    placed = met.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rest = placed.select("band", "node", "comp").join(open_, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.select("band", "node", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select("band", "node", "comp", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    joins = cut(rest.join(sets, "node").groupBy("band", "lo", "hi").applyInArrow(_block(percent), "a long, b long"))
    more = components(joins)
    all_ = comps.unionByName(more.join(comps, "node", "left_anti"))
    step = more.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return cut(all_.join(step, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def _keyed(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in it:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(shingles(t, size, known).tobytes()) for t in texts], pa.binary()), pa.array(texts, pa.string())], ["key", "text"])

    return run


def _classed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_key, n and comp (a number for the component; null without words) of every row."""
    small_batches(docs.sparkSession)
    rows = cut(sketch(docs, size))
    nodes = cut(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")).withColumn("node", F.monotonically_increasing_id()))
    comps = _component_of_nodes(docs, nodes, size, percent)
    by_key = nodes.select("node", "key").join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    return rows.drop("regs").join(by_key, "key", "left").select("doc_id", "text_key", "n", "comp")


def classes(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (first of its component) of every row."""
    rows = cut(_classed(docs, size, percent))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("comp is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = rows.join(least, "comp").select("doc_id", "n", "component_id").unionByName(alone)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, that come first in their component: least id (null last), then text.

    Rows are named by id and text, so rows of one id with different texts are judged apart; of rows that are equal in
    both the one with the least hash of all its columns stays. Rows without a word are all kept.
    """
    if "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    rows = _classed(docs, size, percent)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "text_key")).alias("f")).select("f.*", F.lit(True).alias("_one"))
    bare = rows.where("comp is null").select(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "text_key", F.lit(False).alias("_one")).distinct()
    whole = docs.select(F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), _text_key(F.col("text")).alias("text_key"), F.xxhash64(*docs.columns).alias("_hash"), F.struct("*").alias("_doc"))
    name = ["_null", "_id", "text_key"]
    stay = whole.join(first.unionByName(bare), name)
    once = stay.withColumn("_nth", F.row_number().over(Window.partitionBy(*name).orderBy("_hash")))
    return once.where("_nth = 1 or not _one").select("_doc.*")
