"""Toxicity by nearest labelled examples: exact cosine over a block-max inverted index.

Terms are whole lower-cased words (ASCII punctuation parts words); every word of the examples is in the index. A
term's weight is (1 + ln tf) * idf * (1 + sqrt(G)): idf comes from all documents, and G is the log-likelihood ratio
of how its word divides between the toxic and the clean examples, the usual supervised factor of TF-IDF. (Without that
factor rare invented words, not the abusive ones, decide who is near; see the README for figures.)

A document is compared exactly with every example: rare terms are added up through their postings, and of the frequent
ones only the blocks whose upper bound reaches the k-th best cosine are computed, which loses nothing. The nearest k
vote with the square of their cosine. Leave-one-out votes of the examples, made monotone and joined by straight lines,
turn a vote into a probability; the neighbours are returned as evidence.

The examples are a bounded sample of the labelled rows, at most MAX_EXAMPLES of each class, the least by hash of their
id; of near copies among them (half of the five-word shingles seen before) the first stands for all. Votes, prior and
calibration weight each class by its share among all labels. All else covers all rows and whole texts.

Defined results: a text without any word of the examples (null and empty ones too) has no neighbour and gets the share
of toxic rows among all labels; rows with a null id or label teach nothing; an id with several labels is toxic if one
says so; of several texts under one id all are examples; without labels every score is 0.0; repeated rows score alike;
extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc, small_batches

MAX_EXAMPLES = 1500
NEIGHBOURS = 15
BLOCK = 64
#: Terms in over this share of the examples are held densely and computed block by block.
FREQUENT = 0.04
#: Documents that are compared together.
BATCH = 128
#: Weight of the prior in a vote, in squared cosines.
PRIOR_WEIGHT = 0.02
THRESHOLD = 0.5
#: Bytes of text that are turned into terms together.
SLICE = 4_000_000
#: Every ASCII character that is neither letter nor digit parts words.
_APART = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words begin (and end), the number of each word, and the different words."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    if not len(low):
        return np.zeros(1, np.int64), np.empty(0, np.int64), pa.array([], pa.string())
    _, offsets, raw = low.buffers()
    parted = _APART[np.frombuffer(raw, np.uint8)] if raw is not None and raw.size else np.empty(0, np.uint8)
    runs = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(low), offsets, pa.py_buffer(parted.tobytes()), offset=low.offset))
    flat = runs.flatten().dictionary_encode()
    return runs.offsets.to_numpy().astype(np.int64), flat.indices.to_numpy().astype(np.int64), flat.dictionary


class Bags:
    """Terms of several texts: for the i-th entry its text, its term and how often it occurs; sorted by text and term."""

    def __init__(self, texts: pa.Array, vocabulary: pa.Array):
        ends, which, known = tokens(texts)
        term = pc.fill_null(pc.index_in(known, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[which]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        code = np.sort((text * (len(vocabulary) + 1) + term)[term >= 0])
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
        self.n = len(ends) - 1
        self.text, self.term = np.divmod(code[first], len(vocabulary) + 1)
        self.tf = np.diff(np.r_[first, len(code)]).astype(np.float64)

    def each(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and counts of every text."""
        at = np.searchsorted(self.text, np.arange(self.n + 1))
        return [(self.term[i:j], self.tf[i:j]) for i, j in zip(at, at[1:])]

    def parts(self) -> Iterator["Bags"]:
        """BATCH texts at a time."""
        for begin in range(0, self.n, BATCH):
            i, j = np.searchsorted(self.text, (begin, begin + BATCH))
            part = Bags.__new__(Bags)
            part.n, part.text, part.term, part.tf = min(BATCH, self.n - begin), self.text[i:j] - begin, self.term[i:j], self.tf[i:j]
            yield part

    @classmethod
    def of(cls, vectors: list[tuple[np.ndarray, np.ndarray]]) -> "Bags":
        self = cls.__new__(cls)
        self.n = len(vectors)
        self.text = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        self.term, self.tf = (np.concatenate([v[k] for v in vectors] or [np.empty(0)]) for k in (0, 1))
        self.term = self.term.astype(np.int64)
        return self


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, about SLICE bytes at a time."""
    at = size = 0
    for n, b in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n > at and size + b > SLICE:
            yield texts.slice(at, n - at)
            at, size = n, 0
        size += b
    if at < len(texts):
        yield texts.slice(at)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def first_of_copies(ends: np.ndarray, which: np.ndarray, size: int = 5) -> list[int]:
    """Positions of the texts without those of whose shingles at least half stood in texts kept before.

    Texts are given as `tokens` does. Shingles are numbered once, so that what has been seen is an array of flags.
    """
    mixed = which.astype(np.uint64) + np.uint64(1)
    parts = []
    for a, b in zip(ends, ends[1:]):
        n = max(1, b - a - size + 1)
        code = np.zeros(n, np.uint64)
        for k in range(min(size, b - a)):
            code = (code ^ mixed[a + k : a + k + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        parts.append(np.unique(code))
    known, number = np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]), return_inverse=True)
    seen, out, at = np.zeros(len(known), bool), [], 0
    for n, part in enumerate(parts):
        own = number[at : at + len(part)]
        at += len(part)
        if 2 * seen[own].sum() < len(own):
            out.append(n)
            seen[own] = True
    return out


def separation(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Square root of the log-likelihood ratio of each term's 2 x 2 table of examples."""

    def part(x, row, col):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) * (n_toxic + n_clean) / np.maximum(row * col, 1e-300)), 0.0)

    both, n = toxic + clean, n_toxic + n_clean
    g = part(toxic, both, n_toxic) + part(clean, both, n_clean) + part(n_toxic - toxic, n - both, n_toxic) + part(n_clean - clean, n - both, n_clean)
    return np.sqrt(np.maximum(2 * g, 0.0))


class BlockMaxIndex:
    """Exact top-k cosine over a bounded set of sparse examples: (id, label, terms, counts), and a weight for each term."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: np.ndarray):
        self.weight = weight
        held = [e for e in examples if len(e[2])]
        df = np.bincount(np.concatenate([e[2] for e in held] or [np.empty(0, np.int64)]), minlength=len(weight))
        often = df > max(BLOCK, FREQUENT * len(held))
        # neighbours in this order share their commonest terms, so that a block's bounds are tight
        held.sort(key=lambda e: (tuple(e[2][np.argsort(-df[e[2]], kind="stable")[:4]].tolist()), e[0]))
        self.ids = np.array([e[0] for e in held], np.int64)
        self.labels = np.array([e[1] for e in held], np.float64)
        self.vectors = [e[2:] for e in held]
        self.blocks = max(1, -(-len(held) // BLOCK))
        self.row = np.full(len(weight), -1, np.int64)
        self.row[often] = np.arange(often.sum())
        self.dense = np.zeros((self.blocks, int(often.sum()), BLOCK), np.float32)
        terms, places, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at, (t, n) in enumerate(self.vectors):
            w, f = self.unit(Bags.of([(t, n)])), often[t]
            self.dense[at // BLOCK, self.row[t[f]], at % BLOCK] = w[f]
            terms.append(t[~f])
            places.append(np.full((~f).sum(), at))
            values.append(w[~f])
        terms = np.concatenate(terms)
        order = np.argsort(terms, kind="stable")
        self.place, self.value = np.concatenate(places)[order].astype(np.int32), np.concatenate(values)[order].astype(np.float32)
        self.start = np.searchsorted(terms[order], np.arange(len(weight) + 1)).astype(np.int64)
        self.maxima = self.dense.max(axis=2).T.copy()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": None}  # needed for calibration only

    def unit(self, bags: Bags) -> np.ndarray:
        """The entries' weights, each text's of length 1."""
        w = (1 + np.log(bags.tf)) * self.weight[bags.term]
        norm = np.sqrt(np.bincount(bags.text, w * w, bags.n))
        return w / np.where(norm > 0, norm, 1)[bags.text]

    def nearest(self, bags: Bags, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the positions and cosines of the k nearest with a cosine over 0, best first, ties by position."""
        width, m = self.blocks * BLOCK, bags.n
        k = min(k, width)
        w, row = self.unit(bags), self.row[bags.term]
        often = np.zeros((m, self.dense.shape[1]), np.float32)
        f = row >= 0
        often[bags.text[f], row[f]] = w[f]
        begin = self.start[bags.term[~f]]
        size = self.start[bags.term[~f] + 1] - begin
        # the postings of all rare terms as one gather and one sum by text and place
        at = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]][: len(size)], size) + np.arange(size.sum())
        where = np.repeat(bags.text[~f] * width, size) + self.place[at]
        score = np.bincount(where, np.repeat(w[~f], size) * self.value[at], m * width).astype(np.float32).reshape(m, width)
        if without is not None:
            score[np.arange(m), without] = -4
        # a cosine is its rare part and at most the bound of its block, and not under its rare part
        bound = often @ self.maxima + score.reshape(m, self.blocks, BLOCK).max(axis=2)
        least = np.partition(score, width - k, axis=1)[:, width - k]
        for b in range(self.blocks):
            open_ = np.flatnonzero(bound[:, b] >= least - 1e-6)
            if len(open_):
                score[open_, b * BLOCK : (b + 1) * BLOCK] += often[open_] @ self.dense[b]
        # in closed blocks scores lack their frequent part, but none of them can be among the k best
        kth = np.partition(score, width - k, axis=1)[:, width - k]
        out = []
        for n in range(m):
            tied = np.flatnonzero(score[n] >= max(kth[n], 1e-7))
            tied = tied[np.lexsort((tied, -score[n, tied]))][:k]
            out.append((tied, score[n, tied].astype(np.float64)))
        return out


class Model:
    """`examples` are (id, label, terms, counts); `share` is that of toxic rows among all labels."""

    def __init__(self, vocabulary: pa.Array, weight: np.ndarray, examples: list, share: float):
        self.vocabulary, self.index, self.prior = vocabulary, BlockMaxIndex(examples, weight), share
        toxic, n = float(self.index.labels.sum()), len(self.index.labels)
        self.by_label = (1 - share) * n / max(1.0, n - toxic), share * n / max(1.0, toxic)
        self.at, self.level = self._calibrate()

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        y = self.index.labels[near]
        w = cosines * cosines * np.where(y > 0, self.by_label[1], self.by_label[0])
        return float((PRIOR_WEIGHT * self.prior + (w * y).sum()) / (PRIOR_WEIGHT + w.sum()))

    def _calibrate(self) -> tuple[list[float], list[float]]:
        """Leave-one-out votes and shares of toxic examples: adjacent violators are pooled; lines join the pools."""
        x = self.index
        votes = []
        for at in range(0, len(x.labels), BATCH):
            places = list(range(at, min(at + BATCH, len(x.labels))))
            found = x.nearest(Bags.of([x.vectors[n] for n in places]), NEIGHBOURS, places)
            votes += [(self.vote(*f), float(x.labels[n])) for n, f in zip(places, found)]
        pools: list[list[float]] = []
        for v, y in sorted(votes):
            w = self.by_label[int(y)]
            pools.append([v * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        level = np.maximum.accumulate([(p[1] + self.prior) / (p[2] + 1) for p in pools]) if pools else np.empty(0)
        # a vote of nothing but clean or toxic rows ends the lines
        return [0.0, *[p[0] / p[2] for p in pools], 1.0], [0.0, *level.tolist(), 1.0]

    def score(self, texts: pa.Array) -> list[tuple[float, list[int], list[float]]]:
        """For each text its probability of toxicity, the ids of its nearest examples and their cosines."""
        out = []
        for part in slices(texts):
            for bags in Bags(part, self.vocabulary).parts():
                for near, cosines in self.index.nearest(bags, NEIGHBOURS):
                    p = float(np.interp(self.vote(near, cosines), self.at, self.level)) if len(near) else self.prior
                    out.append((p, self.index.ids[near].tolist(), cosines.tolist()))
        return out


def learns(doc_id: Column) -> Column:
    return id_crc(doc_id) % 5 != 0


def document_frequencies(docs: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are; one row a term reaches the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in it:
            for part in slices(b.column(0)):
                np.add.at(seen, Bags(part, vocabulary).term, 1)
            rows += b.num_rows
        seen[-1] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learns(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda y: marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
    sample = cut(pick(1).unionByName(pick(0)))
    labelled = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = labelled.get(1, 0) / max(1, sum(labelled.values()))
    # the sample has 2 * MAX_EXAMPLES rows at most; of several texts under one id the least is the example
    known = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    texts = known.column("text").combine_chunks()
    ends, which, words = tokens(texts)
    first = first_of_copies(ends, which)
    used = np.unique(np.concatenate([which[ends[n] : ends[n + 1]] for n in first] or [np.empty(0, np.int64)]))
    del ends, which
    found = words.take(pa.array(used, pa.int64()))
    vocabulary = found.filter(pc.not_equal(found, ""))
    df, rows = document_frequencies(docs, vocabulary)
    at = pa.array(first, pa.int64())
    ids, marks = (known.column(c).combine_chunks().take(at).to_pylist() for c in ("doc_id", "toxic"))
    examples = [(i, y, *v) for i, y, v in zip(ids, marks, Bags(texts.take(at), vocabulary).each())]
    del known, texts, words, found
    by = np.zeros((2, len(vocabulary)))
    for _, y, terms, _ in examples:
        by[y, terms] += 1
    toxic = sum(e[1] for e in examples)
    weight = (np.log((1 + rows) / (1 + df)) + 1) * (1 + separation(by[1], by[0], toxic, len(examples) - toxic))
    model = Model(vocabulary, weight, examples, share)
    pa.default_memory_pool().release_unused()
    return model


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and evidence (ids and cosines of the nearest examples) of every document."""
    model = fit(docs, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = model.score(_column(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["doc_id", "score", "neighbours", "cosines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, neighbours array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose score is under THRESHOLD, with all their columns."""
    model = fit(docs, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([p < THRESHOLD for p, _, _ in model.score(_column(b, "text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
