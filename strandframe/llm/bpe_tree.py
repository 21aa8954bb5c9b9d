"""BPE encoding and decoding of whole texts, long ones as a tree of independently encoded parts.

A text up to PART characters is one leaf. A longer one is cut at every PART-th character, whatever stands there, and
its parts are encoded as separate rows on any executor. Neighbours are then joined two by two: a window around the join
is encoded anew and grown until, on both sides, two consecutive tokens of it stand exactly where the side has the same
two (or the text ends). Every two tokens that follow each other are then consecutive in some direct encoding of their
surroundings, which is what makes a sequence of BPE tokens the encoding of the whole; so the result equals that of the
undivided text.

Inside a leaf, the different runs without ASCII white space of a batch are encoded once each, where the tokenizer's normaliser
and pre-tokeniser drop white space and so never join across it (tested when the tokenizer is loaded); otherwise the
leaf goes to the library as it is. Special tokens' strings inside texts are treated as the library does by default.

Defined results: a null or empty text has no tokens and decodes to the empty string; repeated rows and equal ids are
encoded row by row; an empty table gives an empty table; extra columns are carried along.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PART = 32_768
WINDOW = 64
#: Characters from either end of a part within which tokens keep their positions, for joining.
EDGE = 512
#: Bytes of text encoded together, and different runs handed to the library at once.
SLICE, RUNS = 6_000_000, 5_000
WHITE = " \t\n\r\x0b\x0c"


class Encoder:
    """A tokenizers-library tokenizer that encodes each different run of a batch once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.plain = self.tok.decoder is None
        self.pieces = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.apart = all(self._ids(f"a{w}b") == self._ids("a") + self._ids("b") and not self._ids(w) for w in WHITE)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token, in characters."""
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]

    def zoned(self, texts: list[str]) -> list[list[tuple]]:
        """As `tokens`, but all between white space EDGE characters from either end as one entry (a tuple of ids)."""
        spans = []
        for t in texts:
            head, tail = re.compile(r"[ \n]").search(t, EDGE), max(t.rfind(" ", 0, -EDGE), t.rfind("\n", 0, -EDGE))
            spans.append((head.start(), tail) if self.apart and head and head.start() < tail else None)
        inner = iter(self.encode([t[s[0] : s[1]] for t, s in zip(texts, spans) if s])[0].to_pylist())
        out = []
        for t, s in zip(texts, spans):
            if s is None:
                out.append(self.tokens(t))
            else:
                ids = tuple(next(inner))
                out.append([*self.tokens(t[: s[0]]), *([(ids, *s)] if ids else []), *[(i, a + s[1], b + s[1]) for i, a, b in self.tokens(t[s[1] :])]])
        return out

    def _batch(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of each text, directly by the library."""
        ids, decoded = [], []
        for at in range(0, len(texts), RUNS):
            found = [e.ids for e in self.tok.encode_batch_fast(texts[at : at + RUNS], add_special_tokens=False)]
            ids.append(pa.array(found, pa.list_(pa.int32())))
            decoded.append(pa.array([self.decode(i) for i in found], pa.string()))
        return pa.concat_arrays(ids), pa.concat_arrays(decoded)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of each text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts) or not (self.apart and self.plain):
            return self._batch(texts.to_pylist() or [""])
        runs = pc.ascii_split_whitespace(texts)
        at = runs.offsets.to_numpy()
        flat = runs.flatten().dictionary_encode()
        ids, decoded = self._batch(flat.dictionary.to_pylist())
        which = flat.indices.to_numpy()
        sizes = np.diff(ids.offsets.to_numpy())[which]
        if not sizes.all():  # empty runs at the ends, and those that the tokenizer drops
            held = sizes > 0
            at = np.concatenate([[0], np.cumsum(held)])[at]
            which, sizes = which[held], sizes[held]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        taken = ids.take(pa.array(which)).flatten()
        words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), decoded.take(pa.array(which)))
        return pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), taken), pc.binary_join(words, " ")

    def decode(self, ids: list[int]) -> str:
        if self.plain:  # the library joins the token strings with spaces
            return " ".join(map(self.pieces.__getitem__, ids))
        return self.tok.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _agreement(side: dict[tuple[int, int, int], int], ordered: list, window: list, from_left: bool) -> tuple[int, int] | None:
    """Positions (in the side, in the window) of the first token of a pair that both have; nearest to the window's edge."""
    order = range(len(window) - 1) if from_left else range(len(window) - 2, -1, -1)
    for k in order:
        i = side.get(window[k])
        if i is not None and i + 1 < len(ordered) and ordered[i + 1] == window[k + 1]:
            return i, k
    return None


def join_tokens(enc: Encoder, text: str, left: list, right: list, at: int) -> list:
    """The tokens of `text` from those of text[:at] and text[at:], both with positions in `text`."""
    size = WINDOW
    while True:
        lo, hi = max(0, at - size), min(len(text), at + size)
        if lo == 0 and hi == len(text):
            return enc.tokens(text)
        window = [(i, a + lo, b + lo) for i, a, b in enc.tokens(text[lo:hi])]
        near_left, near_right = left[-4 * size :], right[: 4 * size]
        head = (0, 0) if lo == 0 else _agreement({t: k for k, t in enumerate(near_left)}, near_left, window, True)
        tail = (len(near_right), len(window)) if hi == len(text) else _agreement({t: k for k, t in enumerate(near_right)}, near_right, window, False)
        # the pair on the left must end before the join and the one on the right begin after it
        if head and tail and head[1] + (lo > 0) <= tail[1] and (lo == 0 or window[head[1] + 1][2] <= at) and (hi == len(text) or window[tail[1]][1] >= at):
            begin = [] if lo == 0 else left[: len(left) - len(near_left) + head[0]]
            return begin + window[head[1] : tail[1]] + near_right[tail[0] :] + right[len(near_right) :]
        size *= 2


def join_parts(enc: Encoder, parts: list[tuple[str, list]]) -> list:
    """Tree of joins over (text, tokens with positions in that text)."""
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            (a, left), (b, right) = parts[k], parts[k + 1]
            joined.append((a + b, join_tokens(enc, a + b, left, [(i, s + len(a), e + len(a)) for i, s, e in right], len(a))))
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][1]


def _columns(b: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [b.column(b.schema.names.index(n)) for n in names]


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of about SLICE bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(_columns(batch, [name])[0]), 0).to_numpy(zero_copy_only=False)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for b in (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i):
            held.append(b)
            size += b.nbytes
            if size >= SLICE:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode_decode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", part: int = PART) -> DataFrame:
    """The columns `keep` with `ids` (array<int>) and `decoded` (string) for every row; `path` is a tokenizer.json."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep).schema
    short = docs.where(F.col(text_col).isNull() | (F.length(text_col) <= part)).select(*keep, F.col(text_col).alias("_text"))
    long = docs.where(F.length(text_col) > part).select(*keep, F.col(text_col).alias("_text"), F.concat(F.md5(F.col(text_col).cast("binary")), F.xxhash64(*keep).cast("string")).alias("_row"))

    def leaves(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(it, "_text"):
            yield pa.RecordBatch.from_arrays([*_columns(b, keep), *enc.encode(_columns(b, ["_text"])[0])], [*keep, "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in _slices(it, "_text"):
            got = enc.zoned(_columns(b, ["_text"])[0].to_pylist())
            ids = pa.array([[list(t[0]) if isinstance(t[0], tuple) else [t[0]] for t in g] for g in got], pa.list_(pa.list_(pa.int32())))
            flat = [ids, *[pa.array([[t[k] for t in g] for g in got], pa.list_(pa.int32())) for k in (1, 2)]]
            names = [*keep, "_text", "_row", "_part"]
            yield pa.RecordBatch.from_arrays([*_columns(b, names), *flat], [*names, "_ids", "_from", "_to"])

    def whole(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        at = table.column("_part").to_pylist()
        rows = table.select(["_text", "_ids", "_from", "_to"]).take([at.index(k) for k in range(max(at) + 1)]).to_pylist()
        single = lambda x: x[0] if len(x) == 1 else tuple(x)
        found = join_parts(enc, [(r["_text"], [(single(i), a, b) for i, a, b in zip(r["_ids"], r["_from"], r["_to"])]) for r in rows])
        ids = list(chain.from_iterable(t[0] if isinstance(t[0], tuple) else (t[0],) for t in found))
        # equal rows meet in one group and come out as often as they went in
        first = [table.slice(0, 1).column(n).combine_chunks() for n in keep]
        row = pa.RecordBatch.from_arrays([*first, pa.array([ids], pa.list_(pa.int32())), pa.array([enc.decode(ids)])], [*keep, "ids", "decoded"])
        return pa.Table.from_batches([row] * at.count(0))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    starts = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / part).cast("int"))
    cut_up = long.select(*keep, "_row", "_text", F.explode(starts).alias("_part")).withColumn("_text", F.substring("_text", F.col("_part") * part + 1, F.lit(part)))
    pieces = cut_up.repartition("_row", "_part").mapInArrow(parts, f"{out}, _text string, _row string, _part int, _ids array<array<int>>, _from array<int>, _to array<int>")
    ready = f"{out}, ids array<int>, decoded string"
    return short.mapInArrow(leaves, ready).unionByName(pieces.groupBy("_row").applyInArrow(whole, ready))
