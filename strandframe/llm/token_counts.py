"""Token counts by rank-synchronous merging of arrays.

A byte-level BPE tokenizer.json gives the ranks; the pre-tokens of a batch are held as one ragged array of symbols.
In each round every sequence merges, at all places at once, its own pair of lowest rank; sequences without a mergeable
pair leave. The symbols that survive are counted. Each different chunk of a batch goes through this once.

Chunks are the stretches between single spaces (the space belongs to the chunk after it). A pre-token never crosses
such a border when neither side of the space is white space; a text with any other border is split by the
pre-tokeniser's pattern as a whole. Special tokens' strings inside texts count one token, as the library has it.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are counted one by one, whatever their ids;
an empty table gives an empty table; extra columns named in `keep` are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

#: Fixed value: the byte-level pre-tokeniser's public pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 8_000_000


def byte_symbols() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.symbol = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def merged(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each sequence of bytes ends with."""
        none = len(self.made)
        sizes = np.array([len(s) for s in sequences], np.int64)
        out = sizes.copy()
        symbols = self.symbol[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        while len(symbols) > 1:
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            span = np.diff(np.r_[first, len(symbols)])
            least = np.repeat(lowest, span)
            hit = (rank == least) & (rank < none)
            if hit.any():
                # of overlapping places (aaa) every second one counts, from the left
                run = np.flatnonzero(hit)
                begin = np.r_[True, np.diff(run) > 1]
                nth = np.arange(len(run)) - np.maximum.accumulate(np.where(begin, np.arange(len(run)), 0))
                run = run[nth % 2 == 0]
                symbols[run] = self.made[rank[run]]
                gone = np.zeros(len(symbols), bool)
                gone[run + 1] = True
                np.subtract.at(out, owner[run], 1)
            else:
                gone = np.zeros(len(symbols), bool)
            # sequences without a mergeable pair are ready
            stay = ~gone & (least < none)
            symbols, owner = symbols[stay], owner[stay]
        return out

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text without special strings: pre-tokens of all, each different one merged once."""
        # beyond common scripts the library's tables of letters and digits may be of another Unicode version
        found = [self.pattern.findall(t) if t.isascii() or max(t) < "\u0530" else [t[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(t)] for t in texts]
        flat = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        if not len(flat):
            return np.zeros(len(texts), np.int64)
        each = self.merged([p.encode() for p in flat.dictionary.to_pylist()])[flat.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum([0, *map(len, found)])
        return sums[ends[1:]] - sums[ends[:-1]]

    def whole(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return int(self.pieces(parts).sum()) + len(parts) - 1

    def count(self, texts: list[str | None]) -> np.ndarray:
        chunks = [(t or "").split(" ") for t in texts]
        ends = np.cumsum([0, *map(len, chunks)])
        flat = pa.array(list(chain.from_iterable(chunks)), pa.string()).dictionary_encode()
        if not len(flat):
            return np.zeros(len(texts), np.int64)
        different = flat.dictionary.to_pylist()
        # white space at a chunk's border, or a special string, sends the text the slow way
        odd = np.array([not c or c[0].isspace() or c[-1].isspace() for c in different])
        which = flat.indices.to_numpy()
        leads = np.zeros(len(which), bool)
        leads[ends[:-1][ends[:-1] < ends[1:]]] = True
        inner = self.pieces([" " + c for c in different])[which]
        firsts = flat.dictionary.take(pa.array(np.unique(which[leads]))).to_pylist()
        opening = np.zeros(len(different), np.int64)
        opening[np.unique(which[leads])] = self.pieces(firsts)
        each = np.where(leads, opening[which], inner)
        sums, odds = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(odd[which])])
        out = sums[ends[1:]] - sums[ends[:-1]]
        slow = odds[ends[1:]] > odds[ends[:-1]]
        for i, t in enumerate(texts):
            if t and (slow[i] or self.special and self.special.search(t)):
                out[i] = self.whole(t)
            elif not t:
                out[i] = 0
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with n_bytes and n_tokens of every row; `path` is a byte-level BPE tokenizer.json."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(path)
        for batch in it:
            texts = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            cuts = np.flatnonzero(np.diff(np.cumsum(size.to_numpy(zero_copy_only=False)) // SLICE)) + 1
            n = [found.count(texts[i:j].to_pylist()) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, pa.array(np.concatenate(n), pa.int64())], [*keep, "n_bytes", "n_tokens"])

    kept = docs.select(*keep, docs[text_col].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(run, schema + ", n_bytes long, n_tokens long")
