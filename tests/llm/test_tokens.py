"""Encoding, decoding and counting against the tokenizers library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm import bpe_tree, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "a<|endoftext|>b", " <|endoftext|> x", "it's they'll 123 #*&", "e\u0301 \u00e9", "\x1c\x1d \x85  q", "aaaa" * 50, "<|endof text|>", "İ I ß ﬁ", "日本語テキスト 한국어", "😀😃a\u200db", "a \n b", "a\n b", "a  b\t\tc ", "\u3000x \u3000", "½ ² ٣ x"]


def messy(seed, n, most):
    r = random.Random(seed)
    parts = ["abc ", "aaaaaa", "ab", "é", "the", "<|endoftext|>", "x" * 30, " ", "'ll", "É", "\n\n", "12"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, most))) for _ in range(n)]
    return out + [t.replace(" ", "").replace("\n", "") for t in out[: n // 3]]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_encoding_equals_the_library(word):
    enc = bpe_tree.Encoder(WORD)
    texts = TRICKY + messy(1, 60, 80)
    for t, ids, decoded in zip(texts, *[x.to_pylist() for x in enc.encode(texts)]):
        want = word.encode(t, add_special_tokens=False).ids
        assert ids == want and decoded == word.decode(want, skip_special_tokens=False), t


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_joined_parts_equal_the_whole(path):
    enc, lib, r = bpe_tree.Encoder(path), Tokenizer.from_file(path), random.Random(4)
    for t in messy(2, 60, 400) + ["a" * 5000, "ab" * 3000, "the<|endoftext|>" * 300]:
        n = r.randint(20, 1500)
        parts = [t[i : i + n] for i in range(0, len(t), n)] or [""]
        for made in (map(enc.tokens, parts), enc.zoned(parts)):
            got = []
            for x in bpe_tree.join_parts(enc, list(zip(parts, made))):
                got += x[0] if isinstance(x[0], tuple) else [x[0]]
            assert got == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_round_trip_of_a_table(odd, none, path):
    lib = Tokenizer.from_file(path)
    rows = bpe_tree.encode_decode(odd, path, ["doc_id", "n"], part=3000).collect()
    want = []
    for r in odd.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, ids, lib.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in rows) == sorted(want)
    assert bpe_tree.encode_decode(none, path, ["doc_id"]).count() == 0


def test_counts_equal_the_library():
    lib, mine = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)
    r = random.Random(6)
    wild = ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x3000, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts = TRICKY + messy(3, 150, 60) + wild
    for t, n in zip(texts, mine.count(texts)):
        assert n == len(lib.encode(t, add_special_tokens=False).ids), t


def test_counting_a_table(odd, none):
    lib = Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, BYTE, ["doc_id"]).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.token_counts(none, BYTE, ["doc_id"]).count() == 0
