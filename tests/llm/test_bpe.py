"""Ids and bytes against the public library, and the plain merge loop."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from peakforge.llm.bpe import Codec, decode, encode, fingerprints, merge, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
CODEC = Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "Hello  world", "don't we'll\n\n  x\t", "éàü ñ 中文字 😀😀    x", "a" * 3000, " " * 500, "12345 678 <|endoftext|>",
         "one two " * 20000, "ab" * 700 + "\r\n\x0b\x0c\x1c\x85 end"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_library(text):
    ids = CODEC.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_any_bytes_equal_plain_merging(piece):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
        if best is None:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    assert merge(piece, RANKS) == [RANKS[p] for p in parts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_fingerprints(docs):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in fingerprints(
        docs, PATH, public_tokenizers.PATTERN, remembered=5).collect()}
    want = set()
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = LIBRARY.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows == want


def test_round_trip_columns(docs):
    back = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == len(TEXTS) + 2 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)


def test_empty_table(docs):
    assert fingerprints(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr("peakforge.llm.bpe.LONG", 40)
    text = "Some words, 12 numbers   and spaces\n\n then more words don't end " * 30
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)
