"""Counts against the public libraries on whole texts."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakforge.llm.token_lengths import _BySentencePiece, _ByTokenizers, count_batch, segments, token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PIECES = ["Some words, don't we'll", " ", "  ", "\n\n", "\t", "12 345", "éàü ñ", "中文，字。", "😀😀", "<|endoftext|>", "a<|endoftext|> b", "x" * 90,
          " . , ", "'s", "\x1c", "\x85", "é", "the end", "　", "\xa0"]
TEXTS = ["", None, " ", *PIECES, " ".join(PIECES * 40), "word " * 30000, "中" * 3000 + "。" + "文" * 3000, "1" * 5000]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return _BySentencePiece(open(path, "rb").read())
    return _ByTokenizers(open(path, "rb").read())


ENCODERS = {name: library(name) for name in FILES}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12), st.integers(1, 12))
def test_segments_lose_no_token(parts, limit):
    text = "".join(parts)
    for name in FILES[:2]:
        found = list(segments(text, limit))
        assert "".join(found) == text
        assert sum(ENCODERS[name].lengths(found)) == ENCODERS[name].lengths([text])[0], found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "plain words of prose, then more. And so on"]), max_size=12), st.integers(1, 12))
def test_blank_cuts_lose_no_token(parts, limit):
    text = " ".join(parts)
    found = list(segments(text, limit, blank=True))
    encoder = ENCODERS["piece_bpe_32k.model"]
    assert " ".join(found) == text and sum(encoder.lengths(found)) == encoder.lengths([text])[0], found


@pytest.mark.parametrize("name", FILES)
def test_whole_texts(spark, name):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = token_counts(df, public_tokenizers.path(name), batch_bytes=700, segment_chars=300)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, t, _ in rows:
        n = ENCODERS[name].lengths([t or ""])[0]
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), public_tokenizers.path(name)).count() == 0


def test_special_strings_are_one_token():
    model = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    assert len(model.encode("a<|endoftext|>b", add_special_tokens=False)) == 3
    assert ENCODERS[FILES[0]].lengths(["a<|endoftext|>b"]) == [3]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=12), st.integers(1, 12), st.integers(0, 9))
def test_words_lose_no_token(parts, limit, known_words):
    texts = ["".join(parts), " ".join(parts), None]
    for name in FILES[:2]:
        found = count_batch(ENCODERS[name], pa.array(texts, pa.string()), 40, limit, known_words)
        assert found.tolist() == [*ENCODERS[name].lengths(texts[:2]), 0]


def test_a_word_is_encoded_once(monkeypatch):
    """Every word of an encoder batch was encoded wherever it stood."""
    encoder, asked = library(FILES[0]), []
    lengths = encoder.lengths
    monkeypatch.setattr(encoder, "lengths", lambda texts: asked.extend(texts) or lengths(texts))
    texts = ["the old words and the new words " * 50, "and the new words", "the" * 40 + " words"]
    found = count_batch(encoder, pa.array(texts), batch_bytes=10_000)
    assert found.tolist() == lengths(texts)
    assert max(map(asked.count, asked)) == 1 and sum(map(len, asked)) < 200
    assert max(map(len, encoder.known)) <= 64  # a long word is not held
