"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts of an Arrow batch are cut into segments of bounded size at places no token can cross, the segments are dealt into
encoder batches of equal bytes, and only the lengths of the id lists come back, added up per text. So neither a long text nor a batch of
many long texts ever has more than one encoder batch of ids in memory. A byte-level vocabulary gets words, and each of them once:
a bounded memory of the Python worker holds their lengths.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 19  # bytes of text handed to the encoder at once
SEGMENT_CHARS = 1 << 14  # longer texts are cut
KNOWN_WORDS = 1 << 18  # words whose lengths a Python worker holds
KNOWN_CHARS = 64  # longer words are not held

# A piece of the byte-level and the word vocabularies never runs from a character that is no white space into white space,
# nor from a letter into a mark outside ASCII; the special strings hold neither.
_PIECE_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\r\t])|(?<=\p{L})(?=[^\x00-\x7F\s\x1c-\x1f\p{L}\p{N}\p{M}])")
# The same places but those within a word: every match begins at one. Other white space than these four is no place to cut.
_WORDS = re.compile(r"\s*(?:\S+(?:[^\S \n\r\t]\s*)?)+|\s+")
# A sentence piece starts with the mark that a blank becomes; the blank itself is left out, as every text gets that mark in front.
_BLANK_CUT = regex.compile(r"(?<=[a-zA-Z,.]) (?=[a-zA-Z])")


def segments(text: str, limit: int = SEGMENT_CHARS, blank: bool = False):
    """Parts of about ``limit`` characters, cut only where tokens end; a stretch without such a place stays whole."""
    cut, first = (_BLANK_CUT if blank else _PIECE_CUT), 0
    while len(text) - first > limit:
        found = cut.search(text, first + limit)
        if found is None:
            break
        yield text[first:found.start()]
        first = found.end()
    yield text[first:]


def _by_word(vocabulary: dict) -> bool:
    """Whether words may be encoded one by one: byte-level pieces of the text as it is, special strings without white space."""
    before = vocabulary.get("pre_tokenizer") or {}
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not vocabulary.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in vocabulary.get("added_tokens") or []))


class _ByTokenizers:
    """Lengths by a ``.json`` vocabulary; special strings inside a text count as the library's default has it."""
    blank = False

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(source.decode())
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[str, int] | None = {} if _by_word(json.loads(source)) else None

    def lengths(self, texts: list[str]) -> list[int]:
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        return [len(e) for e in encode(texts, add_special_tokens=False)]


class _BySentencePiece:
    """Lengths by a ``.model`` vocabulary."""
    blank = True
    known = None

    def __init__(self, source: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


#: The encoder of this Python worker, by the vocabulary it was made for.
_ENCODERS: dict = {}


def _encoder(name: str, shared):
    if name not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        kind, source = shared.value
        _ENCODERS.clear()
        _ENCODERS[name] = (_BySentencePiece if kind == "model" else _ByTokenizers)(source)
    return _ENCODERS[name]


def count_batch(encoder, column, batch_bytes: int = BATCH_BYTES, segment_chars: int = SEGMENT_CHARS,
                known_words: int = KNOWN_WORDS) -> np.ndarray:
    """Tokens of every text of an Arrow column (null: none)."""
    n_tokens = np.zeros(len(column), np.int64)
    known = encoder.known
    waiting, owners, held = [], [], 0  # lists of parts, and whose they are

    def flush():
        distinct = list(dict.fromkeys(part for parts in waiting for part in parts))
        size = dict(zip(distinct, encoder.lengths(distinct))) if distinct else {}
        for i, parts in zip(owners, waiting):
            n_tokens[i] += sum(map(size.__getitem__, parts))
        if known is not None:
            known.update((w, n) for w, n in size.items() if len(w) <= KNOWN_CHARS)
            if len(known) > known_words:
                known.clear()
        waiting.clear()
        owners.clear()

    for i, value in enumerate(column):
        text = value.as_py()
        if not text:
            continue
        for part in segments(text, segment_chars, encoder.blank):
            parts = [part]
            if known is not None:
                parts = _WORDS.findall(part)
                sizes = list(map(known.get, parts))
                parts = [w for w, n in zip(parts, sizes) if n is None] if None in sizes else []
                n_tokens[i] += sum(filter(None, sizes))
            if not parts:
                continue
            size = sum(len(p.encode()) for p in parts)
            if held + size > batch_bytes:
                flush()
                held = 0
            waiting.append(parts)
            owners.append(i)
            held += size
    flush()
    return n_tokens


def token_counts(df: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text: str = "text",
                 batch_bytes: int = BATCH_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) per row of ``df``, by the vocabulary file at ``path``.

    ``.json`` files are read with ``tokenizers``, ``.model`` files with ``sentencepiece``; nothing is added, cut off or padded.
    ``n_bytes`` is the whole text in UTF-8; ``over_limit`` says ``n_tokens > limit``. A null text counts as empty (0, 0, false), so does
    an empty one; a null id stays null; repeated rows give equal rows; an empty table gives an empty table. Texts of any
    length are counted whole. Only the id and the text are read, whatever other columns ``df`` has.
    """
    kind = "model" if path.endswith(".model") else "json"
    with open(path, "rb") as file:  # a vocabulary: about a megabyte at every input size
        shared = df.sparkSession.sparkContext.broadcast((kind, file.read()))
    name = uuid.uuid4().hex
    id_kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        encoder = _encoder(name, shared)
        for batch in batches:
            tokens = count_batch(encoder, batch.column(1), batch_bytes, segment_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], ["_id", "_bytes", "_tokens"])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counted = df.select(F.col(id_column).alias("_id"), body.alias("_text"), F.octet_length(body).cast("long").alias("_bytes")).mapInArrow(
        run, f"_id {id_kind}, _bytes long, _tokens long")
    return counted.select(F.col("_id").alias(id_column), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"),
                          (F.col("_tokens") > limit).alias("over_limit"))
