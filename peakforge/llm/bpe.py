"""Byte-level BPE with a segment tree over byte positions; short pieces are merged in a plain list.

Leaf i of the tree holds the rank of the pair that starts at byte i, its position in the low bits, so that the root is the leftmost
minimum. A merge changes three leaves: the pair that went, the grown token's pair and the pair before it. Every change
costs the height of the tree, so a piece of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
PLACE = (1 << 32) - 1
# Pieces whose ids a worker remembers, twice: at the bound the older half goes.
REMEMBERED = 300_000
# Bytes up to which a list of parts is faster than the tree.
SHORT = 64
# Longer texts are cut for memory where no piece of the pattern can run across.
LONG = 1 << 20
SAFE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of every token of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` with the ranks of all pairs in a list: a step costs the length of the piece."""
    get = ranks.get
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [get(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == NONE:
            break
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NONE)
    return [ranks[part] for part in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of the lowest rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    if n <= SHORT:
        return _merge_short(piece, ranks)
    get = ranks.get
    leaves = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # end of the live token that starts here
    before = list(range(-1, n - 1))  # start of the live token before

    while tree[1] < NONE:
        i = tree[1] & PLACE
        gone = end[i]
        stop = end[i] = end[gone]
        grown = NONE
        if stop < n:
            before[stop] = i
            rank = get(piece[i:end[stop]])
            if rank is not None:
                grown = rank << 32 | i
        changes = [(gone, NONE), (i, grown)]
        last = before[i]
        if last >= 0:
            rank = get(piece[last:stop])
            changes.append((last, NONE if rank is None else rank << 32 | last))
        for leaf, value in changes:
            at = leaves + leaf
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder over one rank table; remembers the ids of a bounded number of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pattern, self.remembered = ranks, regex.compile(pattern), remembered
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict = {}
        self.older: dict = {}

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else merge(raw, self.ranks)

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def pieces(self, text: str):
        """Lists of the pattern's matches, in order; more than one list for a very long text."""
        start, n = 0, len(text)
        while n - start > LONG:
            cut = SAFE_CUT.search(text, start + LONG)
            if cut is None:
                break
            yield self.pattern.findall(text, start, cut.start())
            start = cut.start()
        yield self.pattern.findall(text, start) if start else self.pattern.findall(text)

    def parts(self, text: str, make):
        """``make(ids)`` of every piece, remembered per piece."""
        for found in self.pieces(text):
            known = self.known
            out = list(map(known.get, found))
            if None in out:
                for i, part in enumerate(out):
                    if part is None:
                        piece = found[i]
                        part = known.get(piece) or self.older.get(piece) or make(self.piece_ids(piece))
                        if len(known) >= self.remembered:
                            self.older, self.known = known, {}
                            known = self.known
                        known[piece] = out[i] = part
            yield out

    def encode(self, text: str) -> array:
        ids = array("i")
        for found in self.parts(text, lambda ids: array("i", ids)):
            for part in found:
                ids.extend(part)
        return ids

    def fingerprint(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimal text, and SHA-256 of the bytes the ids decode to."""
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

        def make(found):
            return b"".join([b" %d" % i for i in found]), self.decode(found)

        for found in self.parts(text, make):
            text_ids = b"".join([part[0] for part in found])
            ids.update(text_ids[1:] if not n else text_ids)
            n += text_ids.count(b" ")
            back.update(b"".join([part[1] for part in found]))
        return n, ids.hexdigest(), back.hexdigest()


#: The codec of this Python worker, by what it is used for: later tasks find the pieces that earlier ones met.
_CODECS: dict[str, Codec] = {}


def _worker_codec(name: str, shared, pattern: str, remembered: int) -> Codec:
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value, pattern, remembered)
    return _CODECS[name]


def _codec_of(df: DataFrame, path: str, pattern: str, remembered: int):
    """Gives the worker's codec; the rank file (under a megabyte, the same at every input size) is read once, by the driver."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    name = uuid.uuid4().hex
    return lambda: _worker_codec(name, shared, pattern, remembered)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           remembered: int = REMEMBERED) -> DataFrame:
    """``df`` with the ids of each whole text (null: no ids) in column ``ids``. Special tokens have no part in it."""
    codec_of = _codec_of(df, path, pattern, remembered)

    def run(batches):
        codec = codec_of()
        for batch in batches:
            found = [np.frombuffer(codec.encode(t or ""), np.int32) for t in batch.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), values)],
                                             [*batch.schema.names[:-1], ids])
    rest = df.drop(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, f"{schema}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids in column ``out``; null for null."""
    codec_of = _codec_of(df, path, "", 0)

    @F.udf("binary", useArrow=True)
    def back(values):
        return None if values is None else codec_of().decode(values)
    return df.withColumn(out, back(F.col(ids)))


def fingerprints(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text",
                 remembered: int = REMEMBERED) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the digests of both; one row per row of ``df``.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256``. Null counts as empty: no ids, digests of
    nothing. Repeated rows get equal rows. Only the id and the text are read, whatever else ``df`` holds.
    """
    codec_of = _codec_of(df, path, pattern, remembered)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        codec = codec_of()
        for batch in batches:
            found = [codec.fingerprint(t or "") for t in batch.column(1).to_pylist()]
            n, ids, back = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.string())],
                                             [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])
    slim = df.select(id_column, F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
