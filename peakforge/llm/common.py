"""What the operators share: white space, stored intermediate tables, and word hashes over Arrow batches."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six white space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
# Largest table, in bytes as estimated from its row count, that a join may copy to every task.
SMALL_BYTES = 16 * 1024 * 1024


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared checkpoint folder and read them from there.

    The lineage ends at files that outlive any executor, and values drawn while writing (row numbers) never change again.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a kept table) marked for broadcast if its counted rows fit in ``SMALL_BYTES``; beyond, a shuffled join serves."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def sized_broadcast(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` (a kept table) marked for broadcast if ``row_bytes``, summed over all rows, fit in ``SMALL_BYTES``."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= SMALL_BYTES else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until none is a column of ``df``, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white(text: Column) -> Column:
    """The text without its white space characters; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


# ---- words of Arrow batches -------------------------------------------------------------------------------------------

_WHITE_BYTE = np.zeros(256, bool)
_WHITE_BYTE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_BYTE_WEIGHT = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_STEP ** 0 .. _STEP ** (n - 1), modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _STEP)
        grown[0] = 1
        _POWERS = np.cumprod(grown)
    return _POWERS[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of whole texts (first, after last) with about ``limit`` bytes; one longer text is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        after = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        after = min(max(after, first + 1), n)
        yield first, after
        first = after


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin in these arrays (n + 1 values)."""
    black = ~_WHITE_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = black[:-1]
    starts = np.flatnonzero(black & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = black[1:]
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a weighted sum of its bytes, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum()), dtype=np.int64)
    place = inside - np.repeat(first, lengths)
    terms = _BYTE_WEIGHT[data[place + np.repeat(starts, lengths)]]
    terms *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp: hash of every ``size`` consecutive values, as one polynomial per window, then mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: the polynomial of 2k values is that of k values, shifted, plus that of the next k.
    total, done, block, span, left = None, 0, hashes, 1, size
    while True:
        if left & 1:
            piece = block[done:done + n]
            total = piece.copy() if total is None else total * powers(span + 1)[span] + piece
            done += span
        left >>= 1
        if not left:
            break
        block = block[:len(block) - span] * powers(span + 1)[span] + block[span:]
        span *= 2
    return mix(total)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte stays."""
    return _LOWER_BYTE[data]


SPACE = re.compile(r"[\x20\x09-\x0D]+")
