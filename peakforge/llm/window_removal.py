"""Repeated passages by Rabin-Karp hashes of every window of 50 words.

Every window of every text is hashed. A map task sorts the hashes of its batch and sends, for each distinct one, the row with the
smallest id: hash ranges go to parts, packed as arrays (about ten bytes a window, and the ids of its texts per part). A part compares the smallest ids of
all batches. Windows that also start in a text with a smaller id come back as positions, overlapping windows merge into
maximal runs, and the runs leave the text. A window that a third of all texts share is sent once per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import SMALL_BYTES, bytes_of, chunks, keep, window_hashes, word_hashes, words

WINDOW = 50
PART_BYTES = 24 << 20  # bytes of text whose windows one part compares
BATCH_ROWS = "2000"
SMALL_CHUNK = 1 << 18  # bytes of text hashed at a time: the arrays stay in a core's cache, and small
NO_ID = 2**63 - 1  # rows without an id come after all others


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] values), then the same from first[1], and so on."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _windows(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every window of a batch of texts."""
    data, offsets = bytes_of(column)
    hashes, texts, places = [], [], []
    for first, after in chunks(offsets, SMALL_CHUNK):
        own = offsets[first:after + 1]
        part = data[own[0]:own[-1]]
        starts, ends, of = words(part, own - own[0])
        runs = window_hashes(word_hashes(part, starts, ends), window)
        counts = np.maximum(np.diff(of) - window + 1, 0)
        at = _spread(of[:-1], counts)
        text = np.repeat(np.arange(first, after), counts)
        hashes.append(runs[at])
        texts.append(text.astype(np.int32))
        places.append((at - of[text - first]).astype(np.int32))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(places)


def _slices(batches, limit: int = 4 << 20):
    """Batches of about ``limit`` bytes of text (the third column) at most; one longer text is a batch of its own."""
    for batch in batches:
        _, offsets = bytes_of(batch.column(2))
        for first, after in chunks(offsets, limit):
            yield batch.slice(first, after - first)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of entries sorted by hash, then id: those with a smaller id under the same hash."""
    if not len(hashes):
        return np.zeros(0, bool)
    edges = _groups(hashes)
    return ids > np.repeat(ids[edges], np.diff(np.concatenate([edges, [len(ids)]])))


def _by_text(texts: np.ndarray, places: np.ndarray):
    """(text number, its places as bytes) of found windows."""
    order = np.lexsort((places, texts))
    texts, places = texts[order], places[order].astype(np.int32)
    edges = _groups(texts) if len(texts) else []
    for a, b in zip(edges, [*edges[1:], len(texts)]):
        yield int(texts[a]), places[a:b].tobytes()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first, and the steps in six bytes each if all of them fit."""
    steps = np.diff(values)
    if len(steps) and int(steps.max()) >= 1 << 48:
        return b"8" + values.tobytes()
    return b"6" + values[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :6] = steps
    values = wide.view(np.uint64).ravel()
    values[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(values, dtype=np.uint64)


def _narrow(values: np.ndarray) -> bytes:
    """Two bytes a number if all of them fit, else four."""
    return values.astype(np.uint16 if not len(values) or int(values.max()) < 1 << 16 else np.uint32).tobytes()


PACKED = "part int, ids binary, marks binary, hashes binary, texts binary, places binary"


def _pack(parts: int, window: int):
    def run(batches):
        for batch in _slices(batches):
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            hashes, texts, places = _windows(batch.column(2), window)
            order = np.lexsort((places, texts, ids[texts], hashes))
            hashes, texts, places = hashes[order], texts[order], places[order]
            once = _groups(hashes, texts) if len(hashes) else np.zeros(0, np.int64)  # the first window of a hash in a text
            hashes, texts, places = hashes[once], texts[once], places[once]
            late = _later(hashes, ids[texts])
            rows = [(i % parts, ids[[t]].tobytes(), marks[[t]].tobytes(), None, None, p)
                    for i, (t, p) in enumerate(_by_text(texts[late], places[late]))]
            hashes, texts, places = hashes[~late], texts[~late], places[~late]
            part_of = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part_of, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                span = slice(cuts[p], cuts[p + 1])
                used, number = np.unique(texts[span], return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                rows.append((int(p), ids[used].tobytes(), marks[used].tobytes(), pack_sorted(hashes[span]),
                             number.astype(kind).tobytes(), _narrow(places[span])))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), [pa.int32(), *[pa.binary()] * 5])],
                    [f.split()[0] for f in PACKED.split(", ")])
    return run


REPLY = "bucket int, ids binary, marks binary, sizes binary, places binary"


def bucketed(found: list, buckets: int) -> pd.DataFrame:
    """Replies (id, mark, places) of one part, packed by buckets of texts: not a row per text and part."""
    packed: dict = {}
    for i, mark, places in found:
        ids, marks, sizes, body = packed.setdefault(mark % buckets, ([], [], [], []))
        ids.append(i)
        marks.append(mark)
        sizes.append(len(places) // 4)
        body.append(places)
    return pd.DataFrame([(b, np.array(i, np.int64).tobytes(), np.array(m, np.int64).tobytes(), np.array(s, np.int32).tobytes(), b"".join(p))
                         for b, (i, m, s, p) in packed.items()], columns=["bucket", "ids", "marks", "sizes", "places"])


def merged(frame: pd.DataFrame):
    """(id, mark, ascending places) of every text of one bucket."""
    ids, marks, places = [], [], []
    for r in frame.itertuples(index=False):
        sizes = np.frombuffer(r.sizes, np.int32)
        ids.append(np.repeat(np.frombuffer(r.ids, np.int64), sizes))
        marks.append(np.repeat(np.frombuffer(r.marks, np.int64), sizes))
        places.append(np.frombuffer(r.places, np.int32))
    ids, marks, places = (np.concatenate(x) for x in (ids, marks, places))
    order = np.lexsort((places, marks, ids))
    ids, marks, places = ids[order], marks[order], places[order]
    edges = _groups(ids, marks) if len(ids) else []
    for a, b in zip(edges, [*edges[1:], len(ids)]):
        yield int(ids[a]), int(marks[a]), np.unique(places[a:b])


def _compare(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Windows of one part that also start under a smaller id."""
    out = []
    ids, marks, hashes, texts, places, base = [], [], [], [], [], 0
    for r in frame.itertuples(index=False):
        own = np.frombuffer(r.ids, np.int64)
        if r.hashes is None:
            out.append((int(own[0]), int(np.frombuffer(r.marks, np.int64)[0]), r.places))
            continue
        ids.append(own)
        marks.append(np.frombuffer(r.marks, np.int64))
        hashes.append(unpack_sorted(r.hashes))
        kind = np.uint16 if len(own) < 1 << 16 else np.uint32
        texts.append(np.frombuffer(r.texts, kind).astype(np.int32) + base)
        narrow = len(r.places) == 2 * len(texts[-1])
        places.append(np.frombuffer(r.places, np.uint16 if narrow else np.uint32).astype(np.int32))
        base += len(own)
    if hashes:
        ids, marks, hashes, texts, places = (np.concatenate(x) for x in (ids, marks, hashes, texts, places))
        order = np.lexsort((ids[texts], hashes))
        late = _later(hashes[order], ids[texts[order]])
        found = order[late]
        out += [(int(ids[t]), int(marks[t]), p) for t, p in _by_text(texts[found], places[found])]
    return bucketed(out, buckets)


def _keyed(docs: DataFrame, id_column: str, text: str) -> list:
    # Texts go to Python in smaller batches than usual: they are cut to slices there anyway, and a batch is held twice.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    body = F.col(text).cast("string")
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(body).alias("_mark"), body.alias("_text")]


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """(``_id``, ``_mark``, ``runs``): per text, first words of windows that also start under a smaller id, as runs of them.

    Of equal windows inside one text the first is named. ``_mark`` is the hash of the text, so that rows which repeat an id with
    another text stay apart.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = int(max(8, -(-total // part_bytes)))
    packed = docs.select(*_keyed(docs, id_column, text)).mapInArrow(_pack(parts, window), PACKED)
    found = packed.groupBy("part").applyInPandas(lambda f: _compare(f, parts), REPLY)
    return found.groupBy("bucket").applyInPandas(_runs, "_id long, _mark long, runs binary")


def _runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Places of all parts, as runs of neighbours (first place, number)."""
    out = []
    for i, mark, places in merged(frame):
        at = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
        size = np.diff(np.concatenate([at, [len(places)]]))
        out.append((i, mark, np.stack([places[at], size], 1).astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["_id", "_mark", "runs"])


def _covered(n: int, first: np.ndarray, size: int) -> np.ndarray:
    """Which of n items lie in a window that begins at one of ``first``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
                    part_bytes: int = PART_BYTES) -> DataFrame:
    """Texts without the words covered by a window of ``window`` words that also starts in a text with a smaller id.

    One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``removed`` (maximal runs as first word and number of words),
    ``kept_text`` (kept words joined by one space). Windows are judged on the input. Null and empty texts have no words.
    Rows with the same id never remove words from one another; a row without an id comes after all others. Other columns
    are not read.
    """
    found = keep(repeated_windows(docs, id_column, text, window, part_bytes))
    size = found.agg(F.sum(F.octet_length("runs") + 32)).first()[0] or 0
    found = F.broadcast(found) if size <= SMALL_BYTES else found
    kind = docs.schema[id_column].dataType.simpleString()
    joined = (docs.select(F.col(id_column).alias("_own"), *_keyed(docs, id_column, text))
              .join(found, ["_id", "_mark"], "left").select("_own", "_text", "runs"))

    def run(batches):
        for batch in batches:
            n_words, n_removed, gone_runs, texts = [], [], [], []
            for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode().split()
                removed = np.zeros(len(raw), bool)
                if runs:
                    first = _spread(*np.frombuffer(runs, np.int32).reshape(-1, 2).T)
                    hashes, _, _ = _windows(pa.array([t]), window)
                    removed = _covered(len(raw), np.flatnonzero(np.isin(hashes, hashes[first])), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)))
                n_words.append(len(raw))
                n_removed.append(int(removed.sum()))
                gone_runs.append([{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                left = raw if not runs else [w for w, gone in zip(raw, removed) if not gone]
                texts.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(gone_runs, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), pa.array(texts, pa.string())],
                [id_column, "n_words", "n_removed", "removed", "kept_text"])
    return joined.mapInArrow(run, f"`{id_column}` {kind}, n_words long, n_removed long, "
                                  "removed array<struct<first: long, n: long>>, kept_text string")
