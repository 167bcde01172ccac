"""Repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Two equal strings of 50 bytes have the same minimal hash among their 18-byte substrings, their key. Runs of neighbouring windows
with one key are a piece of text of at most 82 bytes, and pieces with the same key meet in one task: whatever can be
equal is compared there, and nothing else is sent. Keys of one text only are left out first. The pieces of a key that has
too many for one task are cut into their 50-byte windows, which meet by a hash of their own.

A task collapses equal pieces, and builds the Burrows-Wheeler transform of the pieces that differ under a key. Breadth-first
backward extension of intervals then yields common prefixes by increasing length: an interval of all suffixes that begin
with a string is extended by each byte that precedes them, and the right border of a new interval gets the length
reached, unless it has a shorter one. After 49 rounds the borders without a length separate no two suffixes that
agree in 50 bytes: the classes of equal windows. Longer prefixes are never computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import _BYTE_WEIGHT, bytes_of, chunks, keep, mix, window_hashes
from peakforge.llm.window_removal import (
    REPLY, SMALL_CHUNK, _by_text, _groups, _keyed, _later, _slices, _spread, bucketed, merged)

LENGTH = 50
GRAM = 18
PART_BYTES = 8 << 20  # bytes of text whose keys one part compares
PIECE_BYTES = 1 << 19  # bytes of pieces that one part compares: a transform takes some hundred times that in memory
BROADCAST_BYTES = 64 << 20


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    span = 1
    low = values
    while 2 * span <= size:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = size - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def runs(column: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, text number, first window and number of windows of every run; and the bytes with offsets, flattened last.

    A key is a minimum, so most are small numbers: mixed, they spread evenly over the parts.
    """
    data, offsets = bytes_of(column)
    out = [[], [], [], []]
    for first, after in chunks(offsets, SMALL_CHUNK):
        own = offsets[first:after + 1]
        counts = np.maximum(np.diff(own) - length + 1, 0)
        if not counts.any():
            continue
        hashes = window_hashes(_BYTE_WEIGHT[data[own[0]:own[-1]]], gram)
        low = _sliding_min(hashes, length - gram + 1)
        at = _spread(own[:-1] - own[0], counts)
        keys, text = low[at], np.repeat(np.arange(first, after), counts)
        edges = _groups(keys, text)
        out[0].append(mix(keys[edges]))
        out[1].append(text[edges].astype(np.int32))
        out[2].append((at[edges] + own[0] - offsets[text[edges]]).astype(np.int32))
        out[3].append(np.diff(np.concatenate([edges, [len(keys)]])).astype(np.int32))
    if not out[0]:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 3, data, offsets)
    return (*[np.concatenate(x) for x in out], data, offsets)


PACKED = "part int, ids binary, marks binary, hashes binary, texts binary, places binary"


def _batch(rows: list, names: str, kinds: list):
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), kinds)],
                                         [f.split()[0] for f in names.split(", ")])


def _shared(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of entries sorted by key, then id: those whose key has several ids."""
    if not len(keys):
        return np.zeros(0, bool)
    edges = _groups(keys)
    size = np.diff(np.concatenate([edges, [len(keys)]]))
    return np.repeat(ids[edges] != ids[edges + size - 1], size)


def _pack(parts: int, length: int, gram: int):
    """Keys of a batch, packed by part; a key that several texts of the batch share is sent once and found here."""
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        for batch in _slices(batches):
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            keys, texts, places, *_ = runs(batch.column(2), length, gram)
            order = np.lexsort((texts, ids[texts], keys))
            keys, texts, places = keys[order], texts[order], places[order]
            once = _groups(keys, texts) if len(keys) else np.zeros(0, np.int64)
            keys, texts, places = keys[once], texts[once], places[once]
            several = _shared(keys, ids[texts])
            rows = [(i % parts, ids[[t]].tobytes(), marks[[t]].tobytes(), None, None, p)
                    for i, (t, p) in enumerate(_by_text(texts[several], places[several]))]
            sent = ~several
            sent[_groups(keys) if len(keys) else []] = True
            keys, texts, places = keys[sent], texts[sent], places[sent]
            part_of = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part_of, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                span = slice(cuts[p], cuts[p + 1])
                used, number = np.unique(texts[span], return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                rows.append((int(p), ids[used].tobytes(), marks[used].tobytes(), keys[span].tobytes(),
                             number.astype(kind).tobytes(), places[span].tobytes()))
            yield from _batch(rows, PACKED, kinds)
    return run


def _compare(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one part's keys: the places of those that several texts have."""
    out, ids, marks, keys, texts, places, base = [], [], [], [], [], [], 0
    for r in frame.itertuples(index=False):
        own = np.frombuffer(r.ids, np.int64)
        if r.hashes is None:
            out.append((int(own[0]), int(np.frombuffer(r.marks, np.int64)[0]), r.places))
            continue
        ids.append(own)
        marks.append(np.frombuffer(r.marks, np.int64))
        keys.append(np.frombuffer(r.hashes, np.uint64))
        texts.append(np.frombuffer(r.texts, np.uint16 if len(own) < 1 << 16 else np.uint32).astype(np.int32) + base)
        places.append(np.frombuffer(r.places, np.int32))
        base += len(own)
    if keys:
        ids, marks, keys, texts, places = (np.concatenate(x) for x in (ids, marks, keys, texts, places))
        order = np.argsort(keys).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        keys = keys[order]
        edges = _groups(keys)
        size = np.diff(np.concatenate([edges, [len(keys)]]))
        del keys
        owner = ids[texts[order]]
        several = np.minimum.reduceat(owner, edges) != np.maximum.reduceat(owner, edges)
        del owner
        found = order[np.repeat(several, size)]
        out += [(int(ids[t]), int(marks[t]), p) for t, p in _by_text(texts[found], places[found])]
    return bucketed(out, buckets)


def _listed(frame: pd.DataFrame) -> pd.DataFrame:
    """Places of all parts, one row per text."""
    return pd.DataFrame([(i, mark, places.astype(np.int32).tobytes()) for i, mark, places in merged(frame)],
                        columns=["_id", "_mark", "places"])


# ---- pieces ------------------------------------------------------------------------------------------------------------

def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` codes at least: by seven codes at once, then by prefix doubling.

    Codes are positive and below 512; 0 ends a string, and nothing beyond it counts.
    """
    n = len(codes)
    key, alive = codes.astype(np.int64), codes > 0
    for j in range(1, 7):
        ahead = np.zeros(n, np.int64)
        if j < n:
            ahead[:n - j] = codes[j:]
        ahead[~alive] = 0
        alive &= ahead > 0
        key = key << 9 | ahead
    order, span = np.argsort(key), 7
    ends = np.flatnonzero(codes == 0)
    reach = np.full(n, n)  # codes before the end of the own string
    inside = np.repeat(ends, np.diff(ends, prepend=-1))
    reach[:len(inside)] = inside - np.arange(len(inside))
    while span < min(depth, n):
        ordered = key[order]
        new = np.ones(n + 1, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:n])
        tied = np.flatnonzero(~(new[:-1] & new[1:]))  # the others have their place
        if not len(tied):
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new[:-1])
        ahead = np.zeros(n, np.int64)
        ahead[:n - span] = rank[span:]
        ahead[reach < span] = 0
        key = rank * (n + 1) + ahead
        open_ = order[tied]
        order[tied] = open_[np.argsort(key[open_])]
        span *= 2
    return order


def equal_classes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the strings (one separator after each): a class number, equal where the next ``length`` bytes
    are; and whether the position has that many bytes. By bounded breadth-first interval expansion on the transform."""
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 0
    n = len(data)
    order = suffix_array(data, length)
    transform = data[order - 1]  # the code before every suffix; the first string follows the last separator
    begins = data[order]  # the code every suffix begins with
    place = np.argsort(transform, kind="stable")
    ahead_of = np.empty(n, np.int64)  # where the suffix with its preceding code is: codes in order, equal ones in theirs
    ahead_of[place] = np.arange(n)
    border = np.full(n + 1, -1, np.int32)  # length of the common prefix with the suffix before, once known
    border[0] = 0
    left, right = np.array([0]), np.array([n])
    for reached in range(1, length + 1):
        # Members of all intervals, with the code that precedes each; separators are never crossed.
        counts = right - left
        member = _spread(left, counts)
        owner = np.repeat(np.arange(len(left)), counts)
        ahead = transform[member] > 0
        member, owner = member[ahead], owner[ahead]
        if not len(member):
            break
        # Within one interval, members with one code map to neighbouring suffixes in their order: the first and the last
        # give the new interval.
        target = np.sort(ahead_of[member] << 32 | owner)
        owner = target & 0xFFFFFFFF
        target >>= 32
        edges = _groups(owner, begins[target])
        low = target[edges]
        high = target[np.concatenate([edges[1:], [len(target)]]) - 1] + 1
        fresh = border[high] < 0
        border[high[fresh]] = reached - 1
        left, right = low[fresh], high[fresh]
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(border[:n] >= 0)
    whole = np.repeat(ends, sizes + 1) - np.arange(n) >= length
    return classes, whole


def _collapse(strings: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by string and id; and in that order the number of the string."""
    codes, _ = pd.factorize(strings)
    order = np.lexsort((ids, codes))
    return order, codes[order]


def _matched(frame: pd.DataFrame, length: int) -> list:
    """Spans of one part's pieces whose windows also start under a smaller id."""
    out = []
    done = frame["piece"].isna().to_numpy()
    for r in frame[done].itertuples(index=False):
        out.append((r.id, r.mark, r.spans))
    frame = frame[~done]
    if not len(frame):
        return out
    ids, marks, keys, places = (frame[c].to_numpy() for c in ("id", "mark", "key", "place"))
    pieces = frame["piece"].to_numpy()
    order, number = _collapse(pieces, ids)
    edges = _groups(number)
    count = np.diff(np.concatenate([edges, [len(order)]]))
    lowest = ids[order][edges]  # of every distinct piece
    of = np.repeat(np.arange(len(edges)), count)
    size = np.array([len(p) for p in pieces])[order]
    late = ids[order] > lowest[of]
    starts, ends, who = [places[order][late]], [places[order][late] + size[late]], [order[late]]
    # Pieces that differ under one key: their windows are compared by classes of equal prefixes.
    own_key = keys[order][edges]
    _, group, times = np.unique(own_key, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(times[group] > 1)
    if len(mixed):
        strings = [pieces[order[edges[i]]] for i in mixed]
        classes, whole = equal_classes(strings, length)
        sizes = np.array([len(s) + 1 for s in strings])
        text = np.repeat(np.arange(len(strings)), sizes)
        inside = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes[whole], lowest[mixed][text[whole]])
        hit = np.flatnonzero(whole & (least[classes] < lowest[mixed][text]))
        first = ~late
        holders = order[first]
        begin = np.searchsorted(of[first], mixed[text[hit]], side="left")
        finish = np.searchsorted(of[first], mixed[text[hit]], side="right")
        chosen = holders[_spread(begin, finish - begin)]
        at = places[chosen] + np.repeat(inside[hit], finish - begin)
        starts.append(at)
        ends.append(at + length)
        who.append(chosen)
    starts, ends, who = np.concatenate(starts), np.concatenate(ends), np.concatenate(who)
    by = np.lexsort((starts, marks[who], ids[who]))
    starts, ends, who = starts[by], ends[by], who[by]
    edges = _groups(ids[who], marks[who]) if len(who) else np.zeros(0, np.int64)
    spans = np.stack([starts, ends], 1).astype(np.int32).tobytes()
    cuts = 8 * np.append(edges, len(who))  # bytes
    first = who[edges]
    out += [(i, mark, spans[a:b]) for i, mark, a, b in zip(ids[first].tolist(), marks[first].tolist(), cuts.tolist(), cuts[1:].tolist())]
    return out


PIECES = "part int, id long, mark long, key long, place int, piece binary, spans binary"


def _cut(parts: int, length: int, gram: int):
    """Pieces of texts under their shared keys; of equal pieces in a batch only that with the smallest id is sent."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        for batch in _slices(batches):
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            keys, texts, places, counts, data, offsets = runs(batch.column(2), length, gram)
            wanted = np.zeros(len(keys), bool)
            edges = np.searchsorted(texts, np.arange(batch.num_rows + 1))
            for i, found in enumerate(batch.column(3).to_pylist()):
                if found and edges[i] < edges[i + 1]:
                    span = slice(edges[i], edges[i + 1])
                    known = np.frombuffer(found, np.int32)
                    own = keys[span][np.searchsorted(places[span], known)]
                    wanted[span] = np.isin(keys[span], own)
            keys, texts, places, counts = keys[wanted], texts[wanted], places[wanted], counts[wanted]
            begin = offsets[texts] + places
            raw = data.tobytes()
            pieces = np.array([raw[a:b] for a, b in zip(begin.tolist(), (begin + counts + length - 1).tolist())], object)
            order, number = _collapse(pieces, ids[texts])
            if len(order):
                late = _later(number, ids[texts][order])
                gone = order[late]
                ends = places[gone] + counts[gone] + length - 1
                for t in np.unique(texts[gone]):
                    mine = texts[gone] == t
                    spans = np.stack([places[gone][mine], ends[mine]], 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], k) for c, k in zip((int(t) % parts, ids[t], marks[t], 0, 0, None, spans.tobytes()), kinds)], names)
                sent = order[~late]
                part = ((keys[sent] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                columns = [part, ids[texts[sent]], marks[texts[sent]], keys[sent].view(np.int64), places[sent], pieces[sent],
                           np.full(len(sent), None)]
                for at in range(0, len(sent), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 20_000], k) for c, k in zip(columns, kinds)], names)
    return run


def _windows(parts: int, wide: int, length: int):
    """Rows of ``PIECES``, those with a hot key as windows in parts of their own; of equal windows in a batch only that with the
    smallest id is sent."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        for batch in batches:
            hot = batch.column(len(kinds)).is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.compute.invert(hot)) for i in range(len(kinds))], names)
            rows = batch.filter(hot)
            for at in range(0, rows.num_rows, 5000):
                own = rows.slice(at, 5000)
                ids, marks, places = (own.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4))
                pieces = own.column(5).to_pylist()
                counts = np.array([len(p) - length + 1 for p in pieces])
                of = np.repeat(np.arange(len(pieces)), counts)
                places = _spread(places.astype(np.int64), counts)
                windows = np.array([p[i:i + length] for p in pieces for i in range(len(p) - length + 1)], object)
                order, number = _collapse(windows, ids[of])
                late = _later(number, ids[of][order])
                gone = order[late]
                gone = gone[np.lexsort((places[gone], marks[of[gone]], ids[of[gone]]))]
                edges = _groups(ids[of[gone]], marks[of[gone]]) if len(gone) else []
                for i, (a, b) in enumerate(zip(edges, [*edges[1:], len(gone)])):
                    spans = np.stack([places[gone[a:b]], places[gone[a:b]] + length], 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], k) for c, k in zip((i % parts, ids[of[gone[a]]], marks[of[gone[a]]], 0, 0, None, spans.tobytes()),
                                                          kinds)], names)
                sent = order[~late]
                keys = np.array([xxhash.xxh64_intdigest(w) for w in windows[sent]], np.uint64)
                part = parts + ((keys >> np.uint64(32)) * np.uint64(wide) >> np.uint64(32)).astype(np.int32)
                columns = [part, ids[of[sent]], marks[of[sent]], keys.view(np.int64), places[sent], windows[sent], np.full(len(sent), None)]
                for a in range(0, len(sent), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 20_000], k) for c, k in zip(columns, kinds)], names)
    return run


def _without_hot(pieces: DataFrame, parts: int, length: int, piece_bytes: int) -> DataFrame:
    """``pieces`` (a kept table) in which no key has more than ``piece_bytes`` of pieces that may differ."""
    hot = keep(pieces.filter("piece is not null").groupBy("key")
               .agg(F.sum(F.octet_length("piece")).alias("size"), F.sum(F.octet_length("piece") - length + 1).alias("n"))
               .filter(F.col("size") > piece_bytes))
    windows, keys = hot.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not keys:
        return pieces
    hot = hot.select("key", F.lit(True).alias("hot"))
    hot = F.broadcast(hot) if 16 * keys <= BROADCAST_BYTES else hot
    wide = int(max(8, -(-windows * length // (8 * piece_bytes))))  # windows need no transform
    return (pieces.join(hot, "key", "left").select(*pieces.columns, F.when(F.col("piece").isNotNull(), F.col("hot")).alias("hot"))
            .mapInArrow(_windows(parts, wide, length), PIECES))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   part_bytes: int = PART_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(``_id``, ``_mark``, ``spans``): per text, byte ranges made of strings that also start under a smaller id."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = buckets = int(max(8, -(-total // part_bytes)))
    keyed = docs.select(*_keyed(docs, id_column, text))
    found = (keyed.mapInArrow(_pack(parts, length, gram), PACKED).groupBy("part")
             .applyInPandas(lambda f: _compare(f, buckets), REPLY))
    found = keep(found.groupBy("bucket").applyInPandas(_listed, "_id long, _mark long, places binary"))
    size = found.agg(F.sum(F.octet_length("places") + 32)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    parts = int(max(8, -(-size // 4 * (length + 20) // piece_bytes)))  # four bytes a place
    pieces = (keyed.join(found, ["_id", "_mark"]).select("_id", "_mark", "_text", "places")
              .mapInArrow(_cut(parts, length, gram), PIECES))
    pieces = _without_hot(keep(pieces), parts, length, piece_bytes)
    spans = pieces.groupBy("part").applyInPandas(lambda f: bucketed(_matched(f, length), buckets), REPLY)
    return spans.groupBy("bucket").applyInPandas(_spans, "_id long, _mark long, spans binary")


def _spans(frame: pd.DataFrame) -> pd.DataFrame:
    """Ranges of all parts, one row per text: its maximal runs (first byte, end)."""
    found: dict = {}
    for r in frame.itertuples(index=False):
        sizes = np.frombuffer(r.sizes, np.int32)
        cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
        for i, mark, a, b in zip(np.frombuffer(r.ids, np.int64), np.frombuffer(r.marks, np.int64), cuts, cuts[1:]):
            found.setdefault((int(i), int(mark)), []).append(r.places[a:b])
    return pd.DataFrame([(i, mark, _union(parts).astype(np.int32).tobytes()) for (i, mark), parts in found.items()],
                        columns=["_id", "_mark", "spans"])


def _union(parts: list[bytes]) -> np.ndarray:
    """Maximal runs (first byte, end) of the given ranges."""
    spans = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in parts])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.concatenate([at[1:], [len(spans)]]) - 1]], 1)


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                          part_bytes: int = PART_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Texts as UTF-8 bytes without those covered by ``length`` bytes that also start in a text with a smaller id.

    One row per row of ``docs``: id, ``n_bytes``, ``removed`` (maximal runs as first byte and number), ``kept`` (remaining bytes,
    which need not be UTF-8). Strings are judged on the input. Null counts as empty. Rows with the same id never remove
    bytes from one another; a row without an id comes after all others. Other columns are not read.
    """
    found = keep(repeated_spans(docs, id_column, text, length, gram, part_bytes, piece_bytes))
    size = found.agg(F.sum(F.octet_length("spans") + 32)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    kind = docs.schema[id_column].dataType.simpleString()
    joined = (docs.select(F.col(id_column).alias("_own"), *_keyed(docs, id_column, text))
              .join(found, ["_id", "_mark"], "left").select("_own", "_text", "spans"))

    def run(batches):
        for batch in batches:
            sizes, gone, left = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode()
                sizes.append(len(raw))
                cut = np.frombuffer(spans or b"", np.int32).reshape(-1, 2)
                gone.append([{"first": int(a), "n": int(b - a)} for a, b in cut])
                edges = [0, *cut.ravel().tolist(), len(raw)]
                left.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(gone, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), pa.array(left, pa.binary())],
                [id_column, "n_bytes", "removed", "kept"])
    return joined.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, removed array<struct<first: long, n: long>>, kept binary")
