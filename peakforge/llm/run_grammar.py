"""Periodic runs of words, by a run-length grammar built with recompression.

The words of some texts, named by whole numbers, are compressed level by level: equal neighbours become one block symbol, then
neighbours (left, right) under a two-way split of the alphabet become one pair symbol. Symbols are named by the contents
they stand for, never by a hash, so equal symbols are equal stretches of words. A level decides by the next symbol only, so
two equal stretches are compressed alike up to one symbol at each end; the longest common extension of two places climbs the
levels while both stand at a border, and descends where symbols differ: a step or two a level, no suffix array.

A run of period q that is long enough holds consecutive multiples of q with equal words. Those places of the harmonic grid
(n/1 + n/2 + ... of them) are candidates; their extensions to the left and to the right give the exact run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import bytes_of, chunks, mix

GRID = 1 << 20  # grid places looked at together


def _named(code: np.ndarray) -> np.ndarray:
    return pd.factorize(code)[0].astype(np.int64)


class Grammar:
    """Levels of a sequence of whole numbers: ``symbols[k]``, and ``starts[k]``, ``parents[k]`` between level k and k + 1.

    Odd steps (k even) take blocks of equal symbols, even steps pairs. The first and the last value of every text must occur nowhere else:
    no extension passes them.
    """

    def __init__(self, values: np.ndarray, rest: int = 8):
        self.symbols, self.starts, self.parents = [_named(values)], [], []
        dull = 0
        while len(self.symbols[-1]) > rest and dull < 40:
            at = self.symbols[-1]
            new = np.ones(len(at), bool)
            if len(self.starts) % 2 == 0:
                new[1:] = at[1:] != at[:-1]
                first = np.flatnonzero(new)
                width = np.diff(first, append=len(at))
                code = at[first] * (int(width.max()) + 1) + width
            else:
                left = (mix((at + 1).astype(np.uint64) ^ mix(np.array([len(self.starts)], np.uint64))) & np.uint64(1)) == 0
                new[1:] = ~(left[:-1] & ~left[1:])
                first = np.flatnonzero(new)
                width = np.diff(first, append=len(at))
                second = np.where(width == 2, at[np.minimum(first + 1, len(at) - 1)] + 1, 0)
                code = at[first] * (int(at.max()) + 2) + second
                dull = 0 if len(first) < len(at) else dull + 1
            self.starts.append(np.append(first, len(at)))
            self.parents.append(np.cumsum(new) - 1)
            self.symbols.append(_named(code))

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many words from places i and j on (or back from them, themselves included) are equal, for all pairs at once."""
        step, top = (1 if forward else -1), len(self.starts)
        x, y = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        level = np.zeros(len(x), np.int32)
        live = np.arange(len(x))
        for k in range(top):
            if not len(live):
                break
            a, b, up, start = x[live], y[live], self.parents[k], self.starts[k]
            pa_, pb_ = up[a], up[b]
            # symbols left in the block of either place; a place at a border stands before a whole block
            left_a = start[pa_ + 1] - a if forward else a - start[pa_] + 1
            left_b = start[pb_ + 1] - b if forward else b - start[pb_] + 1
            whole = (left_a == start[pa_ + 1] - start[pa_]) & (left_b == start[pb_ + 1] - start[pb_])
            equal = self.symbols[k][a] == self.symbols[k][b]
            by = np.minimum(left_a, left_b) if k % 2 == 0 else 1
            moved = np.where(whole | ~equal, 0, by) * step
            a, b = a + moved, b + moved
            # after such a step both are at a border, unless blocks of unequal rest ended it
            na, nb = up[np.clip(a, 0, len(up) - 1)], up[np.clip(b, 0, len(up) - 1)]
            border = (start[na] == a) & (start[nb] == b) if forward else (start[na + 1] - 1 == a) & (start[nb + 1] - 1 == b)
            go = border & (whole | equal)
            x[live], y[live] = np.where(go, na, a), np.where(go, nb, b)
            level[live[go]] = k + 1
            live = live[go]
        while len(live):
            same = self.symbols[top][x[live]] == self.symbols[top][y[live]]
            live = live[same]
            x[live] += step
            y[live] += step
        for k in range(top - 1, -1, -1):
            live = np.flatnonzero(level > k)
            if not len(live):
                continue
            start, up, symbol = self.starts[k], self.parents[k], self.symbols[k]
            a = start[x[live]] if forward else start[x[live] + 1] - 1
            b = start[y[live]] if forward else start[y[live] + 1] - 1
            equal = symbol[a] == symbol[b]
            if k % 2 == 0:
                wa, wb = start[x[live] + 1] - start[x[live]], start[y[live] + 1] - start[y[live]]
                by = np.where(equal, np.minimum(wa, wb), 0)
            else:
                by = equal.astype(np.int64)
            x[live], y[live] = a + by * step, b + by * step
        return (x - i) * step


def _grid(first: np.ndarray, n: np.ndarray, repeats: int):
    """Blocks of (period, first place, places) over all texts: every (text, period) with room for ``repeats`` periods."""
    periods = n // repeats
    text = np.repeat(np.arange(len(n)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    size = (n[text] + q - 1) // q
    ends = np.cumsum(size)
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        after = max(int(np.searchsorted(ends, before + GRID, side="right")), at + 1)
        yield q[at:after], first[text[at:after]], size[at:after]
        at = after


def _texts_at_a_time(n: np.ndarray, repeats: int):
    """Ranges of texts with about GRID periods to try; one longer text is a range of its own."""
    total, at = np.cumsum(n // repeats), 0
    while at < len(n):
        before = total[at - 1] if at else 0
        after = max(int(np.searchsorted(total, before + GRID, side="right")), at + 1)
        yield at, after
        at = after


def runs_of(names: list[np.ndarray], least: int = 6, repeats: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of each list of word names, by text, start and period.

    A run has at least ``max(least, repeats * period)`` words, period its smallest one, and cannot be extended. ``repeats`` is 2 or more.
    """
    n = np.array([len(v) for v in names], np.int64)
    # Each text stands between values of its own.
    first = np.cumsum(n + 1) - n
    values = np.empty(int((n + 1).sum()) + 1, np.int64)
    values[0] = -1
    values[first + n] = -2 - np.arange(len(n))
    for at, v in zip(first, names):
        values[at:at + len(v)] = v
    grammar, found = None, []
    need = repeats - 2  # equal neighbours on the grid that every such run holds

    def extents(period, at):
        """[start, end) of the longest stretch with this period around places at, at + period (equal words)."""
        nonlocal grammar
        grammar = grammar or Grammar(values)
        out_start, out_end = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for a in range(0, len(at), GRID // 4):
            part = slice(a, a + GRID // 4)
            x, y = at[part], at[part] + period[part]
            out_end[part] = y + grammar.extension(x, y)
            out_start[part] = x - grammar.extension(x, y, forward=False) + 1
        return out_start, out_end

    for low, high in _texts_at_a_time(n, repeats):
        for q, begin, size in _grid(first[low:high], n[low:high], repeats):
            edge = np.cumsum(size)
            turn = np.arange(int(edge[-1])) - np.repeat(edge - size, size)
            period = np.repeat(q, size)
            place = np.repeat(begin, size) + turn * period
            last = np.repeat(size, size) - 1
            word = values[place]
            equal = np.zeros(len(word) + need, bool)
            equal[:len(word) - 1] = word[1:] == word[:-1]
            equal[:len(word)] &= turn < last
            hit = equal[:len(word)].copy()
            for s in range(1, max(need, 1)):
                hit &= equal[s:s + len(word)]
            hits = np.flatnonzero(hit)
            if not len(hits):
                continue
            # First the heads of consecutive hits, then the hits that no run found so far holds.
            head = np.ones(len(hits), bool)
            head[1:] = (hits[1:] != hits[:-1] + 1) | (turn[hits[1:]] == 0)
            start, end = extents(period[hits[head]], place[hits[head]])
            found.append((period[hits[head]], start, end))
            group = np.cumsum(head) - 1
            rest = ~head & (place[hits] + period[hits] >= end[group])
            if rest.any():
                more = hits[rest]
                found.append((period[more], *extents(period[more], place[more])))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    period, start, end = (np.concatenate(c) for c in zip(*found))
    enough = end - start >= np.maximum(least, repeats * period)
    # Equal stretches with several periods: the smallest divides the others.
    runs = pd.DataFrame({"start": start[enough], "period": period[enough], "end": end[enough]})
    runs = runs.sort_values(["start", "end", "period"]).drop_duplicates(["start", "end"]).sort_values(["start", "period"])
    start, period, length = runs["start"].to_numpy(), runs["period"].to_numpy(), (runs["end"] - runs["start"]).to_numpy()
    text = np.searchsorted(first, start, side="right") - 1
    return text, start - first[text], length, period


def _collapsed(words: list[bytes], runs) -> bytes:
    """The words without what repeats a run's first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 6, repeats: int = 4) -> DataFrame:
    """(id, ``n_words``, ``runs``, ``collapsed``) per row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds (start, length, period) by start, then period: every stretch
    with smallest period q and at least ``max(least, repeats * q)`` words that no neighbouring word extends. ``collapsed``
    is the text without the words that a run contains after its first q words, one space between words. Null, empty and white texts
    have no words: no runs and an empty ``collapsed``. Rows stand for themselves (repeated rows, null ids); an empty table gives an
    empty table. Whole texts are read; the work is bounded by megabytes of text at a time, or one text if that is longer. Only
    the id and the text are read, whatever other columns ``df`` has.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def part(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        words = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:])]
        names = [np.fromiter((known.setdefault(w, len(known)) for w in text), np.int64, len(text)) for text in words]
        known.clear()
        owner, start, length, period = runs_of(names, least, repeats)
        edges = np.searchsorted(owner, np.arange(len(words) + 1))
        per_text = [list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())) for a, b in zip(edges[:-1], edges[1:])]
        runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"]))
        left = pa.array([_collapsed(w, r) for w, r in zip(words, per_text)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), runs, left],
                                          ["_id", "_words", "_runs", "_left"])

    def run(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for a, b in chunks(offsets):
                yield part(batch.column(0).slice(a, b - a), data, offsets[a:b + 1])
    slim = df.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("_text"))
    out = slim.mapInArrow(run, f"_id {kind}, _words long, _runs array<struct<start: long, length: long, period: long>>, _left string")
    return out.select(F.col("_id").alias(id_column), F.col("_words").alias("n_words"), F.col("_runs").alias("runs"),
                      F.col("_left").alias("collapsed"))
