"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from peakforge.llm.common import bytes_of, chunks, lowered, mix, window_hashes, word_hashes, words

SIZE = 5


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: pa.Array, size: int = SIZE):
    """The set of every text in order: distinct runs of ``size`` words of the text with A-Z lower-cased.

    A text with fewer words has its whole sequence as the one member; a text without words, or null, has none.
    """
    data, offsets = bytes_of(texts)
    for first, after in chunks(offsets):
        own = offsets[first:after + 1]
        part = lowered(data[own[0]:own[-1]])
        starts, ends, of = words(part, own - own[0])
        hashes = word_hashes(part, starts, ends)
        runs = window_hashes(hashes, size)
        for a, b in zip(of[:-1], of[1:]):
            if b - a >= size:
                yield _distinct(runs[a:b - size + 1])
            elif b > a:
                yield mix(window_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a))
            else:
                yield hashes[:0]
