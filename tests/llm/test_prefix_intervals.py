"""Kept bytes against a dictionary of all 50-byte strings."""

import random

import numpy as np
import pyarrow as pa
import pytest

from peakforge.llm.prefix_intervals import equal_classes, remove_repeated_bytes, runs, suffix_array

LAST = 2**63 - 1


def brute(rows, size):
    raw = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    low = {}
    for d, b in raw:
        for i in range(len(b) - size + 1):
            k = b[i:i + size]
            low[k] = min(low.get(k, d), d)
    out = []
    for (d, _), (mine, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if low[b[i:i + size]] < mine:
                gone[i:i + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        runs = [(int(a), int(z - a)) for a, z in zip(edge[::2], edge[1::2])]
        out.append((d, len(b), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_classes_are_equal_windows(seed):
    rng = random.Random(seed)
    for _ in range(60):
        size = rng.choice([1, 2, 3, 5, 8, 50])
        base = [bytes(rng.choice([0, 1, 97, 98, 99, 255]) for _ in range(rng.randint(size, size + 30))) for _ in range(3)]
        strings = []
        for _ in range(rng.randint(1, 12)):
            b = bytearray(rng.choice(base))
            b[rng.randrange(len(b))] = rng.choice([0, 97, 98])
            strings.append(bytes(b[rng.randint(0, 3):]) or b"a")
        classes, whole = equal_classes(strings, size)
        at, there, back = 0, {}, {}
        for s in strings:
            for i in range(len(s) + 1):
                assert whole[at] == (len(s) - i >= size)
                if whole[at]:
                    k = s[i:i + size]
                    assert there.setdefault(k, classes[at]) == classes[at] and back.setdefault(classes[at], k) == k
                at += 1


@pytest.mark.parametrize("size,gram", [(6, 3), (50, 18)])
def test_against_dictionary(spark, size, gram):
    rng = random.Random(size)
    letters = "abé \n" if size == 6 else "abcdefgh éü\n"
    passage = "".join(rng.choice(letters) for _ in range(2 * size))
    rows = []
    for i in range(70):
        t = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, size - 1, size, 4 * size])))
        if i % 2:
            at, cut = rng.randint(0, len(t)), rng.randint(0, size // 2)
            t = t[:at] + passage[cut:] + t[at:]
        rows.append((rng.randrange(10**6), t))
    near = passage[:size] + "X" + passage[size:]
    rows += [(5, "z" * 4 * size), (9, "z" * 5 * size), (9, "z" * 3 * size), (9, "zy" * size), (None, "z" * 3 * size), (None, near), (7, near),
             (11, None), (12, ""), (3, "long text " * 20_000), (4, "long text " * 20_000), (6, passage), (6, passage), (6, "q" + passage),
             (8, rows[3][1]), (10**7, rows[3][1])]
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, kept binary, n_bytes int").repartition(5)
    out = remove_repeated_bytes(docs, length=size, gram=gram, part_bytes=40_000, piece_bytes=20_000)
    assert out.columns == ["doc_id", "n_bytes", "removed", "kept"]
    got = [(r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in out.collect()]
    assert sorted(got, key=repr) == brute(rows, size)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = [(i, "".join(chr(97 + (i // 2 * 7 + j * j) % 23) for j in range(90))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = sorted(map(repr, remove_repeated_bytes(docs).collect()))
    monkeypatch.setattr("peakforge.llm.prefix_intervals.BROADCAST_BYTES", 0)
    assert sorted(map(repr, remove_repeated_bytes(docs).collect())) == one


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_key_is_one_group(spark):
    from peakforge.llm.common import keep
    from peakforge.llm.prefix_intervals import PIECES, _without_hot
    rng = random.Random(8)
    line = "The line that stands in every text, and is long enough."

    def words(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, f"{words(60)}{line}{words(60)}") for i in range(300)] + [(None, line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(LAST if r.doc_id is None else r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept))
           for r in remove_repeated_bytes(docs, piece_bytes=2000).collect()]
    assert sorted(((None if d == LAST else d, *x) for d, *x in got), key=repr) == sorted(
        ((None if d == LAST else d, *x) for d, *x in brute(rows, 50)), key=repr)
    raw = [(0, i, i, 7 if i < 300 else 8, 0, t.encode()[40:122], None) for i, (_, t) in enumerate(rows)] + [(1, 5, 5, 0, 0, None, b"x" * 8)]
    out = _without_hot(keep(spark.createDataFrame(raw, PIECES).repartition(4)), 4, 50, 2000).collect()
    size = {}
    for r in out:
        if r.piece is not None:
            size.setdefault(r.key, set()).add(bytes(r.piece))
    assert max(sum(map(len, x)) for x in size.values()) <= 2000
    assert {p for r in raw if r[5] for p in (r[5][i:i + 50] for i in range(len(r[5]) - 49))} == {
        p for x in size.values() for w in x for p in (w[i:i + 50] for i in range(len(w) - 49))}
    assert any(r.spans == b"x" * 8 for r in out)


def test_keys_spread_over_the_parts():
    """Keys are minimal hashes: as they were, the first of 64 parts got a third of them."""
    rng = np.random.default_rng(5)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 5000))) for _ in range(20)])
    keys, *_ = runs(texts, 50, 18)
    parts = np.bincount((keys >> np.uint64(58)).astype(np.int64), minlength=64)
    assert len(keys) > 4000 and parts.max() < 2 * len(keys) / 64 and parts.min() > 0


def test_suffixes_in_order():
    rng = np.random.default_rng(6)
    for alphabet, n in ((2, 300), (3, 60), (200, 50), (1, 120)):
        codes = rng.integers(1, alphabet + 1, n)
        codes[rng.integers(0, n, n // 25)] = 0
        own = [codes[i:].tolist() for i in range(n)]
        own = [s[:s.index(0)] if 0 in s else s for s in own]
        found = suffix_array(codes, 56).tolist()
        assert sorted(found) == list(range(n)) and [own[i][:56] for i in found] == sorted(s[:56] for s in own)
