"""Kept words against a dictionary of all windows."""

import random

import pytest

from peakforge.llm.window_removal import remove_repeated


def brute(rows, size):
    import re
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            mine = 2**63 - 1 if d is None else d
            order[k] = min(order.get(k, mine), mine)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if order[tuple(w[i:i + size])] < (2**63 - 1 if d is None else d):
                gone.update(range(i, i + size))
        runs, i = [], 0
        while i < len(w):
            j = i
            while j in gone:
                j += 1
            if j > i:
                runs.append((i, j - i))
            i = max(j, i + 1)
        out.append((d, len(w), len(gone), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [3, 50])
def test_against_dictionary(spark, size):
    rng = random.Random(size)
    words = ["a", "b", "É", "c!", "dd"] if size == 3 else [f"w{i}" for i in range(50)]
    passage = [rng.choice(words) for _ in range(size + 7)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, size - 1, size, 3 * size]))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(w)))
    same = "same " * (4 * size)
    rows += [(5, same), (9, same), (9, same), (9, "other"), (None, same), (None, same), (11, None), (12, ""), (13, " \n "),
             (3, "x " * 60_000), (4, "x " * 60_000), (2, "y " + " ".join(passage)), (2, " ".join(passage) + " z")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, places string").repartition(5)
    got = [(r[0], r[1], r[2], [tuple(x) for x in r[3]], r[4]) for r in remove_repeated(docs, window=size, part_bytes=20_000).collect()]
    assert sorted(got, key=repr) == brute(rows, size)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 2 + j) % 90}" for j in range(70))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = sorted(map(repr, remove_repeated(docs).collect()))
    monkeypatch.setattr("peakforge.llm.window_removal.SMALL_BYTES", 0)
    assert sorted(map(repr, remove_repeated(docs).collect())) == one


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
