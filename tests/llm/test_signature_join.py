"""Components against all pairs of plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from peakforge.llm import signature_join
from peakforge.llm.signature_join import first_of_each, near_duplicates


def plain_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        best = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), best, d == best))
    return sorted(out, key=repr)


def corpus(seed, copies, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(copies):
            mine = list(base)
            for _ in range(rng.randint(0, max(1, int(len(base) * edits)))):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            rows.append(" ".join(mine))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 60))) for _ in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("copies,edits,short", [(9, 0.02, 48), (16, 0.06, 4)])
def test_against_all_pairs(spark, monkeypatch, copies, edits, short):
    monkeypatch.setattr(signature_join, "SHORT", short)
    monkeypatch.setattr(signature_join, "BLOCK_TEXTS", 10)
    texts = corpus(copies, copies, edits)
    odd = ["", None, " \n ", "one two", "ONE\ttwo", "one two three", "a b c d e", "A B c d e", "a b c d e f", "É b c d e", "é b c d e"]
    rows = [*enumerate(texts + odd), (3, texts[3]), (4, "other text under one id"), (None, texts[0]), (None, None), (None, "alone here"),
            (7000, "word " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, label string").repartition(3)
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_nothing_in_common(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(c), "id") for c in "abcdefgh"]).alias("text"))
    rows = near_duplicates(docs).collect()
    assert len(rows) == 50 and all(r.kept and r.n_shingles == 4 for r in rows)


def test_first_of_each(spark):
    texts = corpus(5, 6, 0.02)
    rows = [*enumerate(texts), (3, texts[3]), (500, texts[7]), (600, None), (601, ""), (601, ""), (None, texts[1]), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, th string").repartition(3)
    out = first_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    groups = {}
    for d, n, component, _ in brute(rows):
        groups.setdefault(component, n)
    want = [(d, t) for d, t in dict.fromkeys(rows) if plain_set(t) and (d, True) in {(x[0], x[3]) for x in brute(rows)}]
    want += [(600, None), (601, ""), (601, "")]
    assert got == sorted([(d, t) for d, t in want if d is not None] + [(None, "alone here")], key=repr)
