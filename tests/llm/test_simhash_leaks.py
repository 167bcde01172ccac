"""Findings against every window of plain multisets."""

import random
import re
from collections import Counter

from peakforge.llm.simhash_leaks import leaks, without_leaks


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, q in items:
            q = words(q)
            if not q:
                continue
            k, size, best = min(5, len(q)), len(q), None
            want = bag(q, k)
            for s in range(max(len(w) - size, 0) + 1):
                have = bag(w[s:s + size], k)
                common = sum((have & want).values())
                total = sum((have | want).values())
                if common and 100 * common >= 75 * total and (best is None or common / total > best):
                    best = common / total
            if best is not None:
                out.add((d, i, round(best, 9)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([15, 22, 40, 60])))) for i in range(15)]
    items += [(50, "one two three"), (51, ""), (52, None), (53, " ".join(["same"] * 20)), (54, items[0][1]), (0, items[0][1])]
    docs = []
    for i in range(90):
        w = some(rng.choice([0, 3, 30, 200]))
        if i % 2:
            q = rng.choice(items[:15])[1].split()
            change = rng.choice(["none", "word", "cut", "insert", "upper", "half"])
            at = rng.randrange(len(q))
            q = {"none": q, "word": q[:at] + ["new"] + q[at + 1:], "cut": q[:at] + q[at + 1:], "insert": q[:at] + ["new"] + q[at:],
                 "upper": [x.upper() for x in q], "half": q[:len(q) // 2]}[change]
            cut = rng.randint(0, len(w))
            w = w[:cut] + q + w[cut:]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "One TWO three four"), (204, "three two one"), (205, "same " * 50), (206, "same same"),
             (207, "x " * 50_000 + items[3][1]), (1, docs[1][1]), (None, items[2][1])]
    return docs, items


def test_against_every_window(spark):
    docs, items = case(4)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, similarity string, size int").repartition(4)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, words string")
    rows = leaks(d, b).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in rows} == brute(docs, items)
    for r in rows:
        if r.doc_id == 207:
            assert (r.first_word, r.similarity) == (50_000, 1.0)
    found = {r[0] for r in brute(docs, items)}
    left = without_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(x for x, _ in docs if x not in found)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert leaks(d.limit(0), b).count() == 0
    assert leaks(d, b.limit(0)).count() == 0 and without_leaks(d, b.limit(0)).count() == 1
    assert leaks(d, b).count() == 1


def test_no_python_on_the_main_path(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    plan = leaks(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_several_cuts_and_insertions(spark):
    """Items with one to three changes of up to 14 words each, against every window."""
    rng = random.Random(8)

    def some(n):
        return [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([40, 80, 120])))) for i in range(8)]
    docs = []
    for i in range(40):
        q = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(len(q)), rng.randint(1, 14)
            q = q[:at] + q[at + n:] if rng.random() < 0.5 else q[:at] + some(n) + q[at:]
        docs.append((i, " ".join(some(rng.randint(0, 60)) + q + some(rng.randint(0, 60)))))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in leaks(d, b).collect()}
    assert found == brute(docs, items) and len(found) > 10


def test_items_longer_than_a_small_counter(spark):
    rng = random.Random(9)
    q = [f"w{rng.randrange(30_000)}" for _ in range(40_000)]
    docs = [(1, " ".join(["x"] * 9 + q + ["y"] * 5)), (2, " ".join(q[:30_000] + ["new"] + q[30_001:])), (3, " ".join(q[:10_000])), (4, "w1 w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = leaks(d, spark.createDataFrame([(1, " ".join(q)), (2, "w5 w6 w7 w8 w9")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in sorted(rows)] == [(1, 1, 9), (2, 1, 0)]
    assert {r.doc_id: r.similarity for r in rows} == {1: 1.0, 2: (39_996 - 5) / (39_996 + 5)}
