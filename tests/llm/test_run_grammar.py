"""Runs and extensions against plain loops."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakforge.llm import run_grammar
from peakforge.llm.run_grammar import Grammar, periodic_runs, runs_of


def plain_runs(words, least=6, repeats=4):
    """Every maximal stretch per period; the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, repeats * q))


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


blocks = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9))
texts = st.lists(blocks, max_size=6).map(lambda parts: [w for block, times in parts for w in block * times])


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4), st.integers(2, 5), st.integers(1, 8))
def test_runs_equal_plain_loops(many, repeats, least):
    text, start, length, period = runs_of([np.array(t, np.int64) for t in many], least, repeats)
    for i, words in enumerate(many):
        mine = list(zip(start[text == i].tolist(), length[text == i].tolist(), period[text == i].tolist()))
        assert mine == plain_runs(words, least, repeats)


@settings(max_examples=200, deadline=None)
@given(texts.filter(bool), st.data())
def test_extensions(words, data):
    values = np.array([-1, *words, -2])
    grammar = Grammar(values, rest=data.draw(st.integers(1, 6)))
    n = len(values)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    ahead, back = grammar.extension(x, y), grammar.extension(x, y, forward=False)
    for (i, j), f, b in zip(pairs, ahead, back):
        want = 0
        while j + want < n and values[i + want] == values[j + want]:
            want += 1
        assert f == want
        want = 0
        while i - want >= 0 and values[i - want] == values[j - want]:
            want += 1
        assert b == want


def test_small_blocks_of_the_grid(monkeypatch):
    monkeypatch.setattr(run_grammar, "GRID", 7)
    rng = np.random.default_rng(1)
    many = [rng.integers(0, 2, n) for n in (0, 1, 50, 200, 3)] + [np.tile([4, 5, 6], 40), np.zeros(100, np.int64)]
    text, start, length, period = runs_of(many)
    for i, words in enumerate(many):
        assert list(zip(start[text == i], length[text == i], period[text == i])) == plain_runs(words.tolist())


def test_grammar_levels_shrink():
    values = np.concatenate([[-1], np.random.default_rng(2).integers(0, 50, 20000), [-2]])
    grammar = Grammar(values)
    assert len(grammar.symbols) < 120 and sum(map(len, grammar.symbols)) < 12 * len(values)
    assert len(Grammar(np.concatenate([[-1], np.zeros(1 << 16, np.int64), [-2]])).symbols) < 20


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    prose = " ".join(rng.choice(["an", "la", "no", "ou"], 900))
    texts = ["", None, " \t\n", "a a a a a a b", "x " * 5, "x\ty\x0bx y\n x y  x y  end", prose, "one " * 7000 + "two three " * 300,
             "é ü é ü é ü é ü 中 中 中 中 中 中", "a b c d e f"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, "z z z z z z", "n")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)


def test_rows(docs):
    rows, df = docs
    got = periodic_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t, _ in rows:
        words = (t or "").encode().split()
        runs = plain_runs(words) if len(words) < 2000 else [(0, 7000, 1), (7000, 600, 2)]
        want.append((i, len(words), runs, b" ".join(plain_collapsed(words, runs)).decode()))
    mine = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert periodic_runs(df.limit(0)).count() == 0


def test_query_on_rewritten_texts(spark, tmp_path):
    """The whole contract on a small table, rewriting included, against plain Python."""
    from peakforge.llm.queries import op12_periodic_runs
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"], rng.integers(0, 60)))) for i in range(300)] + [(400, None), (None, "a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        n = len(words)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
                planted += 1
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = got[i]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapsed(words, runs)).encode()).hexdigest()
    assert planted > 10
