"""Nodes against a plain trie of Python tuples."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakforge.llm import prefix_trie as module
from peakforge.llm.prefix_trie import RangeMinimum, extents, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(conversations):
    """{id: list of (role, text)} to the rows of the contract."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [k for k in members if k[:len(node)] == node]
        children = {k for k in below if len(k) == len(node) + 1}
        leaves = [k for k in below if not any(j[:-1] == k for j in below if j)]
        ends = sorted(c for c in inside if len(conversations[c]) == len(node))
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_order(rows):
    """Conversations in the documented order of their turns."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_extents(lcp, data):
    lcp = np.array([0, *lcp])
    at = np.array(data.draw(st.lists(st.integers(0, len(lcp) - 1), min_size=1, max_size=20)))
    depth = np.array([data.draw(st.integers(1, 7)) for _ in at])
    left, right = extents(lcp, at, depth)
    table = RangeMinimum(lcp)
    for i, d, a, b in zip(at, depth, left, right):
        x = y = i
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y + 1 < len(lcp) and lcp[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
        assert table.minimum(np.array([a]), np.array([b]))[0] == lcp[a:b + 1].min()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(120):
        n = int(rng.integers(1, 7))
        opening = rng.integers(0, 2, 8)
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"é{opening[t]}" * int(opening[t] + 1) if c % 3 else "all the same") for t in range(n)]
    long = [(500 + i, t, "user", f"turn {t % 7}" if t < 60 + i else "own" + str(i)) for i in range(4) for t in range(75)]
    rows += long
    odd = [(700, None, "user", "null first"), (700, 0, None, None), (700, 1, "a", "tie"), (700, 1, "a", "tie"), (700, 1, "A", "tie"),
           (701, 5, None, "null first"), (None, 0, "user", "no conversation"), (-3, 0, "", ""), (702, 0, "us", "er"), (703, 0, "user", "")]
    rows += odd
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, h1 string").repartition(5)


def test_trie(spark, table):
    rows, df = table
    empty = spark.createDataFrame([(900,), (-9,), (5,), (None,)], "conv_id long")
    got = prefix_trie(df, empty)
    assert got.columns == COLUMNS
    assert rows_of(got) == plain_trie({**{900: [], -9: []}, **plain_order(rows)})


def test_pieces_meet(spark, table, monkeypatch):
    """Small batches, running totals and packs of ids: every node is met in many pieces."""
    monkeypatch.setattr(module, "SUPER", 2)
    monkeypatch.setattr(module, "CHUNK_CHARS", 32)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows, df = table
        assert rows_of(prefix_trie(df)) == plain_trie(plain_order(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty(spark, table):
    _, df = table
    assert prefix_trie(df.limit(0)).count() == 0
    only = prefix_trie(df.limit(0), spark.createDataFrame([(4,), (2,)], "conv_id long"))
    assert rows_of(only) == plain_trie({4: [], 2: []})


def test_query(spark, tmp_path):
    """The rebuilt conversations of the contract."""
    from peakforge.llm.queries import op13_prefix_trie
    rng = np.random.default_rng(8)
    rows = [(int(c), t, "user", f"text {rng.integers(0, 3)}") for c in rng.choice(90, 60, replace=False) for t in range(rng.integers(1, 12))]
    rows += [(3, None, None, None), (None, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = plain_order(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in built.values())
    assert rows_of(op13_prefix_trie(spark, str(tmp_path))) == plain_trie(built)
