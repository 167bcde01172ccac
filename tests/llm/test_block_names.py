"""Exact groups against a dictionary of normalised texts."""

import hashlib
import re

import pytest

from peakforge.llm import block_names
from peakforge.llm.block_names import exact_duplicates
from peakforge.llm.queries import ORACLE, QUERIES

LONG = "abc def " * 3000
TEXTS = ["a b\tc", "abc", " abc\n\n", "", None, "   ", "é x", "éx", LONG, LONG.replace(" ", "\x0b"), LONG[:-1] + "!", "!" + LONG, "b",
         "xx" * 40, "xx" * 41, "xx" * 40 + "y", "ABC", "a b", "ab"]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[body])[3]
        out.append((i, best, len(groups[body]), i == best, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [4, 4096])
def test_against_dictionary(spark, block_bytes):
    rows = [*enumerate(TEXTS), (100, "abc"), (101, LONG), (2, " abc\n\n"), (None, "abc"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                                 "doc_id long, text string, name string, group_size int").repartition(4)
    got = [tuple(r) for r in exact_duplicates(docs, block_bytes=block_bytes).drop("level", "name").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).count() == 0


def test_query_has_sql():
    assert "op8_exact_dedup" in QUERIES and "op8_exact_dedup" in ORACLE


def test_white_space_is_taken_out_once_per_row(spark, monkeypatch):
    """A text of many blocks was stripped anew for every block."""
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)
    stored = block_names.keep
    monkeypatch.setattr(block_names, "keep", keep)
    docs = spark.createDataFrame([(1, LONG), (2, "a b"), (None, None)], "doc_id long, text string")
    assert exact_duplicates(docs, block_bytes=4096).count() == 3
    assert [p.count("replace(") for p in plans if "replace(" in p] == [6, 6]  # one for each white space character
