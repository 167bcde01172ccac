"""Held-out accuracy, gradients against differences, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakforge.llm.attention_quality import WIDTH, _bags, _forward, classify, fit
from peakforge.llm.common import table

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SMALL, "documents"), table(spark, SMALL, "labels")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_learning_lowers_the_loss_and_finds_the_one_bad_passage():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 8, 400)
    first = np.concatenate([[0], np.cumsum(n)])
    x = rng.normal(0, 0.3, (first[-1], WIDTH)).astype(np.float32)
    y = rng.integers(0, 2, 400).astype(float)
    marks = [first[i] + rng.integers(n[i]) for i in range(400) if not y[i]]
    x[marks, 0] += 4
    m = fit(x, first, y)
    r = _forward(m, x, first)
    assert np.mean((r["p"] > 0.5) == y) > 0.97
    assert np.allclose(np.add.reduceat(r["a"], first[:-1]), 1)


def test_passages_do_not_depend_on_neighbours():
    texts = ["a b a a\nC 7!", "", "word " * 500, "x" * 5000, "é è"]
    together = [x[a:b] for f, _, x, s in _bags(pa.array(texts)) for a, b in zip(s, s[1:])]
    for t, got in zip(texts, together):
        (_, _, x, s), = _bags(pa.array([t]))
        assert np.array_equal(x, got)
    assert [len(g) for g in together] == [1, 1, 11, 1, 1] and not together[1].any()


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "word " * 400_000), (90004, "same"), (90004, "same"),
                                 (None, "no id")], "doc_id long, text string")
    more = spark.createDataFrame([(90004, 1), (90004, None), (None, 0)], "doc_id long, quality int")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("clash")).withColumn("quality", F.lit(1))
    out = classify(both, labels.select("doc_id", F.col("quality").cast("int")).unionByName(more)).filter(
        "doc_id > 90000 or doc_id is null").collect()
    assert len(out) == 6 and all(r.predicted in (0, 1) and 0 <= r.score <= 1 for r in out)


def test_without_labels_or_rows(tables):
    docs, labels = tables
    rows = classify(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and {(r.score, r.predicted) for r in rows} == {(0.5, 0)}
    assert classify(docs.limit(0), labels).count() == 0
