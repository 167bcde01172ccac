"""Held-out accuracy, and the filters against plain sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.llm.common import held_out, table
from peakforge.llm.language_bits import Filters, _grams, _prepared, _slots, identify, learn, predict_languages


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_lookup_has_every_stored_language(spark):
    import pyarrow as pa
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    filters = learn(docs, least_count=1, least_share=0.0, slot_bits=20)
    text = docs.filter("lang = 'fr'").first().text
    data, offsets = _prepared(pa.array([text]))
    grams, _ = _grams(data, offsets)
    bit = np.uint64(filters.languages.index("fr"))
    found = np.bitwise_and.reduce([filters.table[0][s] for s in _slots(grams, filters.hashes, filters.slot_bits)])
    assert (found >> bit & np.uint64(1)).all()


def test_correction_of_false_answers(spark):
    table_ = np.zeros((1, 1 << 8), np.uint64)
    table_[:] = 2  # the second language's filter is full and says yes to everything
    filters = Filters(["aa", "bb"], table_, np.array([0.0, 1.0]), 2)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert identify(docs, filters).first().lang_pred == "aa"


def test_odd_rows(spark):
    base = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [(9001, None, "en"), (9002, "", "fr"), (9003, "123 --- 456", None), (9004, "the " * 300_000, None),
            (9005, "a", None), (9005, "a", None), (None, "the thing that was", None), (9006, "the of", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = base.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(None).cast("int"))
    out = {}
    for r in predict_languages(docs).filter("doc_id > 9000 or doc_id is null").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert {i: out[i][0].lang_pred for i in (9001, 9002, 9003, 9004, None, 9006)} == {
        9001: "und", 9002: "und", 9003: "und", 9004: "en", None: "en", 9006: "en"}
    assert len(out[9005]) == 2 and out[9005][0].lang_pred == out[9005][1].lang_pred
    assert out[9001][0].score == 0.0


def test_empty_table_and_no_labels(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert predict_languages(docs.limit(0)).count() == 0
    rows = predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_held_out_rule(spark):
    import zlib
    docs = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


@pytest.mark.parametrize("texts", [["", "ab", "abc"], ["hello world", "x", "", "é"]])
def test_grams_stay_within_texts(texts):
    import pyarrow as pa
    data, offsets = _prepared(pa.array(texts))
    grams, starts = _grams(data, offsets)
    want = []
    for t in texts:
        b = f" {t.lower()} ".encode()
        want.append([int.from_bytes(b[i:i + 4], "big") for i in range(len(b) - 3)])
    assert [grams[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
