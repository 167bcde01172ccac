"""Every stage against a plain version of it, on its own input."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from peakforge.llm.bpe import read_ranks
from peakforge.llm.common import keep, table
from tests.llm.test_line_spread import brute as plain_lines
from tests.llm.test_signature_join import plain_set
from tests.llm.test_simhash_leaks import bag, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        new = keep(stage(spark, docs, SF))
        out.append((docs, new))
        docs = new
    return out


def pairs(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    wanted = table(spark, SF, "documents").columns
    assert all(new.columns == wanted for _, new in stages[:-1])


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = pairs(stages[0][0]), pairs(stages[0][1])
    assert all(before[i] == t for i, t in after.items())
    assert sum((i in after) == bool(q) for i, q in labels.items()) > 0.93 * len(labels)


def test_lines(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[1][0].collect()]
    want = {d: t for d, t, *_ in plain_lines(rows, 10)}
    assert pairs(stages[1][1]) == want
    assert all(r.n_chars == len(r.text) for r in stages[1][1].collect())


def test_near_duplicates(stages):
    before, after = pairs(stages[2][0]), pairs(stages[2][1])
    sets = {i: plain_set(t) for i, t in sorted(before.items())}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in sets if find(i) == i}


def test_decontamination(spark, stages):
    before, after = pairs(stages[3][0]), pairs(stages[3][1])
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]

    def leaked(text):
        w = words(text)
        for q in items:
            k = min(5, len(q))
            want = bag(q, k)
            if not set(bag(w, k)) & set(want):
                continue
            for s in range(max(len(w) - len(q), 0) + 1):
                have = bag(w[s:s + len(q)], k)
                if 100 * sum((have & want).values()) >= 75 * sum((have | want).values()):
                    return True
        return False
    assert set(after) == {i for i, t in before.items() if not leaked(t)} and len(after) < len(before)


def test_tokens(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    before = pairs(stages[4][0])
    rows = stages[4][1].collect()
    assert len(rows) == len(before)
    for r in rows:
        ids = library.encode_ordinary(before[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_run_is_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[4][1].collect()))


def test_odd_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-3, "word " * 50_000, "en", "src2", 250_000),
                                 (None, "no id but text of five words", None, None, None)], docs.schema)
    for n, rows in (("odd", docs.unionByName(odd)), ("none", docs.limit(0))):
        folder = str(tmp_path / n)
        rows.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
        count = corpus_pipeline.run(spark, folder).count()
        assert count > 0 if n == "odd" else count == 0


def test_columns_of_any_name_come_back(spark):
    """Names that the operators use themselves, on all rows that every stage keeps."""
    extra = ["_text", "_cut", "_do", "_new", "_k0", "_k1", "m0", "m1", "_n0", "_n1", "_m0", "_m1", "_th", "_keep_id", "_keep_th", "_r", "_rh",
             "_id", "n", "mark", "count", "line", "h", "words", "label", "score", "places", "TH"]
    docs = table(spark, SF, "documents").withColumns({c: F.concat(F.lit(c + ":"), "doc_id") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = keep(stage(spark, docs, SF))
        assert new.columns == docs.columns, name
        wrong = [c for c in extra if new.filter(~F.col(c).eqNullSafe(F.concat(F.lit(c + ":"), "doc_id"))).count()]
        assert not wrong and new.count() > 0, (name, wrong)
        docs = new
