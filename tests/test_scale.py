"""What must hold at any size: empty selections, bounded memory of tasks and driver, grouped blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakforge.functions import distances, kernels
from peakforge.llm import bpe
from peakforge.operators import features as X, models as M, neighbours as N, resample as R, silhouette, spectra
from peakforge.operators.tiles import in_groups


def test_no_feature_is_taken(spark):
    """no feature reaches the threshold."""
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "sample_id string, features array<double>")
    got = {r["sample_id"]: r["features"] for r in X.take_features(df, []).collect()}
    assert got == {"a": [], "b": None}


def test_extra_trees_in_parts(spark, points, monkeypatch):
    """trees grown, stored and asked in parts give what one forest of them gives, for repeated and null ids too."""
    rows = points.unionByName(points.limit(7)).withColumn("sample_id", F.when(F.col("sample_id") != "p003", F.col("sample_id")))
    whole = M.fit("extra_trees", points, trees=6, max_depth=4)
    monkeypatch.setattr(M, "NODES_AT_ONCE", 2 * 150 * 2)
    parts = M.fit("extra_trees", points, trees=6, max_depth=4)
    assert isinstance(parts.model, str)
    got = parts.predict(rows).collect()
    assert len(got) == 157 and set(parts.predict(rows).columns) == set(whole.predict(rows).columns)
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == float(r["probability"][1] > r["probability"][0]) for r in got)
    hits = sum(r["prediction"] == r["label"] for r in got)
    assert hits >= 0.6 * 157


def _lists(df):
    return sorted((r["sample_id"], [(n["id"], round(n["dist"], 9), n["label"]) for n in r["nn"]]) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_copies_are_joined_by_vector(spark, metric):
    """many copies on both sides, ties between vectors on a lattice, a row without a vector."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i:03d}", [float(v) for v in rng.integers(0, 3, 3)], float(i % 2)) for i in range(200)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>, label double").repartition(4)
    assert N._many_copies(df)
    for k, own in ((1, True), (5, True), (5, False)):
        want = _lists(N.knn_lists(df, df, k, metric, own, strategy="broadcast"))
        assert _lists(N.knn_lists(df, df, k, metric, own, strategy="blocks", block_bytes=10 * 24)) == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_shortlists_hold_all_neighbours(metric):
    """rough distances with an error bound find what full distances find; no entry per pair is kept."""
    rng = np.random.default_rng(2)
    for make in (lambda n: rng.normal(size=(n, 7)), lambda n: rng.integers(0, 3, (n, 4)).astype(float), lambda n: rng.normal(size=(n, 5)) * 1e-30 + 1e-28,
                 lambda n: rng.normal(size=(n, 3)) + 1e6, lambda n: np.zeros((n, 2))):
        q, s = make(600), make(1500)
        full = distances._ranked(q, s, 6, metric)
        assert all(np.array_equal(a, b) for a, b in zip(distances.nearest(q, s, 6, metric), full))
        reach = np.full(len(q), np.inf)
        reach[::2] = [full[2][full[0] == i].max() for i in range(0, len(q), 2)]
        assert all(np.array_equal(a, b) for a, b in zip(distances.nearest(q, s, 6, metric, reach), full))
    gap = distances.full(q, s, metric)
    weights = rng.normal(size=(len(s), 2))
    assert np.allclose(distances.Sums(s, weights, metric).of(q), gap @ weights)


def test_small_blocks_make_no_more_groups(spark):
    """groups are bounded by bytes, so blocks of few rows do not multiply the copies of a side."""
    blocks = spark.range(800).select(F.col("id").alias("block"), F.lit(b"x" * 64).alias("data"))
    assert in_groups(blocks).select("group").distinct().count() == 16
    assert in_groups(blocks.withColumn("data", F.lit(b"x" * (1 << 22)))).groupBy("group").count().agg(F.max("count")).first()[0] == 8


def test_bins_come_in_slices(spark, monkeypatch):
    """F16, F17: the results of an Arrow batch are never held whole; every spectrum keeps its own."""
    sizes = []
    plain = kernels.from_rows
    monkeypatch.setattr(kernels, "from_rows", lambda rows: sizes.append(len(rows)) or plain(rows))
    mz, y = (pa.array([[2000.0 + 5 * i, 2001.0, 19000.0][:2 + i % 2] for i in range(300)]), pa.array([[1.0 * i, 2.0, 3.0][:2 + i % 2] for i in range(300)]))
    run = spectra._in_slices(lambda a, b: kernels.from_rows([v for _, v in spectra._rows(a, b)])).func
    parts = list(run(iter([(mz, y)])))
    assert max(sizes) <= spectra.SLICE and pa.concat_arrays(parts).to_pylist() == y.to_pylist()
    df = spark.range(300).coalesce(1).select(F.col("id").alias("spectrum_id"), F.array(F.lit(2000.0) + F.col("id")).alias("mz"), F.array(F.lit(1.0) + F.col("id")).alias("intensity"))
    got = {r[0]: r[1] for r in df.transform(spectra.bin_equal()).select("spectrum_id", F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v)).collect()}
    assert got == {i: 1.0 + i for i in range(300)}


def test_short_pieces_merge_as_in_the_tree(monkeypatch):
    """op9: the list of a short piece and the tree give the same ids."""
    rng = np.random.default_rng(4)
    ranks = {bytes([b]): b for b in range(4)}
    tokens = list(ranks)
    while len(ranks) < 60:
        token = tokens[rng.integers(len(tokens))] + tokens[rng.integers(len(tokens))]
        if token not in ranks:
            ranks[token] = len(ranks)
            tokens.append(token)
    pieces = [rng.integers(0, 4, n).astype(np.uint8).tobytes() for n in range(2, 65) for _ in range(20)]
    short = [bpe.merge(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [bpe.merge(p, ranks) for p in pieces]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_sides_are_made_ready_once(metric):
    """one side serves many calls, for rows far outside its range too, and the calls share their memory."""
    rng = np.random.default_rng(3)
    s = rng.normal(size=(900, 6))
    side = distances.Side(s, metric)
    for q in (rng.normal(size=(70, 6)), rng.normal(size=(700, 6)) * 40, s[:5] + 1e4, s[:0], np.full((2, 6), 1e200)):
        full = distances._ranked(q, s, 4, metric) if len(q) else (np.zeros(0),) * 3
        assert all(np.array_equal(a, b) for a, b in zip(distances.nearest(q, side, 4), full))
    held = {id(distances.scratch("rough", (8, 8), np.float32).base) for _ in range(3)}
    assert len(held) == 1


@pytest.mark.parametrize("sums", ["broadcast", "blocks"])
def test_targets_share_their_distances(spark, monkeypatch, sums):
    """beyond a broadcast, the targets on the same vectors are scored from one set of distances, as one by one."""
    rng = np.random.default_rng(8)
    rows = [(f"r{i:03d}", [float(v) for v in rng.integers(0, 4, 3)], t, int(rng.integers(0, c))) for i in range(90)
            for t, c in (("a", 2), ("b", 3), ("one", 1)) if t != "b" or i % 4]
    rows += [("lone", [9.0, 9.0, 9.0], "a", 7), ("none", None, "a", 1), ("r000", [1.0, 1.0, 2.0], "a", 1)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>, target string, label int")
    points = df.withColumn("n_components", F.explode(F.array(F.lit(2), F.lit(3)))).withColumn("features", F.slice("features", F.lit(1), F.col("n_components")))
    keys = ["target", "n_components"]
    want = {tuple(r[k] for k in keys): (r["n"], r["silhouette"]) for r in silhouette.silhouette_by(points, keys).collect()}
    monkeypatch.setattr(silhouette.B, "fits", lambda n, d: d > 3 and sums == "broadcast")
    made = []
    plain = silhouette._sums_to
    monkeypatch.setattr(silhouette, "_sums_to", lambda *a, **b: made.append(1) or plain(*a, **b))
    got = {tuple(r[k] for k in keys): (r["n"], r["silhouette"]) for r in silhouette.silhouette_by(points, keys, shared=["n_components"], block_bytes=240).collect()}
    assert len(made) == 2 and got.keys() == want.keys() and len(got) == 6
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], equal_nan=True) for k in want)


def _round_by_round(df, k):
    """Editing with a new join in every round."""
    start = sizes = R.class_sizes(df)
    for n in range(1, 30):
        after = R.cut_lineage(R.edited(df, k=k))
        new = R.class_sizes(after)
        if R._shrunk(start, new):
            return df, n
        df = after
        if new == sizes:
            return df, n
        sizes = new


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def cloud(spark):
    """Two classes that overlap and a rare one, with copies, repeated and null ids, rows without a vector."""
    rng = np.random.default_rng(11)
    label = rng.choice(3, 260, p=[0.55, 0.4, 0.05])
    x = (rng.normal(size=(260, 3)) + (label == 1)[:, None]).round(1)
    x[200:230] = x[170:200]
    rows = [(f"r{i % 250:03d}" if i % 90 else None, [float(v) for v in x[i]], int(label[i])) for i in range(260)]
    rows += [("none", None, 0), ("none", None, 2), ("r007", rows[7][1], 0)]
    return R.cut_lineage(spark.createDataFrame(rows, "sample_id string, features array<double>, label int").repartition(4))


@pytest.mark.parametrize("spare", [2, 16])
def test_rounds_of_editing_share_a_join(cloud, monkeypatch, spare):
    """rounds take their neighbours from the lists of one join; rows whose list runs out are joined again."""
    want, rounds = _round_by_round(cloud, 3)
    joined, plain = [], R.knn_lists
    monkeypatch.setattr(R, "SPARE", spare)
    monkeypatch.setattr(R, "knn_lists", lambda left, *a, **b: joined.append(left.count()) or plain(left, *a, **b))
    assert _rows(R.repeated_edited(cloud)) == _rows(want)
    assert rounds > 3 and sum(joined[1:]) < joined[0]


def test_rounds_of_editing_by_blocks(spark, monkeypatch):
    """the same beyond a broadcast."""
    rng = np.random.default_rng(12)
    rows = [(f"r{i:03d}", [float(v) for v in rng.normal(size=3)], int(i % 7 > 0)) for i in range(140)]
    df = R.cut_lineage(spark.createDataFrame(rows, "sample_id string, features array<double>, label int").repartition(4))
    want = _rows(_round_by_round(df, 3)[0])
    monkeypatch.setattr(N.B, "fits", lambda n, d: False)
    monkeypatch.setattr(R, "fits", lambda n, d: n < 100)
    monkeypatch.setattr(R, "SPARE", 4)
    assert _rows(R.repeated_edited(df)) == want


@pytest.mark.parametrize("own", [True, False])
def test_few_rows_are_joined_in_one_pass(spark, own):
    """a few rows, one without a vector, against a table in several parts, with ties."""
    rng = np.random.default_rng(13)
    rows = [(f"r{i:03d}", [float(v) for v in rng.integers(0, 3, 3)], float(i % 2)) for i in range(150)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>, label double").repartition(5)
    few = df.filter("sample_id < 'r006'")
    assert few.count() == 7
    assert _lists(N.knn_lists(few, df, 4, exclude_self=own, strategy="few")) == _lists(N.knn_lists(few, df, 4, exclude_self=own, strategy="broadcast"))
    assert all(not r["nn"] for r in N.knn_lists(few, df.limit(0), 4, strategy="few").collect())


def test_rounds_of_editing_when_the_smallest_class_changes(spark):
    """rows of the class that was the smallest are judged once another one is."""
    rows = [(f"low{i}", [100.0 * i], 1) for i in range(9)] + [("low9", [-5000.5], 1)] + [(f"near{i}", [100.0 * i + 1], 0) for i in range(9)] + [
        (f"far{i}", [-5000.0 - 0.1 * i], 0) for i in range(10)] + [("alone", [-5000.6], 0)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>, label int")
    for k in (1, 2):
        want, rounds = _round_by_round(df, k)
        assert _rows(R.repeated_edited(df, k=k)) == _rows(want)
    sizes = R.class_sizes(R.repeated_edited(df, k=1))
    assert sizes[1] < 10
