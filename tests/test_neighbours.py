import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.operators import neighbours as N
from peakforge.operators import pike, silhouette as S


def brute(left, right, k, metric="euclidean", exclude_self=True):
    out = {}
    for i, x, _ in left:
        found = []
        for j, y, c in right:
            if exclude_self and i == j:
                continue
            gap = np.asarray(x) - np.asarray(y)
            found.append((float(np.sqrt((gap * gap).sum()) if metric == "euclidean" else np.abs(gap).sum()), j, c))
        out[i] = sorted(found)[:k]
    return out


def rows(df):
    return [(r["sample_id"], r["features"], r["label"]) for r in df.collect()]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_knn_matches_brute_force(points, metric, strategy):
    got = N.knn_lists(points, points, 5, metric, strategy=strategy, block_bytes=16 * 48).collect()
    want = brute(rows(points), rows(points), 5, metric)
    assert len(got) == len(want)
    for r in got:
        assert [(n["id"], n["label"]) for n in r["nn"]] == [(j, c) for _, j, c in want[r["sample_id"]]]
        assert np.allclose([n["dist"] for n in r["nn"]], [d for d, _, _ in want[r["sample_id"]]])


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_knn_two_sides_and_few_rows(points, strategy):
    left, right = points.filter("label = 0"), points.filter("label = 1").limit(3)
    right = right.sparkSession.createDataFrame(right.collect(), right.schema)
    got = N.knn_lists(left, right, 5, exclude_self=False, strategy=strategy, block_bytes=16 * 48).collect()
    want = brute(rows(left), rows(right), 5, exclude_self=False)
    assert all([n["id"] for n in r["nn"]] == [j for _, j, _ in want[r["sample_id"]]] for r in got)


def test_graph_of_smaller_k_is_a_filter(points):
    big, small = N.neighbour_graph(points, 10), N.neighbour_graph(points, 4)
    key = ["src", "dst", "rank"]
    assert sorted(map(tuple, N.at_most(big, 4).select(*key).collect())) == sorted(map(tuple, small.select(*key).collect()))


def test_graph_lowers_k(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "sample_id string, features array<double>")
    assert N.neighbour_graph(df, 5).count() == 2


@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_classify(points, weights):
    train, test = points.filter("sample_id < 'p100'"), points.filter("sample_id >= 'p100'")
    got = {r["sample_id"]: r["prediction"] for r in N.knn_classify(test, train, 5, weights=weights).collect()}
    for i, found in brute(rows(test), rows(train), 5, exclude_self=False).items():
        votes = {0.0: 0.0, 1.0: 0.0}
        exact = any(d == 0 for d, _, _ in found)
        for d, _, c in found:
            votes[c] += 1.0 if weights == "uniform" else (float(d == 0) if exact else 1.0 / d)
        assert got[i] == (1.0 if votes[1.0] > votes[0.0] else 0.0)


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_silhouette(points, strategy):
    data = rows(points)
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = d[i, y != y[i]].mean()
        s.append((b - a) / max(a, b))
    got = S.silhouette(points, strategy=strategy, block_bytes=16 * 48).first()[0]
    assert math.isclose(got, np.mean(s), abs_tol=1e-9)
    assert -1 <= got <= 1


def test_silhouette_edge_cases(points, spark):
    assert math.isnan(S.silhouette(points.withColumn("label", F.lit(1.0))).first()[0])
    df = spark.createDataFrame([("a", [0.0], 0.0), ("b", [1.0], 1.0), ("c", [2.0], 1.0)],
                               "sample_id string, features array<double>, label double")
    got = {r["sample_id"]: r["silhouette"] for r in S.silhouette_samples(df).collect()}
    assert got["a"] == 0.0 and got["b"] == 0.0 and math.isclose(got["c"], 0.5)


def kernel(x, mz, t, cut=1e-6):
    w = np.exp(-((mz[:, None] - mz[None]) ** 2) / (4 * t))
    d = np.flatnonzero(w[0] < cut)[0]
    i, j = np.indices(w.shape)
    return x @ np.where(j < i + d, w, 0) @ x.T / (4 * np.pi * t)


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_peak_kernel(points, strategy):
    mz = np.arange(6) * 3.0
    data = sorted(rows(points))
    want = kernel(np.array([r[1] for r in data]), mz, 1.5)
    at = {r[0]: i for i, r in enumerate(data)}
    out = pike.pike_kernel(points, None, mz, t=1.5, strategy=strategy, block_bytes=16 * 48)
    assert out.columns == ["id_x", "id_y", "k"]
    entries = {(r["id_x"], r["id_y"]): r["k"] for r in out.collect()}
    assert len(entries) == want.size
    assert all(np.isclose(k, want[at[i], at[j]]) for (i, j), k in entries.items())
    assert np.abs(want - want.T).max() < 1e-4


def test_peak_kernel_of_listed_pairs(points, spark):
    mz = np.arange(6) * 3.0
    data = sorted(rows(points))
    want = kernel(np.array([r[1] for r in data]), mz, 1.5)
    pairs = spark.createDataFrame([("p001", "p007"), ("p100", "p003")], "id_x string, id_y string")
    for r in pike.pike_pairs(pairs, points, points, mz, t=1.5).collect():
        assert math.isclose(r["k"], want[int(r["id_x"][1:]), int(r["id_y"][1:])], abs_tol=1e-9)


def test_peak_kernel_needs_a_cut(points):
    with pytest.raises(ValueError):
        pike.pike_kernel(points, None, np.arange(6) * 0.001)


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr("peakforge.operators.tiles.GROUP_BLOCKS", 2)


def test_many_tiles(points, small_groups):
    """Several groups on both sides: neighbours, class sums and kernel entries as by broadcast."""
    size = 5 * 48
    a, b = (N.knn_lists(points, points, 4, strategy=s, block_bytes=size) for s in ("broadcast", "blocks"))
    ids = {r["sample_id"]: [n["id"] for n in r["nn"]] for r in a.collect()}
    assert {r["sample_id"]: [n["id"] for n in r["nn"]] for r in b.collect()} == ids
    a, b = (S.silhouette_samples(points, strategy=s, block_bytes=size) for s in ("broadcast", "blocks"))
    one, two = ({r["sample_id"]: r["silhouette"] for r in x.collect()} for x in (a, b))
    assert one.keys() == two.keys() and np.allclose([one[i] for i in one], [two[i] for i in one])
    mz = [2000.0 + 4 * i for i in range(6)]
    a, b = (pike.pike_kernel(points, None, mz, t=1.0, strategy=s, block_bytes=size) for s in ("broadcast", "blocks"))
    one, two = ({(r["id_x"], r["id_y"]): r["k"] for r in x.collect()} for x in (a, b))
    assert one.keys() == two.keys() and len(one) == 150 * 150 and np.allclose([one[i] for i in one], [two[i] for i in one])


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_empty_sides_and_rows_without_a_vector(points, spark, strategy):
    schema = points.schema
    odd = spark.createDataFrame([("null1", None, 1.0), ("null2", None, 0.0)], schema)
    both = points.unionByName(odd)
    got = {r["sample_id"]: [n["id"] for n in r["nn"]] for r in N.knn_lists(both, both, 3, strategy=strategy, block_bytes=480).collect()}
    want = {r["sample_id"]: [n["id"] for n in r["nn"]] for r in N.knn_lists(points, points, 3).collect()}
    assert got == {**want, "null1": [], "null2": []}
    none = points.limit(0)
    assert all(r["nn"] == [] for r in N.knn_lists(points, none, 3, strategy=strategy).collect())
    assert N.knn_lists(none, points, 3, strategy=strategy, block_bytes=480).count() == 0
    mz = [2000.0 + 4 * i for i in range(6)]
    for x, y, n in ((points, none, 0), (none, points, 0), (both, both.limit(152), 150 * 150)):
        assert pike.pike_kernel(x, y, mz, strategy=strategy, block_bytes=480).count() == n
    assert S.silhouette_samples(both, strategy=strategy, block_bytes=480).count() == 150
    assert S.silhouette_samples(none, strategy=strategy).count() == 0
