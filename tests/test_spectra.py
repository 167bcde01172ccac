import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.functions.arrays import tof_to_mz
from peakforge.operators import binning as B, spectra as S

SCHEMA = "spectrum_id string, mz array<double>, intensity array<double>"


def frame(spark, y, mz=None, name="a"):
    mz = [float(v) for v in (range(len(y)) if mz is None else mz)]
    return spark.createDataFrame([(name, mz, [float(v) for v in y])], SCHEMA)


def run(df, step):
    r = df.transform(step).first()
    return np.array(r["mz"]), None if r["intensity"] is None else np.array(r["intensity"])


def test_smoother_reproduces_a_cubic(spark):
    x = np.linspace(-1, 1, 41)
    y = 5 + x - 2 * x ** 2 + x ** 3
    assert np.allclose(run(frame(spark, y), S.smooth())[1], y)


def test_smoother_clips_and_needs_a_window(spark):
    assert run(frame(spark, np.sin(np.arange(60.0)) * 5), S.smooth())[1].min() >= 0
    assert run(frame(spark, np.ones(20)), S.smooth())[1] is None


def test_middle_taps_have_a_closed_form():
    k = np.arange(-10, 11)
    assert np.allclose(kernels.smoother_matrix()[10], 3 * (329 - 5 * k ** 2) / 9177)


def test_snip(spark):
    assert np.allclose(run(frame(spark, np.full(50, 7.0)), S.baseline("snip"))[1], 0)
    y = np.full(50, 7.0)
    y[25] = 100
    out = run(frame(spark, y), S.baseline("snip"))[1]
    assert np.isclose(out[25], 93) and np.allclose(np.delete(out, 25), 0)
    y = np.random.default_rng(0).uniform(0, 9, 80)
    assert (run(frame(spark, y), S.baseline("snip"))[1] >= -1e-9).all()


@pytest.mark.parametrize("kind", ["ALS", "ArPLS"])
def test_penalised_baselines_match_a_dense_solver(spark, kind):
    rng = np.random.default_rng(1)
    y = np.stack([np.linspace(5, 9, 60) + rng.normal(0, 0.3, 60) + 20 * (np.arange(60) == p) for p in (10, 30, 45)])
    d = np.zeros((60, 58))
    for j in range(58):
        d[j:j + 3, j] = (1, -2, 1)
    lam = 1e3
    want = []
    for row in y:
        w = np.ones(60)
        for _ in range(11):
            z = np.linalg.solve(np.diag(w) + lam * d @ d.T, w * row)
            if kind == "ALS":
                new = 0.01 * (row > z) + 0.99 * (row < z)
            else:
                g = row - z
                n = g[g < 0]
                new = 1 / (1 + np.exp(np.minimum(2 * (g - (2 * n.std() - n.mean())) / n.std(), 70)))
            moved = np.linalg.norm(new - w) / np.linalg.norm(w)
            w = new
            if moved <= 1e-6:
                break
        want.append(row - z)
    df = spark.createDataFrame([(str(i), [0.0] * 60, r.tolist()) for i, r in enumerate(y)], SCHEMA)
    got = [r["intensity"] for r in df.transform(S.baseline(kind.lower(), lam=lam)).orderBy("spectrum_id").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_tic(spark):
    assert np.isclose(run(frame(spark, [1, 2, 5]), S.tic(10))[1].sum(), 10)
    assert np.isnan(run(frame(spark, [0, 0]), S.tic())[1]).all()


def test_log_of_zero(spark):
    assert run(frame(spark, [0, 1]), S.stabilise("log"))[1].tolist() == [float("-inf"), 0.0]


def test_trim_is_strict(spark):
    assert run(frame(spark, [1, 2, 3, 4], [2000, 2000.5, 19999, 20000]), S.trim())[1].tolist() == [2, 3]


def test_peak_filter_keeps_order_and_first_of_ties(spark):
    assert run(frame(spark, [5, 9, 5, 1]), S.filter_peaks(top=2))[0].tolist() == [0, 1]
    assert run(frame(spark, [5, 9, 5, 1]), S.filter_peaks(top=3, min_intensity=6))[1].tolist() == [9]


def test_binarise(spark):
    assert run(frame(spark, [1, 2, 3]), S.binarise(2))[1].tolist() == [0, 0, 1]


def test_persistence(spark):
    y = [0, 4, 1, 3, 0, 9, 2]
    assert run(frame(spark, y), S.persistence())[1].tolist() == [0, 4, 0, 2, 0, 9, 0]
    mz, kept = run(frame(spark, y), S.persistence(keep_zero=False))
    assert mz.tolist() == [1, 3, 5] and kept.tolist() == [4, 2, 9]


def sinking_level(y):
    """Components of points above a sinking level, point by point."""
    out, parts = np.zeros(len(y)), {}
    for i in sorted(range(len(y)), key=lambda i: (-y[i], i)):
        near = sorted({parts[j] for j in (i - 1, i + 1) if j in parts}, key=lambda r: (-y[r], r))
        parts[i] = near[0] if near else i
        for loser in near[1:]:
            out[loser] = y[loser] - y[i]
            parts = {p: near[0] if r == loser else r for p, r in parts.items()}
    if len(y):
        out[parts[int(np.argmax(y))]] = y.max() - y.min()
    return out


def test_persistence_of_any_line():
    """Flat tops, equal tops and valleys, staircases both ways, short lines."""
    rng = np.random.default_rng(8)
    lines = [rng.integers(0, high, n).astype(float) for high in (2, 4, 50) for n in (1, 2, 3, 7, 40, 90) for _ in range(8)]
    funnel = np.ravel([[i, -i] for i in range(30)]).astype(float)
    for y in (*lines, rng.normal(size=200), funnel, funnel[::-1], np.arange(9.0), np.zeros(5), np.zeros(0)):
        assert kernels.persistence(y).tolist() == sinking_level(y).tolist()


def test_resample(spark):
    mz, y = run(frame(spark, [0, 10, 20], [0, 1, 3]), S.resample_grid(4))
    assert mz.tolist() == [0, 1, 2, 3] and y.tolist() == [0, 10, 15, 20]


@pytest.mark.parametrize("agg", ["sum", "mean", "std", "median", "min", "max", "count"])
def test_bins_of_arrays_and_points_agree(spark, agg):
    rng = np.random.default_rng(4)
    mz, y = np.append(rng.uniform(1990, 20010, 300), [2000, 2003, 20000]), rng.uniform(1, 5, 303)
    want = kernels.bin_values(mz, y, kernels.equal_edges(step=500), agg)
    df = frame(spark, y, mz)
    assert np.allclose(run(df, S.bin_equal(step=500, agg=agg))[1], want)
    long = df.select("spectrum_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_id", "p.*")
    dense = B.densify(B.bin_points_equal(long, step=500, agg=agg), 36).first()["features"]
    assert np.allclose(dense, want)
    edges = kernels.log_edges(n=25)
    dense = B.densify(B.bin_points_log(long, n=25, agg=agg), 25).first()["features"]
    assert np.allclose(dense, kernels.bin_values(mz, y, edges, agg))


def test_bin_sum_is_the_trimmed_sum(spark):
    y = np.arange(100.0)
    mz = np.linspace(1900, 20100, 100)
    inside = y[(mz >= 2000) & (mz <= 20000)].sum()
    assert np.isclose(run(frame(spark, y, mz), S.bin_equal())[1].sum(), inside)


@pytest.mark.parametrize("edges", [S.MASS_TABLE, S.MASS_TABLE_LITERAL])
def test_shared_boundaries_count_twice(spark, edges):
    mz = [2000, 2050.4, 2075, 2250, 12100, 12250, 12400, 19800]
    df = frame(spark, [1, 2, 4, 8, 16, 32, 64, 128], mz)
    got = run(df, S.bin_table(edges))[1]
    assert len(got) == 68 and got[0] == 3 and got[1] == 6 and got[2] == 8 and got[3] == 8
    at = edges.index(12000)
    if edges is S.MASS_TABLE:
        assert got[at] == 48 and got[at + 1] == 96
    else:
        assert got[at] == 0 and got[at + 1] == 127
    long = df.select("spectrum_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_id", "p.*")
    assert B.densify(B.bin_points_table(long, edges), 68).first()["features"] == got.tolist()


def test_calibration(spark):
    df = spark.createDataFrame([(2.5e6, 100.0, 0.0, 4000.0), (2.5e6, 100.0, 0.01, 4000.0)], "a double, b double, c double, t double")
    got = [r[0] for r in df.select(tof_to_mz(F.col("a"), F.col("b"), F.col("c"), F.col("t"))).collect()]
    b, c = np.sqrt(1e12 / 2.5e6), 100.0 - 4000
    assert np.allclose(got, [c * c / b ** 2, ((-b + np.sqrt(b * b - 0.04 * c)) / 0.02) ** 2])


def test_fused_chain_equals_the_steps(spark):
    rng = np.random.default_rng(6)
    y, mz = rng.uniform(0, 100, 400), np.linspace(1900, 20100, 400)
    df = frame(spark, y, mz)
    steps = S.chain(S.stabilise(), S.smooth(), S.baseline(), S.tic(), S.trim(), S.bin_equal())
    assert np.allclose(run(df, S.standard_chain())[1], run(df, steps)[1], atol=1e-12)
    traced = S.trace_steps(df).orderBy("step_no").collect()
    assert [r["step_no"] for r in traced] == list(range(6))
    assert np.allclose(traced[5]["intensity"], run(df, S.standard_chain(binned=False))[1])


def test_ragged_batch(spark):
    rng = np.random.default_rng(8)
    rows = [(str(i), np.linspace(1990, 20010, n).tolist(), rng.uniform(0, 9, n).tolist()) for i, n in enumerate([30, 25, 30, 10, 44])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r["sample_id"]: r["features"] for r in S.build_features(df).collect()}
    assert got["3"] is None and all(len(got[str(i)]) == 6000 for i in (0, 1, 2, 4))
    alone = S.build_features(spark.createDataFrame(rows[2:3], SCHEMA)).first()["features"]
    assert np.allclose(got["2"], alone)


def test_jitter_is_repeatable_and_bounded(spark):
    df = frame(spark, np.ones(500), np.full(500, 3000.0))
    a, b = run(df, S.jitter_uniform(1.5))[0], run(df.repartition(3), S.jitter_uniform(1.5))[0]
    assert (a == b).all() and np.abs(a - 3000).max() <= 1.5 and np.abs(a - 3000).max() > 1.3
    n = run(df, S.jitter_normal(2.0))[0] - 3000
    assert abs(n.mean()) < 0.4 and abs(n.std() - 2) < 0.3


def test_scale_by_min(spark):
    df = frame(spark, [0, 4, 8]).unionByName(frame(spark, [2, 0, 6], name="b"))
    assert {r["spectrum_id"]: r["intensity"] for r in S.scale_by_min(df).collect()} == {"a": [0, 2, 4], "b": [1, 0, 3]}
