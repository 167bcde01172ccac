import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.operators.amr import labelled
from peakforge.operators import features as X, kernel_map, metrics, models, resample as R, tuning
from peakforge.operators import neighbours as N, silhouette as S
from peakforge.operators.neighbours import knn_lists
from peakforge.operators.ranking import quantile, ranked, smallest
from peakforge.plans import sweep, train

SCHEMA = "sample_id string, features array<double>, label int"


@pytest.fixture(scope="module")
def blobs(spark):
    """18 rows of class 0 and 45 of class 1 in overlapping clouds, with a few copies."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (18, 3)), rng.normal(1.2, 1, (45, 3))])
    x[40:44] = x[40]
    rows = [(f"r{i:02d}", x[i].tolist(), int(i >= 18)) for i in range(63)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def apart(spark):
    """Two well separated classes in six dimensions, the last three of them noise."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (120, 6))
    y = np.arange(120) % 3 > 0
    x[:, :3] += np.where(y, 3.0, -3.0)[:, None]
    return spark.createDataFrame([(f"r{i:03d}", x[i].tolist(), int(y[i])) for i in range(120)], SCHEMA).repartition(4).cache()


def sizes(df):
    return {int(k): v for k, v in R.class_sizes(df).items()}


def local(df):
    rows = sorted((r["sample_id"], r["features"], int(r["label"])) for r in df.collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


# ---- ranks ----------------------------------------------------------------------------------------------------------

def test_ranks_within_a_hot_class(spark):
    rows = [(i, "hot" if i % 5 else f"c{i % 3}", (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(9)
    got = {r["id"]: r["rank"] for r in ranked(df, ["v", "id"], by="g").collect()}
    for g in {r[1] for r in rows}:
        order = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in order] == list(range(len(order)))
    assert sorted(r["id"] for r in smallest(df, ["v", "id"], 7).collect()) == sorted(i for _, i in sorted((v, i) for i, _, v in rows)[:7])


def test_quantile(spark):
    v = [3.0, 1.0, 9.0, 4.0, 4.0]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "sample_id string, v double")
    for q in (0, 0.3, 0.5, 1):
        assert np.isclose(quantile(df, "v", q, 5), np.percentile(v, q * 100))


# ---- rebalancing ----------------------------------------------------------------------------------------------------

def test_split(blobs):
    a, b = R.split(blobs, 0.35)
    assert sizes(b) == {0: 6, 1: 16} and sizes(a) == {0: 12, 1: 29}
    assert not set(local(a)[0]) & set(local(b)[0])
    c, d = R.split(blobs.repartition(7), 0.35)
    assert local(c)[0] == local(a)[0]


def test_random_sampling(blobs):
    assert sizes(R.random_under(blobs)) == {0: 18, 1: 18}
    over = R.random_over(blobs)
    assert sizes(over) == {0: 45, 1: 45}
    assert {tuple(x) for x in local(over)[1]} == {tuple(x) for x in local(blobs)[1]}


@pytest.mark.parametrize("method", ["smote", "borderline_smote", "adasyn", "svm_smote"])
def test_synthetic_rows_lie_on_lines_between_class_rows(blobs, method):
    out = R.resample(blobs, method)
    ids, x, y = local(out)
    old = {i for i in local(blobs)[0]}
    made = x[[i not in old for i in ids]]
    small = local(blobs)[1][local(blobs)[2] == 0]
    assert len(made) == 27 if method != "adasyn" else abs(len(made) - 27) <= 9
    assert (y[[i not in old for i in ids]] == 0).all()
    a, b = small[:, None], small[None, :]
    for p in made:
        ab, ap = b - a, p - a
        t = (ab * ap).sum(2) / np.maximum((ab * ab).sum(2), 1e-12)
        gap = np.abs(ap - t[..., None] * ab).sum(2)
        assert ((gap < 1e-9) & (t >= -0.5 - 1e-9) & (t <= 1 + 1e-9)).any()


def test_adasyn_needs_foreign_neighbours(spark):
    rows = [(f"a{i}", [float(i)], 0) for i in range(6)] + [(f"b{i}", [1000.0 + i], 1) for i in range(9)]
    with pytest.raises(ValueError):
        R.adasyn(spark.createDataFrame(rows, SCHEMA))


def confirmed(x, y, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
    return order, [y[j] == y[i] for j in order]


def test_edited(blobs):
    ids, x, y = local(blobs)
    want = [i for n, i in enumerate(ids) if y[n] == 0 or all(confirmed(x, y, n, 3)[1])]
    assert local(R.edited(blobs))[0] == want
    want = [i for n, i in enumerate(ids) if all(confirmed(x, y, n, 3)[1])]
    assert local(R.edited(blobs, classes="all"))[0] == want
    want = [i for n, i in enumerate(ids) if y[n] == 0 or sum(confirmed(x, y, n, 3)[1]) >= 2]
    assert local(R.edited(blobs, kind="mode"))[0] == want


def test_repeated_edited_is_stable_or_stopped(blobs):
    out = R.repeated_edited(blobs)
    after, then = sizes(out), sizes(R.edited(out))
    assert after[0] == 18 and after[1] >= 18
    assert then == after or then.get(1, 0) < 18


def test_tomek_drops_the_larger_class_member(spark):
    rows = [("a", [0.0, 0.0], 0), ("b", [0.1, 0.0], 1)] + [(f"r{i}", [5.0 + i * 0.3, 5.0], 0) for i in range(5)] + [
        (f"s{i}", [-5.0 - i * 0.4, 2.0], 1) for i in range(19)]
    out = R.tomek(spark.createDataFrame(rows, SCHEMA))
    assert sizes(out) == {0: 6, 1: 19} and "b" not in local(out)[0] and "a" in local(out)[0]


def test_condensed_store_judges_everything_right(blobs):
    store = R.condensed(blobs)
    assert sizes(store)[0] == 18 and sizes(store)[1] < 45
    wrong = knn_lists(blobs, store, 1, exclude_self=False).filter(F.get("nn", F.lit(0))["label"] != F.col("label"))
    assert wrong.count() == 0


def test_one_sided_and_cleaning_keep_the_small_class(blobs):
    for method in (R.one_sided, R.neighbourhood_cleaning, R.all_knn):
        after = sizes(method(blobs))
        assert after[0] == 18 and after[1] < 45


def test_near_miss(blobs):
    ids, x, y = local(blobs)
    small = x[y == 0]
    mean = {i: np.sort(np.sqrt(((small - x[n]) ** 2).sum(1)))[:3].mean() for n, i in enumerate(ids) if y[n] == 1}
    want = sorted(sorted(mean, key=lambda i: (mean[i], i))[:18] + [i for n, i in enumerate(ids) if y[n] == 0])
    assert local(R.near_miss(blobs))[0] == want


def test_instance_hardness_leaves_at_least_the_small_size(blobs):
    """Rows tied with the quantile stay, so the larger class may keep more."""
    after = sizes(R.instance_hardness(blobs, trees=10))
    assert after[0] == 18 and 18 <= after[1] < 45


def test_centroids(blobs):
    """Every centre is the mean of the rows that are nearest to it: the loop ran to its end."""
    out = R.cluster_centroids(blobs)
    assert sizes(out) == {0: 18, 1: 18}
    ids, x, _ = local(out)
    big = local(blobs)[1][18:]
    centres = x[[i.startswith("centre") for i in ids]]
    near = ((big[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    for i in set(near.tolist()):
        assert np.allclose(centres[i], big[near == i].mean(0), atol=1e-6)


def test_condensed_equals_comparing_with_the_whole_store(blobs):
    """Round by round with the whole store, as the rule reads."""
    state = R._first_store(blobs, R.SEED)
    for i in range(50):
        wrong = R._misjudged(state.filter("not stored"), state.filter("stored")).select("sample_id", R._draw(f"add{i}", R.SEED).alias("u")).collect()
        if not wrong:
            break
        low = min(r["u"] for r in wrong)
        new = [r["sample_id"] for r in wrong if r["u"] < 0.5 or r["u"] <= low]
        state = state.withColumn("stored", F.col("stored") | F.col("sample_id").isin(new))
    want = {r["sample_id"] for r in state.filter("stored").collect()}
    assert {r["sample_id"] for r in R.condensed(blobs).collect()} == want


def test_condensed_judges_every_row_right(blobs):
    kept, x, y = local(R.condensed(blobs))
    ids, all_x, all_y = local(blobs)
    for i, p, label in zip(ids, all_x, all_y):
        if i not in kept:
            assert y[((x - p) ** 2).sum(1).argmin()] == label


def test_rebalancing_after_a_join_that_repeats_samples(spark):
    """A sample with several letters is several rows; every method keeps them apart."""
    features = spark.createDataFrame([(f"s{i}", str(i), [float(i % 7), float(i * i % 11)]) for i in range(60)],
                                     "sample_id string, extern_id string, features array<double>")
    letters = [(str(i), "A", "R" if i < 20 else "S") for i in range(60)] + [(str(i), "A", "R") for i in range(10)]
    rows = labelled(features, spark.createDataFrame(letters, "extern_id string, antibiotic string, sir string"), "A")
    rows = rows.select(F.col("row_id").alias("sample_id"), "features", "label")
    assert sizes(rows) == {0: 40, 1: 30} or sizes(rows) == {0: 30, 1: 40}
    assert rows.select("sample_id").distinct().count() == 70
    for method in ("random_over", "smote"):
        assert sorted(sizes(R.resample(rows, method)).values()) == [40, 40]
    assert sorted(sizes(R.resample(rows, "random_under")).values()) == [30, 30]


# ---- features -------------------------------------------------------------------------------------------------------

def test_statistics(blobs, spark):
    _, x, y = local(blobs)
    flat = blobs.withColumn("features", F.concat("features", F.array(F.lit(0.1))))
    rows = X.feature_stats(flat).orderBy("feature").collect()
    for j in range(3):
        r = rows[j]
        assert np.allclose([r["mean"], r["min"], r["max"], r["var_pop"]], [x[:, j].mean(), x[:, j].min(), x[:, j].max(), x[:, j].var()])
        assert np.isclose(r["corr"], np.corrcoef(x[:, j], y == 0)[0, 1])
    assert rows[3]["var_pop"] == 0 and rows[3]["corr"] is None
    stats = X.feature_stats(flat)
    strength = [abs(np.corrcoef(x[:, j], y == 0)[0, 1]) for j in range(3)]
    assert X.select_correlation(stats, 0.0) == sorted(range(3), key=lambda j: -strength[j])
    assert X.select_variance(stats, 0.0) == [0, 1, 2]
    assert np.allclose(local(X.take_features(flat, [2, 0]))[1], x[:, [2, 0]])
    scaled = local(X.min_max(flat))[1]
    assert scaled.min() == 0 and np.isclose(scaled.max(), 1) and (scaled[:, 3] == 0).all()
    z = local(X.standardise(flat))[1]
    assert np.allclose(z[:, :3], (x - x.mean(0)) / x.std(0)) and (z[:, 3] == 0).all()


def test_scaling_with_other_rows(spark):
    fit = spark.createDataFrame([("a", [0.0, 2.0], 0), ("b", [4.0, 2.0], 0)], SCHEMA)
    new = spark.createDataFrame([("c", [6.0, 5.0], 0)], SCHEMA)
    assert X.min_max(new, fit).first()["features"] == [1.5, 3.0]


def test_pca(blobs):
    _, x, _ = local(blobs)
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    v = v * np.sign(v[np.arange(3), np.abs(v).argmax(1)])[:, None]
    full = X.pca_project(blobs, 3)
    assert np.allclose(local(full)[1], centred @ v.T)
    assert np.allclose(local(X.leading(full, 2))[1], (centred @ v.T)[:, :2])


def test_randomised_components(spark):
    """Never a d x d matrix: the same scores as the exact fit, on a spectrum that falls."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 40)) * 0.7 ** np.arange(40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 3
    df = spark.createDataFrame([(str(i), [float(v) for v in r], 0) for i, r in enumerate(x)], SCHEMA).repartition(4)
    one, two = (local(X.pca_project(df, 6, method=m))[1] for m in ("exact", "randomised"))
    assert np.allclose(one, two, atol=1e-6)
    loads = X.principal_axes(df, 6)
    assert np.allclose(loads.T @ loads, np.eye(6))


def test_targets(spark):
    """One pass for all targets equals target by target; one class gives NaN, one row nothing."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5))
    x[:30, 0] += 4
    df = spark.createDataFrame([(str(i), [float(v) for v in r], 0) for i, r in enumerate(x)], SCHEMA).repartition(4)
    letters = [(str(i), "split", int(i >= 30)) for i in range(90)] + [(str(i), "three", i % 3) for i in range(60)] + [
        (str(i), "same", 1) for i in range(9)] + [("3", "lonely", 0), ("4", "none", None)]
    table = spark.createDataFrame(letters, "sample_id string, target string, label int")
    stats = {(r["target"], r["feature"]): r["corr"] for r in X.feature_stats(sweep.with_targets(df, table), keys=["target"]).collect()}
    y = np.arange(90) >= 30
    assert np.isclose(stats["split", 0], np.corrcoef(x[:, 0], ~y)[0, 1]) and stats["same", 0] is None and ("none", 0) not in stats
    got = {(r["target"], r["threshold"], r["n_components"]): r for r in sweep.sweep_targets(df, table, (0.0, 0.0001, 0.9), (2, 3, 9)).collect()}
    assert {(t, c) for t, c, _ in got if t in ("split", "three")} == {(t, c) for t in ("split", "three") for c in (0.0, 0.0001)}
    for target, upto in (("split", 90), ("three", 60)):
        own = df.filter(F.col("sample_id").cast("int") < upto).drop("label").join(table.filter(F.col("target") == target), "sample_id")
        scaled = X.min_max(df).select("sample_id", "features").join(own.select("sample_id", "label"), "sample_id")
        scores = X.leading(X.pca_project(scaled, 3), 2)
        assert np.isclose(got[target, 0.0, 2]["silhouette"], S.silhouette(scores).first()[0])
    assert not any(t in ("lonely", "none") for t, _, _ in got)
    points = sweep.with_targets(df, table)
    by = {r["target"]: r["silhouette"] for r in S.silhouette_by(points, ["target"]).collect()}
    assert np.isnan(by["same"]) and np.isnan(by["lonely"])


def test_sweep(apart):
    rows = sweep.sweep_pca(apart, (0.3, 2.0), (1, 2, 50)).collect()
    assert {(r["threshold"], r["n_components"]) for r in rows} == {(0.3, 1), (0.3, 2)}
    assert all(r["silhouette"] > 0.5 and r["n_features"] == 3 for r in rows)
    assert [N.bounded_neighbourhood(n) for n in (1, 5, 100)] == [None, 4, 30]
    assert N.bounded_neighbourhood(12, top=10, divisor=3) == 4


# ---- models ---------------------------------------------------------------------------------------------------------

SMALL = {"logistic": {}, "random_forest": {"trees": 10}, "knn": {}, "adaboost": {"rounds": 3}, "gradient_boosting": {"trees": 3},
         "xgboost_like": {"trees": 3}, "lightgbm_like": {"trees": 3}, "extra_trees": {"trees": 10, "max_depth": 5},
         "svm": {"gamma": "scale", "max_iter": 20}, "gaussian_bayes": {}, "decision_tree": {"max_depth": 5},
         "neural_net": {"hidden": (10,), "epochs": 30}}


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_models_separate_classes(apart, name):
    a, b = R.split(apart, 0.3)
    row = metrics.evaluate(models.fit(name, a, **SMALL[name]).predict(b)).first()
    assert row["accuracy"] > 0.9 and row["f1_R"] > 0.85 and row["f1_S"] > 0.9


@pytest.mark.parametrize("kernel", kernel_map.KERNELS)
def test_kernel_maps(blobs, kernel):
    """Every row a landmark: dot products are the kernel, of a sigmoid its positive part."""
    ids, x, _ = local(kernel_map.kernel_map(blobs, kernel, 0.3, degree=3, offset=0.5, landmarks=100)(blobs))
    _, raw, _ = local(blobs)
    want = kernel_map.values(raw, raw, kernel, 0.3, 3, 0.5)
    if kernel == "sigmoid":
        sizes, vectors = np.linalg.eigh(want)
        want = vectors * np.maximum(sizes, 0) @ vectors.T
    assert np.allclose(x @ x.T, want, atol=1e-6 * np.abs(want).max())


def test_curved_kernels_separate_rings(spark):
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * np.pi, 160), np.repeat([1.0, 3.0], 80) + rng.normal(0, 0.1, 160)
    rows = [(f"p{i}", [float(r * np.cos(a)), float(r * np.sin(a))], int(i >= 80)) for i, (a, r) in enumerate(zip(angle, radius))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    for params in ({"kernel": "poly", "degree": 2}, {"kernel": "rbf", "mapping": "landmarks"}):
        fitted = models.fit("svm", df, gamma="scale", size=60, **params)
        assert metrics.evaluate(fitted.predict(df)).first()["accuracy"] > 0.97
    with pytest.raises(ValueError):
        models.fit("svm", df, kernel="unknown")


def test_margin_rows_against_an_exact_machine(blobs):
    """The dual of the hinge loss solved by coordinate steps over pairs; rows clearly inside the margin are seeds, rows clearly outside are not."""
    ids, x, y = local(blobs)
    sign = np.where(y == 0, 1.0, -1.0)
    gamma = 1 / (x.shape[1] * x.var())
    k = kernel_map.values(x, x, "rbf", gamma)
    a, rng = np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(60000):
        i, j = rng.choice(len(y), 2, replace=False)
        f = k @ (a * sign)
        bend = k[i, i] + k[j, j] - 2 * k[i, j]
        if bend < 1e-12:
            continue
        step = ((f[j] - sign[j]) - (f[i] - sign[i])) / bend * sign[i]  # a_i moves by step, a_j against it
        new_i = np.clip(a[i] + step, 0, 1)
        new_j = a[j] - (new_i - a[i]) * sign[i] * sign[j]
        if new_j < 0 or new_j > 1:
            new_j = np.clip(new_j, 0, 1)
            new_i = a[i] - (new_j - a[j]) * sign[i] * sign[j]
        a[i], a[j] = np.clip(new_i, 0, 1), new_j
    f = k @ (a * sign)
    free = (a > 1e-4) & (a < 1 - 1e-4)
    margin = sign * (f + np.mean(sign[free] - f[free]))
    seeds = {r[0] for r in R.margin_rows(blobs, 0, landmarks=100).collect()}
    own = [i for i in range(len(y)) if y[i] == 0]
    assert {ids[i] for i in own if margin[i] < 0.95} <= seeds <= {ids[i] for i in own if margin[i] < 1.05}


def test_boosting_weights_match_a_direct_loop(blobs):
    """Three stumps against the same rule computed by hand from their own predictions."""
    fitted = models.fit("adaboost", blobs, rounds=3, rate=0.5)
    ids, x, y = local(blobs)
    w = np.ones(len(y))
    votes = np.zeros((len(y), 2))
    for guess, alpha in fitted.model:
        out = blobs.select("sample_id", guess.alias("_q")).collect()
        p = np.array([q for _, q in sorted((r["sample_id"], r["_q"]) for r in out)])
        error = (w * (p != y)).sum() / w.sum()
        assert np.isclose(alpha, 0.5 * np.log((1 - error) / error))
        w = w * np.exp(alpha * (p != y))
        votes[np.arange(len(y)), p.astype(int)] += alpha
    got = {r["sample_id"]: r["prediction"] for r in fitted.predict(blobs).collect()}
    assert [got[i] for i in ids] == votes.argmax(1).astype(float).tolist()


def test_grid_search_and_compare(apart):
    a, b = R.split(apart, 0.3)
    scores, best, fitted = tuning.grid_search(a, "decision_tree", {"max_depth": [1, 4]}, folds=2)
    assert scores.count() == 4 and best["max_depth"] in (1, 4)
    assert metrics.evaluate(fitted.predict(b)).first()["accuracy"] > 0.9
    table = tuning.compare(a, b, {"gaussian_bayes": {}, "knn": {}}, ("none", "random_under"))
    assert {(r["method"], r["model"]) for r in table.collect()} == {
        (m, n) for m in ("none", "random_under") for n in ("gaussian_bayes", "knn")}


def test_kernel_machines_of_a_grid_share_their_maps(apart, monkeypatch):
    """One map per kernel, width and fold, whatever the costs; every score is that of a fit of its own."""
    made, real = [], models.kernel_map
    monkeypatch.setattr(models, "kernel_map", lambda *a, **k: made.append(a[1:3]) or real(*a, **k))
    grid = {"C": [0.1, 10.0], "kernel": ["linear", "poly"], "gamma": ["scale", "auto"], "size": [20], "max_iter": [5]}
    rows = tuning.grid_search(apart, "svm", grid, folds=2, refit=False)[0].collect()
    assert len(made) == 4 and len(rows) == 16
    data, points = tuning.with_folds(apart, 2).cache(), tuning.expand(grid)
    for row in rows:
        if row["fold"] == 0 and row["point"] in (0, 2, 6):
            fitted = models.fit("svm", data.filter("fold <> 0").drop("fold"), **points[row["point"]])
            want = metrics.macro_f1(fitted.predict(data.filter("fold = 0"))).first()[0]
            assert row["params"] == str(points[row["point"]]) and np.isclose(row["macro_f1"], want, atol=0.03)


def test_kernel_values_of_a_batch_are_not_held_at_once():
    import tracemalloc
    rng = np.random.default_rng(4)
    x, points, turn = rng.normal(size=(10_000, 4)), rng.normal(size=(300, 4)), rng.normal(size=(300, 2))
    tracemalloc.start()
    got = kernel_map.mapped(x, points, turn, "rbf", 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000  # 24 MB a copy for the whole batch
    assert np.allclose(got, kernel_map.values(x, points, "rbf", 0.5) @ turn)
    assert kernel_map.mapped(x[:0], points, turn, "rbf", 0.5).shape == (0, 2)


def test_elimination_keeps_the_informative_positions(apart):
    kept, scores = tuning.rfecv(apart, step=0.2, folds=2, min_features=2, trees=10)
    assert set(kept) & {0, 1, 2} and {r["n_features"] for r in scores.collect()} == {6, 5, 4, 3, 2}


def test_confidence_of_model_output(apart):
    a, b = R.split(apart, 0.3)
    rows = metrics.confidence(models.fit("logistic", a).predict(b)).collect()
    assert rows and all(r["confidence"] == max(r["probability"]) for r in rows)


def test_confidence(apart):
    a, b = R.split(apart, 0.3)
    scores, bins, curve = train.confidence_report(a, b)
    assert scores.count() == 1 and bins.agg(F.sum("count")).first()[0] == b.count()
    assert 0 <= curve.first()["reject_rate"] <= 1


# ---- scores ---------------------------------------------------------------------------------------------------------

def test_scores_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, prediction int")
    row = metrics.evaluate(df, names={0: "R", 1: "S", 2: "I"}).first()
    assert np.allclose([row["accuracy"], row["precision_R"], row["recall_R"], row["f1_S"], row["f1_I"], row["precision_I"]],
                       [0.6, 0.5, 0.5, 0.8, 0, 0])
    assert np.isclose(metrics.MacroF1Evaluator().evaluate(df), (0.5 + 0.8 + 0) / 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.5, 1.0, 1.0)], "v double")
    assert [r["count"] for r in metrics.histogram(df, "v", 4).orderBy("bin").collect()] == [2, 0, 1, 2]
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert [r["count"] for r in metrics.histogram(flat, "v", 2).orderBy("bin").collect()] == np.histogram([2.0] * 3, 2)[0].tolist()
