"""Second-order boosting against a direct loop, and its exported splits applied in SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.operators import boosting, models

SCHEMA = "sample_id string, features array<double>, label int"


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(240, 5)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.4, 240)) > 0.2).astype(int)
    df = spark.createDataFrame([(f"r{i:03d}", x[i].tolist(), int(y[i])) for i in range(240)], SCHEMA).repartition(4).cache()
    return df, x, y


def direct(x, y, cuts, trees, depth, rate=0.1, penalty=1.0, least_hessian=1.0):
    """Margins by plain recursion over rows."""
    margin = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, step = p - y, p * (1 - p), np.zeros(len(x))

        def grow(rows, level):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in cuts[f]:
                    low = x[rows, f] <= cut
                    a, b = rows[low], rows[~low]
                    if min(len(a), len(b)) and min(h[a].sum(), h[b].sum()) >= least_hessian:
                        gain = score(a) + score(b) - score(rows)
                        if gain > best[0] * (1 + 1e-6):
                            best = (gain, (a, b))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
            else:
                for part in best[1]:
                    grow(part, level + 1)
        grow(np.arange(len(x)), 0)
        margin += step
    return margin


def by_id(df):
    return np.array([r["probability"][1] for r in sorted(df.collect(), key=lambda r: r["sample_id"])])


def test_equals_a_direct_loop(cloud):
    df, x, y = cloud
    cuts = boosting.quantile_cuts(df, 16, 5)
    assert all(len(c) <= 15 and (np.diff(c) > 0).all() for c in cuts)
    got = by_id(models.xgboost_like(df, trees=12, depth=3, bins=16).predict(df))
    assert np.allclose(got, 1 / (1 + np.exp(-direct(x, y, cuts, 12, 3))), atol=1e-9)


def test_splits_in_sql(spark, cloud):
    """A recursive query over the exported nodes gives the margins; leaves are worth -rate G / (H + penalty)."""
    df, x, _ = cloud
    fitted = models.xgboost_like(df, trees=4, depth=3, subsample=0.7, columns=0.6, bins=32)
    nodes, rows = fitted.model.splits(spark).toPandas(), df.toPandas()  # noqa: F841
    assert np.allclose(nodes["value"], -0.1 * nodes["gradient"] / (nodes["hessian"] + 1))
    inner = nodes[nodes["feature"] >= 0]
    assert (inner["gain"] > 0).all() and inner.groupby("round")["feature"].nunique().max() <= 3
    assert nodes[(nodes["node"] == 0)]["rows"].between(120, 216).all()
    sql = duckdb.sql("""WITH RECURSIVE walk AS (
        SELECT sample_id, features, round, 0 AS node FROM rows, (SELECT DISTINCT round FROM nodes)
        UNION ALL SELECT w.sample_id, w.features, w.round, CASE WHEN w.features[n.feature + 1] <= n.cut THEN n."left" ELSE n."right" END
        FROM walk w JOIN nodes n ON n.round = w.round AND n.node = w.node WHERE n.feature >= 0)
        SELECT sample_id, 1 / (1 + exp(-sum(n.value))) FROM walk w JOIN nodes n ON n.round = w.round AND n.node = w.node
        WHERE n.feature < 0 GROUP BY sample_id ORDER BY sample_id""").fetchall()
    assert np.allclose([v for _, v in sql], by_id(fitted.predict(df)), atol=1e-12)


def test_draws_do_not_depend_on_partitions(cloud):
    df, _, _ = cloud
    one, two = (by_id(models.xgboost_like(d, trees=3, subsample=0.5, columns="0.8").predict(df)) for d in (df, df.repartition(7, "label")))
    assert np.allclose(one, two, atol=1e-9)


def test_leaf_wise(spark, cloud):
    """Kept splits are those of repeated choice of the best leaf; leaves hold enough rows."""
    df, _, _ = cloud
    full, cut = (boosting.fit(df, trees=1, depth=5, leaves=n, penalty=0.0, least_rows=10, least_hessian=1e-3).rounds[0][0] for n in (None, 5))
    leaves, kept = {0}, set()
    while len(leaves) < 5:
        best = max((i for i in leaves if full.feature[i] >= 0), key=lambda i: full.gain[i])
        leaves, kept = leaves - {best} | {full.left[best], full.right[best]}, kept | {best}
    assert {i for i, f in enumerate(cut.feature) if f >= 0} == kept
    assert all(round(cut.sums[i][2]) >= 10 for i in leaves)
    assert abs(sum(cut.sums[i][2] for i in leaves) - 240) < 1e-6


def test_three_classes_and_missing_values(spark):
    rng = np.random.default_rng(4)
    y = np.arange(150) % 3
    x = rng.normal(0, 0.4, (150, 2)) + np.stack([y * 2.0, -y * 1.0], 1)
    rows = [(f"r{i:03d}", x[i].tolist(), int(y[i])) for i in range(150)]
    rows += [("nan", [float("nan"), 0.0], 2), ("null", [None, 0.0], 2), ("none", None, 1), ("open", [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("xgboost_like", "lightgbm_like"):
        out = {r["sample_id"]: r for r in models.fit(name, df, trees=11).predict(df).collect()}
        assert len(out) == 154 and out["none"]["prediction"] is None and out["nan"]["prediction"] == out["null"]["prediction"] is not None
        assert np.mean([out[f"r{i:03d}"]["prediction"] == y[i] for i in range(150)]) > 0.9
        assert abs(sum(out["open"]["probability"]) - 1) < 1e-9


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1)], SCHEMA)
    assert [r["prediction"] for r in models.xgboost_like(df, trees=2).predict(df).collect()] == [1.0, 1.0]
    assert boosting.fit(df.limit(0), trees=2, depth=2).rounds == []
    same = df.withColumn("label", F.when(F.col("sample_id") == "a", 0).otherwise(1)).withColumn("features", F.array(F.lit(1.0)))
    tree = boosting.fit(same, trees=1, depth=2).rounds[0][0]
    assert tree.feature == [-1] and abs(tree.value[0]) < 1e-12
