"""Feature scaling, statistics, selection and projection on array columns.

Statistics are vector summaries per (class, salt), merged per feature afterwards, so no single task merges the buffers of
all partitions. Selection happens on the small per-feature table; wide rows are only sliced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.schema import DOUBLES
from peakforge.session import BROADCAST_BYTES, array_lit, once, require_small

SALTS = 64


def _partial(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, salt): count and the vectors of mean, sample variance, minimum and maximum."""
    rows = df.select(*keys, array_to_vector(F.col("features").cast("array<double>")).alias("v"),
                     (F.spark_partition_id() % SALTS).alias("_salt"))
    wanted = Summarizer.metrics("count", "mean", "variance", "min", "max")
    return rows.groupBy(*keys, "_salt").agg(wanted.summary(F.col("v")).alias("s"))


def _merge(keys: list[str]):
    n, mean = F.col("n"), F.col("mean")
    total = F.sum(n)
    centre = F.sum(n * mean) / total
    spread = F.sum(F.col("variance") * (n - 1)) + F.sum(n * mean * mean) - total * centre * centre
    return [total.alias("n"), centre.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
            F.greatest(F.when(F.min("min") < F.max("max"), spread / total).otherwise(0.0), F.lit(0.0)).alias("var_pop")]


def feature_moments(df: DataFrame, keys=()) -> DataFrame:
    """(keys, feature, n, mean, min, max, var_pop): population variance, exactly 0 for a constant feature."""
    keys = list(keys)
    parts = _partial(df, keys).select(
        *keys, F.col("s.count").alias("n"),
        F.posexplode(F.arrays_zip(*[vector_to_array(f"s.{m}").alias(m) for m in ("mean", "variance", "min", "max")]))
        .alias("feature", "m")).select(*keys, "n", "feature", "m.*")
    return parts.groupBy(*keys, "feature").agg(*_merge(keys))


def feature_stats(df: DataFrame, label: str = "label", positive=0, keys=()) -> DataFrame:
    """Moments of every feature and ``corr``, its correlation with the indicator label == positive (NULL if undefined).

    r = (mean of the class - mean of the rest) * sqrt(p (1 - p)) / population deviation, from one pass. With ``keys`` (such as the
    target a row's label belongs to) all of this per value of the keys, still in the one pass.
    """
    keys = list(keys)
    flagged = df.withColumn("_one", (F.col(label) == positive).cast("int"))
    per_side = feature_moments(flagged, [*keys, "_one"])
    n, mean = F.col("n"), F.col("mean")
    total, one = F.sum(n), F.col("_one") == 1
    centre = F.sum(n * mean) / total
    spread = F.sum(n * F.col("var_pop")) + F.sum(n * mean * mean) - total * centre * centre
    sides = per_side.groupBy(*keys, "feature").agg(
        total.alias("n"), centre.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.greatest(F.when(F.min("min") < F.max("max"), spread / total).otherwise(0.0), F.lit(0.0)).alias("var_pop"),
        F.max(F.when(one, mean)).alias("_m1"), F.max(F.when(~one, mean)).alias("_m0"),
        F.coalesce(F.max(F.when(one, n)), F.lit(0)).alias("_n1"))
    p = F.col("_n1") / F.col("n")
    return sides.withColumn("corr", F.when(
        F.col("var_pop") > 0, (F.col("_m1") - F.col("_m0")) * F.sqrt(p * (1 - p)) / F.sqrt("var_pop"))
    ).drop("_m1", "_m0", "_n1")


def _small(stats: DataFrame, *columns):
    """The per-feature table on the driver: one row per vector position."""
    table = stats.select("feature", *columns).orderBy("feature").toPandas()
    require_small(table.size, "feature table")
    return table


def select_variance(stats: DataFrame, threshold: float) -> list[int]:
    """Positions of features whose population variance exceeds the threshold."""
    return [int(r[0]) for r in stats.filter(F.col("var_pop") > threshold).select("feature").orderBy("feature").collect()]


def select_correlation(stats: DataFrame, threshold: float) -> list[int]:
    """Positions with an absolute correlation of at least the threshold, strongest first."""
    rows = (stats.filter(F.abs("corr") >= threshold).select("feature", F.abs("corr").alias("r"))
            .orderBy(F.desc("r"), "feature").collect())
    return [int(r["feature"]) for r in rows]


def take_features(df: DataFrame, positions: list[int]) -> DataFrame:
    """Vectors reduced to the given positions, in the given order; without positions every vector becomes empty."""
    if not positions:
        return df.withColumn("features", F.slice(F.col("features").cast("array<double>"), 1, 0))
    cut = VectorSlicer(inputCol="_v", outputCol="_cut", indices=[int(i) for i in positions])
    ready = df.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))
    return cut.transform(ready).withColumn("features", vector_to_array("_cut")).drop("_v", "_cut")


def _affine(x: Column, shift, scale) -> Column:
    moved = F.zip_with(x, array_lit(shift), lambda v, s: v - s)
    return F.zip_with(moved, array_lit(scale), lambda v, s: v * s)


def min_max(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Scale every feature to [0, 1] over ``fit`` (default: ``df`` itself); a constant feature becomes 0."""
    t = _small(feature_moments(df if fit is None else fit), "min", "max")
    width = (t["max"] - t["min"]).to_numpy()
    return df.withColumn("features", _affine(F.col("features").cast("array<double>"), t["min"],
                                             1.0 / np.where(width == 0, 1.0, width)))


def standardise(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant feature becomes 0."""
    t = _small(feature_moments(df if fit is None else fit), "mean", "var_pop")
    std = np.sqrt(t["var_pop"].to_numpy())
    return df.withColumn("features", _affine(F.col("features").cast("array<double>"), t["mean"],
                                             1.0 / np.where(std == 0, 1.0, std)))


def _times_covariance(df: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """C @ block for the covariance C of the features: one pass, partial products per task, summed per feature by Spark."""
    require_small(block.size, "projection block")
    shared = df.sparkSession.sparkContext.broadcast((mean, block))

    def run(batches):
        centre, w = shared.value
        total, n = np.zeros_like(w), 0
        for batch in batches:
            x = kernels.to_matrix(batch.column(0))
            if len(x):
                x = x - centre
                total += x.T @ (x @ w)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), kernels.from_matrix(total)],
                                             ["feature", "n", "row"])
    parts = df.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "feature long, n long, row array<double>")
    summed = parts.groupBy("feature").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("row")).alias("row"))
    rows = summed.orderBy("feature").collect()  # as many values as the block has, checked above
    return np.array([r["row"].toArray() for r in rows]) / max(rows[0]["n"], 1)


def principal_axes(df: DataFrame, k: int, extra: int = 10, passes: int = 4, seed: int = 42) -> np.ndarray:
    """Loadings (d x k) of the first ``k`` principal components by a randomised range finder.

    A drawn d x (k + extra) block goes through the covariance ``passes`` times, made orthonormal in between; the components are those of
    the covariance inside the range found. The driver holds d x (k + extra) values, never a d x d matrix. With k + extra at
    least d the range is everything and the result exact.
    """
    mean = _small(feature_moments(df), "mean")["mean"].to_numpy()
    d = len(mean)
    width = min(d, k + extra)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(passes if width < d else 0):
        block = np.linalg.qr(_times_covariance(df, mean, block))[0]
    inner = block.T @ _times_covariance(df, mean, block)
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return block @ vectors[:, ::-1][:, :k]


def project(df: DataFrame, loads: np.ndarray, mean=None) -> DataFrame:
    """Scores ``(features - mean) @ loads`` in ``features``."""
    loads = np.asarray(loads, np.float64)
    require_small(loads.size, "loadings")
    shift = (np.zeros(len(loads)) if mean is None else np.asarray(mean, np.float64)) @ loads
    shared = df.sparkSession.sparkContext.broadcast((loads, shift))

    @F.arrow_udf(DOUBLES)
    def run(features: pa.Array) -> pa.Array:
        w, s = shared.value
        x = kernels.to_matrix(features)
        return kernels.from_matrix(x @ w - s if len(x) else np.zeros((0, w.shape[1])))
    return df.withColumn("features", once(run)(F.col("features").cast("array<double>")))


def pca_project(df: DataFrame, k: int, method: str = "auto", **finding) -> DataFrame:
    """Centred scores on the first ``k`` components in ``features``; the largest loading of a component is positive.

    Scores of fewer components are the leading positions, so a sweep fits once. ``exact`` solves the d x d covariance, which the
    driver must hold; ``randomised`` never builds it (``principal_axes``, whose settings ``finding`` gives). ``auto`` is exact
    while the matrix is below the driver's limit.
    """
    mean = _small(feature_moments(df), "mean")["mean"].to_numpy()
    if method == "auto":
        method = "exact" if len(mean) ** 2 * 8 <= BROADCAST_BYTES else "randomised"
    if method == "exact":
        ready = df.select(array_to_vector(F.col("features").cast("array<double>")).alias("_v"))
        loads = PCA(k=k, inputCol="_v", outputCol="_y").fit(ready).pc.toArray()
    else:
        loads = principal_axes(df, k, **finding)
    sign = np.sign(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])])
    return project(df, loads * np.where(sign == 0, 1.0, sign), mean)


def leading(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` positions of every vector."""
    return df.withColumn("features", F.slice("features", 1, n))
