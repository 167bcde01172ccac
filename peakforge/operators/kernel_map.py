"""Kernels as maps: features whose dot products are the kernel, from a bounded set of landmark rows.

The landmarks are the rows with the lowest draws, so they depend on neither order nor partitioning. With K the kernel among
them, ``kernel(x, landmarks) U S^(-1/2)`` over the positive eigenvalues of K gives K itself between landmarks, and the best
approximation of that rank elsewhere. A sigmoid kernel need not be positive; its negative part has no map and is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import distances, kernels
from peakforge.functions.scalars import hash_uniform
from peakforge.operators import blocks as B
from peakforge.operators.features import feature_moments
from peakforge.operators.ranking import smallest
from peakforge.schema import DOUBLES
from peakforge.session import once, require_small

LANDMARKS = 300
KERNELS = ("linear", "rbf", "poly", "sigmoid")


def gamma_of(df: DataFrame, gamma: float | str) -> float:
    """A number stays; ``auto`` is 1 / features, ``scale`` also divides by the variance over all values."""
    if gamma not in ("auto", "scale"):
        return float(gamma)
    width = B.shape(df)[1]
    if gamma == "auto":
        return 1.0 / max(width, 1)
    m = feature_moments(df).agg(F.avg("mean"), F.avg("var_pop"), F.avg(F.col("mean") * F.col("mean"))).first()
    return 1.0 / (width * max(m[1] + m[2] - m[0] ** 2, 1e-12))


def values(x: np.ndarray, y: np.ndarray, kernel: str, gamma: float, degree: int = 3, offset: float = 0.0) -> np.ndarray:
    """Kernel of every row of x with every row of y."""
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0))
    product = x @ y.T
    if kernel == "linear":
        return product
    if kernel == "poly":
        return (gamma * product + offset) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * product + offset)
    raise ValueError(f"kernel {kernel!r} is none of {KERNELS}")


def mapped(x: np.ndarray, points: np.ndarray, turn: np.ndarray, *kernel) -> np.ndarray:
    """``values`` with the landmarks times ``turn``, in parts of bounded size: a whole batch of kernel values has several copies on its way."""
    out = np.empty((len(x), turn.shape[1]))
    for part in distances.chunks(len(x), len(points)):
        out[part] = values(x[part], points, *kernel) @ turn
    return out


def landmark_rows(df: DataFrame, n: int = LANDMARKS, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the lowest draws."""
    draw = hash_uniform(F.col("sample_id"), F.lit("landmark"), F.lit(seed))
    return smallest(df.filter(F.col("features").isNotNull()).select("sample_id", "features", draw.alias("_u")), ["_u", "sample_id"], n)


def kernel_map(df: DataFrame, kernel: str = "rbf", gamma: float | str = "scale", degree: int = 3, offset: float = 0.0,
               landmarks: int = LANDMARKS, seed: int = 42):
    """A function that maps ``features`` of any DataFrame; landmarks and ``gamma`` are taken from ``df``."""
    gamma = gamma_of(df, gamma) if kernel != "linear" else 1.0
    rows = landmark_rows(df, landmarks, seed).select("sample_id", F.col("features").cast("array<double>").alias("features")).toArrow()
    points = kernels.to_matrix(rows.sort_by("sample_id")["features"].combine_chunks())  # at most ``landmarks`` rows
    require_small(points.size + len(points) ** 2, "landmarks")
    own = values(points, points, kernel, gamma, degree, offset)
    sizes, vectors = np.linalg.eigh((own + own.T) / 2)
    good = sizes > max(sizes.max(initial=0.0), 0.0) * 1e-12
    turn = vectors[:, good] / np.sqrt(sizes[good])
    shared = df.sparkSession.sparkContext.broadcast((points, turn))

    @F.arrow_udf(DOUBLES)
    def run(features: pa.Array) -> pa.Array:
        points, turn = shared.value
        return kernels.from_matrix(mapped(kernels.to_matrix(features), points, turn, kernel, gamma, degree, offset))
    return lambda other: other.withColumn("features", once(run)(F.col("features").cast("array<double>")))
