"""Peak kernel between spectra on one m/z axis: K = X W Y' / (4 pi t), W[i, j] = exp(-(mz_i - mz_j)^2 / 4t), j < i + d.

``d`` is the first column of the first row whose weight is below the cut. X W is a banded product done row by row; the
product with Y is one matrix product per block of Y, so each X row leaves a task once per Y block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators import blocks as B
from peakforge.operators.tiles import in_groups, meet
from peakforge.schema import DOUBLES
from peakforge.session import once


ENTRIES = "id_x string, id_y string, k double"


def band(mz_x: np.ndarray, mz_y: np.ndarray, t: float = 1.0, cut: float = 1e-6):
    """Non-zero diagonals of W as (offset, first row, weights)."""
    below = np.flatnonzero(np.exp(-((mz_x[0] - mz_y) ** 2) / (4.0 * t)) < cut)
    if not len(below):
        raise ValueError("no weight falls below the cut; choose a smaller t")
    out = []
    for offset in range(-(len(mz_x) - 1), int(below[0])):
        first, last = max(0, -offset), min(len(mz_x), len(mz_y) - offset)
        if last <= first:
            continue
        i = np.arange(first, last)
        w = np.exp(-((mz_x[i] - mz_y[i + offset]) ** 2) / (4.0 * t))
        if w.any():
            out.append((offset, first, w))
    return out


def pike_project(df: DataFrame, mz_x, mz_y=None, t: float = 1.0, cut: float = 1e-6) -> DataFrame:
    """Add ``projected`` = features x W / (4 pi t); the kernel of a pair is its dot product with the other spectrum."""
    mz_x = np.asarray(mz_x, dtype=np.float64)
    mz_y = mz_x if mz_y is None else np.asarray(mz_y, dtype=np.float64)
    diagonals = band(mz_x, mz_y, t, cut)

    @F.arrow_udf(DOUBLES)
    def run(features: pa.Array) -> pa.Array:
        x = kernels.to_matrix(features)
        z = np.zeros((len(x), len(mz_y)))
        if len(x):
            for offset, first, w in diagonals:
                rows = slice(first, first + len(w))
                z[:, first + offset:first + offset + len(w)] += x[:, rows] * w
        return kernels.from_matrix(z / (4.0 * np.pi * t))
    return df.withColumn("projected", once(run)(F.col("features").cast("array<double>")))


def pike_pairs(pairs: DataFrame, x: DataFrame, y: DataFrame, mz, t: float = 1.0, cut: float = 1e-6) -> DataFrame:
    """Kernel values of the listed (id_x, id_y) pairs only."""
    px = pike_project(x, mz, t=t, cut=cut).select(F.col("sample_id").alias("id_x"), "projected")
    py = y.select(F.col("sample_id").alias("id_y"), F.col("features").cast("array<double>").alias("_y"))
    dot = F.aggregate(F.zip_with("projected", "_y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return pairs.join(px, "id_x").join(py, "id_y").select("id_x", "id_y", dot.alias("k"))


def pike_kernel(x: DataFrame, y: DataFrame | None, mz, t: float = 1.0, cut: float = 1e-6, strategy: str = "auto",
                block_bytes: int | None = None) -> DataFrame:
    """The kernel matrix, one row per entry: (id_x, id_y, k).

    A Y side that fits is broadcast; beyond that, blocks of both sides meet on a grid of tiles. Both ways give the same rows;
    spectra without a vector have no entries, and an empty side gives none. ``pike_pairs`` evaluates listed pairs only.
    """
    x, y = (side.filter(F.col("features").isNotNull()) for side in (x, x if y is None else y))
    z = pike_project(x, mz, t=t, cut=cut).select("sample_id", F.col("projected").alias("features"))
    if strategy == "auto":
        strategy = "broadcast" if B.fits(*B.shape(y)) else "blocks"
    if strategy == "broadcast":
        ids, vectors, _, _ = B.collect_matrix(y)
        shared = x.sparkSession.sparkContext.broadcast(([str(i) for i in ids], vectors))

        def rows(batches):
            names, columns = shared.value
            for batch in batches if names else ():
                q = kernels.to_matrix(batch.column(1))
                for i, row in zip(batch.column(0).to_pylist(), q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(columns @ row)],
                        ["id_x", "id_y", "k"])
        return z.select(F.col("sample_id").cast("string"), "features").mapInArrow(rows, ENTRIES)

    if y.isEmpty():
        return x.sparkSession.createDataFrame([], ENTRIES)
    pivots = B.pick_pivots(y, "euclidean")
    lblocks, rblocks = (in_groups(B.pack(side, pivots, "euclidean", block_bytes)) for side in (z, y))

    def evaluate(row, held):
        x_rows, left = B.vectors_of(row["data"], row["n"].as_py()), np.array(row["ids"].values.to_pylist(), object)
        found = [(B.vectors_of(r["data"], r["n"].as_py()), r["ids"].values.to_pylist()) for r in held]
        right = [i for _, ids in found for i in ids]
        k = np.concatenate([x_rows @ v.T for v, _ in found], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(left, len(right)), pa.string()), pa.array(right * len(left), pa.string()),
                                           pa.array(k.ravel())], ["id_x", "id_y", "k"])
    return meet(lblocks, rblocks, ENTRIES, evaluate, ["ids", "data"], ["ids", "data"])
