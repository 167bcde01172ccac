"""Binning of long-form points (spectrum_id, mz, intensity).

Points are counted into (spectrum, bin) with map-side partial sums, so a spectrum that holds a third of all points never
meets in one task; only the bins of a spectrum, whose number is fixed, are put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators.spectra import MASS_TABLE
from peakforge.schema import DOUBLES
from peakforge.session import array_lit, once

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
}


def _settled(raw: Column, mz: Column, edge, n: int) -> Column:
    """Correct a computed bin number by comparing with its edges; the last bin is closed."""
    at = F.when(mz < edge(raw), raw - 1).when(mz >= edge(raw + 1), raw + 1).otherwise(raw)
    return F.when(mz == edge(F.lit(n)), n - 1).otherwise(at).cast("int")


def equal_bin(mz: Column, start=2000, stop=20000, step=3) -> Column:
    n = len(kernels.equal_edges(start, stop, step)) - 1
    return _settled(F.floor((mz - start) / step).cast("int"), mz, lambda i: start + i * F.lit(float(step)), n)


def log_bin(mz: Column, start=2000, stop=20000, n: int = 100) -> Column:
    edges = array_lit(kernels.log_edges(start, stop, n))
    low, width = np.log10(start), (np.log10(stop) - np.log10(start)) / n
    raw = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.log10(mz) - low) / width).cast("int")))
    return _settled(raw, mz, lambda i: F.get(edges, i), n)


def _grouped(points: DataFrame, at: Column, lo: float, hi: float, agg: str) -> DataFrame:
    return (points.filter((F.col("mz") >= lo) & (F.col("mz") <= hi))
            .groupBy("spectrum_id", at.alias("bin"))
            .agg(AGGREGATES[agg]("intensity").alias("value")))


def bin_points_equal(points: DataFrame, start=2000, stop=20000, step=3, agg: str = "sum") -> DataFrame:
    """Non-empty bins as (spectrum_id, bin, value)."""
    edges = kernels.equal_edges(start, stop, step)
    return _grouped(points, equal_bin(F.col("mz"), start, stop, step), float(edges[0]), float(edges[-1]), agg)


def bin_points_log(points: DataFrame, start=2000, stop=20000, n: int = 100, agg: str = "sum") -> DataFrame:
    edges = kernels.log_edges(start, stop, n)
    return _grouped(points, log_bin(F.col("mz"), start, stop, n), float(edges[0]), float(edges[-1]), agg)


def bin_points_table(points: DataFrame, edges=None) -> DataFrame:
    """Sum per closed range between consecutive boundaries; a point on a shared boundary lands in both ranges.

    Ascending boundaries are searched by bisection; any other list is tested range by range inside the row.
    """
    edges = list(MASS_TABLE if edges is None else edges)
    points = points.withColumn("_r", F.bround("mz", 0))
    if all(a < b for a, b in zip(edges, edges[1:])):
        points = points.filter((F.col("_r") >= edges[0]) & (F.col("_r") <= edges[-1]))
        located = Bucketizer(splits=[float(e) for e in edges], inputCol="_r", outputCol="_b").transform(points)
        at = F.col("_b").cast("int")
        shared = (F.col("_r") == F.get(array_lit(edges), at)) & (at > 0)
        bins = F.when(shared, F.array(at - 1, at)).otherwise(F.array(at))
    else:
        located = points
        starts, ends = array_lit(edges[:-1]), array_lit(edges[1:])
        bins = F.filter(F.sequence(F.lit(0), F.lit(len(edges) - 2)),
                        lambda i: (F.col("_r") >= F.get(starts, i)) & (F.col("_r") <= F.get(ends, i)))
    return (located.select("spectrum_id", "intensity", F.explode(bins).alias("bin"))
            .groupBy("spectrum_id", "bin").agg(F.sum("intensity").alias("value")))


def densify(bins: DataFrame, n: int) -> DataFrame:
    """One dense array of ``n`` values per spectrum (at most ``n`` rows meet per spectrum)."""
    @F.arrow_udf(DOUBLES)
    def scatter(at: pa.Array, value: pa.Array) -> pa.Array:
        flat_at, offsets = kernels.split_lists(at)
        flat_v, _ = kernels.split_lists(value)
        row = np.repeat(np.arange(len(at)), np.diff(offsets))
        out = np.zeros((len(at), n))
        out[row, flat_at[offsets[0]:offsets[-1]].astype(np.int64)] = flat_v[offsets[0]:offsets[-1]]
        return kernels.from_matrix(out)
    packed = bins.groupBy("spectrum_id").agg(F.collect_list(F.struct("bin", "value")).alias("b"))
    return packed.select("spectrum_id", once(scatter)(F.col("b.bin"), F.col("b.value")).alias("features"))
