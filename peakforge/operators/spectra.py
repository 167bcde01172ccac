"""Spectrum operators: DataFrame(spectrum_id, mz, intensity, ...) -> DataFrame.

Pointwise steps are array expressions in the JVM. Stencils and solvers run as Arrow functions over whole batches. The
standard chain is fused into one Arrow function, so a spectrum crosses to Python once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import arrays, kernels
from peakforge.functions.scalars import hash_uniform
from peakforge.schema import DOUBLES, SPECTRUM
from peakforge.session import once

Step = Callable[[DataFrame], DataFrame]

# Spectra whose results are held at once: an Arrow batch comes with thousands of spectra, and bins make a spectrum far longer.
SLICE = 128

# The 69 mass boundaries of the table-driven binning. The literal list has 1250 where 12250 is meant.
MASS_TABLE = [
    2000, 2050, 2100, 2250, 2300, 2500, 2750, 3000, 3250, 3500, 3750, 4000, 4250, 4500, 4750, 5000, 5250, 5500, 5750,
    6000, 6250, 6500, 7000, 7250, 7500, 8000, 8250, 8500, 8750, 9000, 9250, 9500, 9750, 10000, 10500, 11000, 11500,
    12000, 12250, 12500, 12750, 13000, 13250, 13500, 13750, 14000, 14250, 14500, 14750, 15000, 15250, 15500, 15750,
    16000, 16250, 16500, 16750, 17000, 17250, 17500, 17750, 18000, 18250, 18500, 18750, 19000, 19250, 19500, 19750,
]
MASS_TABLE_LITERAL = [1250 if m == 12250 else m for m in MASS_TABLE]


def chain(*steps: Step) -> Step:
    """Any number of DataFrame -> DataFrame steps, applied in order."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df
    return run


# ---- pointwise steps ------------------------------------------------------------------------------------------------

def stabilise(method: str = "sqrt") -> Step:
    return lambda df: df.withColumn("intensity", arrays.stabilise("intensity", method))


def tic(total: float = 1.0) -> Step:
    """Scale every spectrum to a total of ``total``; an all-zero signal gives NaN in every position."""
    return lambda df: (df.withColumn("_sum", arrays.total("intensity"))
                       .withColumn("intensity", arrays.scaled("intensity", "_sum", total)).drop("_sum"))


def _from_pairs(df: DataFrame, pairs) -> DataFrame:
    """Replace mz and intensity by an array of (mz, y)."""
    return (df.withColumn("_pairs", pairs)
            .withColumns({"mz": F.col("_pairs.mz"), "intensity": F.col("_pairs.y")}).drop("_pairs"))


def trim(lo: float = 2000, hi: float = 20000) -> Step:
    return lambda df: _from_pairs(df, arrays.inside(arrays.peaks("mz", "intensity"), lo, hi))


def binarise(threshold: float) -> Step:
    return lambda df: df.withColumn("intensity", arrays.binarise("intensity", threshold))


def filter_peaks(top: int | None = None, min_intensity: float | None = None) -> Step:
    """Keep the ``top`` most intense points, then those of at least ``min_intensity``; original order stays."""
    def run(df: DataFrame) -> DataFrame:
        pairs = arrays.peaks("mz", "intensity")
        if top is not None:
            pairs = arrays.highest(pairs, top)
        if min_intensity is not None:
            pairs = F.filter(pairs, lambda p: p["y"] >= min_intensity)
        return _from_pairs(df, pairs)
    return run


def _jitter(noise, seed: int) -> Step:
    def run(df: DataFrame) -> DataFrame:
        return df.withColumn("mz", F.transform("mz", lambda v, i: v + noise(
            hash_uniform(F.col("spectrum_id"), i, F.lit(seed)), hash_uniform(F.col("spectrum_id"), i, F.lit(-seed - 1)))))
    return run


def jitter_normal(std: float = 1.0, seed: int = 42) -> Step:
    """Add a repeatable normal shift to every m/z (Box-Muller over two hash draws)."""
    return _jitter(lambda u, v: F.lit(std) * F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(F.lit(2.0 * np.pi) * v), seed)


def jitter_uniform(width: float = 1.5, seed: int = 42) -> Step:
    return _jitter(lambda u, v: F.lit(width) * (2.0 * u - 1.0), seed)


def scale_by_min(df: DataFrame) -> DataFrame:
    """Scale all intensities so that the smallest non-zero value of the whole set becomes 1."""
    low = df.agg(F.min(F.array_min(F.filter("intensity", lambda v: v != 0))).alias("low"))
    return (df.withColumn("_low", low.scalar())
            .withColumn("intensity", F.transform("intensity", lambda v: F.when(
                F.col("_low").isNotNull(), v * (1.0 / F.col("_low"))).otherwise(v)))
            .drop("_low"))


# ---- stencils and solvers -------------------------------------------------------------------------------------------

def _on_intensity(kernel) -> Step:
    @F.arrow_udf(DOUBLES)
    def run(y: pa.Array) -> pa.Array:
        return kernels.by_length(y, kernel)
    return lambda df: df.withColumn("intensity", once(run)("intensity"))


def smooth(halfwindow: int = 10, order: int = 3) -> Step:
    return _on_intensity(lambda y: kernels.smooth(y, halfwindow, order))


def baseline(method: str = "snip", iterations: int = 10, lam: float = 1e8, p: float = 0.01, max_iter: int = 10,
             tol: float = 1e-6) -> Step:
    """Subtract a baseline: ``snip``, ``als`` or ``arpls``."""
    if method == "snip":
        return _on_intensity(lambda y: y - kernels.snip_baseline(y, iterations))
    kind = {"als": "ALS", "arpls": "ArPLS"}[method]
    return _on_intensity(lambda y: y - kernels.ls_baseline(y, kind, lam, p, max_iter, tol))


def persistence(keep_zero: bool = True) -> Step:
    @F.arrow_udf(DOUBLES)
    def run(y: pa.Array) -> pa.Array:
        return kernels.by_length(y, lambda block: [kernels.persistence(row) for row in block])

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("intensity", once(run)("intensity"))
        if keep_zero:
            return df
        return _from_pairs(df, F.filter(arrays.peaks("mz", "intensity"), lambda p: p["y"] != 0))
    return step


def _rows(mz: pa.Array, y: pa.Array):
    fx, ox = kernels.split_lists(mz)
    fy, oy = kernels.split_lists(y)
    for i in range(len(mz)):
        yield fx[ox[i]:ox[i + 1]], fy[oy[i]:oy[i + 1]]


def _in_slices(make):
    """Arrow function of (mz, intensity) that makes and hands on the results of ``SLICE`` spectra at a time."""
    @F.arrow_udf(SPECTRUM)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for mz, y in batches:
            for at in range(0, len(mz), SLICE):
                yield make(mz.slice(at, SLICE), y.slice(at, SLICE))
    return run


def _pairwise(kernel) -> Step:
    """Step whose kernel maps one (mz, intensity) to a new pair."""
    def make(mz: pa.Array, y: pa.Array) -> pa.Array:
        done = [kernel(a, b) if len(a) else (a, b) for a, b in _rows(mz, y)]
        return pa.StructArray.from_arrays(
            [kernels.from_rows([d[0] for d in done]), kernels.from_rows([d[1] for d in done])], ["mz", "intensity"])
    run = _in_slices(make)

    def step(df: DataFrame) -> DataFrame:
        return (df.withColumn("_s", once(run)("mz", "intensity"))
                .withColumns({"mz": F.col("_s.mz"), "intensity": F.col("_s.intensity")}).drop("_s"))
    return step


def resample_grid(n: int = 1000) -> Step:
    """Linear interpolation at ``n`` equally spaced m/z between the ends of each spectrum."""
    return _pairwise(lambda mz, y: kernels.resample(mz, y, n))


# ---- binning of whole spectra ---------------------------------------------------------------------------------------

def _binner(edges: np.ndarray, centres: np.ndarray, agg: str) -> Step:
    return _pairwise(lambda mz, y: (centres, kernels.bin_values(mz, y, edges, agg)))


def bin_equal(start=2000, stop=20000, step=3, agg: str = "sum") -> Step:
    edges = kernels.equal_edges(start, stop, step)
    return _binner(edges, edges[:-1] + step / 2, agg)


def bin_log(start=2000, stop=20000, n: int = 100, agg: str = "sum") -> Step:
    edges = kernels.log_edges(start, stop, n)
    return _binner(edges, (edges[:-1] + edges[1:]) / 2, agg)


def bin_table(edges=None) -> Step:
    """Sums between consecutive boundaries of the rounded m/z, both ends included."""
    edges = np.asarray(MASS_TABLE if edges is None else edges, dtype=np.float64)
    centres = (edges[:-1] + edges[1:]) / 2
    return _pairwise(lambda mz, y: (centres, kernels.bin_ranges(mz, y, edges[:-1], edges[1:])))


# ---- the standard chain ---------------------------------------------------------------------------------------------

def _stage_kernels():
    """The five stages as (mz, block) -> (mz, block) for rows that share one m/z axis length."""
    def normalise(y):
        s = y.sum(axis=1, keepdims=True)
        return np.where(s != 0, y / np.where(s == 0, 1.0, s), np.nan)
    return [
        ("sqrt", np.sqrt),
        ("smooth", lambda y: kernels.smooth(y, 10, 3)),
        ("snip", lambda y: y - kernels.snip_baseline(y, 10)),
        ("tic", normalise),
    ]


def _trimmed(mz, y, lo=2000.0, hi=20000.0):
    keep = (mz > lo) & (mz < hi)
    return mz[keep], y[keep]


def standard_chain(binned: bool = True) -> Step:
    """sqrt, smooth, SNIP, total-ion scaling, trim and (optionally) equal-width bins, fused into one Arrow pass."""
    edges = kernels.equal_edges()
    centres = edges[:-1] + 1.5
    stages = [fn for _, fn in _stage_kernels()]

    def make(mz: pa.Array, y: pa.Array) -> pa.Array:
        def prepare(block):
            for fn in stages:
                block = None if block is None else fn(block)
            return block
        ready = kernels.by_length(y, prepare)
        null = ready.is_null().to_numpy(zero_copy_only=False)
        out_mz, out_y = [], []
        for i, (a, b) in enumerate(_rows(mz, ready)):
            if null[i]:
                a = b = None
            else:
                a, b = _trimmed(a, b)
                if binned:
                    a, b = centres, kernels.bin_values(a, b, edges)
            out_mz.append(a)
            out_y.append(b)
        return pa.StructArray.from_arrays([kernels.from_rows(out_mz), kernels.from_rows(out_y)], ["mz", "intensity"])
    run = _in_slices(make)

    return lambda df: (df.withColumn("_s", once(run)("mz", "intensity"))
                       .withColumns({"mz": F.col("_s.mz"), "intensity": F.col("_s.intensity")}).drop("_s"))


def resampled_chain(n: int = 1000) -> Step:
    """The five steps with a resample to ``n`` points after each; no binning."""
    def run(mz, y):
        for _, fn in _stage_kernels():
            done = fn(y[None, :])
            if done is None:
                return None, None
            mz, y = kernels.resample(mz, done[0], n)
        mz, y = _trimmed(mz, y)
        return kernels.resample(mz, y, n) if len(mz) else (mz, y)
    return _pairwise(run)


def trace_steps(df: DataFrame) -> DataFrame:
    """Long rows (spectrum_id, step_no, step, mz, intensity): the original and the result of each of the five steps."""
    @F.arrow_udf("array<struct<step_no:int,step:string,mz:array<double>,intensity:array<double>>>")
    def run(mz: pa.Array, y: pa.Array) -> pa.Array:
        names, xs, ys, sizes = [], [], [], []
        for a, b in _rows(mz, y):
            steps = [("raw", a, b)]
            for name, fn in _stage_kernels():
                done = fn(steps[-1][2][None, :])
                if done is None:
                    break
                steps.append((name, a, done[0]))
            else:
                steps.append(("trim", *_trimmed(a, steps[-1][2])))
            sizes.append(len(steps))
            for name, u, v in steps:
                names.append(name)
                xs.append(u)
                ys.append(v)
        number = [i for s in sizes for i in range(s)]
        items = pa.StructArray.from_arrays(
            [pa.array(number, pa.int32()), pa.array(names, pa.string()), kernels.from_rows(xs), kernels.from_rows(ys)],
            ["step_no", "step", "mz", "intensity"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)
    return (df.select("spectrum_id", once(run)("mz", "intensity").alias("_s")).select("spectrum_id", F.explode("_s").alias("r"))
            .select("spectrum_id", "r.step_no", "r.step", "r.mz", "r.intensity"))


def before_after(df: DataFrame, n: int = 1000) -> DataFrame:
    """Every spectrum twice, resampled to ``n`` points: as measured and after the standard chain."""
    raw = df.transform(resample_grid(n)).withColumn("stage", F.lit("raw"))
    done = df.transform(standard_chain(binned=False)).transform(resample_grid(n))
    return raw.unionByName(done.withColumn("stage", F.lit("preprocessed")))


def build_features(df: DataFrame, sample_id: str = "spectrum_id") -> DataFrame:
    """One row per spectrum with its fixed-length vector in ``features``."""
    keep = [c for c in df.columns if c not in ("mz", "intensity", sample_id)]
    return (df.transform(standard_chain())
            .select(F.col(sample_id).cast("string").alias("sample_id"), *keep, F.col("intensity").alias("features")))
