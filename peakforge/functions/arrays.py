"""Array column expressions that stay in the JVM.

A lambda here refers to its own element and to plain columns, never to the variable of an outer lambda: Spark fails to
plan an Arrow function whose argument holds such an expression. A column read inside a lambda is also read outside of it
or twice, so the optimizer keeps it as a column instead of evaluating it again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STABILISERS = {"sqrt": F.sqrt, "log": F.ln, "log2": F.log2, "log10": F.log10}


def total(y) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v)


def stabilise(y, method: str = "sqrt") -> Column:
    fn = STABILISERS[method]
    if method == "sqrt":
        return F.transform(y, lambda v: fn(v))
    return F.transform(y, lambda v: F.when(v > 0, fn(v)).when(v == 0, float("-inf")).otherwise(float("nan")))


def scaled(y, by: str, to: float = 1.0) -> Column:
    """Elements divided by the column ``by`` and multiplied by ``to``; NaN where the divisor is 0."""
    return F.transform(y, lambda v: F.when(F.col(by) != 0, v / F.col(by) * to).otherwise(F.lit(float("nan"))))


def binarise(y, threshold: float) -> Column:
    return F.transform(y, lambda v: F.when(v > threshold, 1.0).otherwise(0.0))


def peaks(mz: str, y: str) -> Column:
    """The two arrays of a spectrum as one array of (mz, y)."""
    return F.arrays_zip(F.col(mz).alias("mz"), F.col(y).alias("y"))


def inside(pairs: Column, lo: float, hi: float) -> Column:
    """Pairs whose m/z lies strictly between ``lo`` and ``hi``."""
    return F.filter(pairs, lambda p: (p["mz"] > lo) & (p["mz"] < hi))


def highest(pairs: Column, n: int) -> Column:
    """The ``n`` most intense pairs in their original order; ties go to the earlier position."""
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct(
        (-p["y"]).alias("down"), i.alias("i"), p["mz"].alias("mz"), p["y"].alias("y"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda r: F.struct(
        r["i"].alias("i"), r["mz"].alias("mz"), r["y"].alias("y"))))


def tof_to_mz(ml1, ml2, ml3, tof) -> Column:
    """Mass calibration of a time of flight: a plain square when the quadratic term is absent, else the root."""
    b = F.sqrt(F.lit(1e12) / ml1)
    c = ml2 - tof
    return F.when(ml3 == 0, c * c / (b * b)).otherwise(
        F.pow((-b + F.sqrt(b * b - 4 * ml3 * c)) / (2 * ml3), 2)
    )
