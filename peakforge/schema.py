"""Table shapes used across the package."""

from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())

SPECTRUM = T.StructType([T.StructField("mz", DOUBLES), T.StructField("intensity", DOUBLES)])

YEARLY_LABELS = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("species", T.StringType()),
])

# Class codes of the susceptibility letters.
CLASS_CODES = {"R": 0, "S": 1, "I": 2}
