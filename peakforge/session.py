"""Session helpers: lineage cuts, bounded driver reads, literals for small lookup arrays."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side, in bytes, that may be read to the driver and broadcast to the tasks.
BROADCAST_BYTES = 32 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators are written for."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="peakforge-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def n_parts(spark: SparkSession) -> int:
    """Partitions for work that is not in proportion to the bytes of its input."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, n_other: int) -> DataFrame:
    """Rows dealt anew for work that is a row's number times ``n_other``, where that is much more than moving the row.

    The given partitions follow the bytes of the input, and a table of few bytes would keep one core busy.
    """
    if n_other < 4096:
        return df
    return df.repartition(n_parts(df.sparkSession))


def require_small(n_values: int, what: str, limit: int = BROADCAST_BYTES) -> None:
    """Guard for what is about to be held by the driver and every task."""
    if n_values * 8 > limit:
        raise ValueError(f"{what}: {n_values * 8} bytes exceed the {limit} bytes allowed on the driver")


def once(udf):
    """Arrow function that the optimizer neither merges nor repeats: its result column is computed once per row.

    Spark otherwise copies the call into every place that reads the column, and cannot always join the copies again when
    an argument holds a higher-order function.
    """
    return udf.asNondeterministic()


def array_lit(values, kind: str = "double") -> Column:
    """A (size-checked) Python sequence as one foldable array literal."""
    values = [None if v is None else (int(v) if kind != "double" else float(v)) for v in values]
    require_small(len(values), "array literal")
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>", {"allowNonNumericNumbers": "true"})
