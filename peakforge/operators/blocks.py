"""Vectors packed into bounded blocks.

A block is one row with at most ``BLOCK_BYTES`` of vectors. Rows are range-partitioned by where they lie (nearest pivots
in order, distance to the first, id) and packed partition by partition, so a crowded region is cut into many blocks and no group is ever
collected. Each block carries its rows' distances to every pivot and their intervals; by the triangle inequality these
bound the distance between a row and a block and between any two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from peakforge.functions import distances, kernels
from peakforge.schema import DOUBLES
from peakforge.session import BROADCAST_BYTES, cut_lineage, once, require_small

BLOCK_BYTES = 1024 * 1024
PIVOTS = 16
PIVOT_SAMPLE = 1024
# How many nearest pivots, in order, name the cell of a row.
CELL_DEPTH = 3
PLACE = T.StructType([T.StructField("p", DOUBLES), T.StructField("c", T.ArrayType(T.IntegerType()))])

BLOCK_SCHEMA = ("block long, n int, ids array<string>, labels array<double>, weights array<double>, data binary, "
                "places binary, lo array<double>, hi array<double>")


def shape(df: DataFrame) -> tuple[int, int]:
    """Number of rows and vector length, in one small job."""
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    return int(n), int(d or 0)


def fits(n: int, d: int) -> bool:
    """Whether n vectors of length d may be broadcast."""
    return n * (d + 2) * 8 <= BROADCAST_BYTES


def collect_matrix(df: DataFrame):
    """Ids, vectors, labels and weights of a size-checked side, in id order."""
    table = df.select(*_columns(df)).toArrow().sort_by("sample_id")
    if table.num_rows == 0:
        return np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    vectors = kernels.to_matrix(table["features"].combine_chunks())
    require_small(vectors.size, "broadcast side")
    return (np.array(table["sample_id"].to_pylist(), dtype=object), vectors,
            table["label"].to_numpy().astype(np.float64), table["weight"].to_numpy().astype(np.float64))


def _columns(df: DataFrame):
    def optional(name):
        return (F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")).alias(name)
    weight = F.col("weights").cast("array<double>").alias("weight") if "weights" in df.columns else optional("weight")
    return [F.col("sample_id").cast("string").alias("sample_id"), F.col("features").cast("array<double>").alias("features"),
            optional("label"), weight]


def pick_pivots(df: DataFrame, metric: str) -> np.ndarray:
    """A fixed number of far-apart vectors out of a bounded sample in hash order, independent of partitioning."""
    width = shape(df.limit(1))[1]
    sample = max(PIVOTS, min(PIVOT_SAMPLE, BROADCAST_BYTES // (8 * max(1, width))))
    rows = df.select(F.col("features").cast("array<double>").alias("features")).orderBy(F.xxhash64("features")).limit(sample)
    vectors = np.unique(kernels.to_matrix(rows.toArrow()["features"].combine_chunks()), axis=0)
    chosen, gap = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(PIVOTS, len(vectors)):
        gap = np.minimum(gap, distances.exact(vectors, vectors[chosen[-1]], metric))
        chosen.append(int(gap.argmax()))
    return vectors[chosen]


def with_pivot_distances(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add ``_p``, the distance to every pivot, and ``_c``, the numbers of the nearest pivots in order."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf(PLACE)
    def run(vectors: pa.Array) -> pa.Array:
        p, x = shared.value, kernels.to_matrix(vectors)
        out = np.empty((len(x), len(p)))
        for part in distances.chunks(len(x), len(p), x.shape[1] if len(x) else 1):
            gap = x[part, None, :] - p[None, :, :]
            out[part] = np.sqrt((gap * gap).sum(2)) if metric == "euclidean" else np.abs(gap).sum(2)
        order = np.argsort(out, axis=1, kind="stable")[:, :CELL_DEPTH].astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
        return pa.StructArray.from_arrays([kernels.from_matrix(out), cells], ["p", "c"])
    return (df.withColumn("_at", once(run)("features"))
            .withColumns({"_p": F.col("_at.p"), "_c": F.col("_at.c")}).drop("_at"))


def pack(df: DataFrame, pivots: np.ndarray, metric: str = "euclidean", block_bytes: int | None = None) -> DataFrame:
    """Blocks of (sample_id, features[, label, weight or weights]) as checkpointed rows of ``BLOCK_SCHEMA``.

    With ``weights``, lists of one length, a block holds them row after row.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    placed = with_pivot_distances(df.select(*_columns(df)), pivots, metric)
    placed = placed.withColumn("_d", F.array_min("_p"))
    ordered = placed.repartitionByRange("_c", "_d", "sample_id").sortWithinPartitions("_c", "_d", "sample_id")

    def packing(batches):
        held, rows, number = [], 0, TaskContext.get().partitionId() << 33

        def emit(parts, size, number):
            t = pa.Table.from_batches(parts).combine_chunks()
            done = t.slice(0, size).sort_by("sample_id")
            p, x = kernels.to_matrix(done["_p"].combine_chunks()), kernels.to_matrix(done["features"].combine_chunks())
            if pa.types.is_list(done["weight"].type):
                weight = pa.array([done["weight"].combine_chunks().flatten().to_pylist()], pa.list_(pa.float64()))
            else:
                weight = pa.array([done["weight"].to_pylist()], pa.list_(pa.float64()))
            lists = [pa.array([done[c].to_pylist()], kind) for c, kind in
                     (("sample_id", pa.list_(pa.string())), ("label", pa.list_(pa.float64())))]
            block = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([size], pa.int32()), *lists, weight, pa.array([x.tobytes()], pa.binary()),
                 pa.array([p.tobytes()], pa.binary()),
                 pa.array([p.min(0)], pa.list_(pa.float64())), pa.array([p.max(0)], pa.list_(pa.float64()))],
                ["block", "n", "ids", "labels", "weights", "data", "places", "lo", "hi"])
            return block, t.slice(size).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            width = len(batch.column(batch.schema.get_field_index("features"))[0])
            size = max(1, block_bytes // (8 * max(1, width)))
            while rows >= size:
                block, held = emit(held, size, number)
                rows, number = rows - size, number + 1
                yield block
        if rows:
            yield emit(held, rows, number)[0]

    return cut_lineage(ordered.select("sample_id", "features", "label", "weight", "_p")
                       .mapInArrow(packing, BLOCK_SCHEMA))


def vectors_of(data: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(n, -1)


def numbers_of(values: pa.Scalar) -> np.ndarray:
    """A list of numbers as an array, NULL as NaN."""
    return values.values.to_numpy(zero_copy_only=False).astype(np.float64)
