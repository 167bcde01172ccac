"""Exact k-nearest-neighbour join and what stands on it: classification and neighbourhood graphs.

A right side of checked small size is broadcast, and the left side is only mapped over. Beyond that size both sides are
packed into bounded blocks that meet on a grid of tiles. A left block first meets the group of right blocks nearest to it; then only
groups whose distance bound does not exceed the k-th distance that one of its rows has found. Copies of a vector are reduced to the k+1 smallest ids first, which is all that ties can ever use.
Only the best k of each row leave a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions import distances, kernels
from peakforge.operators import blocks as B
from peakforge.operators.tiles import in_groups, meet
from peakforge.session import BROADCAST_BYTES, cut_lineage, once, spread

NN = "array<struct<id:string,dist:double,label:double>>"
# Right rows that a left block meets at once; smaller blocks are taken together.
RUN_ROWS = 4096
ROWS = "lblock long, sample_id string, id string, dist double, label double"


def _lists(n: int, rows, ids, dist, labels) -> pa.Array:
    """Neighbour lists from sorted (row, ...) entries."""
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, int)
    items = pa.StructArray.from_arrays(
        [pa.array(ids, pa.string()), pa.array(dist, pa.float64()), pa.array(labels, pa.float64(), from_pandas=True)],
        ["id", "dist", "label"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)


def _without_self(rows, cols, dist, own, other, k):
    keep = own[rows] != other[cols]
    rows, cols, dist = rows[keep], cols[keep], dist[keep]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[first], cols[first], dist[first]


def _limit_copies(ids, vectors, labels, need: int):
    """The first ``need`` rows of every distinct vector, in id order."""
    if not len(ids):
        return ids, vectors, labels
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.argsort(group, kind="stable")
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order], side="left")
    keep = np.sort(order[rank < need])
    return ids[keep], vectors[keep], labels[keep]


def _by_broadcast(left: DataFrame, right: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    ids, vectors, labels, _ = B.collect_matrix(right)
    shared = left.sparkSession.sparkContext.broadcast(_limit_copies(ids, vectors, labels, k + exclude_self))

    @F.arrow_udf(NN)
    def run(own: pa.Array, features: pa.Array) -> pa.Array:
        ids, s, labels = shared.value
        place = np.flatnonzero(features.is_valid().to_numpy(zero_copy_only=False))
        if not len(place) or not len(s):
            return _lists(len(features), [], [], [], [])
        rows, cols, dist = distances.nearest(kernels.to_matrix(features.drop_null()), s, k + exclude_self, metric)
        rows = place[rows]
        if exclude_self:
            rows, cols, dist = _without_self(rows, cols, dist, np.array(own.to_pylist(), dtype=object), ids, k)
        return _lists(len(features), rows, ids[cols], dist, labels[cols])
    return spread(left, len(ids)).withColumn("nn", once(run)(F.col("sample_id").cast("string"), F.col("features").cast("array<double>")))


def _by_few(left: DataFrame, right: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """A left side of few rows goes to the tasks, and the right side is read once where it lies: a task leaves the best of its rows."""
    need = k + int(exclude_self)
    ids, vectors, _, _ = B.collect_matrix(left.select("sample_id", "features").filter(F.col("features").isNotNull()))
    shared = left.sparkSession.sparkContext.broadcast((ids, vectors))
    label = (F.col("label") if "label" in right.columns else F.lit(None)).cast("double").alias("label")

    def run(batches):
        own, q = shared.value
        best = [np.zeros(0, int), np.zeros(0), np.zeros(0, str), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            t = pa.Table.from_batches([batch]).sort_by("id").combine_chunks()
            rows, cols, dist = distances.nearest(q, kernels.to_matrix(t["features"].combine_chunks()), need, metric)
            names, labels = np.array(t["id"].to_pylist(), dtype=str), t["label"].to_numpy().astype(np.float64)
            best = [np.concatenate(c) for c in zip(best, (rows, dist, names[cols], labels[cols]))]
            order = np.lexsort((best[2], best[1], best[0]))
            rows = best[0][order]
            order = order[np.arange(len(order)) - np.searchsorted(rows, rows, side="left") < need]
            best = [c[order] for c in best]
        rows, dist, names, labels = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[rows] if len(rows) else [], pa.string()), pa.array(names.tolist(), pa.string()), pa.array(dist), pa.array(labels, pa.float64(), from_pandas=True)],
            ["sample_id", "id", "dist", "label"])
    found = (right.select(F.col("sample_id").cast("string").alias("id"), F.col("features").cast("array<double>").alias("features"), label)
             .mapInArrow(run, "sample_id string, id string, dist double, label double"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("dist", "id", "label"))), 1, need)
    lists = found.groupBy("sample_id").agg(first.alias("nn"))
    nn = F.filter("nn", lambda r: r["id"] != F.col("sample_id")) if exclude_self else F.col("nn")
    lists = lists.select("sample_id", F.transform(F.slice(nn, 1, k), lambda r: F.struct(r["id"], r["dist"], r["label"])).cast(NN).alias("nn"))
    return left.join(lists, "sample_id", "left").withColumn("nn", F.coalesce("nn", F.array().cast(NN)))


def _by_vector(left: DataFrame, right: DataFrame, k: int, metric: str, exclude_self: bool, block_bytes: int | None) -> DataFrame:
    """``_by_blocks`` between the distinct vectors of both sides, for sides with many copies.

    Of the rows in order (distance, id), the first n lie on the first n vectors in order (distance, smallest id): a vector before
    another one has a row before all of the other's.
    """
    need = k + int(exclude_self)
    key = [F.xxhash64("features").alias("_a"), F.xxhash64(F.lit("copy"), "features").alias("_b")]
    own = left.withColumns({"_a": key[0], "_b": key[1]})
    label = (F.col("label") if "label" in right.columns else F.lit(None)).cast("double").alias("label")
    copies = (_few_copies(right, need).select(*key, F.col("sample_id").cast("string").alias("id"), label, "features").groupBy("_a", "_b")
              .agg(F.min("id").alias("sample_id"), F.any_value("features").alias("features"),
                   F.array_sort(F.collect_list(F.struct("id", "label"))).alias("copies")))
    copies = cut_lineage(copies.drop("_a", "_b"))
    vectors = cut_lineage(own.filter(F.col("features").isNotNull()).groupBy("_a", "_b").agg(F.any_value("features").alias("features"))
                          .withColumn("sample_id", F.concat_ws(":", "_a", "_b")))
    near = _by_blocks(vectors.select("sample_id", "features"), copies.select("sample_id", "features"), need, metric, False, block_bytes)
    at = near.select(F.col("sample_id").alias("_v"), F.explode("nn").alias("n")).select("_v", F.col("n.id").alias("sample_id"), F.col("n.dist").alias("dist"))
    rows = at.join(copies.select("sample_id", "copies"), "sample_id").select(
        "_v", F.transform("copies", lambda c: F.struct(F.col("dist").alias("dist"), c["id"].alias("id"), c["label"].alias("label"))).alias("c"))
    lists = rows.groupBy("_v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, need).alias("_nn"))
    nn = F.filter("_nn", lambda r: r["id"] != F.col("sample_id").cast("string")) if exclude_self else F.col("_nn")
    nn = F.transform(F.slice(nn, 1, k), lambda r: F.struct(r["id"], r["dist"], r["label"])).cast(NN)
    return (own.withColumn("_v", F.when(F.col("features").isNotNull(), F.concat_ws(":", "_a", "_b"))).join(lists, "_v", "left")
            .withColumn("nn", F.coalesce(nn, F.array().cast(NN))).drop("_v", "_a", "_b", "_nn"))


def _many_copies(df: DataFrame) -> bool:
    """Whether there are, by estimate, less than two vectors for three rows."""
    n, vectors = df.agg(F.count("features"), F.approx_count_distinct(F.xxhash64("features"), 0.03)).first()
    return 3 * vectors < 2 * n


def _few_copies(right: DataFrame, need: int) -> DataFrame:
    """The ``need`` smallest ids of every distinct vector; the row limit is applied before the shuffle as well."""
    key = [F.xxhash64("features"), F.xxhash64(F.lit("copy"), "features")]
    order = Window.partitionBy(*key).orderBy("sample_id")
    return right.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= need).drop("_n")


def _bounds(lo, hi, table) -> np.ndarray:
    """Lower bound of the distance between each left block and each right block."""
    ql, qh = kernels.to_matrix(lo), kernels.to_matrix(hi)
    out = np.zeros((len(ql), len(table["block"])))
    for j in range(ql.shape[1]):
        np.maximum(out, ql[:, j, None] - table["hi"][None, :, j], out=out)
        np.maximum(out, table["lo"][None, :, j] - qh[:, j, None], out=out)
    return out


def _id_lists(picked) -> pa.Array:
    sizes = np.array([len(p) for p in picked])
    flat = pa.array(np.concatenate(picked) if len(picked) else np.zeros(0), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _block_table(part: DataFrame) -> dict:
    t = part.select("block", "n", "lo", "hi").toArrow()
    return {"block": t["block"].to_numpy(), "n": t["n"].to_numpy(),
            "lo": kernels.to_matrix(t["lo"].combine_chunks()), "hi": kernels.to_matrix(t["hi"].combine_chunks())}


def _first_pairs(left: DataFrame, table: dict, need: int) -> DataFrame:
    """Each left block with its closest right blocks, as many as hold ``need`` rows."""
    shared = left.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<long>")
    def run(lo: pa.Array, hi: pa.Array) -> pa.Array:
        t = shared.value
        bound = _bounds(lo, hi, t)
        middle = (kernels.to_matrix(lo) + kernels.to_matrix(hi)) / 2
        picked = []
        for i in range(len(bound)):
            gap = np.abs((t["lo"] + t["hi"]) / 2 - middle[i]).mean(1)
            order = np.lexsort((t["block"], gap, bound[i]))
            enough = int(np.searchsorted(np.cumsum(t["n"][order]), need)) + 1
            picked.append(t["block"][order[:enough]])
        return _id_lists(picked)
    return (left.select(F.col("block").alias("lblock"), once(run)("lo", "hi").alias("_r"))
            .select("lblock", F.explode("_r").alias("rblock")))


def _close_pairs(left: DataFrame, table: dict) -> DataFrame:
    """Pairs of a left block with every right block that may hold a neighbour of at least one of its rows.

    A row needs a block only if its distance bound does not exceed ``reach``, the k-th distance the row has found so far.
    The intervals of whole blocks are compared first, the rows only with the blocks that are left.
    """
    shared = left.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<long>")
    def run(lo: pa.Array, hi: pa.Array, places: pa.Array, reach: pa.Array) -> pa.Array:
        t = shared.value
        bound = _bounds(lo, hi, t)
        flat, offsets = kernels.split_lists(reach)
        picked = []
        for i in range(len(bound)):
            limit = flat[offsets[i]:offsets[i + 1]] * (1 + 1e-9) + 1e-12
            near = np.flatnonzero(bound[i] <= limit.max())
            p = B.vectors_of(places[i], len(limit))
            keep = np.zeros(len(near), dtype=bool)
            for part in distances.chunks(len(near), len(limit)):
                some = near[part]
                gap = np.zeros((len(some), len(limit)))
                for j in range(p.shape[1]):
                    np.maximum(gap, p[None, :, j] - t["hi"][some, j, None], out=gap)
                    np.maximum(gap, t["lo"][some, j, None] - p[None, :, j], out=gap)
                keep[part] = (gap <= limit[None, :]).any(1)
            picked.append(t["block"][near[keep]])
        return _id_lists(picked)
    return (left.select(F.col("block").alias("lblock"), once(run)("lo", "hi", "places", "reach").alias("_r"))
            .select("lblock", F.explode("_r").alias("rblock")))


def _by_blocks(left: DataFrame, right: DataFrame, k: int, metric: str, exclude_self: bool,
               block_bytes: int | None) -> DataFrame:
    need = k + int(exclude_self)
    valid = left.filter(F.col("features").isNotNull())
    right = cut_lineage(_few_copies(right, need))
    if right.isEmpty():
        return left.withColumn("nn", F.array().cast(NN))
    pivots = B.pick_pivots(right, metric)
    rblocks, lblocks = (in_groups(B.pack(side, pivots, metric, block_bytes)) for side in (right, valid))

    def edge(best, name):
        return F.array(*[best(F.get(name, F.lit(i))) for i in range(len(pivots))]).alias(name)
    groups = cut_lineage(rblocks.groupBy(F.col("group").alias("block")).agg(F.sum("n").alias("n"), edge(F.min, "lo"), edge(F.max, "hi")))

    # The table of group intervals goes to the tasks in parts of bounded size.
    per_group = (2 * len(pivots) + 2) * 8
    parts = max(1, math.ceil(groups.count() * per_group / BROADCAST_BYTES))

    def table(i):
        return _block_table(groups.filter(F.pmod(F.xxhash64("block"), F.lit(parts)) == i))

    def prepare(held):
        """The right blocks of a tile in runs of at least ``RUN_ROWS`` rows: (first row, vectors, lo, hi); and all ids and labels."""
        runs, run, at, first = [], [], 0, 0
        for n, r in enumerate(held):
            run.append(r)
            at += r["n"].as_py()
            if at - first >= RUN_ROWS or n == len(held) - 1:
                vectors = np.concatenate([B.vectors_of(x["data"], x["n"].as_py()) for x in run])
                runs.append((first, distances.Side(vectors, metric),
                             np.min([B.numbers_of(x["lo"]) for x in run], axis=0), np.max([B.numbers_of(x["hi"]) for x in run], axis=0)))
                run, first = [], at
        return (runs, pa.chunked_array([r["ids"].values for r in held], pa.string()).combine_chunks(),
                pa.chunked_array([r["labels"].values for r in held], pa.float64()).combine_chunks())

    def evaluate(row, ready):
        """The best of each left row among the right blocks of a tile, nearest blocks first."""
        runs, ids, labels = ready
        q, p = B.vectors_of(row["data"], row["n"].as_py()), B.vectors_of(row["places"], row["n"].as_py())
        limit = np.full(len(q), np.inf)
        if "reach" in row:
            limit = B.numbers_of(row["reach"]) * (1 + 1e-9) + 1e-12
        gaps = [np.maximum(p - hi, lo - p).max(1) for _, _, lo, hi in runs]
        best, found = np.full((len(q), need), np.inf), []
        for n in np.argsort([g.min() for g in gaps], kind="stable"):
            # Only rows that this run may improve, and of those only what is no farther than they have found.
            at = np.flatnonzero(gaps[n] <= limit)
            if not len(at):
                continue
            rows, cols, dist = distances.nearest(q[at], runs[n][1], need, metric, limit[at])
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            rows = at[rows]
            wider = np.full((len(q), need), np.inf)
            wider[rows, rank] = dist
            best = np.partition(np.concatenate([best, wider], axis=1), need - 1, axis=1)[:, :need]
            limit = np.minimum(limit, best.max(1) * (1 + 1e-9) + 1e-12)
            found.append((rows, dist, cols + runs[n][0]))
        if found:
            rows, dist, cols = (np.concatenate(c) for c in zip(*found))
            keep = dist <= limit[rows]
            rows, dist, cols = rows[keep], dist[keep], cols[keep]
        else:
            rows, dist, cols = (np.zeros(0, t) for t in (int, float, int))
        at = pa.array(cols, pa.int64())
        ids, labels = ids.take(at), labels.take(at)
        order = np.lexsort((np.array(ids.to_pylist(), dtype=str), dist, rows)) if len(rows) else np.zeros(0, int)
        order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left") < need]
        pick = pa.array(order, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(order), row["block"].as_py(), dtype=np.int64)),
             row["ids"].values.take(pa.array(rows[order], pa.int64())), ids.take(pick), pa.array(dist[order], pa.float64()), labels.take(pick)],
            ["lblock", "sample_id", "id", "dist", "label"])

    order = Window.partitionBy("sample_id").orderBy("dist", "id")
    start = table(0)
    right_columns = ["ids", "labels", "data", "lo", "hi"]

    def met(blocks, pairs, *more):
        return meet(blocks, rblocks, ROWS, evaluate, ["ids", "data", "places", *more], right_columns, pairs.withColumnRenamed("rblock", "rgroup"), prepare)
    first = cut_lineage(_first_pairs(lblocks, start, need))
    near = cut_lineage(met(lblocks, first))
    kth = (near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= need)
           .groupBy("lblock", "sample_id").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("c"))
           .withColumn("d", F.when(F.col("c") < need, float("inf")).otherwise(F.col("d")))
           .groupBy(F.col("lblock").alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("sample_id", "d"))).alias("_rows"))
           .select("block", F.col("_rows.d").alias("reach")))
    reached = lblocks.join(cut_lineage(kth), "block")
    more = None
    for i in range(parts):
        pairs = _close_pairs(reached, start if i == 0 else table(i))
        more = pairs if more is None else more.unionByName(pairs)
    more = cut_lineage(more.join(first, ["lblock", "rblock"], "left_anti"))
    found = near if more.isEmpty() else near.unionByName(met(reached, more, "reach"))
    if exclude_self:
        found = found.filter(F.col("id") != F.col("sample_id"))
    best = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    lists = best.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("dist", "id", "label"))).alias("nn"))
    lists = lists.select("sample_id", F.transform("nn", lambda r: F.struct(r["id"], r["dist"], r["label"])).alias("nn"))
    return left.join(lists, "sample_id", "left").withColumn("nn", F.coalesce("nn", F.array().cast(NN)))


def knn_lists(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True,
              strategy: str = "auto", block_bytes: int | None = None) -> DataFrame:
    """``left`` plus ``nn``: its k nearest rows of ``right`` as (id, dist, label), by distance, then id.

    Both sides have a unique text ``sample_id`` and ``features``; ``label`` of the right side is carried if present. A row without
    a vector has no neighbours and is none; an empty right side gives empty lists. ``strategy="few"`` is for a left side that fits
    a broadcast and a right side that does not.
    """
    right = right.filter(F.col("features").isNotNull())
    if strategy == "auto":
        strategy = "broadcast" if B.fits(*B.shape(right)) else "blocks"
    if strategy == "broadcast":
        return _by_broadcast(left, right, k, metric, exclude_self)
    if strategy == "few":
        return _by_few(left, right, k, metric, exclude_self)
    if _many_copies(left) or _many_copies(right):
        return _by_vector(left, right, k, metric, exclude_self, block_bytes)
    return _by_blocks(left, right, k, metric, exclude_self, block_bytes)


def knn_join(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True,
             strategy: str = "auto", block_bytes: int | None = None) -> DataFrame:
    """Rows (src, dst, rank, dist) of the k-nearest-neighbour join."""
    lists = knn_lists(left, right, k, metric, exclude_self, strategy, block_bytes)
    return (lists.select("sample_id", F.posexplode("nn").alias("at", "n"))
            .select(F.col("sample_id").alias("src"), F.col("n.id").alias("dst"), (F.col("at") + 1).alias("rank"),
                    F.col("n.dist").alias("dist")))


def bounded_neighbourhood(n_rows: int, top: int = 30, divisor: int | None = None) -> int | None:
    """Neighbourhood size lowered to what ``n_rows`` allow: n - 1, or n // divisor. None when nothing can be projected."""
    if n_rows <= 1:
        return None
    return max(1, min(top, n_rows - 1 if divisor is None else n_rows // divisor))


def neighbour_graph(df: DataFrame, k: int, metric: str = "euclidean", n_rows: int | None = None,
                    divisor: int | None = None) -> DataFrame:
    """Directed neighbourhood graph; ``k`` is lowered to what the number of rows allows. One row or none: no edge."""
    k = bounded_neighbourhood(B.shape(df)[0] if n_rows is None else n_rows, k, divisor)
    return knn_join(df, df, k or 1, metric)


def at_most(graph: DataFrame, k: int) -> DataFrame:
    """The graph of a smaller k, without another join."""
    return graph.filter(F.col("rank") <= k)


def vote(nn: Column, classes=(0, 1), weights: str = "distance") -> Column:
    """Array of class weights: counts, or inverse distances where exact matches outvote everything else."""
    exact = F.exists(nn, lambda x: x["dist"] == 0)

    def weight(x):
        if weights == "uniform":
            return F.lit(1.0)
        return F.when(exact, (x["dist"] == 0).cast("double")).otherwise(1.0 / x["dist"])

    def total(c):
        return F.aggregate(nn, F.lit(0.0), lambda acc, x: acc + F.when(x["label"] == c, weight(x)).otherwise(0.0))
    return F.array(*[total(float(c)) for c in classes])


def knn_classify(test: DataFrame, train: DataFrame, k: int = 5, classes=(0, 1), weights: str = "distance",
                 metric: str = "euclidean", strategy: str = "auto") -> DataFrame:
    """Test rows with ``prediction`` and class shares in ``probability``; ties go to the smaller class."""
    out = knn_lists(test, train, k, metric, exclude_self=False, strategy=strategy)
    out = out.withColumn("_v", vote(F.col("nn"), classes, weights)).drop("nn")
    total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("_v", F.array_max("_v")).cast("int")
    return (out.withColumn("_s", total)
            .withColumns({"prediction": F.get(F.array(*[F.lit(float(c)) for c in classes]), best - 1),
                          "probability": F.transform("_v", lambda v: F.try_divide(v, F.col("_s")))})
            .drop("_v", "_s"))
