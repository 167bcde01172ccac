"""Mean silhouette of labelled points on plain Euclidean distances.

The value needs the distance of every point to every class, so the exact form looks at all pairs of blocks, on a grid of tiles;
a tile gives each of its points one row of per-class sums and never emits a pair of points. Copies are merged into weighted points first. The fast
form is the built-in evaluator on squared distances, linear in the rows, and not the same number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import distances, kernels
from peakforge.operators import blocks as B
from peakforge.operators.tiles import in_groups, meet
from peakforge.schema import DOUBLES
from peakforge.session import cut_lineage, once, spread

# Sums of a vector (a class of a value of the keys each) that are made at once.
COLUMNS_AT_ONCE = 64


def _weighted(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.xxhash64("features").alias("_a"), F.xxhash64(F.lit("copy"), "features").alias("_b"), "label")
            .agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("sample_id").alias("sample_id"),
                 F.any_value("features").alias("features")).drop("_a", "_b"))


def _class_sums(s, labels, weights, classes, metric) -> distances.Sums:
    return distances.Sums(s, (labels[:, None] == np.asarray(classes, dtype=np.float64)[None, :]) * weights[:, None], metric)


def distance_sums(df: DataFrame, classes, metric: str = "euclidean", strategy: str = "auto",
                  block_bytes: int | None = None) -> DataFrame:
    """(sample_id, label, sums): total distance of every point to each class."""
    right = _weighted(df)
    if strategy == "auto":
        strategy = "broadcast" if B.fits(*B.shape(right)) else "blocks"
    if strategy == "broadcast":
        _, vectors, labels, weights = B.collect_matrix(right)
        shared = df.sparkSession.sparkContext.broadcast((vectors, labels, weights))

        @F.arrow_udf(DOUBLES)
        def run(features: pa.Array) -> pa.Array:
            return kernels.from_matrix(_class_sums(*shared.value, classes, metric).of(kernels.to_matrix(features)))
        return spread(df.select("sample_id", "label", "features"), len(vectors)).select("sample_id", "label", once(run)("features").alias("sums"))

    pivots = B.pick_pivots(right, metric)
    lblocks, rblocks = (in_groups(B.pack(side, pivots, metric, block_bytes)) for side in (df, right))

    def prepare(held):
        return _class_sums(np.concatenate([B.vectors_of(r["data"], r["n"].as_py()) for r in held]),
                           *(np.concatenate([B.numbers_of(r[c]) for r in held]) for c in ("labels", "weights")), classes, metric)

    def evaluate(row, sums):
        return pa.RecordBatch.from_arrays(
            [row["ids"].values, row["labels"].values, kernels.from_matrix(sums.of(B.vectors_of(row["data"], row["n"].as_py())))],
            ["sample_id", "label", "sums"])
    parts = meet(lblocks, rblocks, "sample_id string, label double, sums array<double>", evaluate,
                 ["ids", "labels", "data"], ["labels", "weights", "data"], prepare=prepare)
    summed = parts.groupBy("sample_id", "label").agg(
        *[F.sum(F.get("sums", F.lit(i))).alias(f"_s{i}") for i in range(len(classes))])
    return summed.select("sample_id", "label", F.array(*[f"_s{i}" for i in range(len(classes))]).alias("sums"))


def silhouette_samples(df: DataFrame, metric: str = "euclidean", strategy: str = "auto",
                       block_bytes: int | None = None) -> DataFrame:
    """(sample_id, label, silhouette); points alone in their class get 0, a single class gives NaN.

    Rows without a vector or a label are no points and get no row.
    """
    df = df.filter(F.col("features").isNotNull() & F.col("label").isNotNull())
    counts = {float(r["label"]): r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts)
    if len(classes) < 2:
        return df.select("sample_id", "label", F.lit(float("nan")).alias("silhouette"))
    sums = distance_sums(df, classes, metric, strategy, block_bytes)
    label = F.col("label").cast("double")
    own = own_n = None
    others = []
    for i, c in enumerate(classes):
        s = F.get("sums", F.lit(i))
        own = (F.when if own is None else own.when)(label == c, s)
        own_n = (F.when if own_n is None else own_n.when)(label == c, F.lit(counts[c]))
        others.append(F.when(label != c, s / F.lit(counts[c])))
    out = sums.withColumns({"_a": F.when(own_n > 1, own / (own_n - 1)), "_b": F.least(*others)})
    value = F.when(F.col("_a").isNull() | (F.greatest("_a", "_b") == 0), 0.0).otherwise(
        (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return out.select("sample_id", "label", value.alias("silhouette"))


def _sums_to(points: DataFrame, metric: str, block_bytes: int | None = None) -> DataFrame:
    """(sample_id, sums) of (sample_id, features, weights): the distances to all points, added up once per position of ``weights``."""
    n, d = B.shape(points)
    m = points.select(F.size("weights")).first()[0] if n else 0
    if B.fits(n, d + m):
        table = points.select("features", "weights").toArrow().combine_chunks()  # a checked size
        shared = points.sparkSession.sparkContext.broadcast(tuple(kernels.to_matrix(table[c].chunk(0)) for c in ("features", "weights")) if n else None)

        @F.arrow_udf(DOUBLES)
        def run(features: pa.Array) -> pa.Array:
            return kernels.from_matrix(distances.Sums(*shared.value, metric).of(kernels.to_matrix(features)))
        return spread(points.select("sample_id", F.col("features").cast("array<double>").alias("features")), n).select(
            "sample_id", once(run)("features").alias("sums"))
    pivots = B.pick_pivots(points, metric)
    blocks = in_groups(B.pack(points, pivots, metric, block_bytes))

    def prepare(held):
        weights = [B.numbers_of(r["weights"]).reshape(r["n"].as_py(), -1) for r in held]
        return distances.Sums(np.concatenate([B.vectors_of(r["data"], r["n"].as_py()) for r in held]), np.concatenate(weights), metric)

    def evaluate(row, sums):
        return pa.RecordBatch.from_arrays(
            [row["ids"].values, kernels.from_matrix(sums.of(B.vectors_of(row["data"], row["n"].as_py())))], ["sample_id", "sums"])
    parts = meet(blocks, blocks, "sample_id string, sums array<double>", evaluate, ["ids", "data"], ["weights", "data"], prepare=prepare)
    return parts.groupBy("sample_id").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(m)]).alias("sums"))


def _shared_silhouettes(df: DataFrame, rest: list[str], metric: str, block_bytes: int | None = None) -> DataFrame:
    """(rest, ``n``, ``silhouette``): for every value of ``rest``, whose points may be the same vectors under other labels.

    The distance of two vectors is computed once for all values: a vector carries how many points of every (value, class) lie on it.
    """
    sizes: dict[tuple, dict] = {}
    for r in df.groupBy(*rest, "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(tuple(r[k] for k in rest), {})[r["label"]] = r["n"]
    out, values = None, sorted(sizes, key=str)
    while values:
        some = [values.pop()]
        while values and sum(len(sizes[v]) for v in [*some, values[-1]]) <= COLUMNS_AT_ONCE:
            some.append(values.pop())
        columns = [(v, c) for v in some for c in sizes[v]]

        def is_value(v):
            own = F.lit(True)
            for k, x in zip(rest, v):
                own = own & F.col(k).eqNullSafe(F.lit(x))
            return own
        counts = F.array(*[F.count_if(is_value(v) & (F.col("label") == c)).cast("double") for v, c in columns])
        points = cut_lineage(df.groupBy(F.xxhash64("features").alias("_a"), F.xxhash64(F.lit("copy"), "features").alias("_b"))
                             .agg(F.any_value("features").cast("array<double>").alias("features"), counts.alias("weights"))
                             .select(F.concat_ws(":", "_a", "_b").alias("sample_id"), "features", "weights"))
        scored = _sums_to(points, metric, block_bytes).join(points.select("sample_id", "weights"), "sample_id")
        totals = []
        for v in some:
            mean = {c: F.get("sums", F.lit(columns.index((v, c)))) for c in sizes[v]}
            total = F.lit(0.0) if len(sizes[v]) > 1 else F.lit(float("nan"))
            for c, n in sizes[v].items():
                if len(sizes[v]) == 1 or n == 1:  # no other class; alone: 0
                    continue
                a = mean[c] / (n - 1)
                b = F.array_min(F.array(*[mean[o] / m for o, m in sizes[v].items() if o != c]))
                one = F.when(F.greatest(a, b) == 0, 0.0).otherwise((b - a) / F.greatest(a, b))
                # a vector without a point of the class has no say, whatever its value is
                held = F.get("weights", F.lit(columns.index((v, c))))
                total = total + F.when(held > 0, held * one).otherwise(0.0)
            totals.append(F.sum(total) / sum(sizes[v].values()))
        kinds = df.schema
        rows = F.array(*[F.struct(*[F.lit(x).cast(kinds[k].dataType).alias(k) for k, x in zip(rest, v)],
                                  F.lit(sum(sizes[v].values())).cast("long").alias("n"), s.alias("silhouette")) for v, s in zip(some, totals)])
        one = scored.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out


def silhouette_by(df: DataFrame, keys: list[str], metric: str = "euclidean", shared: list[str] | None = None, **options) -> DataFrame:
    """(keys, ``n``, ``silhouette``): the mean silhouette of the points of every value of ``keys``, vectors of equal length per value.

    All values are scored in one pass while their points together can be broadcast. Beyond that the values of the columns ``shared``
    (``keys`` without it) follow one another, and what has the same value there shares its distances: name columns that fix a point's
    vector. One class only: NaN.
    """
    df = df.filter(F.col("features").isNotNull() & F.col("label").isNotNull())
    n, d = B.shape(df)
    if not B.fits(n, d):
        shared = keys if shared is None else shared
        rest = [k for k in keys if k not in shared]
        df = cut_lineage(df.select(*dict.fromkeys([*shared, *keys]), "sample_id", "label", "features"))  # read several times per value
        out = None
        for point in [tuple(r) for r in df.select(*shared).distinct().orderBy(*shared).collect()]:
            own = F.lit(True)
            for k, v in zip(shared, point):
                own = own & F.col(k).eqNullSafe(F.lit(v))
            one = _shared_silhouettes(df.filter(own), rest, metric, **options)
            one = one.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in zip(shared, point)}).select(*keys, "n", "silhouette")
            out = one if out is None else out.unionByName(one)
        return out
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    slim = df.select(key.alias("key"), F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features"))
    sides = {}
    table = slim.toArrow().sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()  # a checked size
    names, first = np.unique(np.array(table["key"].to_pylist(), dtype=str), return_index=True)
    for name, a, b in zip(names, first, [*first[1:], table.num_rows]):
        part = table.slice(a, b - a).combine_chunks()
        labels = part["label"].to_numpy()
        vectors = kernels.to_matrix(part["features"].chunk(0))
        sides[str(name)] = (vectors, labels, np.unique(labels))
    shared = df.sparkSession.sparkContext.broadcast(sides)

    @F.arrow_udf("double")
    def run(keys: pa.Array, label: pa.Array, features: pa.Array) -> pa.Array:
        own, mine = np.array(keys.to_pylist(), dtype=str), label.to_numpy(zero_copy_only=False)
        out = np.full(len(own), np.nan)
        for name in np.unique(own):
            at = np.flatnonzero(own == name)
            vectors, labels, classes = shared.value[str(name)]
            if len(classes) < 2:
                continue
            sums = _class_sums(vectors, labels, np.ones(len(labels)), classes, metric).of(kernels.to_matrix(features.take(pa.array(at))))
            sizes = (labels[:, None] == classes).sum(0)
            inside = mine[at][:, None] == classes
            alone = sizes[inside.argmax(1)] < 2
            a = (sums * inside).sum(1) / np.maximum(sizes[inside.argmax(1)] - 1, 1)
            b = np.where(inside, np.inf, sums / sizes).min(1)
            top = np.maximum(a, b)
            out[at] = np.where(alone | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
        return pa.array(out)
    scored = spread(df.select(*keys, "label", "features"), n).select(*keys, once(run)(key, F.col("label").cast("double"), F.col("features").cast("array<double>")).alias("s"))
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def silhouette(df: DataFrame, exact: bool = True, **options) -> DataFrame:
    """One row with the mean silhouette. ``exact=False`` uses squared distances (linear time, another value)."""
    if exact:
        return silhouette_samples(df, **options).agg(F.avg("silhouette").alias("silhouette"))
    ready = df.select(array_to_vector("features").alias("v"), F.col("label").cast("double").alias("c"))
    score = ClusteringEvaluator(featuresCol="v", predictionCol="c").evaluate(ready)
    return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")
