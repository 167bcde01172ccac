"""Second-order boosting: trees grown from histograms of gradients and hessians that Spark sums.

Values are cut into at most ``bins`` ranges per feature at quantiles over all rows, and stored once as a byte each. A level of all
trees of a round is one job: an Arrow batch adds its rows' gradient, hessian and count to the bins of their nodes, Spark sums these
vectors per (tree, node, stretch of features), the best cut of a vector is found where it lies, and the driver sees one cut per node.

A missing value (NaN or a NULL inside a vector) goes right. Rows without a vector or label are left out of a fit and get a NULL prediction.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators import blocks as B
from peakforge.operators.resample import class_sizes
from peakforge.schema import DOUBLES
from peakforge.session import cut_lineage, once, require_small

# Doubles in one vector of sums: with three sums a bin, so many features of a node travel together.
STRETCH = 48 * 1024
# Rounds after which the margins of all rows are stored again.
KEEP = 10
LEAST_GAIN = 1e-6
SUMS = "tree int, node int, first int, sums array<double>"
BEST = "tree int, node int, rank double, gain double, feature int, cut int, gl double, hl double, nl double, g double, h double, n double"
SPLITS = ("round int, class int, node int, feature int, cut double, left int, right int, gain double, gradient double, hessian double, "
          "rows double, value double")


@dataclass
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 at a leaf. A row goes left if its value is at most the cut."""
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    sums: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        for column, empty in zip((self.feature, self.bin, self.cut, self.left, self.right, self.gain, self.sums, self.value),
                                 (-1, 0, 0.0, 0, 0, 0.0, (0.0, 0.0, 0.0), 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def leaf_of(self, x: np.ndarray, cuts: list) -> np.ndarray:
        """Node of every row; ``cuts`` are ``self.bin`` for rows of bins and ``self.cut`` for rows of values."""
        node, feature, cut = np.zeros(len(x), np.int64), np.array(self.feature), np.array(cuts)
        left, right, rows = np.array(self.left), np.array(self.right), np.arange(len(x))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            f = np.where(inner, feature[node], 0)
            node = np.where(inner, np.where(x[rows, f] <= cut[node], left[node], right[node]), node)


@dataclass
class Boosted:
    """Fitted rounds, one tree per margin; ``start`` are the margins before the first."""
    classes: list
    start: np.ndarray
    rounds: list

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += np.array(tree.value)[tree.leaf_of(x, tree.cut)]
        return out

    def probability(self) -> Column:
        """Probabilities of ``classes`` in order, NULL without a vector."""
        @F.arrow_udf(DOUBLES)
        def run(features: pa.Array) -> pa.Array:
            has = np.array(features.is_valid())
            rows = iter(chances(self.margins(_values(features.drop_null())))) if has.any() else iter(())
            return kernels.from_rows([next(rows) if known else None for known in has])
        return once(run)(F.col("features").cast("array<double>"))

    def splits(self, spark: SparkSession) -> DataFrame:
        """Nodes as rows: inner nodes with feature and cut (a value at most the cut goes left), leaves with feature -1."""
        rows = [(r, c, i, t.feature[i], float(t.cut[i]), t.left[i], t.right[i], float(t.gain[i]), *[float(v) for v in t.sums[i]],
                 float(t.value[i])) for r, trees in enumerate(self.rounds) for c, t in enumerate(trees) for i in range(len(t.feature))]
        return spark.createDataFrame(rows, SPLITS)


def _values(features: pa.Array) -> np.ndarray:
    flat = np.asarray(features.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(features), -1)


def chances(margins: np.ndarray) -> np.ndarray:
    """One margin is the log odds of the second of two classes; several are shares of their exponentials."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return np.hstack([1.0 - p, p])
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def quantile_cuts(df: DataFrame, bins: int, width: int) -> list[np.ndarray]:
    """Inner borders of at most ``bins`` ranges per feature, from mergeable quantile summaries over all rows."""
    require_small(width * bins, "borders of bins")
    at = [i / bins for i in range(1, bins)]
    rows = (df.select(F.posexplode(F.col("features").cast("array<double>")).alias("feature", "v")).filter(~F.isnan("v"))
            .groupBy("feature").agg(F.percentile_approx("v", at, 40 * bins).alias("cuts"), F.max("v").alias("most")).collect())
    out = [np.zeros(0)] * width
    for r in rows:
        cuts = np.unique(r["cuts"])
        out[r["feature"]] = cuts[cuts < r["most"]]
    return out


def _draw(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per key and salt."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64(salt % 2 ** 64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def _stored(train: DataFrame, cuts: list[np.ndarray], classes: list, start: np.ndarray) -> DataFrame:
    """Rows as one byte per feature, with their class number and margins."""
    @F.arrow_udf("binary")
    def place(features: pa.Array) -> pa.Array:
        x = _values(features)
        out = np.zeros(x.shape, np.uint8)
        for f, borders in enumerate(cuts):
            out[:, f] = np.searchsorted(borders, x[:, f], side="left")
        return pa.array([row.tobytes() for row in out], pa.binary())

    key = "row_id" if "row_id" in train.columns else "sample_id"
    number = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col("label").cast("double")).cast("int") - 1
    return cut_lineage(train.select(F.xxhash64(key).alias("key"), once(place)(F.col("features").cast("array<double>")).alias("bins"),
                                    number.alias("y"), F.array(*[F.lit(float(v)) for v in start]).alias("margin")))


def _now(batch: pa.RecordBatch, width: int, pending: list) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a batch and its margins after the rounds that are not stored yet."""
    x = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(batch.num_rows, width)
    margin = _values(batch["margin"]).copy()
    for trees in pending:
        for c, tree in enumerate(trees):
            margin[:, c] += np.array(tree.value)[tree.leaf_of(x, tree.bin)]
    return x, margin


def _advance(state: DataFrame, width: int, pending: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("margin")
                yield batch.set_column(at, "margin", kernels.from_matrix(_now(batch, width, pending)[1]))
    return cut_lineage(state.mapInArrow(run, state.schema))


def _level(state: DataFrame, width: int, size: int, pending: list, trees: list[Tree], open_nodes: list[list[int]], drawn: list,
           draw: tuple, curvature: float, rules: tuple) -> list:
    """Best cut of every open node of every tree of the round."""
    share, salt = draw
    penalty, least_rows, least_hessian = rules
    per = max(1, STRETCH // (3 * size))

    def add_up(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margin = _now(batch, width, pending)
            p, y = chances(margin), batch["y"].to_numpy(zero_copy_only=False)
            chosen = _draw(batch["key"].to_numpy(), salt) < share if share < 1 else np.ones(len(x), bool)
            for c, tree in enumerate(trees):
                of = 1 if len(trees) == 1 else c
                node = tree.leaf_of(x, tree.bin)
                g, h = p[:, of] - (y == of), curvature * p[:, of] * (1 - p[:, of])
                for wanted in open_nodes[c]:
                    rows = np.flatnonzero(chosen & (node == wanted))
                    if not len(rows):
                        continue
                    for first in range(0, len(drawn[c]), per):
                        columns = drawn[c][first:first + per]
                        m = len(columns)
                        at = (x[np.ix_(rows, columns)].astype(np.int64) + np.arange(m) * size).ravel()
                        sums = [np.bincount(at, weights=np.repeat(w, m), minlength=m * size) for w in (g[rows], h[rows])]
                        sums.append(np.bincount(at, minlength=m * size).astype(np.float64))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([c], pa.int32()), pa.array([wanted], pa.int32()), pa.array([first], pa.int32()),
                            kernels.from_matrix(np.concatenate(sums)[None, :])], names=["tree", "node", "first", "sums"])

    def best(batches):
        for batch in batches:
            for c, node, first, sums in zip(*[batch[name].to_pylist() for name in ("tree", "node", "first")], batch["sums"]):
                left = np.cumsum(sums.values.to_numpy().reshape(3, -1, size), axis=2)
                total = left[:, :1, -1:]
                g, h, n = left
                right = total - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = g ** 2 / (h + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
                fair = (np.minimum(np.round(n), np.round(right[2])) >= max(1, least_rows)) & (np.minimum(h, right[1]) >= least_hessian)
                gain = np.where(fair & np.isfinite(gain), gain, -np.inf)
                # Equal cuts of several features differ in the last bits only; the first of them counts.
                rank = gain.astype(np.float32)
                f, b = np.unravel_index(int(np.argmax(rank)), rank.shape)
                row = [c, node, float(rank[f, b]), float(gain[f, b]), int(drawn[c][first + f]), int(b), g[f, b], h[f, b], n[f, b],
                       *total[:, 0, 0]]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(
                    row, [pa.int32()] * 2 + [pa.float64()] * 2 + [pa.int32()] * 2 + [pa.float64()] * 6)],
                    names=[part.split()[0] for part in BEST.split(", ")])

    summed = (state.mapInArrow(add_up, SUMS).groupBy("tree", "node", "first")
              .agg(Summarizer.sum(array_to_vector("sums")).alias("v")).select("tree", "node", "first", vector_to_array("v").alias("sums")))
    order = F.struct("rank", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("b"))
    found = summed.mapInArrow(best, BEST)
    return found.groupBy("tree", "node").agg(F.max_by(F.struct(*found.columns[3:]), order).alias("s")).select("tree", "node", "s.*").collect()


def best_first(tree: Tree, leaves: int) -> None:
    """Keep the splits that always splitting the leaf of highest gain would make, up to ``leaves`` leaves."""
    kept, heap = set(), [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    while heap and len(kept) < leaves - 1:
        _, i = heapq.heappop(heap)
        kept.add(i)
        for child in (tree.left[i], tree.right[i]):
            if tree.feature[child] >= 0:
                heapq.heappush(heap, (-tree.gain[child], child))
    for i in range(len(tree.feature)):
        if i not in kept:
            tree.feature[i] = -1


def fit(train: DataFrame, trees: int, depth: int, rate: float = 0.1, penalty: float = 1.0, least_gain: float = 0.0, least_rows: int = 1,
        least_hessian: float = 1.0, subsample: float = 1.0, columns: float = 1.0, leaves: int | None = None, average_start: bool = False,
        multi_curvature: float | None = None, bins: int = 256, cuts=None, seed: int = 42) -> Boosted:
    """``trees`` rounds of logistic (two classes) or softmax (more) boosting; every round grows one tree per margin, level by level.

    A leaf is worth ``-rate * G / (H + penalty)``; a cut must gain more than ``least_gain`` and leave ``least_rows`` rows and
    ``least_hessian`` on both sides. A round sees a ``subsample`` of the rows, a tree a share ``columns`` of the features. With ``leaves``
    the tree keeps what leaf-wise growth to that many leaves gives within ``depth`` levels. ``cuts`` replaces the quantiles by
    given borders for every feature. An equal gain goes to the smaller feature, then the smaller cut. A single class gives no rounds.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    train = train.filter(F.col("features").isNotNull() & F.col("label").isNotNull())
    sizes = class_sizes(train)
    classes, width = sorted(sizes), B.shape(train)[1]
    k = 1 if len(classes) <= 2 else len(classes)
    shares = [sizes[c] / sum(sizes.values()) for c in classes]
    start = np.zeros(k)
    if average_start and len(classes) > 1:
        start = np.array([math.log(shares[1] / shares[0])] if k == 1 else [math.log(s) for s in shares])
    if len(classes) < 2:
        return Boosted(classes, start, [])
    borders = quantile_cuts(train, bins, width) if cuts is None else [np.unique(np.asarray(cuts, float))] * width
    size = max(len(b) for b in borders) + 1
    if size > 256:
        raise ValueError("more than 255 borders")
    state = _stored(train, borders, classes, start)
    curvature = 1.0 if k == 1 else (2.0 if multi_curvature is None else multi_curvature)
    rounds, pending = [], []

    for r in range(trees):
        grown, drawn, level = [Tree() for _ in range(k)], [], 0
        open_nodes = [[t.add()] for t in grown]
        for c in range(k):
            rng = np.random.default_rng([seed, r, c])
            drawn.append(np.sort(rng.choice(width, max(1, int(columns * width)), replace=False)) if columns < 1 else np.arange(width))
        while level < depth and any(open_nodes):
            found = _level(state, width, size, pending, grown, open_nodes, drawn, (subsample, (seed << 32) + r + 1), curvature,
                           (penalty, least_rows, least_hessian))
            open_nodes, level = [[] for _ in range(k)], level + 1
            for s in sorted(found, key=lambda s: (s["tree"], s["node"])):
                tree, i = grown[s["tree"]], s["node"]
                total, low = (s["g"], s["h"], s["n"]), (s["gl"], s["hl"], s["nl"])
                if i == 0:
                    tree.sums[0] = total
                if not s["gain"] > max(LEAST_GAIN, least_gain):
                    continue
                tree.feature[i], tree.bin[i], tree.gain[i] = s["feature"], s["cut"], s["gain"]
                tree.cut[i] = float(borders[s["feature"]][s["cut"]])
                tree.left[i], tree.right[i] = tree.add(), tree.add()
                tree.sums[tree.left[i]], tree.sums[tree.right[i]] = low, tuple(t - v for t, v in zip(total, low))
                open_nodes[s["tree"]] += [tree.left[i], tree.right[i]]
        for tree in grown:
            if leaves:
                best_first(tree, leaves)
            tree.value = [-rate * g / (h + penalty) if h + penalty > 0 else 0.0 for g, h, _ in tree.sums]
        rounds.append(grown)
        pending.append(grown)
        if len(pending) == KEEP and r + 1 < trees:
            state, pending = _advance(state, width, pending), []
    return Boosted(classes, start, rounds)
