"""Classifiers on (sample_id, features, label): fit, then predict as a DataFrame.

Nearly all are ``pyspark.ml`` learners. The neighbour vote is the neighbour join, AdaBoost is a loop of weighted stumps,
and the kernel machine is a map of its kernel followed by a linear separator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators import blocks as B, boosting
from peakforge.operators.kernel_map import gamma_of, kernel_map
from peakforge.operators.neighbours import knn_classify
from peakforge.operators.resample import class_sizes
from peakforge.schema import DOUBLES
from peakforge.session import cut_lineage, once, require_small

VECTOR = "_v"


@dataclass
class Fitted:
    """A fitted classifier: ``predict`` adds ``prediction`` and, where the learner has one, ``probability`` (array)."""
    name: str
    predict: Callable[[DataFrame], DataFrame]
    model: object = None


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn(VECTOR, array_to_vector(F.col("features").cast("array<double>")))


def _ml(name: str, estimator, train: DataFrame, prepare=lambda df: df, weight: str | None = None) -> Fitted:
    ready = with_vector(prepare(train)).withColumn("label", F.col("label").cast("double"))
    model = estimator.fit(ready.select(VECTOR, "label", *([weight] if weight else [])))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(with_vector(prepare(df)).drop("prediction", "probability", "rawPrediction"))
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        kept = [c for c in df.columns if c not in ("prediction", "probability")]
        return out.select(*[F.col(c) for c in kept if c != "features"], F.col("prediction"),
                          *([F.col("probability")] if "probability" in out.columns else []))
    return Fitted(name, predict, model)


def _cols(**extra):
    return dict(featuresCol=VECTOR, labelCol="label", **extra)


def logistic(train: DataFrame, C: float = 1000.0, max_iter: int = 100, **_) -> Fitted:
    """L1-penalised regression; the penalty per row is 1 / (C n)."""
    est = LogisticRegression(**_cols(elasticNetParam=1.0, regParam=1.0 / (C * train.count()), maxIter=max_iter,
                                     standardization=False))
    return _ml("logistic", est, train)


def balanced(df: DataFrame) -> DataFrame:
    """Row weights that give every class the same total."""
    sizes = class_sizes(df)
    total, w = sum(sizes.values()), None
    for c, n in sizes.items():
        w = (F.when if w is None else w.when)(F.col("label") == c, F.lit(total / (len(sizes) * n)))
    return df.withColumn("weight", w)


def random_forest(train: DataFrame, trees: int = 200, max_depth: int = 15, weighted: bool = True, seed: int = 42, **_) -> Fitted:
    """The built-in forest has no least size of a node to split; leaves of one row are allowed."""
    est = RandomForestClassifier(**_cols(numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed))
    if weighted:
        return _ml("random_forest", est.setWeightCol("weight"), balanced(train), weight="weight")
    return _ml("random_forest", est, train)


def knn(train: DataFrame, k: int = 5, weights: str = "distance", **_) -> Fitted:
    classes = sorted(class_sizes(train))
    return Fitted("knn", lambda df: knn_classify(df, train, k, classes, weights).drop("features"))


def _tree_class(model) -> Column:
    """The class a fitted tree predicts, as a column expression over the features array."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in model.toDebugString.splitlines()[1:] if x.strip()]

    def read(at: int) -> tuple[Column, int]:
        indent, text = lines[at]
        if text.startswith("Predict:"):
            return F.lit(float(text.split()[1])), at + 1
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", text).groups()
        left, after = read(at + 1)
        right, end = read(after + 1)  # the line between them is the tree's "Else"
        return F.when(F.get("features", F.lit(int(feature))) <= float(cut), left).otherwise(right), end
    return read(0)[0]


def adaboost(train: DataFrame, rounds: int = 100, rate: float = 0.1, depth: int = 1, seed: int = 42, **_) -> Fitted:
    """Multi-class boosting of trees of ``depth``: the vote of a tree is its log odds of being right, times the rate.

    A fitted tree is a column expression, so neither the rounds nor ``predict`` stack model transforms.
    """
    classes = sorted(class_sizes(train))
    k = len(classes)
    state = cut_lineage(train.select(F.col("features").cast("array<double>").alias("features"),
                                     F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight")))
    trees = []
    for i in range(rounds):
        guess = _tree_class(DecisionTreeClassifier(**_cols(maxDepth=depth, weightCol="weight", seed=seed)).fit(
            with_vector(state).select(VECTOR, "label", "weight")))
        miss = (guess != F.col("label")).cast("double")
        wrong, total = state.agg(F.sum(miss * F.col("weight")), F.sum("weight")).first()
        error = wrong / total
        if error >= 1 - 1 / k:
            break
        if error <= 0:
            trees.append((guess, 1.0))
            break
        alpha = rate * (float(np.log((1 - error) / error)) + float(np.log(k - 1)))
        trees.append((guess, alpha))
        # Weights are kept near 1 on average, so they neither vanish nor overflow.
        state = state.withColumn("weight", F.col("weight") * F.exp(miss * alpha) / F.lit(
            float((total - wrong + wrong * np.exp(alpha)) / total)))
        if i % 5 == 4:
            state = cut_lineage(state)

    def predict(df: DataFrame) -> DataFrame:
        kept = [F.col(c) for c in df.columns if c not in ("features", "prediction", "probability")]
        votes = F.array(*[F.struct(guess.alias("c"), F.lit(alpha).alias("w")) for guess, alpha in trees])
        def of(c):
            return F.aggregate("_cast", F.lit(0.0), lambda s, v: s + F.when(v["c"] == float(c), v["w"]).otherwise(0.0))
        sums = F.array(*[of(c) for c in classes])
        best = F.array_position("_votes", F.array_max("_votes")).cast("int")
        out = df.withColumn("_cast", votes if trees else F.array().cast("array<struct<c: double, w: double>>")).withColumn("_votes", sums)
        return out.select(*kept, F.get(F.array(*[F.lit(float(c)) for c in classes]), best - 1).alias("prediction"))
    return Fitted("adaboost", predict, trees)


def gradient_boosting(train: DataFrame, trees: int = 100, depth: int = 3, rate: float = 0.1, subsample: float = 1.0, seed: int = 42, **_) -> Fitted:
    est = GBTClassifier(**_cols(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy="all", seed=seed))
    if len(class_sizes(train)) > 2:
        est = OneVsRest(classifier=est, featuresCol=VECTOR, labelCol="label", parallelism=2)
    return _ml("gradient_boosting", est, train)


def _second_order(name: str, train: DataFrame, **settings) -> Fitted:
    model = boosting.fit(train, **settings)

    def predict(df: DataFrame) -> DataFrame:
        kept = [F.col(c) for c in df.columns if c not in ("features", "prediction", "probability")]
        names = F.array(*[F.lit(float(c)) for c in model.classes])
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        return df.withColumn("_p", model.probability()).select(*kept, F.get(names, best - 1).alias("prediction"),
                                                               F.col("_p").alias("probability"))
    return Fitted(name, predict, model)


def xgboost_like(train, trees: int = 500, depth: int = 3, rate: float = 0.1, subsample: float = 1.0, columns: float | str = "all",
                 penalty: float = 1.0, seed: int = 42, **more):
    """Level-wise second-order boosting with an L2 penalty. Also used with 200 trees of depth 10, subsample 0.8 and columns 0.8."""
    return _second_order("xgboost_like", train, trees=trees, depth=depth, rate=rate, subsample=subsample, penalty=penalty,
                         columns=1.0 if columns == "all" else float(columns), seed=seed, **more)


def lightgbm_like(train, trees: int = 500, leaves: int = 31, depth: int = 8, rate: float = 0.1, subsample: float = 1.0, seed: int = 42,
                  **more):
    """Leaf-wise second-order boosting from the class shares: no penalty, 20 rows a leaf, the 31 leaves of best gain in eight levels."""
    k = len(class_sizes(train))
    return _second_order("lightgbm_like", train, **dict(
        trees=trees, leaves=leaves, depth=depth, rate=rate, subsample=subsample, seed=seed, penalty=0.0, least_rows=20, least_hessian=1e-3,
        average_start=True, multi_curvature=k / max(k - 1, 1)) | more)


# Nodes of the trees that one forest may grow at once on the driver, some 0.5 KB each with their statistics.
NODES_AT_ONCE = 1_000_000


def _stored_forests(name: str, groups: int, forest, train: DataFrame) -> Fitted:
    """A forest grown, stored in ``spark.checkpoint.dir`` and read back in parts, so that the driver holds one part at a time.

    ``forest(i)`` is the learner of part i. The classes' weights in the leaves are added over all trees, as one forest does.
    """
    ready = cut_lineage(with_vector(train).select(VECTOR, F.col("label").cast("double").alias("label")))
    folder = f"{train.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    for i in range(groups):
        forest(i).fit(ready).write().save(f"{folder}/{i}")

    def predict(df: DataFrame) -> DataFrame:
        rows = cut_lineage(with_vector(df.drop("prediction", "probability")).withColumn("_row", F.monotonically_increasing_id()))
        votes = None
        for i in range(groups):
            model = RandomForestClassificationModel.load(f"{folder}/{i}")
            part = cut_lineage(model.transform(rows.select("_row", VECTOR)).select(
                "_row", F.lit(i).alias("i"), vector_to_array("rawPrediction").alias("raw")))
            votes = part if votes is None else votes.unionByName(part)
        each = F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda r: r["raw"])  # always added in one order
        total = F.aggregate("_each", F.transform(F.get("_each", F.lit(0)), lambda v: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        summed = votes.groupBy("_row").agg(each.alias("_each")).select("_row", total.alias("_raw"))
        sum_of = F.aggregate("_raw", F.lit(0.0), lambda s, v: s + v)
        kept = [F.col(c) for c in df.columns if c not in ("features", "prediction", "probability")]
        return rows.join(summed, "_row").withColumn("_all", sum_of).select(
            *kept, (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double").alias("prediction"),
            F.transform("_raw", lambda v: v / F.col("_all")).alias("probability"))
    return Fitted(name, predict, folder)


def extra_trees(train: DataFrame, trees: int = 100, max_depth: int = 30, seed: int = 42, **_) -> Fitted:
    """Trees on all rows. A fully grown tree has up to two nodes a row, so on many rows the trees are grown in parts (``_stored_forests``)."""
    at_once = max(1, NODES_AT_ONCE // max(2 * train.count(), 1))

    def forest(i: int, n: int):
        return RandomForestClassifier(**_cols(numTrees=n, maxDepth=max_depth, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed + i,
                                              cacheNodeIds=True))
    if at_once >= trees:
        return _ml("extra_trees", forest(0, trees), train)
    return _stored_forests("extra_trees", -(-trees // at_once), lambda i: forest(i, min(at_once, trees - i * at_once)), train)


def cosine_map(width: int, gamma: float, size: int = 500, seed: int = 42):
    """Random features whose dot product approximates exp(-gamma |x - y|^2)."""
    require_small(width * size, "random feature matrix")
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)), rng.uniform(0, 2 * np.pi, size)

    @F.arrow_udf(DOUBLES)
    def run(features: pa.Array) -> pa.Array:
        x = kernels.to_matrix(features)
        return kernels.from_matrix(np.sqrt(2.0 / size) * np.cos(x @ w + b) if len(x) else np.zeros((0, size)))
    return lambda df: df.withColumn("features", once(run)(F.col("features").cast("array<double>")))


def svm_map(train: DataFrame, kernel: str = "rbf", gamma: float | str = 0.1, degree: int = 3, size: int = 500, mapping: str = "cosine",
            seed: int = 42, **_):
    """The map of the kernel that ``svm`` has before its separator: a function of a DataFrame, made from the rows of ``train``."""
    if kernel == "linear":
        return lambda df: df
    if kernel == "rbf" and mapping == "cosine":
        return cosine_map(B.shape(train)[1], gamma_of(train, gamma), size, seed)
    return kernel_map(train, kernel, gamma, degree, landmarks=size, seed=seed)


def svm_map_key(kernel: str = "rbf", gamma: float | str = 0.1, degree: int = 3, size: int = 500, mapping: str = "cosine", seed: int = 42,
                **_) -> tuple:
    """What ``svm_map`` depends on besides its rows: settings with one key share a map."""
    return (kernel,) if kernel == "linear" else (kernel, gamma, degree, size, mapping, seed)


def svm(train: DataFrame, kernel: str = "rbf", C: float = 3.0, gamma: float | str = 0.1, degree: int = 3, size: int = 500,
        mapping: str = "cosine", max_iter: int = 100, seed: int = 42, **_) -> Fitted:
    """Kernel machine: a map of the kernel with ``size`` features, then a linear separator.

    ``rbf`` has a random cosine map or, with ``mapping="landmarks"``, that of ``kernel_map``, which ``poly`` and ``sigmoid`` always use.
    """
    prepare = svm_map(train, kernel, gamma, degree, size, mapping, seed)
    est = LinearSVC(**_cols(regParam=1.0 / (C * B.shape(train)[0]), maxIter=max_iter))
    if len(class_sizes(train)) > 2:
        est = OneVsRest(classifier=est, featuresCol=VECTOR, labelCol="label")
    return _ml("svm", est, train, prepare)


def gaussian_bayes(train: DataFrame, **_) -> Fitted:
    return _ml("gaussian_bayes", NaiveBayes(**_cols(modelType="gaussian")), train)


def decision_tree(train: DataFrame, max_depth: int = 30, seed: int = 42, **_) -> Fitted:
    return _ml("decision_tree", DecisionTreeClassifier(**_cols(maxDepth=max_depth, seed=seed)), train)


def neural_net(train: DataFrame, hidden=(128, 64, 32), epochs: int = 50, seed: int = 42, **_) -> Fitted:
    """Feed-forward net; ``hidden=(10,)`` with 20 epochs is the small variant."""
    layers = [B.shape(train)[1], *hidden, len(class_sizes(train))]
    return _ml("neural_net", MultilayerPerceptronClassifier(**_cols(layers=layers, maxIter=epochs, seed=seed)), train)


MODELS = {
    "logistic": logistic, "random_forest": random_forest, "knn": knn, "adaboost": adaboost,
    "gradient_boosting": gradient_boosting, "xgboost_like": xgboost_like, "lightgbm_like": lightgbm_like,
    "extra_trees": extra_trees, "svm": svm, "gaussian_bayes": gaussian_bayes, "decision_tree": decision_tree,
    "neural_net": neural_net,
}


def fit(name: str, train: DataFrame, **params) -> Fitted:
    """Fit one of ``MODELS`` with the given parameters."""
    return MODELS[name](train, **params)


def dump(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Table of actual and predicted class."""
    return predictions.select(F.col(label).cast("int").alias("Actual"), F.col("prediction").cast("int").alias("Predicted"))
