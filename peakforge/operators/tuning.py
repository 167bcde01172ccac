"""Hyper-parameter search, recursive feature elimination and the method x model comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions.scalars import hash_uniform
from peakforge.operators import blocks as B, metrics
from peakforge.operators.features import take_features
from peakforge.operators.models import Fitted, VECTOR, fit, svm_map, svm_map_key, with_vector
from peakforge.operators.ranking import ranked
from peakforge.operators.resample import resample
from peakforge.session import cut_lineage


def with_folds(df: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold``: the rows of every class, in the order of their draws, dealt to the folds in turn.

    So every fold has its share of every class, within one row. ``sample_id`` must be unique.
    """
    draw = hash_uniform(F.col("sample_id"), F.lit("cv"), F.lit(seed))
    dealt = ranked(df.select("sample_id", "label", draw.alias("_u")), ["_u", "sample_id"], by="label")
    return df.join(dealt.select("sample_id", (F.col("rank") % folds).cast("int").alias("fold")), "sample_id")


def expand(grid: dict) -> list[dict]:
    """All combinations of a parameter grid."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


# Most bytes of mapped rows in a partition that a kernel machine is fitted on.
MAPPED_BYTES = 64 * 1024 * 1024


def _few_parts(df: DataFrame, width: int) -> DataFrame:
    """``df`` in as many partitions as its mapped rows need.

    A separator asks for its loss hundreds of times, each a job that takes longer to start than to run on all but large tables; on one
    partition it has one stage. Other fits use the other cores.
    """
    n, own = B.shape(df)
    return df.repartition(max(1, -(-n * max(width, own) * 8 // MAPPED_BYTES)))


def _svm_scores(data: DataFrame, points: list[dict], folds: int, at_once: int) -> tuple[list, callable]:
    """(tasks, score of a task) for the kernel machine: a task is a fold and the settings that share a map.

    The rows of a fold are mapped once per task and kept while its separators are fitted on them, as a kernel machine is a linear one on
    mapped rows, ``at_once`` of a task side by side. Settings that differ only in what neither the map nor the separator reads share a fit.
    """
    shared = {}
    for i, point in enumerate(points):
        shared.setdefault(svm_map_key(**point), []).append(i)

    def score(task):
        some, f = task
        own, other = data.filter(F.col("fold") != f).drop("fold"), data.filter(F.col("fold") == f)
        prepare, width = svm_map(own, **points[some[0]]), points[some[0]].get("size", 500)
        own, other = (prepare(_few_parts(df, width)).persist() for df in (own, other))
        separators = {i: tuple((k, points[i][k]) for k in ("C", "max_iter") if k in points[i]) for i in some}

        def value(separator):
            return metrics.macro_f1(fit("svm", own, kernel="linear", **dict(separator)).predict(other)).first()[0]
        try:
            different = list(dict.fromkeys(separators.values()))
            with ThreadPoolExecutor(max(1, at_once)) as pool:
                found = dict(zip(different, pool.map(inheritable_thread_target(data.sparkSession)(value), different)))
        finally:
            own.unpersist()
            other.unpersist()
        return [(i, f, str(points[i]), float(found[separators[i]] or 0.0)) for i in some]
    return [(some, f) for some in shared.values() for f in range(folds)], score


def grid_search(train: DataFrame, model: str, grid: dict, folds: int = 3, seed: int = 42, at_once: int = 4,
                refit: bool = True) -> tuple[DataFrame, dict, Fitted | None]:
    """(scores, best parameters, model refitted on all rows) by mean macro F1 over stratified folds.

    ``scores`` has a row per parameter set and fold, all fitted on one stored table of folds. ``at_once`` of them run side by side, so that the
    small jobs of one fit fill the gaps of another; the answer does not depend on it. Ties go to the first parameter set. Without ``refit``
    no model is fitted on all rows. Kernel machines share the maps of their kernels (``_svm_scores``).
    """
    data = cut_lineage(with_folds(train, folds, seed))
    points = expand(grid)

    def score(task):
        i, f = task
        fitted = fit(model, data.filter(F.col("fold") != f).drop("fold"), **points[i])
        value = metrics.macro_f1(fitted.predict(data.filter(F.col("fold") == f))).first()[0]
        return [(i, f, str(points[i]), float(value or 0.0))]

    tasks = [(i, f) for i in range(len(points)) for f in range(folds)]
    if model == "svm":
        tasks, score = _svm_scores(data, points, folds, at_once)
    if at_once > 1:
        with ThreadPoolExecutor(at_once) as pool:
            scored = list(pool.map(inheritable_thread_target(train.sparkSession)(score), tasks))
    else:
        scored = [score(t) for t in tasks]
    rows = sorted(row for part in scored for row in part)
    means = [np.mean([r[3] for r in rows if r[0] == i]) for i in range(len(points))]
    best = points[int(np.argmax(means))]
    scores = train.sparkSession.createDataFrame(rows, "point int, fold int, params string, macro_f1 double")
    return scores, best, fit(model, train, **best) if refit else None


def _ranked_forest(train: DataFrame, trees: int, seed: int):
    model = RandomForestClassifier(featuresCol=VECTOR, labelCol="label", numTrees=trees, seed=seed).fit(
        with_vector(train).select(VECTOR, F.col("label").cast("double").alias("label")))
    return model, model.featureImportances.toArray()


def _sizes(width: int, step: float, min_features: int) -> list[int]:
    cut, out = max(1, int(step * width)), [width]
    while out[-1] > min_features:
        out.append(max(min_features, out[-1] - cut))
    return out


def rfecv(df: DataFrame, step: float = 0.1, folds: int = 5, min_features: int = 96, trees: int = 100,
          seed: int = 42) -> tuple[list[int], DataFrame]:
    """(kept positions, scores): drop the least important share of the initial features per step, choose the size with the
    best mean held-out accuracy (the smallest of equals), then eliminate down to it on all rows."""
    data = cut_lineage(with_folds(df.select("sample_id", "features", "label"), folds, seed))
    width = data.agg(F.max(F.size("features"))).first()[0]
    sizes, rows = _sizes(width, step, min_features), []

    def eliminate(train, until, test=None, fold=0):
        kept = list(range(width))
        for size in sizes:
            kept = kept if size == width else sorted(
                np.array(kept)[np.argsort(importance, kind="stable")[len(kept) - size:]].tolist())
            if size <= until and test is None:
                return kept
            model, importance = _ranked_forest(take_features(train, kept), trees, seed)
            if test is not None:
                hit = (F.col("prediction") == F.col("label")).cast("int")
                score = model.transform(with_vector(take_features(test, kept))).agg(F.avg(hit)).first()[0]
                rows.append((size, fold, float(score or 0.0)))
        return kept

    for f in range(folds):
        eliminate(data.filter(F.col("fold") != f), 0, data.filter(F.col("fold") == f), f)
    mean = {s: np.mean([r[2] for r in rows if r[0] == s]) for s in sizes}
    best = min(sizes, key=lambda s: (-mean[s], s))
    scores = df.sparkSession.createDataFrame(rows, "n_features int, fold int, accuracy double")
    return eliminate(data, best), scores


def train_and_evaluate(train: DataFrame, test: DataFrame, model: str, method: str = "none", names=None,
                       seed: int = 42, **params) -> DataFrame:
    """One result row: rebalance the training side, fit, score the untouched test side."""
    fitted = fit(model, cut_lineage(resample(train, method, seed)), **params)
    return metrics.evaluate(fitted.predict(test), names=names).select(
        F.lit(method).alias("method"), F.lit(model).alias("model"), "*")


def compare(train: DataFrame, test: DataFrame, models: dict, methods=("none",), names=None, seed: int = 42) -> DataFrame:
    """Result rows of every method and model; ``models`` maps a model name to its parameters."""
    rows = []
    for method in methods:
        balanced = cut_lineage(resample(train, method, seed))
        for model, params in models.items():
            fitted = fit(model, balanced, **params)
            table = metrics.evaluate(fitted.predict(test), names=names)
            rows.append((method, model, *table.first()))
            columns = table.columns
    schema = "method string, model string, " + ", ".join(f"{c} double" for c in columns)
    return train.sparkSession.createDataFrame(rows, schema)
