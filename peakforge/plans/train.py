"""Features and susceptibility letters to a comparison of models and rebalancing methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.operators import metrics, tuning
from peakforge.operators.amr import labelled
from peakforge.operators.features import take_features
from peakforge.operators.models import fit
from peakforge.operators.resample import split
from peakforge.session import cut_lineage


def train_and_compare(features: DataFrame, amr: DataFrame, antibiotic: str, models: dict, methods=("none",),
                      test: float = 0.35, seed: int = 42) -> DataFrame:
    """Result row per method and model for one antibiotic (R against S)."""
    rows = labelled(features, amr, antibiotic).select(F.col("row_id").alias("sample_id"), "features", "label")
    train, held = split(cut_lineage(rows), test, seed)
    return tuning.compare(train, held, models, methods, seed=seed)


def line_up(train: DataFrame, test: DataFrame, models: dict, **elimination) -> DataFrame:
    """Recursive elimination first, then every model on the kept features."""
    kept, _ = tuning.rfecv(train, **elimination)
    return tuning.compare(take_features(train, kept), take_features(test, kept), models)


def confidence_report(train: DataFrame, test: DataFrame, thresholds=(0.75,), bins: int = 30, **params):
    """(scores, histogram of the confidence, reject rates) of the logistic model."""
    scored = cut_lineage(metrics.confidence(fit("logistic", train, **params).predict(test)))
    return (metrics.evaluate(scored), metrics.histogram(scored, "confidence", bins),
            metrics.reject_curve(scored, thresholds))
