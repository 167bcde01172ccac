"""Scores of predictions and simple distributions; everything derives from a small grouped table."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs; 0 where a ratio is undefined."""
    sides = confusion(df, label, prediction).select(
        "n", F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("true"),
                                        (F.col("label") == F.col("prediction")).cast("int").alias("hit")),
                               F.struct(F.col("prediction").alias("class"), F.lit(0).alias("true"),
                                        F.lit(0).alias("hit")))).alias("s")).select("n", "s.*")
    sums = sides.groupBy("class").agg(
        F.sum(F.col("n") * F.col("hit")).alias("tp"), F.sum(F.col("n") * F.col("true")).alias("support"),
        F.sum(F.col("n") * (1 - F.col("true"))).alias("predicted"))
    return sums.select(
        "class",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("predicted") + F.col("support") > 0,
               2 * F.col("tp") / (F.col("predicted") + F.col("support"))).otherwise(0.0).alias("f1"),
        F.col("support").cast("bigint").alias("support"))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction", names=None) -> DataFrame:
    """One row: accuracy and, per class name, precision, recall and F1 (``names`` maps class code to name)."""
    names = {0: "R", 1: "S"} if names is None else names
    counts = confusion(df, label, prediction)
    n = F.col("n")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    aggs = [total(F.lit(True)).alias("_all"), total(F.col("label") == F.col("prediction")).alias("_hit")]
    for code in names:
        aggs += [total((F.col("label") == code) & (F.col("prediction") == code)).alias(f"_tp{code}"),
                 total(F.col("label") == code).alias(f"_true{code}"),
                 total(F.col("prediction") == code).alias(f"_pred{code}")]
    row = counts.agg(*aggs)

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = [ratio(F.col("_hit"), F.col("_all")).alias("accuracy")]
    for code, name in names.items():
        tp, true, pred = F.col(f"_tp{code}"), F.col(f"_true{code}"), F.col(f"_pred{code}")
        out += [ratio(tp, pred).alias(f"precision_{name}"), ratio(tp, true).alias(f"recall_{name}"),
                ratio(2 * tp, pred + true).alias(f"f1_{name}")]
    return row.select(*out)


def macro_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Unweighted mean of the class F1 values."""
    return per_class(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


class MacroF1Evaluator(Evaluator):
    """Macro F1 as a tuning objective (the built-in ``f1`` weights classes by support)."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(macro_f1(dataset, self.label, self.prediction).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def run_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean and population standard deviation of a score over runs, in percent."""
    return df.agg((F.avg(score) * 100).alias("mean_accuracy"), (F.stddev_pop(score) * 100).alias("std_accuracy"))


# ---- confidence -----------------------------------------------------------------------------------------------------

def confidence(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    """Largest class probability of every row, of an array or a vector column."""
    kind = predictions.schema[probability].dataType.typeName()
    values = F.col(probability) if kind == "array" else vector_to_array(probability)
    return predictions.withColumn("confidence", F.array_max(values))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest value, the last bin closed; empty bins included."""
    c = F.col(column)
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).cast("double").alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).cast("double").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    counts = (df.filter(c.isNotNull()).withColumns({"_lo": lo, "_hi": hi})
              .withColumn("bin", F.least(F.lit(bins - 1), F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                                                                   * bins).cast("int")))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left").withColumns({"_lo": lo, "_hi": hi})
            .select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("low"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("high"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def reject_curve(df: DataFrame, thresholds=(0.75,), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows below each confidence threshold and the accuracy of the rest."""
    hit = (F.col(label).cast("int") == F.col(prediction).cast("int")).cast("int")
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return (df.select("confidence", hit.alias("hit"), levels.alias("threshold")).groupBy("threshold").agg(
        F.avg((F.col("confidence") < F.col("threshold")).cast("int")).alias("reject_rate"),
        F.avg(F.when(F.col("confidence") >= F.col("threshold"), F.col("hit"))).alias("accepted_accuracy")))


def append_results(*tables: DataFrame) -> DataFrame:
    """One long table from several result tables with differing columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
