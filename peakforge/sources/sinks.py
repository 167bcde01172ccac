"""Writers: Parquet for tables that are read again, CSV, JSON and XML for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.operators.catalog import nested_report


def write_features(features: DataFrame, path: str, single_precision: bool = True) -> None:
    """Feature table as Parquet; single precision halves the size of the wide vectors."""
    if single_precision:
        features = features.withColumn("features", F.col("features").cast("array<float>"))
    features.write.mode("overwrite").parquet(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Catalog split by dataset and year, so that later scans read only the years they ask for."""
    catalog.write.mode("overwrite").partitionBy("dataset", "year").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Species report of accepted rows: flat CSV, or one nested record per genus as JSON or XML."""
    if fmt == "csv":
        df.groupBy(F.col("genus").alias("Genus"), F.col("species").alias("Species")).agg(
            F.count(F.lit(1)).alias("Count")).write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "json":
        nested_report(df).write.mode("overwrite").json(path)
    elif fmt == "xml":
        per_species = df.groupBy("genus", "species").agg(F.count(F.lit(1)).alias("n"))
        (per_species.groupBy(F.col("genus").alias("_name"))
         .agg(F.array_sort(F.collect_list(F.struct(F.col("species").alias("_name"), F.col("n").alias("_VALUE"))))
              .alias("Species"))
         .write.mode("overwrite").format("xml").option("rootTag", "Results").option("rowTag", "Genus").save(path))
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Any flat result table (scores, predictions, counts)."""
    df.write.mode("overwrite").option("header", "true").format(fmt).save(path)
