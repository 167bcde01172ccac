"""Susceptibility tables: wide to long, recoding, joins with the catalog and the features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions.scalars import canonical_id, class_code, pad8, recode

MARK = "Interpretación"


def antibiotic_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if MARK in c]


def rejected_ids(df: DataFrame, id_column: str = "Muestra") -> DataFrame:
    """Rows whose sample id is no number."""
    return df.filter(canonical_id(id_column).isNull())


def amr_wide(df: DataFrame, policy: str = "merge_i", origin: str | None = None, id_column: str = "Muestra",
             origin_column: str = "Origen") -> DataFrame:
    """Cleaned wide table: canonical id, recoded letters; rows without any interpretation drop out."""
    if origin is not None:
        df = df.filter(F.col(origin_column) == origin)
    columns = antibiotic_columns(df)
    filled = F.lit(False)
    for c in columns:
        filled = filled | F.coalesce(F.col(f"`{c}`") != "", F.lit(False))
    out = df.withColumn("extern_id", canonical_id(id_column)).filter(F.col("extern_id").isNotNull() & filled)
    origins = [F.col(origin_column).alias("origin")] if origin_column in df.columns else [
        F.lit(None).cast("string").alias("origin")]
    return out.select("extern_id", *origins,
                      *[recode(F.col(f"`{c}`"), policy).alias(c.replace(f" {MARK}", "")) for c in columns])


def amr_long(df: DataFrame, policy: str = "merge_i", origin: str | None = None, id_column: str = "Muestra",
             origin_column: str = "Origen") -> DataFrame:
    """Long table (extern_id, origin, antibiotic, sir); cells without a letter are left out."""
    wide = amr_wide(df, policy, origin, id_column, origin_column)
    names = [c for c in wide.columns if c not in ("extern_id", "origin")]
    return (wide.unpivot(["extern_id", "origin"], [F.col(f"`{c}`") for c in names], "antibiotic", "sir")
            .filter(F.col("sir").isNotNull()))


def complete_cases(df: DataFrame, columns=None) -> DataFrame:
    """Rows without a missing value in ``columns`` (all columns by default)."""
    return df.dropna(subset=None if columns is None else list(columns))


def keep_known(amr: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose sample has a spectrum, and those that have none."""
    ids = catalog.select("extern_id").distinct()
    return amr.join(ids, "extern_id", "left_semi"), amr.join(ids, "extern_id", "left_anti")


def sir_counts(amr: DataFrame) -> DataFrame:
    """S, R and I per antibiotic; a missing class counts 0."""
    return amr.groupBy("antibiotic").pivot("sir", ["S", "R", "I"]).agg(F.count(F.lit(1))).fillna(0, ["S", "R", "I"])


def labelled(features: DataFrame, amr: DataFrame, antibiotic: str | None = None, classes=("R", "S")) -> DataFrame:
    """Features joined with the letters of one antibiotic on the padded id, many-to-many, with integer labels.

    A spectrum with several letters is several rows. ``row_id`` tells them apart: the sample id, and a number among its rows.
    Rebalancing needs it as its ``sample_id``.
    """
    if antibiotic is not None:
        amr = amr.filter(F.col("antibiotic") == antibiotic)
    letters = amr.filter(F.col("sir").isin(*classes)).select(
        pad8("extern_id").alias("extern_id"), *[c for c in amr.columns if c != "extern_id"])
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy(*letters.columns))
    return (features.filter(F.col("features").isNotNull())
            .withColumn("extern_id", pad8("extern_id"))
            .join(letters, "extern_id", "inner")
            .withColumn("label", class_code("sir", classes))
            .withColumn("row_id", F.concat_ws("#", F.col("sample_id").cast("string"), number)))
