"""Clean one year of a clinical archive: identifications, archive folders, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import catalog
from peakforge.operators.identification import accepted, validate_matches
from peakforge.sources.archives import list_members, parse_analytes, scan_archives


def identifications(spark: SparkSession, xml_archives, year) -> tuple[DataFrame, DataFrame]:
    """(validated rows with status and reason, documents that could not be read)."""
    documents = scan_archives(spark, xml_archives, year, ".xml")
    parsed = parse_analytes(documents.filter(F.col("error").isNull()))
    broken = documents.filter(F.col("error").isNotNull()).select("archive", "member", "error").unionByName(
        parsed.filter(F.col("error").isNotNull()).select("archive", "member", "error"))
    rows = parsed.filter(F.col("error").isNull()).drop("archive", "member", "error")
    return validate_matches(rows), broken


def clean_year(spark: SparkSession, xml_archives, spectrum_archives, year, limit: int | None = None):
    """(found identifications with their folder, missing ones, species report)."""
    checked, _ = identifications(spark, xml_archives, year)
    found, missing = catalog.match_folders(accepted(checked, limit), list_members(spark, spectrum_archives))
    return found, missing, catalog.species_report(found)
