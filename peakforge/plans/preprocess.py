"""Raw acquisition tree to feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators.catalog import drop_empty
from peakforge.operators.spectra import build_features
from peakforge.sources.readers import decode_acquisition, scan_spectra


def preprocess(spark: SparkSession, root: str, years=None, species=None) -> DataFrame:
    """(sample_id, keys, status, features): scan, decode, standard chain; the folder path is the sample id.

    The only shuffle pairs the two files of a folder.
    """
    raw = drop_empty(scan_spectra(spark, root, years, species)).withColumn("spectrum_id", F.col("path"))
    return build_features(decode_acquisition(raw).drop("path"))
