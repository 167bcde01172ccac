"""Readers of loose files: identification XML, acquisition trees, text spectra, susceptibility and label tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions import arrays, kernels
from peakforge.operators.amr import MARK
from peakforge.schema import DOUBLES, YEARLY_LABELS
from peakforge.session import once

TREE = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)/1SLin/(acqu|fid)$"


def read_analytes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per ``Analyte`` of loose XML files; ids stay text, the first three matches in document order.

    ``MspMatch`` elements are expected directly below the analyte; ``parse_analytes`` finds them at any depth.
    """
    schema = ("_externId string, _targetPosition string, "
              "MspMatch array<struct<_referencePatternName:string,_globalMatchValue:double>>, _corrupt_record string")
    raw = (spark.read.format("xml").option("rowTag", "Analyte").option("mode", "PERMISSIVE")
           .schema(schema).load(path))
    out = raw.filter(F.col("_corrupt_record").isNull()).select(
        F.col("_externId").alias("extern_id"), F.col("_targetPosition").alias("target_position"),
        F.transform(F.slice("MspMatch", 1, 3), lambda m: F.struct(
            m["_referencePatternName"].alias("pattern"), m["_globalMatchValue"].alias("score"))).alias("matches"))
    return out if limit is None else out.limit(limit)


def _year_folders(root: str, years) -> str:
    """``root`` with the given years, or any folder of four digits, in the place of ``{year}``."""
    wanted = "[0-9][0-9][0-9][0-9]" if years is None else "{" + ",".join(str(int(y)) for y in years) + "}"
    return root.replace("{year}", wanted)


def scan_spectra(spark: SparkSession, root: str, years=None, species=None) -> DataFrame:
    """Acquisition folders below ``root`` that hold both files: keys from the path, header text and signal bytes.

    Each kind of file has one scan of its own, so no content is read twice; the two files of a folder are paired by their folder, never
    by listing order. Where ``root`` has ``{year}`` in it, only the folders of the wanted years are listed; without it all files are
    listed and read, and ``years`` filters them. No years, or none of them there, give no rows.
    """
    names = ["genus", "species", "extern_id", "target_position", "replicate"]
    found = True
    if "{year}" in root:
        found = years is None or len(list(years)) > 0
        root = _year_folders(root, years if found else None)

    def kind(name: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        try:
            files = reader.load(root)
        except AnalysisException as problem:
            if "{" not in root or problem.getCondition() != "PATH_NOT_FOUND":
                raise
            files = spark.createDataFrame([], "path string, content binary")
        files = files.filter(F.col("path").rlike(TREE)).select(
            F.regexp_extract("path", rf"^(.*)/{name}$", 1).alias("path"),
            F.regexp_extract("path", r"/([0-9]{4})/(?:matched_bacteria/)?[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/1SLin/", 1)
            .try_cast("int").alias("year"),
            *[F.regexp_extract("path", TREE, i + 1).alias(n) for i, n in enumerate(names)], F.col("content").alias(name))
        if years is not None:
            files = files.filter(F.col("year").isin(list(years)) if found else F.lit(False))
        return files if species is None else files.filter(F.concat_ws(" ", "genus", "species").isin(list(species)))

    acqu = kind("acqu").select("path", F.decode("acqu", "ISO-8859-1").alias("acqu"))
    return acqu.join(kind("fid"), "path", "inner").withColumn("label", F.concat_ws("_", "genus", "species", "extern_id"))


def parse_header(df: DataFrame) -> DataFrame:
    kinds = {"td": ("TD", "int"), "delay": ("DELAY", "int"), "dw": ("DW", "double"), "ml1": ("ML1", "double"),
             "ml2": ("ML2", "double"), "ml3": ("ML3", "double"), "bytorda": ("BYTORDA", "int")}
    return df.withColumns({name: F.trim(F.try_element_at(
        F.regexp_extract_all("acqu", F.lit(rf"(?m)^##\${key}[^=\n]*= *([^\r\n]*)"), F.lit(1)), F.lit(-1))).try_cast(kind)
        for name, (key, kind) in kinds.items()})


@F.arrow_udf(DOUBLES)
def _samples(fid: pa.Array, big_endian: pa.Array) -> pa.Array:
    rows = []
    for blob, big in zip(fid, big_endian):
        data = blob.as_buffer() if blob.is_valid else b""
        data = memoryview(data)[:len(data) // 4 * 4] if len(data) else b""
        rows.append(np.frombuffer(data, dtype=">i4" if big.as_py() else "<i4"))
    return kernels.from_rows(rows)


def decode_acquisition(df: DataFrame) -> DataFrame:
    """(acqu, fid) to (mz, intensity): int32 samples, at most TD of them, negatives set to 0, calibrated masses.

    ``status`` says ``ok``, ``no calibration`` (a constant of the masses is missing or no number: NULL masses), ``no length`` (the same
    of TD, or no signal bytes: an empty spectrum) or ``short signal`` (fewer samples than TD: those that are there).
    """
    df = parse_header(df).withColumn("_raw", once(_samples)("fid", F.col("bytorda") == 1))
    df = df.withColumn("_n", F.greatest(F.least(F.col("td"), F.size("_raw")), F.lit(0)))
    at = F.filter(F.sequence(F.lit(0), F.col("_n")), lambda i: i < F.col("_n"))
    out = df.withColumns({
        "mz": F.transform(at, lambda i: arrays.tof_to_mz(F.col("ml1"), F.col("ml2"), F.col("ml3"),
                                                         F.col("delay") + i * F.col("dw"))),
        "intensity": F.transform(F.slice("_raw", 1, F.col("_n")), lambda v: F.greatest(v, F.lit(0.0))),
        "status": F.when(F.col("td").isNull() | (F.col("_n") == 0), "no length").when(F.greatest(*[
            F.col(c).isNull() for c in ("ml1", "ml2", "ml3", "delay", "dw")]), "no calibration").when(
            F.col("_n") < F.col("td"), "short signal").otherwise("ok"),
    }).drop("_n")
    return out.drop("_raw", "acqu", "fid", "td", "delay", "dw", "ml1", "ml2", "ml3", "bytorda")


def read_text_points(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text spectra as long points; both columns are cut to whole numbers, ``#`` starts a comment line."""
    raw = (spark.read.option("sep", sep).option("comment", "#").schema("mz double, intensity double").csv(path)
           .select(F.col("_metadata.file_path").alias("path"), "mz", "intensity"))
    return raw.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("spectrum_id"),
                      F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("year"),
                      F.col("mz").cast("int").alias("mz"), F.col("intensity").cast("int").alias("intensity"))


def read_text_spectra(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text spectra as arrays in ascending m/z (one file, one spectrum)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"),
                                                 F.col("intensity").cast("double").alias("intensity"))))
    return (read_text_points(spark, path, sep).groupBy("year", "spectrum_id").agg(pairs.alias("p"))
            .select("year", "spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")))


def read_amr(spark: SparkSession, path: str, id_column: str = "Muestra") -> DataFrame:
    """Susceptibility CSV, all text; a leading byte-order mark is removed from the first name."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.replace("﻿", "") for c in df.columns])
    if id_column not in df.columns or not any(MARK in c for c in df.columns):
        raise ValueError(f"expected a column {id_column!r} and columns containing {MARK!r}, found {df.columns}")
    return df


def read_yearly_labels(spark: SparkSession, root: str, years=(2015, 2016, 2017, 2018)) -> DataFrame:
    """Label CSVs ``root/<year>/<year>_clean.csv``; a missing year is skipped, the year comes from the path."""
    pattern = f"{root}/{{{','.join(str(y) for y in years)}}}/*_clean.csv"
    raw = spark.read.option("header", "true").csv(pattern)
    return raw.select(*[F.col(f.name) for f in YEARLY_LABELS],
                      F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]{4})/[^/]*$", 1).alias("year"))
