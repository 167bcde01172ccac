"""From raw documents to token digests: quality, boilerplate lines, near duplicates, benchmark passages, tokens.

Each stage reads all rows that its predecessor kept, written as Parquet, and its decisions take effect. All stages but the
last return the columns of ``documents``. Two stages fit models or search similarities that SQL cannot express, so there
is no SQL for the whole; the tests compare it with a plain version of every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.llm.attention_quality import accepted, learn
from peakforge.llm.bpe import fingerprints
from peakforge.llm.common import held_out, keep, table
from peakforge.llm.line_spread import without_spread_lines
from peakforge.llm.signature_join import first_of_each
from peakforge.llm.simhash_leaks import without_leaks


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels of rows that are not held out."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that occur on many sites; ``n_chars`` follows the text."""
    out = without_spread_lines(docs)
    n_chars = F.when(F.col("_n_cut") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest id."""
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of what they decode to, per document."""
    return fingerprints(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
