"""Relational cleaning and statistics over the catalog of acquisitions.

Counts group on keys with map-side partial sums. Where a group may hold a large share of the rows, one value per group is
aggregated first and joined back, so no window or collected list ever sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.session import cut_lineage

MEMBER = r"^(.*)/([^/]+)/0_([^/]+)/(.*)$"


# ---- archives and labels --------------------------------------------------------------------------------------------

def archive_folders(members: DataFrame) -> DataFrame:
    """Sample folders named by archive member paths ``.../{extern_id}/0_{target}/...``.

    A folder is usable when the archive lists the folder itself, not only something below a folder of that name.
    """
    def part(i):
        return F.regexp_extract("member", MEMBER, i)
    keyed = members.filter(F.col("member").rlike(MEMBER)).select(
        part(2).alias("extern_id"), part(3).alias("target_position"),
        F.concat(part(1), F.lit("/"), part(2), F.lit("/0_"), part(3), F.lit("/")).alias("folder"),
        (part(4) == "").cast("int").alias("own"), (part(4) != "").cast("int").alias("file"))
    per_folder = keyed.groupBy("extern_id", "target_position", "folder").agg(
        F.max("own").alias("own"), F.sum("file").cast("bigint").alias("files"))
    return per_folder.groupBy("extern_id", "target_position").agg(
        F.min("folder").alias("folder"),
        F.min_by("files", "folder").alias("files"),
        F.when(F.min_by("own", "folder") == 1, "found").otherwise("illegal").alias("folder_status"))


def match_folders(valid: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid identifications with their first archive folder, and those without one."""
    folders = archive_folders(members)
    keys = ["extern_id", "target_position"]
    return valid.join(folders, keys, "inner"), valid.join(folders, keys, "left_anti")


def match_labels(labels: DataFrame, spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Yearly label rows that have a text spectrum of the same (year, code), and those that have none."""
    keys = ["year", "code"]
    return labels.join(spectra, keys, "inner"), labels.join(spectra.select(*keys), keys, "left_anti")


# ---- counts ---------------------------------------------------------------------------------------------------------

def species_report(df: DataFrame) -> DataFrame:
    return df.groupBy("genus", "species").agg(F.count(F.lit(1)).alias("count"))


def nested_report(df: DataFrame) -> DataFrame:
    """One map species -> count per genus."""
    return species_report(df).groupBy("genus").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "count")))).alias("species"))


def counts_with_total(df: DataFrame) -> DataFrame:
    """Counts per (year, genus, species) and, under the year ``TOTAL``, per (genus, species)."""
    per_year = df.groupBy("year", "genus", "species").agg(F.count(F.lit(1)).alias("n"))
    y, g, s = F.col("year"), F.col("genus"), F.col("species")
    return (per_year.groupingSets([[y, g, s], [g, s]], y, g, s)
            .agg(F.sum("n").alias("count"), F.grouping("year").alias("_all"))
            .select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("year").cast("string")).alias("year"),
                    "genus", "species", "count"))


def species_counts(catalog: DataFrame, years=None, listed: DataFrame | None = None) -> DataFrame:
    """Spectra per ``genus species`` over the given years, ascending. ``listed`` adds species without any spectrum."""
    rows = catalog if years is None else catalog.filter(F.col("year").isin(list(years)))
    counts = rows.groupBy("genus", "species").agg(F.count(F.lit(1)).alias("n"))
    if listed is not None:
        counts = listed.select("genus", "species").distinct().join(counts, ["genus", "species"], "left")
    return (counts.select(F.concat_ws(" ", "genus", "species").alias("name"),
                          F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
            .orderBy("count", "name"))


def dataset_totals(catalog: DataFrame) -> DataFrame:
    """Samples, spectra, genera and species per dataset; a sample is one (genus, species, extern_id) folder."""
    per_sample = catalog.groupBy("dataset", "genus", "species", "year", "extern_id").agg(F.count(F.lit(1)).alias("n"))
    per_species = per_sample.groupBy("dataset", "genus", "species").agg(
        F.sum("n").alias("spectra"), F.count("extern_id").alias("samples"))
    per_genus = per_species.groupBy("dataset", "genus").agg(
        F.sum("spectra").alias("spectra"), F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("species"))
    return per_genus.groupBy("dataset").agg(
        F.sum("samples").alias("samples"), F.sum("spectra").alias("spectra"),
        F.count(F.lit(1)).alias("genera"), F.sum("species").alias("species"))


def top_species(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest species of every dataset; ties go to the alphabetically first."""
    counts = catalog.groupBy("dataset", "genus", "species").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("dataset").orderBy(F.desc("total"), "genus", "species")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def global_stats(catalog: DataFrame, n: int = 5) -> DataFrame:
    """Summary row of each dataset followed by its top species; columns a row does not have are NULL."""
    top = top_species(catalog, n).select("dataset", F.concat_ws(" ", "genus", "species").alias("name"),
                                         F.col("total").alias("fids"), F.lit(0).cast("bigint").alias("amr"))
    return dataset_totals(catalog).unionByName(top, allowMissingColumns=True)


# ---- content checks -------------------------------------------------------------------------------------------------

def _all_zero():
    """Whether a blob has bytes and all are zero, against zeros of its length."""
    return (F.octet_length("fid") > 0) & (F.col("fid") == F.expr("cast(repeat(char(0), octet_length(fid)) AS binary)"))


def fingerprint(blobs: DataFrame) -> DataFrame:
    """SHA-256 of each blob; all-zero blobs are ``is_empty``, blobs without bytes are flagged apart."""
    return blobs.select("path", F.sha2("fid", 256).alias("hash"),
                        _all_zero().alias("is_empty"),
                        (F.octet_length("fid") == 0).alias("no_bytes"))


def drop_empty(blobs: DataFrame) -> DataFrame:
    return blobs.filter(~_all_zero())


def duplicate_report(prints: DataFrame) -> DataFrame:
    """Paths whose content was seen before, each with the first path of that content (paths in ascending order).

    Paths and hashes are stored once, so the contents are read a single time.
    """
    prints = cut_lineage(prints.select("path", "hash"))
    first = (prints.groupBy("hash").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > 1).drop("n"))
    return (prints.join(first, "hash").filter(F.col("path") != F.col("first_path"))
            .select("path", "first_path", "hash"))


def one_per_sample(catalog: DataFrame, replicate: str = "1") -> DataFrame:
    """Keep the smallest target position of each sample, and of that only the given replicate."""
    chosen = catalog.groupBy("extern_id").agg(F.min("target_position").alias("target_position"))
    return catalog.join(chosen, ["extern_id", "target_position"], "left_semi").filter(F.col("replicate") == replicate)


def pruned_levels(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sample, species and genus folders that hold nothing any more after rows were dropped. One pass over each side, one shuffle."""
    both = before.select("genus", "species", "extern_id", F.lit(0).alias("kept")).unionByName(
        after.select("genus", "species", "extern_id", F.lit(1).alias("kept")))
    # Grouping ids of the rollup: 3 leaves two of the three columns out, 1 the last.
    level = F.grouping_id()
    return (both.rollup("genus", "species", "extern_id").agg(F.max("kept").alias("kept"), level.alias("id"))
            .filter((F.col("id") < 7) & (F.col("kept") == 0))
            .select(F.when(F.col("id") == 3, "genus").when(F.col("id") == 1, "species").otherwise("sample").alias("level"),
                    F.concat_ws("/", "genus", "species", "extern_id").alias("name")))
