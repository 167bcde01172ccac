"""The given tables seen as spectra, identifications, catalogs and susceptibility letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakforge.functions.scalars import class_code, pad8

ANTIBIOTICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spectra(spark, sf) -> DataFrame:
    at = F.sequence(F.lit(0), F.size("embedding") - 1)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("spectrum_id"),
        F.transform(at, lambda i: 2000.0 + 281.25 * i).alias("mz"),
        F.transform("embedding", lambda x: 1000.0 * (x.cast("double") + 0.6)).alias("intensity"))


def points(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("spectrum_id"),
        (F.lit(2000.0) + F.col("l_extendedprice") % 18000).alias("mz"), F.col("l_quantity").alias("intensity"))


def features(spark, sf) -> DataFrame:
    sir = F.when(F.col("label") < 3, "R").otherwise("S")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), pad8("vec_id").alias("extern_id"),
        F.col("embedding").cast("array<double>").alias("features"), class_code(sir).alias("label"),
        F.col("label").alias("group"))


def target_letters(spark, sf) -> DataFrame:
    """Letters (0, 1, 2) of three targets per vector; the third has none for some of them."""
    group = F.col("label")
    of = {"first": F.when(group < 3, 0).otherwise(1), "second": (group % 3).cast("int"),
          "third": F.when(group % 4 < 3, (group % 4).cast("int"))}
    of = F.array(*[F.struct(F.lit(t).alias("target"), x.alias("label")) for t, x in of.items()])
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.explode(of).alias("t")).select(
        "sample_id", "t.target", "t.label")


def letters(spark, sf) -> DataFrame:
    """Raw letters per order, with the codes that are no class mixed in by price."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    raw = (F.when(price >= 480000, "ESBL").when(price >= 440000, "R*").when(price >= 420000, "EBL?")
           .when(status == "F", "R").when(status == "O", "S").otherwise("I"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("antibiotic"),
                                             raw.alias("raw"))


def amr_wide(spark, sf) -> DataFrame:
    wide = (letters(spark, sf).groupBy("o_custkey").pivot("antibiotic", ANTIBIOTICS).agg(F.max("raw")))
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = wide.join(people, F.col("o_custkey") == F.col("c_custkey"))
    sample = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x"), F.col("o_custkey"))).otherwise(
        F.concat(F.col("o_custkey"), F.lit(".0")))
    return rows.select(sample.alias("Muestra"), F.col("c_mktsegment").alias("Origen"),
                       *[F.col(f"`{a}`").alias(f"{a} Interpretación") for a in ANTIBIOTICS])


def amr(spark, sf) -> DataFrame:
    sir = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "S").otherwise("I")
    return table(spark, sf, "orders").select(pad8("o_custkey").alias("extern_id"), "o_orderkey",
                                             F.col("o_orderpriority").alias("antibiotic"), sir.alias("sir"))


def matches(spark, sf) -> DataFrame:
    """Up to three matches per order, in line order; lines with some tax rates get an odd pattern."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = (F.when(F.col("l_tax") == 0.01, F.concat("p_name", F.lit("-x"))).when(F.col("l_tax") == 0.02, "genus sp.")
            .when(F.col("l_tax") == 0.03, "oneword").otherwise(F.col("p_name")))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", name.alias("pattern"), (F.col("l_quantity") / 20).alias("score"), "l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "pattern", "score", "l_returnflag")
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 3)
    packed = first.groupBy("l_orderkey").agg(
        F.min_by("l_returnflag", "n").alias("target_position"),
        F.array_sort(F.collect_list(F.struct("n", "pattern", "score"))).alias("m"))
    return packed.select(
        pad8("l_orderkey").alias("extern_id"), "target_position",
        F.transform("m", lambda x: F.struct(x["pattern"].alias("pattern"), x["score"].alias("score"))).alias("matches"))


def catalog(spark, sf) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    replicate = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise("3")
    return rows.select(
        F.col("c_mktsegment").alias("dataset"), F.year("o_orderdate").alias("year"), F.col("r_name").alias("genus"),
        F.col("n_name").alias("species"), pad8("o_custkey").alias("extern_id"),
        F.col("o_orderpriority").alias("target_position"), replicate.alias("replicate"),
        F.col("o_orderkey").cast("string").alias("path"))


def members(spark, sf) -> DataFrame:
    """Archive member paths: the files of every catalog row, and the folder entry of those with replicate 1."""
    rows = catalog(spark, sf).filter(F.col("dataset") == "MACHINERY")
    folder = F.concat_ws("/", F.col("year").cast("string"), F.col("genus"), F.col("extern_id"),
                         F.concat(F.lit("0_"), F.col("target_position")))
    paths = F.when(F.col("replicate") == "1", F.array(F.concat(folder, F.lit("/")), F.concat(folder, F.lit("/1/1SLin/fid")))
                   ).otherwise(F.array(F.concat(folder, F.lit("/"), F.col("replicate"), F.lit("/1SLin/fid"))))
    return rows.select(F.lit("a").alias("archive"), F.explode(paths).alias("member"))


def blobs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"),
                                                F.col("text").cast("binary").alias("fid"))


def predictions(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
