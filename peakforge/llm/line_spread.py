"""Boilerplate lines by the number of distinct sites that carry them.

A HyperLogLog sketch of sites per line hash, merged by aggregation, estimates every line's spread. Lines whose estimate is near
the threshold get an exact count of distinct sites, so every decision equals the exact one. Widespread lines leave the
texts in which they are the smaller part; a text that mostly consists of them is a copy of another, not a page with a
frame around it, and stays whole for the stage that looks for copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import SMALL_BYTES, WHITE, free_names, keep, maybe_broadcast

SITES = 10
SKETCH_BITS = 12  # standard error 1.6 %
MARGIN = 0.1  # estimates within this share of the threshold are counted exactly: six standard errors


def _marks(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("m0"), F.xxhash64(F.lit(1), text).alias("m1")]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """(``h``): hash of every line, without white space around it, that occurs on ``sites`` distinct sites or more.

    A null site is a site of its own. Every line that is more than white space counts, however short.
    """
    where = F.coalesce(F.col(site).cast("string"), F.lit("\0"))
    lines = (docs.select(where.alias("site"), F.explode(F.split(F.col(text).cast("string"), "\n")).alias("line"))
             .select("site", _trimmed(F.col("line")).alias("line")).filter("line <> ''"))
    hashed = lines.select("site", F.xxhash64("line").alias("h"))
    margin = max(1.0, sites * MARGIN)
    # A copy of a line on its own site adds nothing: pairs are distinct within a task before they are sketched.
    spread = hashed.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("spread"))
    spread = keep(spread.filter(F.col("spread") >= sites - margin))
    near = spread.filter(F.col("spread") <= sites + margin).select("h")
    exact = (lines.withColumn("h", F.xxhash64("line")).join(maybe_broadcast(near, 16), "h")
             .select("h", "line", "site").distinct().groupBy("h", "line").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= sites).select("h").distinct())
    return keep(spread.filter(F.col("spread") > sites + margin).select("h").unionByName(exact))


def without_spread_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs``, all columns, with widespread lines cut from ``text``; adds ``_n_lines`` and ``_n_cut``.

    A text is cut if the widespread lines hold less than half of its characters (without white space around lines). Null
    stays null, with 0 lines; empty texts have one line. Repeated rows are treated alike. Other columns of any name are
    returned as they are, but for two of the added names, which are replaced.
    """
    found = spread_lines(docs, text, site, sites)
    body = F.col(text).cast("string")
    lines = F.split(body, "\n")
    # Decisions are made once per distinct text, whatever the number of its copies.
    placed = (docs.select(*_marks(body), F.posexplode(lines).alias("at", "line"))
              .select("m0", "m1", "at", _trimmed(F.col("line")).alias("line"))
              .filter("line <> ''").select("m0", "m1", "at", F.xxhash64("line").alias("h")))
    hits = (placed.join(maybe_broadcast(found, 16), "h").groupBy("m0", "m1").agg(F.collect_set("at").alias("cut")))
    hits = keep(hits)
    size = hits.agg(F.sum(32 + 4 * F.size("cut"))).first()[0] or 0
    hits = F.broadcast(hits) if size <= SMALL_BYTES else hits
    m0, m1 = _marks(body)
    docs = docs.drop("_n_lines", "_n_cut")
    k0, k1, cut_at, do, new = free_names(docs, "_k0", "_k1", "_cut", "_do", "_new")
    joined = docs.withColumns({k0: m0, k1: m1}).join(
        hits.select(F.col("m0").alias(k0), F.col("m1").alias(k1), F.col("cut").alias(cut_at)), [k0, k1], "left")

    def chars(chosen: Column) -> Column:
        return F.aggregate(chosen, F.lit(0), lambda s, line: s + F.char_length(_trimmed(line)))
    cut_lines = F.filter(lines, lambda line, i: F.array_contains(cut_at, i))
    left_lines = F.filter(lines, lambda line, i: ~F.array_contains(cut_at, i))
    cut = F.col(cut_at).isNotNull() & (2 * chars(cut_lines) < chars(lines))
    out = joined.withColumn(do, F.coalesce(cut, F.lit(False)))
    out = out.withColumns({"_n_lines": F.when(body.isNull(), 0).otherwise(F.size(lines)),
                           "_n_cut": F.when(F.col(do), F.size(cut_at)).otherwise(0),
                           new: F.when(F.col(do), F.array_join(left_lines, "\n")).otherwise(body)})
    return out.select(*[F.col(new).alias(c) if c == text else F.col(c) for c in docs.columns], "_n_lines", "_n_cut")
