"""Distributed row numbers: exact ranks without a window over a whole class.

Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the sizes of the partitions before
them. A class that holds most of the rows is therefore spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.session import cut_lineage


def ranked(df: DataFrame, order: list, by: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0) in the given order, within each value of ``by``. The order must end in a unique column."""
    names, extra = [], {}
    for i, c in enumerate(order):
        if isinstance(c, str):
            names.append(c)
        else:
            extra[f"_o{i}"] = c
            names.append(f"_o{i}")
    group = by or "_all"
    if by is None:
        extra["_all"] = F.lit(0)
    placed = df.withColumns(extra) if extra else df
    placed = placed.repartitionByRange(group, *names).sortWithinPartitions(group, *names)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    starts = placed.groupBy(part.alias("_part"), group).agg(
        F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy(group, "_part").collect()
    shift, seen = [], {}
    for r in starts:
        before = seen.get(r[group], 0)
        shift.append((r["_part"], r[group], before - r["first"]))
        seen[r[group]] = before + r["n"]
    kind = placed.schema[group].dataType.simpleString()
    # One row per (partition, group value): as many as the shuffle has partitions.
    table = df.sparkSession.createDataFrame(shift, f"_part long, {group} {kind}, _shift long")
    out = (placed.withColumn("_part", part).join(F.broadcast(table), ["_part", group])
           .withColumn("rank", F.col("_at") + F.col("_shift")))
    return out.drop("_part", "_shift", "_at", *extra)


def smallest(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in the given total order, kept distributed."""
    return ranked(df, order).filter(F.col("rank") < n).drop("rank")


def lowest(df: DataFrame, draw: Column, counts: dict, by: str = "label", id_column: str = "sample_id") -> Column:
    """Condition that holds for exactly ``counts[c]`` rows of every class c: those with the lowest (draw, id).

    Only ids and draws are sorted and stored. The rows themselves are neither shuffled nor copied: they are compared with one
    boundary per class.
    """
    slim = df.select(id_column, by, draw.alias("_u"))
    placed = ranked(slim, ["_u", id_column], by=by)
    wanted = F.lit(False)
    for c, n in counts.items():
        wanted = wanted | ((F.col(by) == c) & (F.col("rank") == n))
    edges = {r[by]: r for r in placed.filter(wanted).collect()}
    out = None
    for c in counts:
        below = F.lit(counts[c] > 0) if c not in edges else (draw < edges[c]["_u"]) | (
            (draw == edges[c]["_u"]) & (F.col(id_column) < edges[c][id_column]))
        out = (F.when if out is None else out.when)(F.col(by) == c, below)
    return out.otherwise(False)


def quantile(df: DataFrame, column: str, q: float, n: int, id_column: str = "sample_id") -> float:
    """Exact linearly interpolated quantile of one column over ``n`` rows."""
    at = (n - 1) * q
    low = int(at)
    rows = {r["rank"]: r[column] for r in ranked(df.select(id_column, column), [column, id_column])
            .filter(F.col("rank").isin([low, min(low + 1, n - 1)])).collect()}
    return rows[low] + (at - low) * (rows[min(low + 1, n - 1)] - rows[low])
