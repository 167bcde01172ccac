"""Joins of all blocks of two sides on a grid of tiles.

Blocks are numbered in their packed order and taken together in groups of bounded size. A tile is a pair of a left and a right
group. Every right block is copied once per left group that needs it and every left block once per right group, so with p tiles of a
square grid a side crosses the shuffle sqrt(p) times, where a table of block pairs would carry both payloads p times over. A task
holds the right blocks of one tile and streams the left blocks past them: what is computed for a left row is combined
inside the tile (sums, the best k so far) before it leaves the task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.operators.blocks import BLOCK_BYTES
from peakforge.operators.ranking import ranked
from peakforge.session import n_parts

GROUP_BLOCKS = 32  # blocks of a group, if they are full ones: at most so many bytes are held by a task
SIDE = 16  # groups of a side, while groups are below that bound: enough tiles for all cores, few copies


def _group_size(blocks: DataFrame) -> int:
    """A ``SIDE``th of the blocks, as far as a task may hold them. So smaller blocks do not mean more copies."""
    n, largest = blocks.agg(F.count(F.lit(1)), F.max(F.octet_length("data"))).first()
    return max(1, min(-(-n // SIDE), GROUP_BLOCKS * BLOCK_BYTES // max(largest or 1, 1)))


def in_groups(blocks: DataFrame, size: int | None = None) -> DataFrame:
    """``blocks`` with ``group``: consecutive blocks, ``size`` of them."""
    at = ranked(blocks.select("block"), ["block"]).select("block", F.expr(f"rank div {size or _group_size(blocks)}").alias("group"))
    return blocks.join(at, "block")


def n_groups(blocks: DataFrame) -> int:
    return (blocks.agg(F.max("group")).first()[0] + 1) if not blocks.isEmpty() else 0


def _sides(left: DataFrame, right: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tile (``i``, ``j``), once per tile that they belong to."""
    if wanted is None:
        n_left, n_right = n_groups(left), n_groups(right)
        if not n_left or not n_right:
            return left.limit(0).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}), right.limit(0).withColumns(
                {"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        return (left.withColumn("i", F.col("group")).withColumn("j", every(n_right)),
                right.withColumn("j", F.col("group")).withColumn("i", every(n_left)))
    tiles = left.select("block", F.col("group").alias("i")).join(wanted.withColumnsRenamed({"lblock": "block", "rgroup": "j"}), "block")
    return (left.join(tiles, "block"), right.withColumn("j", F.col("group")).join(tiles.select("i", "j").distinct(), "j"))


def meet(left: DataFrame, right: DataFrame, schema: str, evaluate, left_columns: list[str], right_columns: list[str],
         wanted: DataFrame | None = None, prepare=lambda held: held) -> DataFrame:
    """``evaluate(left block, right blocks)`` gives a RecordBatch, for every left block and every right group it meets.

    Blocks are passed as dicts of Arrow scalars (``block``, ``n`` and the columns asked for). ``wanted`` limits the tiles to its rows
    (``lblock``, ``rgroup``); without it every left block meets every right group. ``prepare(right blocks)`` is called once a tile,
    and ``evaluate`` gets what it returns.
    """
    kinds = {f.name: f.dataType for f in [*left.schema, *right.schema]}
    columns = ["block", "n", *dict.fromkeys([*left_columns, *right_columns])]

    def side(df, number, own):
        return df.select("i", "j", F.lit(number).alias("side"), *[
            F.col(c) if c in ("block", "n", *own) else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    a, b = _sides(left, right, wanted)
    both = side(b, 0, right_columns).unionByName(side(a, 1, left_columns))
    # A fixed number: merged by their few bytes, tiles would leave cores without work.
    placed = both.repartition(n_parts(left.sparkSession), "i", "j").sortWithinPartitions("i", "j", "side", "block")

    def run(batches):
        tile, held, ready = None, [], None
        for batch in batches:
            at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                here = (at["i"][r].as_py(), at["j"][r].as_py())
                if here != tile:
                    tile, held, ready = here, [], None
                row = {c: at[c][r] for c in columns}
                if at["side"][r].as_py() == 0:
                    # a copy: a slice would keep the whole batch it came in
                    held.append({c: pa.scalar(v.as_py(), v.type) if c in right_columns else v for c, v in row.items()})
                    continue
                if held:  # the tile's last right block has come
                    ready, held = prepare(held), []
                if ready is not None:
                    yield evaluate(row, ready)
    return placed.mapInArrow(run, schema)
