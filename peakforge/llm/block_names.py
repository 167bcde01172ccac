"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get integer
names in that order; then adjacent names are paired, the distinct pairs sorted and named, and so on until one name is left.
Two texts have the same last name on the same level if and only if they are equal: a name is given to one block or pair only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import keep, without_white

BLOCK_BYTES = 4096


def _named(keys: DataFrame) -> DataFrame:
    """An integer ``name`` for every distinct row, in sorted order.

    Rows are made distinct in the map tasks first, so a block that half of the texts share is sent once per task. Names
    carry the range in their upper bits: no counting pass, no single task.
    """
    columns = keys.columns
    return (keys.distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
            .withColumn("name", F.monotonically_increasing_id()))


def _stripped(text):
    return without_white(text).cast("binary")


def _blocks(data, block_bytes: int):
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(block_bytes)), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")),
                       lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _mark(block, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), block).alias("m0"), F.xxhash64(F.lit(seed + 1), block).alias("m1"))


def _block_level(docs: DataFrame, data: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the marks of their blocks, and the name of each mark.

    Names are sorted over the blocks themselves. Occurrences are joined to them by a 128-bit mark, so that texts are moved
    once only. The marks are checked over all distinct blocks: if two blocks share one, another seed is taken.
    """
    seed = 0
    while True:
        blocks = docs.select(F.explode(_blocks(F.col(data), block_bytes)).alias("block"))
        names = keep(_named(blocks).select(_mark(F.col("block"), seed).alias("mark"), "name").select("mark.*", "name"))
        if names.groupBy("m0", "m1").count().filter("count > 1").isEmpty():
            break
        seed += 2
    rows = docs.withColumn("_marks", F.transform(_blocks(F.col(data), block_bytes), lambda b: _mark(b, seed)))
    return rows, names


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (kept, without their text) with ``level`` and ``name``: equal exactly for equal texts.

    Null and empty texts are one empty block. Repeated rows get the same identity. A row number ``_row`` is added.
    """
    return _identities(docs.withColumn(text, _stripped(F.col(text))), text, block_bytes)


def _identities(docs: DataFrame, data: str, block_bytes: int) -> DataFrame:
    """``identities`` of rows whose ``data`` holds the text without white space, as bytes.

    A column, so that the white space is taken out once per row: the function of an array has its argument computed per block.
    """
    rows, names = _block_level(docs, data, block_bytes)
    rows = keep(rows.drop(data).withColumn("_row", F.monotonically_increasing_id()))
    longest = rows.agg(F.max(F.size("_marks"))).first()[0] or 0
    spread = rows.select("_row", F.size("_marks").alias("n"), F.posexplode("_marks").alias("i", "mark"))
    current = (spread.select("_row", "n", "i", "mark.*").join(names, ["m0", "m1"]).select("_row", "n", "i", "name"))
    done, level = [current.filter("n = 1").select("_row", F.lit(0).alias("level"), "name")], 0
    current = current.filter("n > 1")
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        even = F.col("i") % 2 == 0
        pairs = keep(current.groupBy("_row", "n", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")))
        names = keep(_named(pairs.select("left", "right")))
        current = pairs.join(names, ["left", "right"]).select("_row", F.shiftright(F.col("n") + 1, 1).alias("n"), "i", "name")
        done.append(current.filter("n = 1").select("_row", F.lit(level).alias("level"), "name"))
        current = current.filter("n > 1")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.drop("_marks").join(found, "_row")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of texts that are equal without white space; of each, the longest original with the smallest id stays.

    One row per row of ``docs``: id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256``, and the
    identity (``level``, ``name``). Null texts count as empty; rows without an id come after all others; rows that repeat an
    id and text are all kept or all dropped. Other columns of ``docs`` are not read.
    """
    slim = docs.select(F.col(id_column).alias("_id"), _stripped(F.col(text).cast("string")).alias("_data"),
                       F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).alias("_points"))
    slim = slim.withColumn("text_sha256", F.sha2("_data", 256))
    rows = keep(_identities(slim, "_data", block_bytes))
    best = rows.groupBy("level", "name").agg(
        F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"))
    best = best.select("level", "name", F.col("best._id").alias("keep_id"), "group_size")
    return (rows.join(best, ["level", "name"])
            .select(F.col("_id").alias(id_column), "keep_id", "group_size",
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "level", "name"))
