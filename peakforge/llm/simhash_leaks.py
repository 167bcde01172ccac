"""Benchmark passages in texts: SimHash of item-sized windows, multi-index search, exact verification. Column functions only.

A window has as many words as an item. Its fingerprint is the majority of its shingles' hashes, bit by bit. The 64 bits are
cut into eight blocks: two fingerprints within ``RADIUS`` = 23 bits differ by at most two bits in some block, so an item is
posted under every block value within two bits, and no fingerprint within the radius is missed. Similarity 0.75 means a
distance of 11 bits on average and of more than 23 with probability 3e-5. What is found is verified on the weighted
shingles themselves (a shingle counts as often as it occurs).

A window without any shingle of an item has similarity 0. Only windows that line up with a common shingle, and those up to
``SLACK`` words beside them (where words were put in or left out), are fingerprinted; a text without such a shingle has none.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import WHITE, free_names, keep, maybe_broadcast, sized_broadcast

SIZE = 5
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
SLACK = 2


def _words(text: Column) -> Column:
    body = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def _shingles(words: Column, k: int) -> Column:
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _marks(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("m0"), F.xxhash64(F.lit(1), text).alias("m1")]


def _common(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``common``: the size of the intersection of two multisets (arrays).

    Each becomes a set in which the j-th occurrence of a shingle is a member of its own. Sorted arrays and repeats are columns
    first, as a lambda would evaluate them per element.
    """
    rows = rows.withColumns({f"{x}_sorted": F.array_sort(x) for x in (a, b)})

    def repeats(x: str) -> Column:
        return F.filter(f"{x}_sorted", lambda s, i: (i > 0) & (F.get(f"{x}_sorted", i - 1) == s))

    def members(x: str) -> Column:
        again = F.transform(f"{x}_again", lambda s, i: F.xxhash64(s, i - F.array_position(f"{x}_again", s) + 2))
        return F.concat(F.transform(F.array_distinct(f"{x}_sorted"), lambda s: F.xxhash64(s, F.lit(0))), again)
    rows = rows.withColumns({f"{x}_again": repeats(x) for x in (a, b)})
    return rows.withColumn("common", F.size(F.array_intersect(members(a), members(b)))).drop(
        *[x + end for x in (a, b) for end in ("_sorted", "_again")])


def _fingerprints(rows: DataFrame, keys: list[str], shingles: str, most: int) -> DataFrame:
    """``keys`` and the majority bits of the shingle hashes, of which a row of ``shingles`` has at most ``most``.

    Each sum holds several counters: four of 16 bits where ``most`` is below 2^15, else two of 32 bits (no array has 2^31
    elements). Rows are summed before the shuffle.
    """
    one = rows.select(*keys, F.explode(shingles).alias("h"))
    width = 16 if most < 1 << 15 else 32
    per = 64 // width
    sums = []
    for q in range(width):
        few = F.shiftrightunsigned("h", per * q).bitwiseAND(F.lit((1 << per) - 1))
        lanes = few  # the j-th bit goes to the j-th counter
        for j in range(1, per):
            lanes = lanes.bitwiseOR(F.shiftleft(few, (width - 1) * j))
        sums.append(F.sum(lanes.bitwiseAND(F.lit(sum(1 << width * j for j in range(per))))).alias(f"s{q}"))
    counted = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for b in range(64):
        ones = F.shiftrightunsigned(f"s{b // per}", width * (b % per)).bitwiseAND(F.lit((1 << width) - 1))
        bits = bits.bitwiseOR(F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, bits.alias("print"))


def _block(fingerprint: str, block: Column) -> Column:
    return F.expr(f"shiftrightunsigned({fingerprint}, {BLOCK_BITS} * block)").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _flips(most: int) -> list[int]:
    """Every value of a block with at most so many bits set."""
    return [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(BLOCK_BITS), r)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
          item_text: str = "text", percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """Items found in texts: id, item, ``similarity`` (of the best window, the first at a tie), ``first_word``, ``n_words``.

    One row per row of ``docs`` and item with a window of weighted similarity ``percent`` / 100 or more; texts without any are
    absent. Texts are compared in lower case, as words between white space; items with fewer than five words as one shingle.
    A text shorter than an item is one window. Null, empty and white texts or items match nothing. Repeated rows and items
    give repeated findings once per row of ``docs`` and distinct item. Other columns are not read.
    """
    found = _found(docs, benchmark, text, item_column, item_text, percent, radius)
    own = docs.select(F.col(id_column), *_marks(F.col(text).cast("string")))
    return own.join(maybe_broadcast(found, 64), ["m0", "m1"]).drop("m0", "m1")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **search) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item. Null and empty texts hold none; repeated rows
    are kept or dropped alike; columns of any name are returned as they are."""
    found = keep(_found(docs, benchmark, text, **search).select("m0", "m1").distinct())
    own = free_names(docs, "_n0", "_n1")
    marked = docs.withColumns(dict(zip(own, _marks(F.col(text).cast("string")))))
    other = free_names(marked, "_m0", "_m1")
    found = maybe_broadcast(found.toDF(*other), 16)
    same = (F.col(own[0]) == F.col(other[0])) & (F.col(own[1]) == F.col(other[1]))
    return marked.join(found, same, "left_anti").drop(*own)


def _found(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text",
           percent: int = 75, radius: int = RADIUS) -> DataFrame:
    words = _words(F.col(item_text).cast("string"))
    items = benchmark.select(F.col(item_column).alias("item"), words.alias("words")).distinct().filter(F.size("words") > 0)
    items = items.withColumn("size", F.size("words")).withColumn("k", F.least(F.lit(SIZE), F.size("words")))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SIZE values
    shingles = F.array().cast("array<bigint>")
    for k in sizes:
        shingles = F.when(F.col("k") == k, _shingles(F.col("words"), k)).otherwise(shingles)
    items = keep(items.select("item", "size", "k", shingles.alias("shingles")).withColumn("number", F.monotonically_increasing_id()))
    posted = keep(items.select("size", F.posexplode("shingles").alias("at", "h")).distinct())

    body = F.col(text).cast("string")
    texts = docs.select(*_marks(body), _words(body).alias("words"))
    windows = None
    for k in sizes:
        hits = (texts.select("m0", "m1", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), k)).alias("p", "h"))
                .join(maybe_broadcast(posted.filter(F.least(F.lit(SIZE), F.col("size")) == k), 24), "h"))
        shift = F.explode(F.array(*[F.lit(d) for d in range(-SLACK, SLACK + 1)])).alias("d")
        starts = hits.select("m0", "m1", "n", "size", (F.col("p") - F.col("at")).alias("line")).distinct().select("*", shift)
        first = F.greatest(F.lit(0), F.least(F.col("line") + F.col("d"), F.col("n") - F.col("size")))
        places = keep(starts.select("m0", "m1", "size", first.alias("first")).distinct()
                      .groupBy("m0", "m1").agg(F.collect_list(F.struct("size", "first")).alias("places")))
        long = F.col("place.size") - F.lit(k - 1)
        own = (texts.join(sized_broadcast(places, 48 + 8 * F.size("places")), ["m0", "m1"])
               .select("m0", "m1", _shingles(F.col("words"), k).alias("all"), "places")
               .select("m0", "m1", "all", F.explode("places").alias("place"))
               .select("m0", "m1", "place.size", "place.first", F.slice("all", F.col("place.first") + 1, long).alias("shingles"))
               .dropDuplicates(["m0", "m1", "size", "first"]))
        windows = own if windows is None else windows.unionByName(own)
    if windows is None:
        kind = benchmark.schema[item_column].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"m0 long, m1 long, {item_column} {kind}, similarity double, first_word int, n_words int")
    windows = keep(windows)
    longest = items.agg(F.max(F.size("shingles"))).first()[0]
    prints = _fingerprints(windows, ["m0", "m1", "size", "first"], "shingles", longest)
    item_prints = _fingerprints(items, ["number", "size"], "shingles", longest).withColumnRenamed("print", "item_print")
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    flips = F.explode(F.array(*[F.lit(f).cast("long") for f in _flips(radius // BLOCKS)])).alias("flip")
    probes = keep(item_prints.select("*", block).select("*", flips).select(
        "number", "size", "item_print", "block", _block("item_print", F.col("block")).bitwiseXOR(F.col("flip")).alias("value")))
    near = (prints.select("*", block).withColumn("value", _block("print", F.col("block")))
            .join(maybe_broadcast(probes, 40), ["size", "block", "value"])
            .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
            .select("m0", "m1", "size", "first", "number").distinct())
    exact = (near.join(windows, ["m0", "m1", "size", "first"])
             .join(sized_broadcast(items.select("number", "item", F.col("shingles").alias("other")),
                                   64 + F.octet_length(F.coalesce(F.col("item").cast("string"), F.lit(""))) + 8 * F.size("other")), "number"))
    # Written before it is filtered: a filter would carry the sorting below into its lambdas.
    exact = keep(_common(exact, "shingles", "other").select(
        "m0", "m1", "item", "first", "size", "common", (F.size("shingles") + F.size("other") - F.col("common")).alias("all")))
    best = (exact.filter(100 * F.col("common") >= percent * F.col("all"))
            .withColumn("similarity", F.col("common") / F.col("all"))
            .groupBy("m0", "m1", "item").agg(F.min(F.struct(-F.col("similarity"), F.col("first"), F.col("size"))).alias("best")))
    return keep(best.select("m0", "m1", F.col("item").alias(item_column), (-F.col("best.col1")).alias("similarity"),
                            F.col("best.first").alias("first_word"), F.col("best.size").alias("n_words")))
