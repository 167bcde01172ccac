"""Near duplicates by an inverted join on MinHash signature coordinates.

A text's signature has ``COORDINATES`` values. Each (coordinate, value) is a posting key. Two sets of similarity 0.75 agree in
48 of 64 coordinates on average and in fewer than ``MATCHES`` with probability 1e-7, so pairs below that count are skipped:

* Prefix: keys are ordered from rare to common. Two texts with ``MATCHES`` common keys share one among the first
  64 - MATCHES + 1 of each. Keys of one text only join nothing, yet take places in the prefix; a text with fewer than
  ``MATCHES`` shared keys is done.
* Skip: pairs that are connected already need no count. Postings are first joined with one member of their key (linear);
  what falls into one component is skipped. Only keys that still hold several components are searched in full: short ones
  as pairs, long ones in tiles of two bounded blocks that return a spanning forest, never the pairs.

Collisions are counted over whole signatures, and links confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import WHITE, free_names, keep, maybe_broadcast, mix
from peakforge.llm.components import components
from peakforge.llm.shingles import shingle_sets

COORDINATES = 64
MATCHES = 30
SHORT = 48  # keys with at most so many members are searched as pairs
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
STAR_ROUNDS = 2

_DRAWS = np.random.Generator(np.random.PCG64(10))
_FACTORS = _DRAWS.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _DRAWS.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_EMPTY = np.zeros(COORDINATES, np.uint32)


def signature(members: np.ndarray) -> np.ndarray:
    low = None
    for at in range(0, len(members), 1024):
        part = (members[at:at + 1024, None] * _FACTORS + _SHIFTS).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return _EMPTY if low is None else (low >> np.uint64(32)).astype(np.uint32)


def _mark(members: np.ndarray) -> bytes:
    """128 bits that name a set: two sums over differently mixed members."""
    total = [int(mix(members ^ np.uint64(c)).sum(dtype=np.uint64)) for c in (0x51ED, 0xA17E)]
    return (total[0] ^ len(members)).to_bytes(8, "big") + total[1].to_bytes(8, "big")


def _signed(docs: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, marks, sigs = [], [], []
            for members in shingle_sets(batch.column(1), size):
                n.append(len(members))
                marks.append(_mark(members))
                sigs.append(signature(members).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(marks, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES),
                                          pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32)))],
                ["_id", "th", "n", "mark", "sig"])
    body = F.col(text).cast("string")
    return docs.select(id_column, body.alias("_text"), F.xxhash64(body).alias("_th")).mapInArrow(
        run, f"_id {kind}, th long, n long, mark binary, sig array<int>")


def _members(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(``c``, ``n``, ``members``) of the wanted classes (``c``, ``_id``, ``th``, ``mark``), from one text of each."""
    def run(batches):
        for batch in batches:
            c, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, members in enumerate(shingle_sets(batch.column(2), size)):
                if _mark(members) == marks[i]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c[i]], pa.int64()), pa.array([len(members)], pa.int64()),
                         pa.array([members.view(np.int64)], pa.list_(pa.int64()))], ["c", "n", "members"])
    body = F.col(text).cast("string")
    texts = docs.select(F.col(id_column).alias("_own"), body.alias("_text"), F.xxhash64(body).alias("_th"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("th"))
    found = texts.join(maybe_broadcast(wanted, 48), same).select("c", "mark", "_text")
    return found.mapInArrow(run, "c long, n long, members array<long>").dropDuplicates(["c"])


def _similar(percent: int):
    both = F.col("n_a") + F.col("n_b")
    return 100 * F.col("common") >= percent * (both - F.col("common"))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b): those with enough collisions whose full sets are similar."""
    sig = classes.select("c", "n", "sig")
    left = sig.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = sig.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    hits = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    counted = pairs.join(right, "b").join(left, "a").filter(fits & (hits >= MATCHES)).select("a", "b", "n_a", "n_b")
    other = sets.select(F.col("c").alias("b"), F.col("members").alias("members_b"))
    center = sets.select(F.col("c").alias("a"), F.col("members").alias("members_a"))
    return (keep(counted).join(other, "b").join(center, "a")
            .withColumn("common", F.size(F.array_intersect("members_a", "members_b")))
            .filter(_similar(percent)).select("a", "b"))


def _tile(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of two blocks of one key, within and between them, that join different components, as a spanning forest."""
    frame = frame.sort_values("c").drop_duplicates("c")
    c, comp = frame["c"].to_numpy(), frame["label"].to_numpy()
    sets = list(frame["members"])
    n = np.array([len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    both = times[at] > 1  # a shingle of one text only is common to no pair
    values, at = np.unique(at[both], return_inverse=True)
    row = row[both]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for first in range(0, len(values), 8192):
        span = slice(*np.searchsorted(at, [first, first + 8192]))
        has = np.zeros((len(sets), 8192), np.float32)
        has[row[span], at[span] - first] = 1
        common += has @ has.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    linked &= comp[:, None] != comp[None, :]
    root = {v: v for v in comp.tolist()}

    def find(v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((c[i], c[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _searched(live: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members (key, c, n, label) of keys that hold several components."""
    size = live.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    sized = keep(live.join(size, "key"))
    short = sized.filter(F.col("size") <= SHORT).select("key", "c", "n", "label")
    a, b = short.select("key", *[F.col(x).alias(x + "_a") for x in ("c", "n", "label")]), short
    pairs = (a.join(b, "key").filter((F.col("c_a") < F.col("c")) & (F.col("label_a") != F.col("label"))
                                     & (100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")))
             .select(F.col("c_a").alias("a"), F.col("c").alias("b")).distinct())
    links = _confirmed(pairs, classes, sets, percent)

    long = sized.filter(F.col("size") > SHORT)
    if long.isEmpty():
        return links
    grouped = _together(long)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = (grouped.withColumn("blocks", blocks)
              .withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1),
                                                      lambda x: (x != F.col("own")) | (F.col("blocks") == 1))))
              .select("group", "c", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    tiles = placed.join(sets.select("c", "members"), "c")
    return links.unionByName(tiles.groupBy("group", "i", "j").applyInPandas(lambda f: _tile(f, percent), "a long, b long"))


def _together(long: DataFrame) -> DataFrame:
    """Rows (``group``, c, label, size, total) within which all pairs are compared, from long keys.

    Copies of one text share dozens of keys with nearly the same members. Keys connected by members are searched as one group if
    that takes fewer pairs than key by key; either way every pair under a key is compared. The connections are contracted before
    components are sought: a text only links its keys (a bounded prefix) in one common order, and texts with the same keys give the same links.
    """
    listed = long.groupBy("c").agg(F.sort_array(F.collect_set("key")).alias("keys")).filter(F.size("keys") > 1).select("keys").distinct()
    rest = F.size("keys") - 1
    steps = F.explode(F.arrays_zip(F.slice("keys", F.lit(1), rest).alias("a"), F.slice("keys", F.lit(2), rest).alias("b")))
    chains = listed.select(steps.alias("s")).select("s.a", "s.b").distinct()
    cluster = components(chains).select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    member = keep(long.join(cluster, "key", "left").withColumn("cluster", F.coalesce("cluster", "key")))
    once = member.select("cluster", "c", "n", "label").distinct()
    whole = once.groupBy("cluster").agg(F.count(F.lit(1)).alias("union"), F.sum("n").alias("union_total"))
    whole = keep(member.groupBy("cluster").agg(F.sum("size").alias("pairs")).join(whole, "cluster"))
    merged = F.col("union") * F.col("union") <= F.col("pairs")
    one = (once.join(whole.filter(merged), "cluster")
           .select(F.concat(F.lit("c"), "cluster").alias("group"), "c", "label", F.col("union").alias("size"),
                   F.col("union_total").alias("total")))
    each = (member.join(whole.filter(~merged).select("cluster"), "cluster")
            .select(F.concat(F.lit("k"), "key").alias("group"), "c", "label", "size", "total"))
    return one.unionByName(each)


def _labelled(docs: DataFrame, id_column: str, text: str, size: int, percent: int) -> DataFrame:
    """(``_id``, ``th`` the hash of the text, ``n``, ``label`` of the component, ``component_id``); no label for an empty set."""
    rows = keep(_signed(docs, id_column, text, size))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "th")).alias("first")
    classes = keep(rows.filter("n > 0").groupBy("mark").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig"))
                   .select("mark", "first._id", "first.th", "n", "sig").withColumn("c", F.monotonically_increasing_id()))
    keys = classes.select("c", "n", F.posexplode("sig").alias("at", "value")).select(
        "c", "n", F.col("at").cast("long").bitwiseOR(F.shiftleft(F.col("value").cast("long"), 8)).alias("key"))
    shared = keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    ordered = (keys.join(shared, "key").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
               .filter(F.size("keys") >= MATCHES))
    postings = ordered.select("c", "n", F.explode(F.slice("keys", 1, F.size("keys") - MATCHES + 1)).alias("k")).select(
        "c", "n", F.col("k.key").alias("key"))
    postings = keep(postings)
    postings = postings.join(postings.groupBy("key").count().filter("count > 1").select("key"), "key")
    live = keep(postings.withColumn("label", F.col("c")))
    wanted = keep(live.select("c").distinct().join(classes.select("c", "_id", "th", "mark"), "c"))
    sets = keep(_members(docs, wanted, id_column, text, size))
    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            order = F.struct(F.xxhash64("c", F.lit(turn)), "c", "label")
            heads = live.groupBy("key").agg(F.min(order).alias("head")).select("key", F.col("head.c").alias("h"), F.col("head.label").alias("l"))
            pairs = (live.join(heads, "key").filter(F.col("label") != F.col("l"))
                     .select(F.col("h").alias("a"), F.col("c").alias("b")).distinct())
            found = _confirmed(pairs, classes, sets, percent)
        else:
            found = _searched(live, classes, sets, percent)
        links = keep(found if links is None else links.unionByName(found))
        labels = components(links)
        if turn < STAR_ROUNDS:
            now = (live.drop("label").join(labels.withColumnRenamed("node", "c"), "c", "left")
                   .withColumn("label", F.coalesce("label", "c")))
            mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
            live = keep(now.join(mixed, "key"))
    of = (classes.select("c", "mark", "_id").join(labels.withColumnRenamed("node", "c"), "c", "left")
          .withColumn("label", F.coalesce("label", "c")))
    low = of.groupBy("label").agg(F.min("_id").alias("component_id"))
    of = keep(of.join(low, "label").select("mark", "label", "component_id"))
    out = rows.select("_id", "th", "n", "mark").join(of, "mark", "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select("_id", "th", "n", "label", component.alias("component_id"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5,
                    percent: int = 75) -> DataFrame:
    """Components of texts linked by ``100 * |intersection| >= percent * |union|`` of their shingle sets.

    One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the smallest id reachable), ``kept`` (that id is the row's own).
    Null, empty and white texts have no shingles and are their own component; so is a row without an id among such, kept with
    a null ``component_id``. Repeated rows share a component; equal ids with different texts are different texts. Other
    columns are not read.
    """
    found = _labelled(docs, id_column, text, size, percent)
    return found.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
                        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component, all columns: that with the smallest id (rows without an id come last).

    Texts without shingles are no copies of anything and all stay. Of rows that repeat an id and text one stays.
    """
    found = _labelled(docs, id_column, text, size, percent)
    th, keep_id, keep_th, r, rh = free_names(docs, "_th", "_keep_id", "_keep_th", "_r", "_rh")
    best = F.min(F.struct(F.col("_id").isNull(), "_id", "th")).alias("best")
    chosen = keep(found.filter("n > 0").groupBy("label").agg(best)
                  .select(F.col("best._id").alias(keep_id), F.col("best.th").alias(keep_th)))
    body = F.col(text).cast("string")
    keyed = docs.withColumn(th, F.xxhash64(body))
    same = F.col(id_column).eqNullSafe(F.col(keep_id)) & (F.col(th) == F.col(keep_th))
    out = keyed.join(maybe_broadcast(chosen, 24), same, "left_semi")
    empty = F.coalesce(F.length(F.btrim(body, F.lit(WHITE))), F.lit(0)) == 0
    repeated = keep(keyed.filter(~empty).select(F.col(id_column).alias(r), F.col(th).alias(rh)).groupBy(r, rh)
                    .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(r, rh))
    if not repeated.isEmpty():
        again = F.col(id_column).eqNullSafe(F.col(r)) & (F.col(th) == F.col(rh))
        copies = maybe_broadcast(repeated, 24)
        out = out.join(copies, again, "left_anti").unionByName(
            out.join(copies, again, "left_semi").dropDuplicates([id_column, th]))
    return out.unionByName(keyed.filter(empty)).drop(th)
