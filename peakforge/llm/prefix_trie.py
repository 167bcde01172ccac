"""The trie of all conversation prefixes, from sorted conversations and their longest common prefixes.

A conversation travels in segments of at most ``SEGMENT`` turns: one row per segment with the names of its turns (128 bits each, the turn's
number included) and the combined name of all turns before it, so no conversation is ever one row. Rows are range
partitioned and sorted by (turns before, names). In every Arrow batch of such rows the common prefix of neighbours goes into a
sparse table of range minima; each prefix that begins in the batch binary-searches, independently of all others, how far
to the left and to the right the minimum stays at its depth. That interval gives its members there. Prefixes that
go on in another batch or partition meet by name in one aggregation, so a first turn that a third of all conversations share is spread over
many tasks and costs one row per batch.

Sums over subtrees need no walk either: every node belongs to its smallest member. The nodes below a node are all nodes that its
members own, without those its own smallest member owns above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.common import keep

SEGMENT = 16
SUPER = 1024  # rows of one running total
CHUNK_CHARS = 1 << 16
NODE = ["depth", "h1", "h2"]


def numbered(df: DataFrame, conv: str, order: list[Column], near: list[Column]) -> DataFrame:
    """``df`` with ``pos`` (from 0, in ``order``) inside its conversation, and ``n_turns``.

    ``near`` are short columns that agree with the order; by them rows are dealt in ranges, so a conversation of any size is spread over
    tasks. Only one row per partition reaches the driver.
    """
    ranges = {f"_near{i}": c for i, c in enumerate(near)}
    sorts = {f"_sort{i}": c for i, c in enumerate(order)}
    placed = (df.withColumns({**ranges, **sorts}).repartitionByRange(conv, *ranges)
              .sortWithinPartitions(conv, *sorts).drop(*ranges, *sorts))
    placed = keep(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    shift, before = [], 0
    for row in placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        shift.append((row["_part"], before - (row["_part"] << 33)))
        before += row["n"]
    shifts = df.sparkSession.createDataFrame(shift, "_part long, _shift long")  # one row per partition
    at = (placed.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn("pos", F.col("_at") + F.col("_shift"))
          .drop("_part", "_shift", "_at"))
    first = at.groupBy(conv).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("n_turns"))
    return at.join(first, conv).withColumn("pos", F.col("pos") - F.col("_first")).drop("_first")


def _running(df: DataFrame, by: str, order: str, columns: list[str], total) -> DataFrame:
    """``df`` with ``before_<c>``: ``total`` of column c over the rows of the same ``by`` that come earlier.

    First inside stretches of ``SUPER`` values of ``order``, then over the stretches, so no task holds a long group.
    """
    cut = df.withColumn("_super", F.expr(f"{order} div {SUPER}"))
    inner = Window.partitionBy(by, "_super").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(by).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(by, "_super").agg(*[total(c).alias("_all_" + c) for c in columns])
    whole = whole.select(by, "_super", *[F.coalesce(total("_all_" + c).over(outer), F.lit(0)).alias("_far_" + c) for c in columns])
    near = cut.withColumns({"_near_" + c: F.coalesce(total(c).over(inner), F.lit(0)) for c in columns})
    joined = near.join(whole, [by, "_super"])
    both = {c: F.col("_near_" + c) + F.col("_far_" + c) if total is F.sum else F.col("_near_" + c).bitwiseXOR(F.col("_far_" + c))
            for c in columns}
    return joined.withColumns({"before_" + c: v for c, v in both.items()}).drop(
        "_super", *["_near_" + c for c in columns], *["_far_" + c for c in columns])


class RangeMinimum:
    """Sparse table over a list of whole numbers; ``minimum(a, b)`` of many non-empty ranges [a, b] at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))
        self.logs = np.zeros(len(values) + 1, np.int64)
        for k in range(1, len(self.levels)):
            self.logs[1 << k:] = k
        size = len(values)
        self.table = np.stack([np.concatenate([lv, np.full(size - len(lv), lv[-1], lv.dtype)]) for lv in self.levels]) if size else None

    def minimum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = self.logs[b - a + 1]
        return np.minimum(self.table[k, a], self.table[k, b - (1 << k) + 1])


def extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the stretch around row ``at`` whose neighbours share ``depth`` names (``lcp[i]``: rows i - 1 and i).

    Two binary searches per candidate over range minima; no candidate looks at another.
    """
    table, last = RangeMinimum(lcp), len(lcp) - 1
    low, high = at.copy(), np.full(len(at), last)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        good = np.zeros(len(at), bool)
        good[open_] = table.minimum(at[open_] + 1, middle[open_]) >= depth[open_]
        low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
    right = low
    low, high = np.zeros(len(at), np.int64), at.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        good = np.zeros(len(at), bool)
        good[open_] = table.minimum(middle[open_] + 1, at[open_]) >= depth[open_]
        low, high = np.where(open_ & ~good, middle + 1, low), np.where(open_ & good, middle, high)
    return low, right


def _lists(column: pa.Array, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, filled up with zeros, and the lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((m, width), np.int64)
    rows = np.repeat(np.arange(m), n)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def _block(batch: pa.RecordBatch, weights: tuple[str, ...]):
    """Per prefix that begins in this batch of sorted rows: its name, its interval's rows, smallest conversation and weights."""
    m = batch.num_rows
    get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    flat, n2 = _lists(get["names"], m, 2 * SEGMENT)
    sizes, _ = _lists(get["sizes"], m, SEGMENT)
    x1, x2, n = flat[:, 0::2], flat[:, 1::2], n2 // 2
    seg, p1, p2, conv = (get[c].to_numpy().astype(np.int64) for c in ("seg", "before_x1", "before_x2", "conv"))
    lcp = np.zeros(m, np.int64)
    if m > 1:
        same = (x1[1:] == x1[:-1]) & (x2[1:] == x2[:-1]) & (np.arange(SEGMENT) < np.minimum(n[1:], n[:-1])[:, None])
        same &= ((seg[1:] == seg[:-1]) & (p1[1:] == p1[:-1]) & (p2[1:] == p2[:-1]))[:, None]
        lcp[1:] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    fresh = n - lcp  # prefixes that no row above shares
    at = np.repeat(np.arange(m), fresh)
    depth = lcp[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(fresh) - fresh, fresh)
    left, right = extents(lcp, at, depth)
    name1 = np.concatenate([p1[:, None], p1[:, None] ^ np.bitwise_xor.accumulate(x1, axis=1)], axis=1)
    name2 = np.concatenate([p2[:, None], p2[:, None] ^ np.bitwise_xor.accumulate(x2, axis=1)], axis=1)
    out = {"depth": seg[at] * SEGMENT + depth, "h1": name1[at, depth], "h2": name2[at, depth]}
    if not weights:
        out |= {"g1": name1[at, depth - 1], "g2": name2[at, depth - 1], "size": sizes[at, depth - 1], "n": right - left + 1,
                "low": RangeMinimum(conv).minimum(left, right) if len(at) else conv[:0]}
    for w in weights:
        total = np.concatenate([[0], np.cumsum(get[w].to_numpy().astype(np.int64))])
        out[w] = total[right + 1] - total[left]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def _intervals(rows: DataFrame, *weights: str) -> DataFrame:
    """The prefixes of every batch of sorted rows, not yet merged over batches."""
    places = [F.col("seg"), F.col("before_x1"), F.col("before_x2")]
    # Ranges by the first turns and the conversation: short keys, and no prefix is too common to be split.
    placed = (rows.withColumn("_head", F.slice("names", 1, 4)).repartitionByRange(*places, "_head", "conv").drop("_head")
              .sortWithinPartitions(*places, "names", "conv"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _block(batch, weights)
    schema = "depth long, h1 long, h2 long, " + (", ".join(f"{w} long" for w in weights) or "g1 long, g2 long, size long, n long, low long")
    return placed.mapInArrow(run, schema)


def _segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and ``SEGMENT`` turns: names, sizes, and the combined name of the turns before."""
    rows = (turns.withColumn("seg", F.expr(f"pos div {SEGMENT}")).groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "x1", "x2", "size"))).alias("t"),
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.first("n_turns").alias("n_turns")))
    rows = rows.select("conv", "seg", "x1", "x2", "n_turns", F.flatten(F.transform("t", lambda t: F.array(t["x1"], t["x2"]))).alias("names"),
                       F.transform("t", lambda t: t["size"]).alias("sizes"))
    short = rows.filter(F.col("n_turns") <= SEGMENT).withColumns({"before_x1": F.lit(0).cast("long"), "before_x2": F.lit(0).cast("long")})
    long = _running(keep(rows.filter(F.col("n_turns") > SEGMENT)), "conv", "seg", ["x1", "x2"], F.bit_xor)
    columns = ["conv", "seg", "before_x1", "before_x2", "names", "sizes"]
    return keep(short.select(*columns).unionByName(long.select(*columns)))


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 per node of its conversations' ids, ascending, joined by commas.

    Ids are packed into pieces of bounded length in sorted ranges; the pieces of a node then pass one hash object in order, so
    a node at which very many conversations end is a stream, never a list.
    """
    def pack(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            ids = batch.column(3).to_pylist()
            out, first = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[first] or i - first >= CHUNK_CHARS // 16:
                    out.append((*keys[first], ids[first], ",".join(map(str, ids[first:i]))))
                    first = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out))],
                                                 [*NODE, "first", "ids"])

    def digest(batches):
        last, state = None, None

        def done(nodes):
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*nodes))[:3]],
                                               pa.array([n[3] for n in nodes], pa.string())], [*NODE, "ends_sha256"])
        for batch in batches:
            out = []
            for d, h1, h2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, h1, h2) == last:
                    state.update(b"," + ids.encode())
                else:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = (d, h1, h2), hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if last:
            yield done([(*last, state.hexdigest())])
    key = ", ".join(f"{c} long" for c in NODE)
    pieces = (ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
              .mapInArrow(pack, f"{key}, first long, ids string"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per distinct sequence of first turns (role, text), from the empty one (the root, depth 0).

    Members of a node are the conversations that start with its sequence; subtrees include their top. Columns: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id`` (the parent's ``conv_id``; null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (over the subtree: members less one, times UTF-8 bytes of the last text),
    ``ends_sha256`` (digest of the ids of members that end here, ascending, joined by commas).

    ``conversations`` (ids in column ``conv``) adds conversations without turns, which are members of the root only. Ids are whole numbers.
    Turns are ordered by ``turn``, null first; turns with equal numbers by role, then text, and repeated rows are turns of their own. Null
    role or text counts as empty. Rows without an id belong to no conversation and are left out. No conversation at all: no row. Other
    columns, whatever their names, are not read; texts and conversations may have any length. Turns are named by 128 bits.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    own = turns.filter(F.col(conv).isNotNull())
    own = own.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), role_.alias("_role"), text_.alias("_text"))
    digest = F.sha2(F.concat(F.char_length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256)
    own = own.withColumn("_key", F.unhex(F.substring(digest, 1, 32))).withColumn("size", F.octet_length("_text").cast("long"))
    head = F.substring(F.concat("_role", F.lit("\0"), F.col("_text")), 1, 24)
    placed = numbered(own, "conv", [F.col("_turn"), F.col("_role"), F.col("_text")], [F.col("_turn"), head])
    slim = placed.select("conv", "pos", "n_turns", "size", F.xxhash64("pos", "_key").alias("x1"), F.xxhash64("_key", "pos", F.lit(13)).alias("x2"))
    slim = keep(slim)
    ids = slim.select("conv")
    if conversations is not None:
        ids = ids.unionByName(conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv")))
    ends = (slim.groupBy("conv").agg(F.max("n_turns").alias("depth"), F.bit_xor("x1").alias("h1"), F.bit_xor("x2").alias("h2"))
            .unionByName(ids.distinct().select("conv", *[F.lit(0).cast("long").alias(c) for c in NODE]))
            .groupBy("conv").agg(F.max(F.struct("depth", "h1", "h2")).alias("e")).select("conv", "e.*"))
    ends = keep(ends)

    rows = _segments(slim)
    merged = _intervals(rows).groupBy(*NODE).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.first("g1").alias("g1"),
                                                 F.first("g2").alias("g2"), F.first("size").alias("size"))
    zero = F.lit(0).cast("long")
    root = (ends.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low")).filter("n > 0")
            .select(*[zero.alias(c) for c in NODE], "n", "low", *[F.lit(None).cast("long").alias(c) for c in ("g1", "g2")], zero.alias("size")))
    found = keep(merged.unionByName(root))
    children = (found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("h1"), F.col("g2").alias("h2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = keep(found.join(children, NODE, "left").fillna(0, ["n_children"])
                 .withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("size")))

    owned = nodes.groupBy(F.col("low").alias("conv")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    weighted = rows.join(owned, "conv", "left").fillna(0, ["leaf", "saved"])
    below = _intervals(weighted, "leaf", "saved").groupBy(*NODE).agg(F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved"))
    whole = nodes.agg(F.sum("leaf").alias("all_leaf"), F.sum("saved").alias("all_saved")).filter("all_leaf is not null")
    below = below.unionByName(whole.select(*[zero.alias(c) for c in NODE], "all_leaf", "all_saved"))
    # What the smallest member owns above the node: never a leaf.
    above = _running(nodes, "low", "depth", ["saved"], F.sum)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("low").alias("parent_conv_id"))
    out = (above.join(below, NODE).join(_end_digests(ends), NODE, "left").join(parents, ["depth", "g1", "g2"], "left"))
    return out.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("all_leaf").alias("n_leaves"), (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
