"""Quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages; only the document has a label. Every passage is encoded, a gated attention weighs the
passages, and the weighted mean of their codes is scored:

    h = tanh(x W + b)    a = softmax(w . (tanh(h V) * sigmoid(h U)))    score = sigmoid(c . sum(a h) + d)

All parameters are learned together from document labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import bytes_of, chunks, free_names, held_out, word_hashes, words

PASSAGE_WORDS = 48
BUCKETS = 48
PLAIN = 14
WIDTH = PLAIN + BUCKETS
CODE, GATE = 24, 12

_KIND = np.zeros(256, np.int64)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 white, 5 full stop or comma, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[[44, 46]] = 4, 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (``PASSAGE_WORDS`` words, the last one shorter) and where each text's begin.

    Shares of kinds of bytes, word lengths, repeated words, runs of one byte, line ends, and a bag of hashed words. A text
    without words is one passage of zeros.
    """
    starts, ends, of = words(data, offsets)
    n_words = np.diff(of)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    first_passage = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first_passage[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return x, first_passage
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts)) - of[text_of]
    passage = first_passage[text_of] + place // PASSAGE_WORDS
    edges = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    rows = passage[edges]
    size = np.diff(np.concatenate([edges, [len(starts)]]))
    begin = starts[edges]
    finish = ends[np.concatenate([edges[1:], [len(starts)]]) - 1]
    length = np.maximum(finish - begin, 1)
    for kind in range(7):
        seen = np.concatenate([[0], np.cumsum(_KIND[data] == kind)])
        x[rows, kind] = (seen[finish] - seen[begin]) / length
    same = np.zeros(len(data), np.int64)
    same[1:] = data[1:] == data[:-1]
    for column, values in ((7, same), (8, data == 10)):
        seen = np.concatenate([[0], np.cumsum(values)])
        x[rows, column] = (seen[finish] - seen[begin]) / length
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    x[rows, 9] = np.add.reduceat(again, edges) / size
    order = np.lexsort((hashes, passage))
    new = np.ones(len(hashes), np.int64)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[rows, 10] = np.add.reduceat(new, edges) / size
    lengths = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(lengths, edges) / size
    x[rows, 11] = mean / 10
    x[rows, 12] = np.sqrt(np.maximum(np.add.reduceat(lengths ** 2, edges) / size - mean ** 2, 0)) / 10
    x[rows, 13] = np.log1p(size) / 4
    bags = np.bincount(passage * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS)
    x[:, PLAIN:] = np.sqrt(bags.reshape(total, BUCKETS) / PASSAGE_WORDS)
    return x, first_passage


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    top = np.maximum.reduceat(e, first[:-1])
    n = np.diff(first)
    a = np.exp(e - np.repeat(top, n))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ m["c"] + m["d"])))}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 7) -> dict:
    """Parameters learned by mini-batch Adam on the log loss of document labels."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = {"mean": x.mean(axis=0).astype(np.float64), "scale": x.std(axis=0).astype(np.float64) + 1e-2,
         "W": start(x.shape[1], CODE), "b": np.zeros(CODE), "V": start(CODE, GATE), "U": start(CODE, GATE),
         "w": start(GATE), "c": start(CODE), "d": np.array(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))}
    names = ["W", "b", "V", "U", "w", "c", "d"]
    one, two = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at:at + batch]
            n = first[docs + 1] - first[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            f = np.concatenate([[0], np.cumsum(n)])
            xb = ((x[rows] - m["mean"]) / m["scale"])
            r = _forward(m, x[rows], f)
            dl = (r["p"] - y[docs]) / len(docs)
            dz = dl[:, None] * m["c"]
            each = np.repeat(dz, n, axis=0)
            da = (each * r["h"]).sum(axis=1)
            de = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, f[:-1]), n))
            dt, ds = de[:, None] * m["w"] * r["s"] * (1 - r["t"] ** 2), de[:, None] * m["w"] * r["t"] * r["s"] * (1 - r["s"])
            dh = (each * r["a"][:, None] + dt @ m["V"].T + ds @ m["U"].T) * (1 - r["h"] ** 2)
            grad = {"W": xb.T @ dh, "b": dh.sum(axis=0), "V": r["h"].T @ dt, "U": r["h"].T @ ds,
                    "w": (r["t"] * r["s"]).T @ de, "c": r["z"].T @ dl, "d": np.array(dl.sum())}
            step += 1
            pace = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k in names:
                g = grad[k] + decay * m[k] * (k not in ("b", "d"))
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m[k] = m[k] - pace * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def _bags(batch_texts: pa.Array):
    """(first text, after last, features, passage starts) over ranges of whole texts."""
    data, offsets = bytes_of(batch_texts)
    for first, after in chunks(offsets):
        own = offsets[first:after + 1]
        x, starts = passages(data[own[0]:own[-1]], own - own[0])
        yield first, after, x, starts


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = 3000, longest: int = 100_000, **fitting) -> dict | None:
    """Model from at most ``sample`` labelled texts of at most ``longest`` characters; None without any.

    The sample has the labelled rows with the lowest hash of their id. Passages are encoded in Spark's tasks; the bounded
    features are fitted in one task, which returns the parameters (a few kilobytes). Of several labels for one id the most
    frequent counts (1 at a tie); null labels do not count.
    """
    votes = (labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y")))
    body = F.col(text).cast("string")
    rows = (docs.filter(body.isNotNull() & (F.char_length(body) <= longest))
            .select(F.col(id_column).alias("_id"), body.alias("_text")))
    drawn = (rows.select("_id").join(votes, "_id").withColumn("_draw", F.xxhash64(F.col("_id").cast("string")))
             .orderBy("_draw", "_id").limit(sample).select("_id", "_y").distinct())
    picked = rows.join(F.broadcast(drawn), "_id")  # at most ``sample`` ids

    def encode(batches):
        for batch in batches:
            for first, after, x, starts in _bags(batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, after - first), batch.column(1).slice(first, after - first),
                     pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())],
                    ["_id", "_y", "_x"])

    def train(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True)
        frame = frame.sort_values(["_id", "_x"])  # the same order whichever task came first
        bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in frame["_x"]]
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        model = fit(np.concatenate(bags), first, frame["_y"].to_numpy(np.float64), **fitting)
        for name, value in model.items():
            yield pd.DataFrame({"name": [name], "shape": [list(value.shape)], "value": [value.astype(np.float64).ravel().tolist()]})

    kind = docs.schema[id_column].dataType.simpleString()
    encoded = picked.select("_id", "_y", "_text").mapInArrow(encode, f"_id {kind}, _y int, _x binary")
    # A shuffle: scan, join and encoding stay spread; one task gets the bounded sample only.
    found = encoded.repartition(1).mapInPandas(train, "name string, shape array<int>, value array<double>").collect()
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in found} or None


def score(docs: DataFrame, model: dict | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every whole text, from 0 to 1: id, ``score``. A null text counts as empty; without a model all are 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for first, after, x, starts in _bags(batch.column(1)):
                    out[first:after] = _forward(model, x, starts)["p"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_column, "score"])
    return docs.select(id_column, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, score double")


def accepted(docs: DataFrame, model: dict | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores ``threshold`` or more; all rows without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for first, after, x, starts in _bags(batch.column(batch.num_columns - 1)):
                good[first:after] = _forward(shared.value, x, starts)["p"] >= threshold
            yield batch.filter(pa.array(good)).select(range(batch.num_columns - 1))
    return docs.withColumn(free_names(docs, "_text")[0], F.col(text).cast("string")).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = 0.7, **learning) -> DataFrame:
    """Learn from labels of rows that are not held out, score all: id, ``held_out``, ``score``, ``predicted``."""
    model = learn(docs.filter(~held_out(F.col(id_column))), labels, id_column, text, label, **learning)
    return score(docs, model, id_column, text).select(
        id_column, held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
