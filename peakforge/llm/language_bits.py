"""Language identification with one Bloom filter per language, sliced so that one lookup answers for all languages.

Slot s of the table holds one bit per language. The n-grams (four bytes of the lower-cased text, white space as one space) set
their slots when a language contains them. The AND of an n-gram's slots is the set of languages that may contain it. Over a
whole text the bits are counted per language; a filter that is full to a share f answers yes to f ** hashes of the n-grams it
never saw, and the counts are corrected for that before they decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.common import bytes_of, chunks, held_out

GRAM = 4
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
WORD = 63  # languages per table word


@dataclass(frozen=True)
class Filters:
    """Languages in order, ``table[word][slot]`` with a bit per language, and the share of false answers per language."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    hashes: int

    @property
    def slot_bits(self) -> int:
        return int(self.table.shape[1]).bit_length() - 1


def _prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case with a space on each side."""
    texts = pc.utf8_lower(pc.fill_null(column, ""))
    data, offsets = bytes_of(pc.binary_join_element_wise(" ", texts, " ", ""))
    data = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    return data, offsets


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that lie within one text, as 32-bit numbers, and where each text's begin (n + 1 values)."""
    wide = data.astype(np.uint32)
    n = max(len(wide) - GRAM + 1, 0)
    grams = np.zeros(n, np.uint32)
    for i in range(GRAM):
        grams = grams << np.uint32(8) | wide[i:i + n]
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(end - GRAM + 1, 0):end] = False
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return grams[inside], np.concatenate([[0], np.cumsum(counts)])


def _slots(grams: np.ndarray, hashes: int, slot_bits: int):
    for m in MULTIPLIERS[:hashes]:
        h = grams * np.uint32(m)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - slot_bits)


def learn(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000,
          longest: int = 200_000, least_share: float = 0.2, least_count: int = 3, hashes: int = 3,
          slot_bits: int = 20) -> Filters:
    """Filters from at most ``per_language`` labelled texts per language, of at most ``longest`` characters each.

    The sample has the rows with the lowest hash of their id; ids and labels choose rows, they are no input of a prediction.
    A language contains an n-gram that it uses ``least_count`` times and at least ``least_share`` as often as the language that
    uses it most. N-grams are counted in Spark; the driver gets one row per used slot (at most ``2 ** slot_bits``).
    """
    label, body = F.col(lang).cast("string"), F.col(text).cast("string")
    rows = docs.filter(label.isNotNull() & body.isNotNull() & (F.char_length(body) <= longest))
    draw = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    order = Window.partitionBy("_lang").orderBy("_draw", "_id")
    picked = (rows.select(F.col(id_column).alias("_id"), label.alias("_lang"), draw.alias("_draw"))
              .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language))
    sample = rows.select(F.col(id_column).alias("_id"), label.alias("_lang"), body.alias("_text")).join(
        F.broadcast(picked.select("_id", "_lang").distinct()), ["_id", "_lang"])  # per_language ids per language

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = _prepared(batch.column(1))
            for first, after in chunks(offsets):
                own = offsets[first:after + 1]
                grams, starts = _grams(data[own[0]:own[-1]], own - own[0])
                of = np.repeat([hash_of[langs[i]] for i in range(first, after)], np.diff(starts)).astype(np.uint64)
                keys, n = np.unique(of << np.uint64(32) | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)),
                                                  pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                                                  pa.array(n.astype(np.int64))], ["l", "gram", "n"])

    languages = sorted(r[0] for r in picked.select("_lang").distinct().collect())
    hash_of = {name: i for i, name in enumerate(languages)}
    words = max(1, -(-len(languages) // WORD))
    table = np.zeros((words, 1 << slot_bits), np.uint64)
    if languages:
        counted = (sample.select("_lang", "_text").mapInArrow(count, "l int, gram long, n long")
                   .groupBy("l", "gram").agg(F.sum("n").alias("n")))
        totals = counted.groupBy("l").agg(F.sum("n").alias("total"))
        shares = counted.join(F.broadcast(totals), "l").withColumn("share", F.col("n") / F.col("total"))
        most = shares.groupBy("gram").agg(F.max("share").alias("most"))
        chosen = shares.join(most, "gram").filter((F.col("share") >= least_share * F.col("most")) & (F.col("n") >= least_count))

        def place(batches):
            for batch in batches:
                grams = batch.column(0).to_numpy().astype(np.uint32)
                l = batch.column(1).to_numpy()
                for slot in _slots(grams, hashes, slot_bits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((l // WORD).astype(np.int32)), pa.array(slot.astype(np.int32)),
                         pa.array((np.int64(1) << (l % WORD).astype(np.int64)))], ["word", "slot", "bits"])

        for r in (chosen.select("gram", "l").mapInArrow(place, "word int, slot int, bits long")
                  .groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))).collect():
            table[r["word"], r["slot"]] = r["bits"]
    fill = np.array([np.mean(table[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) for i in range(len(languages))])
    return Filters(languages, table, fill ** hashes, hashes)


def _counts(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams per text, and of them those that each language's filter knows."""
    grams, starts = _grams(data, offsets)
    found = [None] * len(filters.table)
    for slot in _slots(grams, filters.hashes, filters.slot_bits):
        for w, words in enumerate(filters.table):
            bits = words[slot]
            found[w] = bits if found[w] is None else found[w] & bits
    known = np.zeros((len(offsets) - 1, len(filters.languages)))
    for i in range(len(filters.languages)):
        total = np.concatenate([[0], np.cumsum(found[i // WORD] >> np.uint64(i % WORD) & np.uint64(1), dtype=np.int64)])
        known[:, i] = total[starts[1:]] - total[starts[:-1]]
    return np.diff(starts), known


def identify(docs: DataFrame, filters: Filters, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: id, ``lang_pred``, ``score`` (its share of all corrected counts).

    A null text, or one without a letter, is ``und`` with score 0; so is every text when no language was learned. Equal
    counts go to the language first in order. Only the id and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 ** slot_bits words, whatever the input
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        filters = shared.value
        names = np.array([*filters.languages, "und"], object)
        for batch in batches:
            texts = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            data, offsets = _prepared(texts)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for first, after in chunks(offsets) if filters.languages else ():
                own = offsets[first:after + 1]
                n, known = _counts(filters, data[own[0]:own[-1]], own - own[0])
                true = np.maximum((known - n[:, None] * filters.false) / (1 - np.minimum(filters.false, 0.999)), 0)
                best[first:after] = np.argmax(true, axis=1)
                score[first:after] = np.max(true, axis=1) / np.maximum(true.sum(axis=1), 1e-9)
            best[~lettered], score[~lettered] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                                             [id_column, "lang_pred", "score"])
    return docs.select(id_column, F.col(text).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_column}` {kind}, lang_pred string, score double")


def predict_languages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", **learning) -> DataFrame:
    """Learn from the rows that are not held out, predict for all: id, ``held_out``, ``lang_pred``, ``score``."""
    filters = learn(docs.filter(~held_out(F.col(id_column))), id_column, text, lang, **learning)
    return (identify(docs, filters, id_column, text)
            .select(id_column, held_out(F.col(id_column)).alias("held_out"), "lang_pred", "score"))
