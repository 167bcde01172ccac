"""One registered query per operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.llm.attention_quality import classify
from peakforge.llm.block_names import exact_duplicates
from peakforge.llm.bpe import fingerprints
from peakforge.llm.common import keep, table
from peakforge.llm.language_bits import predict_languages
from peakforge.llm.line_spread import without_spread_lines
from peakforge.llm.prefix_intervals import remove_repeated_bytes
from peakforge.llm.prefix_trie import numbered, prefix_trie
from peakforge.llm.run_grammar import periodic_runs
from peakforge.llm.signature_join import near_duplicates
from peakforge.llm.simhash_leaks import leaks
from peakforge.llm.template_slots import main_text
from peakforge.llm.token_lengths import token_counts
from peakforge.llm.window_removal import remove_repeated

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_cut").alias("n_cut"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("level", "name")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The texts with the repeats that the contract of op12 plants: a tenth of them, by the checksum of the id."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    planted = (docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
               .withColumn("w", F.when(F.col("h") % 10 == 0, words))
               .withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    planted = planted.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    again = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that the contract of op13 rebuilds, (conv_id, turn, role, text), and the ids of all of them."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    own = turns.filter("conv_id is not null").select("conv_id", "turn", role, text)
    head = F.substring(F.concat("role", F.lit("\0"), F.col("text")), 1, 24)
    own = keep(numbered(own, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], [F.col("turn"), head])
               .select("conv_id", "pos", "role", "text", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")))
    ids = keep(own.groupBy("conv_id").agg(F.first("h").alias("h")))
    heads = own.filter("pos < 8").select(F.col("conv_id").alias("base"), "pos", "role", "text")
    taken = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base").filter("pos < h")
             .select("conv_id", F.col("pos").alias("turn"), "role", "text"))
    left = own.filter("pos >= h").select("conv_id", (F.col("pos") + 8).alias("turn"), "role", "text")
    return taken.unionByName(left), ids.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*_rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array": op4_suffix_array,
    "op5_window_dedup": op5_window_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash": op10_minhash,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op13_prefix_trie": r"""
        WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
                     FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT c, c - c % 5 AS base, xor(list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))),
                    4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM own)),
        rebuilt AS (SELECT ids.c, pos, role, text FROM ids JOIN own ON own.c = ids.base AND pos < h
                    UNION ALL SELECT ids.c, pos + 8, role, text FROM ids JOIN own USING (c) WHERE pos >= h),
        listed AS (SELECT c, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns FROM rebuilt GROUP BY c),
        convs AS (SELECT ids.c, coalesce(turns, []) AS turns FROM ids LEFT JOIN listed USING (c)),
        starts AS (SELECT c, len(turns) AS n, d, turns[1:d] AS k FROM convs, unnest(range(0, len(turns) + 1)) AS u(d)),
        node AS (SELECT d, k, min(c) AS low, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM starts GROUP BY d, k),
        kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
        full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children,
                             CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(k[d].t) END AS saved FROM node LEFT JOIN kids USING (d, k)),
        up AS (SELECT a.d, f.k[1:a.d] AS k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
               FROM full_node f, unnest(range(0, f.d + 1)) AS a(d) GROUP BY 1, 2)
        SELECT f.low AS conv_id, f.d AS depth, p.low AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens,
               sha256(coalesce(f.ends, '')) AS ends_sha256
        FROM full_node f JOIN up USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1] AND f.d > 0""",
    "op10_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
                 FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM sets),
        one AS (SELECT doc_id, unnest(s) AS s FROM sets),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.s = y.s AND x.doc_id <> y.doc_id
                  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
                  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (max(nx.n) + max(ny.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, min(b) = n.doc_id AS kept
        FROM n JOIN reach ON n.doc_id = reach.a GROUP BY n.doc_id, n.n""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS raw,
                          unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        wide AS (SELECT line FROM t WHERE line <> ''
                 GROUP BY line HAVING count(DISTINCT site) >= 10),
        m AS (SELECT t.*, wide.line IS NOT NULL AS cut FROM t LEFT JOIN wide USING (line)),
        d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_cut,
                     coalesce(2 * sum(length(line)) FILTER (cut) < sum(length(line)), false) AS yes,
                     string_agg(raw, chr(10) ORDER BY pos) AS whole, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut) AS rest
              FROM m GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, CASE WHEN yes THEN n_cut ELSE 0 END::INT AS n_cut,
               sha256(coalesce(CASE WHEN yes THEN rest ELSE whole END, '')) AS kept_sha256
        FROM documents LEFT JOIN d USING (doc_id)""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        item AS (SELECT item_id, w, len(w) AS size, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM item),
        ish AS (SELECT item_id, size, k, unnest(range(0, size - k + 1)) AS o,
                       unnest(list_transform(range(1, size - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS h FROM item),
        dsh AS (SELECT doc_id, len(w) AS n, k, unnest(range(0, len(w) - k + 1)) AS p,
                       unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS h
                FROM d, ks WHERE len(w) >= k),
        win AS (SELECT DISTINCT doc_id, size, ish.k, greatest(0, least(p - o + s, n - size)) AS first
                FROM dsh JOIN ish ON dsh.h = ish.h AND dsh.k = ish.k, (SELECT unnest(range(-2, 3)) AS s)),
        wsh AS (SELECT win.*, h, row_number() OVER (PARTITION BY win.doc_id, size, first, h ORDER BY p) AS turn
                FROM win JOIN dsh ON dsh.doc_id = win.doc_id AND dsh.k = win.k AND p BETWEEN first AND first + size - win.k),
        ino AS (SELECT *, row_number() OVER (PARTITION BY item_id, h ORDER BY o) AS turn FROM ish),
        total AS (SELECT doc_id, size, first, count(*) AS n FROM wsh GROUP BY ALL),
        hit AS (SELECT doc_id, item_id, wsh.size, first, count(*) AS c, max(wsh.size - wsh.k + 1) AS m
                FROM wsh JOIN ino ON wsh.size = ino.size AND wsh.h = ino.h AND wsh.turn = ino.turn GROUP BY ALL),
        sim AS (SELECT doc_id, item_id, size, first, c / (n + m - c) AS s FROM hit JOIN total USING (doc_id, size, first)
                WHERE 100 * c >= 75 * (n + m - c)),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, first) AS r FROM sim)
        SELECT doc_id, item_id, round(s, 6) AS similarity, first::INT AS first_word, size::INT AS n_words FROM best WHERE r = 1""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
             g AS (SELECT body, count(*) AS group_size,
                          (min(struct_pack(p := -points, d := doc_id))).d AS keep_id FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)""",
}
