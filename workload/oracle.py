"""The SQL each query is checked against, written from the definitions and not from the Spark code."""

from __future__ import annotations

import numpy as np

from peakforge.operators.spectra import MASS_TABLE, MASS_TABLE_LITERAL

SEED = 42


def u(*parts) -> str:
    """Uniform draw of the given SQL text parts."""
    text = ", ".join(parts)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


def pad8(x) -> str:
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) < 8 THEN lpad(CAST({x} AS VARCHAR), 8, '0') ELSE CAST({x} AS VARCHAR) END"


def cap(x) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


# ---- views ----------------------------------------------------------------------------------------------------------

ANTIBIOTICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

MATCH_ROWS = """
line AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 20 AS score,
         CASE WHEN l_tax = 0.01 THEN p_name || '-x' WHEN l_tax = 0.02 THEN 'genus sp.' WHEN l_tax = 0.03 THEN 'oneword'
              ELSE p_name END AS pattern
  FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, pattern, score, l_returnflag) AS n FROM line),
three AS (SELECT * FROM numbered WHERE n <= 3)
"""

SPECIES = ("(CASE WHEN len(string_split({p}, ' ')) < 2 THEN NULL ELSE "
           "string_split(regexp_replace(string_split({p}, ' ')[2], '[^a-zA-Z0-9 .]', ' ', 'g'), ' ')[1] END)")

CHECKED = MATCH_ROWS + f""",
wide AS (
  SELECT {pad8('l_orderkey')} AS extern_id, arg_min(l_returnflag, n) AS target_position,
         {', '.join(f"max(CASE WHEN n = {k} THEN pattern END) AS p{k}, max(CASE WHEN n = {k} THEN score END) AS s{k}" for k in (1, 2, 3))}
  FROM three GROUP BY l_orderkey),
parsed AS (
  SELECT *, {', '.join(f"string_split(p{k}, ' ')[1] AS g{k}, {SPECIES.format(p=f'p{k}')} AS sp{k}" for k in (1, 2, 3))}
  FROM wide),
checked AS (
  SELECT extern_id, target_position, g1, sp1, s2, s3, sp2, sp3,
    CASE WHEN s1 < 1.7 THEN 'low_score'
         WHEN sp1 IS NULL THEN 'bad_pattern_1'
         WHEN NOT regexp_full_match(sp1, '[a-zA-Z]+') THEN 'bad_species_1'
         {' '.join(f'''
         WHEN p{k} IS NULL THEN 'too_few_matches'
         WHEN sp{k} IS NULL THEN 'bad_pattern_{k}'
         WHEN NOT regexp_full_match(sp{k}, '[a-zA-Z]+') THEN 'bad_species_{k}'
         WHEN g1 <> g{k} AND s{k} >= 1.7 THEN 'genus_mismatch_{k}'
         WHEN sp1 <> sp{k} AND s{k} >= 1.7 THEN 'species_mismatch_{k}' ''' for k in (2, 3))}
    END AS reason
  FROM parsed)
"""

CATALOG = f"""
catalog AS (
  SELECT c_mktsegment AS dataset, CAST(year(o_orderdate) AS INTEGER) AS year, r_name AS genus, n_name AS species,
         {pad8('o_custkey')} AS extern_id, o_orderpriority AS target_position,
         CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS replicate,
         CAST(o_orderkey AS VARCHAR) AS path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
"""

AMR = f"""
amr AS (
  SELECT {pad8('o_custkey')} AS extern_id, o_orderkey, o_orderpriority AS antibiotic,
         CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'S' ELSE 'I' END AS sir FROM orders)
"""

LETTERS = """
letters AS (
  SELECT o_orderkey, o_custkey, o_orderpriority AS antibiotic,
         CASE WHEN o_totalprice >= 480000 THEN 'ESBL' WHEN o_totalprice >= 440000 THEN 'R*'
              WHEN o_totalprice >= 420000 THEN 'EBL?' WHEN o_orderstatus = 'F' THEN 'R'
              WHEN o_orderstatus = 'O' THEN 'S' ELSE 'I' END AS raw FROM orders)
"""

AMR_WIDE = LETTERS + f""",
wide AS (
  SELECT c_custkey, c_mktsegment AS origin, c_acctbal < 0 AS bad,
         CASE WHEN c_acctbal < 0 THEN 'x' || c_custkey ELSE c_custkey || '.0' END AS sample,
         {', '.join(f"max(CASE WHEN antibiotic = '{a}' THEN raw END) AS a{i}" for i, a in enumerate(ANTIBIOTICS))}
  FROM letters JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def recode(x, keep: bool) -> str:
    mapped = "WHEN 'I' THEN 'I' WHEN 'R*' THEN 'R'" if keep else "WHEN 'I' THEN 'R' WHEN 'R*' THEN NULL"
    return f"CASE {x} {mapped} WHEN 'ESBL' THEN NULL WHEN 'EBL?' THEN NULL ELSE {x} END"


SPECTRA = """
spectra AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS spectrum_id, [2000.0::DOUBLE + 281.25::DOUBLE * i FOR i IN range(64)] AS mz,
         [1000.0::DOUBLE * (CAST(x AS DOUBLE) + 0.6::DOUBLE) FOR x IN embedding] AS y FROM embeddings)
"""

POINTS = """
points AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS spectrum_id, 2000.0::DOUBLE + l_extendedprice % 18000 AS mz, l_quantity AS y
  FROM lineitem)
"""

ROWS = """
pts AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS sample_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS f,
         CASE WHEN label < 3 THEN 0 ELSE 1 END AS label FROM embeddings)
"""

def spectrum_rows(body: str, source: str = "done", digits: int = 6) -> str:
    return f"""WITH {SPECTRA}, {body}
    SELECT spectrum_id, CAST(pos AS BIGINT) AS pos, round(mz, 6) AS mz, round(y, {digits}) AS intensity
    FROM (SELECT spectrum_id, unnest(range(len(mz))) AS pos, unnest(mz) AS mz, unnest(y) AS y FROM {source})"""


def boosting_round(i: int) -> str:
    """Best split of round i (b<i>) by gradients and hessians of the margins m<i>, and the margins after it."""
    return f"""g{i} AS MATERIALIZED (SELECT sample_id, p - label AS g, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{i})),
        s{i} AS (SELECT feature, cut, sum(g) FILTER (v <= cut) AS gl, sum(h) FILTER (v <= cut) AS hl, count(*) FILTER (v <= cut) AS nl,
            sum(g) AS gt, sum(h) AS ht, count(*) AS nt FROM cells JOIN g{i} USING (sample_id), cuts GROUP BY ALL),
        b{i} AS MATERIALIZED (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain,
            -0.1 * gl / (hl + 1) AS lw, -0.1 * (gt - gl) / (ht - hl + 1) AS rw FROM s{i}
            WHERE nl BETWEEN 1 AND nt - 1 AND least(hl, ht - hl) >= 1 ORDER BY gain DESC, feature, cut LIMIT 1),
        m{i + 1} AS MATERIALIZED (SELECT sample_id, f, label, m + CASE WHEN f[feature + 1] <= cut THEN lw ELSE rw END AS m FROM m{i}, b{i})"""


def pointwise(expression: str, digits: int = 6) -> str:
    return spectrum_rows(f"done AS (SELECT spectrum_id, mz, {expression} AS y FROM spectra)", digits=digits)


# ---- stencils -------------------------------------------------------------------------------------------------------

def polynomial_taps(half: int = 10, order: int = 3) -> list[list[float]]:
    """Taps of the window fit at each window position, by solving the normal equations for unit impulses."""
    x = np.arange(-half, half + 1, dtype=float)
    a = np.stack([x ** p for p in range(order + 1)], axis=1)
    return (a @ np.linalg.solve(a.T @ a, a.T)).tolist()


TAPS = polynomial_taps()
MIDDLE = [3.0 * (329 - 5 * k * k) / 9177 for k in range(-10, 11)]


def literal(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


TAPS_CTE = "taps AS MATERIALIZED (SELECT [" + ", ".join(literal(r) for r in TAPS) + f"] AS h, {literal(MIDDLE)} AS m)"


def smooth(source: str, target: str) -> str:
    return f"""{target} AS MATERIALIZED (
      SELECT spectrum_id, mz, [greatest(0.0::DOUBLE, CASE
          WHEN j <= 10 THEN list_dot_product(y[1:21], h[j])
          WHEN j > len(y) - 10 THEN list_dot_product(y[len(y) - 20:len(y)], h[j - len(y) + 21])
          ELSE list_dot_product(y[j - 10:j + 10], m) END) FOR j IN range(1, len(y) + 1)] AS y FROM {source}, taps)"""


def snip(source: str, target: str) -> str:
    parts = [f"""{target}0 AS MATERIALIZED (SELECT spectrum_id, mz, y, [ln(ln(sqrt(x + 1) + 1) + 1) FOR x IN y] AS v FROM {source})"""]
    for i in range(1, 11):
        parts.append(f"""{target}{i} AS MATERIALIZED (SELECT spectrum_id, mz, y,
          [least(v[j], (v[greatest(j - {i}, 1)] + v[least(j + {i}, len(v))]) / 2) FOR j IN range(1, len(v) + 1)] AS v
          FROM {target}{i - 1})""")
    parts.append(f"""{target} AS MATERIALIZED (SELECT spectrum_id, mz,
      [y[j] - (pow(exp(exp(v[j]) - 1) - 1, 2) - 1) FOR j IN range(1, len(v) + 1)] AS y FROM {target}10)""")
    return ", ".join(parts)


def tic(source: str, target: str) -> str:
    return f"""{target} AS MATERIALIZED (SELECT spectrum_id, mz, [x / s FOR x IN y] AS y
      FROM (SELECT *, list_sum(y) AS s FROM {source}))"""


def trim(source: str, target: str, lo=2000, hi=20000) -> str:
    return f"""{target} AS MATERIALIZED (SELECT spectrum_id,
      [mz[j] FOR j IN range(1, len(mz) + 1) IF mz[j] > {lo} AND mz[j] < {hi}] AS mz,
      [y[j] FOR j IN range(1, len(mz) + 1) IF mz[j] > {lo} AND mz[j] < {hi}] AS y FROM {source})"""


def root(source: str, target: str) -> str:
    return f"{target} AS MATERIALIZED (SELECT spectrum_id, mz, [sqrt(x) FOR x IN y] AS y FROM {source})"


STANDARD = ", ".join([root("spectra", "t1"), TAPS_CTE, smooth("t1", "t2"), snip("t2", "t3"), tic("t3", "t4"),
                      trim("t4", "t5")])


def regrid(source: str, target: str, n: int) -> str:
    """Linear interpolation on n equal steps; works on any ascending axis."""
    return f"""{target} AS MATERIALIZED (
      SELECT spectrum_id, list(g ORDER BY i) AS mz, list(v ORDER BY i) AS y FROM (
        SELECT spectrum_id, i, g, CASE WHEN k >= len(mz) THEN y[len(y)]
          ELSE y[k] + (y[k + 1] - y[k]) * (g - mz[k]) / (mz[k + 1] - mz[k]) END AS v
        FROM (SELECT *, greatest(1, len(list_filter(mz, lambda q: q <= g))) AS k FROM (
          SELECT spectrum_id, mz, y, i, CASE WHEN i = {n} - 1 THEN mz[len(mz)]
             ELSE mz[1] + i * ((mz[len(mz)] - mz[1]) / ({n} - 1)) END AS g
          FROM {source}, range({n}) r(i))))
      GROUP BY spectrum_id)"""


def unnested(source: str) -> str:
    return f"(SELECT spectrum_id, unnest(mz) AS mz, unnest(y) AS y FROM {source})"


EDGES, EDGES_LITERAL = MASS_TABLE, MASS_TABLE_LITERAL


def ranges_cte(edges) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"ranges(bin, a, b) AS (VALUES {rows})"


def binned(source: str, expression: str, n: int, agg: str = "sum(y)", where: str = "TRUE") -> str:
    """Bins (spectrum_id, bin, value) of points by a bin-number expression over mz."""
    return f"SELECT spectrum_id, CAST(bin AS BIGINT) AS bin, round(CAST({agg} AS DOUBLE), 6) AS value FROM (" \
           f"SELECT *, {expression} AS bin FROM {source} WHERE {where}) GROUP BY spectrum_id, bin"


EQUAL = "CASE WHEN mz = 20000 THEN 5999 ELSE CAST(floor((mz - 2000) / 3) AS BIGINT) END"


def log_edges_cte(n: int) -> str:
    return (f"edges AS (SELECT i AS bin, pow(10, log10(2000) + i * (log10(20000) - log10(2000)) / {n}) AS a, "
            f"pow(10, log10(2000) + (i + 1) * (log10(20000) - log10(2000)) / {n}) AS b FROM range({n}) r(i))")


def log_binned(source: str, agg: str = "sum(y)") -> str:
    return (f"SELECT spectrum_id, CAST(bin AS BIGINT) AS bin, round(CAST({agg} AS DOUBLE), 6) AS value FROM {source} "
            f"JOIN edges ON mz >= a AND mz < b GROUP BY spectrum_id, bin")


def table_binned(source: str) -> str:
    return (f"SELECT spectrum_id, CAST(bin AS BIGINT) AS bin, round(sum(y), 6) AS value FROM {source} "
            f"JOIN ranges ON round_even(mz, 0) >= a AND round_even(mz, 0) <= b GROUP BY spectrum_id, bin")


def as_filled(sql: str, ctes: str) -> str:
    return f"WITH {ctes} SELECT spectrum_id, bin AS pos, value AS intensity FROM ({sql}) WHERE value <> 0"


# ---- neighbours -----------------------------------------------------------------------------------------------------

EUCLID = "list_distance(a.f, b.f)"
MANHATTAN = "list_sum([abs(a.f[i] - b.f[i]) FOR i IN range(1, len(a.f) + 1)])"


def near(target: str, left: str, right: str, k: int, dist: str = EUCLID, other: bool = True) -> str:
    """CTE (src, dst, rank, dist, label, dst_label) of the k nearest rows."""
    return f"""{target} AS MATERIALIZED (SELECT * FROM (
      SELECT a.sample_id AS src, b.sample_id AS dst, {dist} AS dist, a.label AS label, b.label AS dst_label,
        row_number() OVER (PARTITION BY a.sample_id ORDER BY {dist}, b.sample_id) AS rank
      FROM {left} a JOIN {right} b ON {'a.sample_id <> b.sample_id' if other else 'TRUE'}) WHERE rank <= {k})"""


def edited(target: str, source: str, k: int = 3, everything: bool = False) -> str:
    low = f"(SELECT label FROM {source} GROUP BY label ORDER BY count(*), label LIMIT 1)"
    keep = "" if everything else f" OR label = {low}"
    return near(f"{target}_nn", source, source, k) + f""", {target} AS MATERIALIZED (
      SELECT * FROM {source} WHERE sample_id IN (
        SELECT src FROM {target}_nn GROUP BY src HAVING bool_and(label = dst_label)){keep})"""


IDS = "SELECT sample_id, CAST(label AS INTEGER) AS label FROM "


def rounds_of_editing(rows: str, ks) -> str:
    """The last round in which the larger class (1) is not below the smaller one (0); rounds after stability change nothing."""
    names = ["pts"] + [f"e{i}" for i in range(1, len(ks) + 1)]
    steps = ", ".join(edited(names[i + 1], names[i], k) for i, k in enumerate(ks))

    def size(name, label):
        return f"(SELECT count(*) FROM {name} WHERE label = {label})"
    parts = [f"SELECT * FROM {n} WHERE {size(n, 1)} >= {size('pts', 0)}"
             + (f" AND {size(names[i + 1], 1)} < {size('pts', 0)}" if i < len(ks) else "") for i, n in enumerate(names)]
    return f"WITH {rows}, {steps} {IDS} ({' UNION ALL '.join(parts)})"


CELLS = "cells AS (SELECT sample_id, label, unnest(range(len(f))) AS feature, unnest(f) AS v FROM pts)"

SMOTE = ROWS + f""",
low AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS rank FROM pts WHERE label = 0),
{near('nn', 'low', 'low', 5)},
sizes AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM pts),
draws AS (
  SELECT i, CAST(floor({u("CAST(i AS VARCHAR)", "'smote0'", "'seed'", "'42'")} * n0) AS BIGINT) AS rank,
         CAST(floor({u("CAST(i AS VARCHAR)", "'smote0'", "'nn'", "'42'")} * 5) AS BIGINT) + 1 AS k,
         {u("CAST(i AS VARCHAR)", "'smote0'", "'gap'", "'42'")} AS gap
  FROM sizes, range((SELECT n1 - n0 FROM sizes)) r(i)),
made AS MATERIALIZED (
  SELECT 'smote:0:' || i AS sample_id, [a.f[j] + gap * (b.f[j] - a.f[j]) FOR j IN range(1, 65)] AS f, 0 AS label
  FROM draws JOIN low a ON draws.rank = a.rank JOIN nn ON nn.src = a.sample_id AND nn.rank = k
  JOIN low b ON b.sample_id = nn.dst),
smoted AS MATERIALIZED (SELECT sample_id, f, label FROM pts UNION ALL SELECT sample_id, f, label FROM made)
"""

# A point's persistence on a line is its height above the higher of the two lowest points on the way to a higher one.
PROMINENCE = """
p AS MATERIALIZED (SELECT spectrum_id, unnest(range(64)) AS i, unnest(mz) AS mz, unnest(y) AS y FROM spectra),
higher AS (SELECT a.spectrum_id, a.i, max(b.i) FILTER (b.i < a.i) AS l, min(b.i) FILTER (b.i > a.i) AS r
  FROM p a LEFT JOIN p b ON a.spectrum_id = b.spectrum_id AND b.y > a.y GROUP BY ALL),
saddle AS (SELECT a.spectrum_id, a.i, any_value(a.mz) AS mz, any_value(a.y) AS y, any_value(l) AS l, any_value(r) AS r,
  min(b.y) FILTER (b.i BETWEEN l AND a.i) AS lo_l, min(b.y) FILTER (b.i BETWEEN a.i AND r) AS lo_r, min(b.y) AS lowest
  FROM p a JOIN higher USING (spectrum_id, i) JOIN p b ON a.spectrum_id = b.spectrum_id GROUP BY a.spectrum_id, a.i),
peaks AS (SELECT spectrum_id, i, mz, y - CASE WHEN l IS NULL AND r IS NULL THEN lowest WHEN l IS NULL THEN lo_r
  WHEN r IS NULL THEN lo_l ELSE greatest(lo_l, lo_r) END AS p FROM saddle)
"""


def labelled_vectors(source: str) -> str:
    return f"""SELECT sample_id, CAST(label AS INTEGER) AS label, CAST(pos AS BIGINT) AS pos, round(v, 6) AS value
      FROM (SELECT sample_id, label, unnest(range(len(f))) AS pos, unnest(f) AS v FROM {source})"""


HASH_SIDE = u("sample_id", "'split'", "'42'")

SILHOUETTE = ROWS + f""",
d AS (SELECT a.sample_id, a.label, b.label AS other, {EUCLID} AS dist FROM pts a JOIN pts b ON a.sample_id <> b.sample_id),
m AS (SELECT sample_id, label, avg(dist) FILTER (label = other) AS a, avg(dist) FILTER (label <> other) AS b FROM d GROUP BY ALL),
s AS (SELECT sample_id, label, (b - a) / greatest(a, b) AS s FROM m)
"""

SCORES = """
c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
k AS (SELECT cls, coalesce(sum(n) FILTER (l = cls AND p = cls), 0) AS tp, coalesce(sum(n) FILTER (l = cls), 0) AS t,
             coalesce(sum(n) FILTER (p = cls), 0) AS q FROM c, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS re,
             CASE WHEN t + q > 0 THEN 2 * tp / (t + q) ELSE 0 END AS f1, t FROM k)
"""

LABEL_ROWS = """
rows AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS code FROM orders),
have AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS code FROM orders
         WHERE o_orderstatus = 'F')
"""

FOLDERS = CATALOG + """,
member AS (
  SELECT DISTINCT year || '/' || genus || '/' || extern_id || '/0_' || target_position || '/' AS folder, extern_id,
         target_position, replicate FROM catalog WHERE dataset = 'MACHINERY'),
files AS (
  SELECT year || '/' || genus || '/' || extern_id || '/0_' || target_position || '/' AS folder, extern_id,
         target_position, count(*) AS files, max(CASE WHEN replicate = '1' THEN 1 ELSE 0 END) AS own
  FROM catalog WHERE dataset = 'MACHINERY' GROUP BY ALL),
first AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY extern_id, target_position ORDER BY folder) = 1),
valid AS (SELECT DISTINCT extern_id, target_position FROM catalog)
"""


def points_stat(agg: str) -> str:
    return f"WITH {POINTS}, {log_edges_cte(100)} {log_binned('points', agg)}"


def model_free_histogram() -> str:
    return """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
      c AS (SELECT least(29, CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT)) AS bin, count(*) AS n FROM events, e GROUP BY 1)
      SELECT CAST(i AS BIGINT) AS bin, round(lo + i * (hi - lo) / 30, 6) AS low, round(lo + (i + 1) * (hi - lo) / 30, 6) AS high,
             CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(30) r(i) LEFT JOIN c ON c.bin = i, e"""


ORACLE = {
    "validate_matches": f"""WITH {CHECKED} SELECT extern_id, target_position,
        CASE WHEN reason IS NULL THEN g1 END AS genus, CASE WHEN reason IS NULL THEN {cap('sp1')} END AS species,
        CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
        CASE WHEN reason IS NULL THEN nullif(concat_ws(',', CASE WHEN sp1 <> sp2 AND s2 < 1.7 THEN 'species_mismatch_2' END,
             CASE WHEN sp1 <> sp3 AND s3 < 1.7 THEN 'species_mismatch_3' END), '') END AS warning FROM checked""",
    "species_report": f"""WITH {CHECKED} SELECT g1 AS genus, {cap('sp1')} AS species, count(*) AS count FROM checked
        WHERE reason IS NULL GROUP BY 1, 2""",
    "nested_report": f"""WITH {CHECKED}, n AS (SELECT g1 AS genus, {cap('sp1')} AS species, count(*) AS c FROM checked
        WHERE reason IS NULL GROUP BY 1, 2) SELECT genus, string_agg(species || ':' || c, ',' ORDER BY species) AS species
        FROM n GROUP BY genus""",
    "parse_analyte_documents": f"""WITH {MATCH_ROWS}, t AS (SELECT *, arg_min(l_returnflag, n) OVER (PARTITION BY l_orderkey) AS tp FROM three)
        SELECT {pad8('l_orderkey')} AS extern_id, tp AS target_position, CAST(n AS BIGINT) AS n, pattern, round(score, 6) AS score FROM t""",
    "normalise_species": f"""WITH r AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part)
        SELECT p_partkey, {cap('w[1]')} AS genus, {cap('w[2]')} AS species FROM r WHERE p_size > 5""",
    "counts_with_total": f"""WITH {CATALOG} SELECT CASE WHEN grouping(year) = 1 THEN 'TOTAL' ELSE CAST(year AS VARCHAR) END AS year,
        genus, species, count(*) AS count FROM catalog GROUP BY GROUPING SETS ((year, genus, species), (genus, species))""",
    "species_counts": f"""WITH {CATALOG}, l AS (SELECT r_name AS genus, n_name AS species FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT r_name, n_name || '_UNSEEN' FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT l.genus || ' ' || l.species AS name, count(path) AS count FROM l LEFT JOIN catalog c
        ON l.genus = c.genus AND l.species = c.species AND c.year IN (1996, 1997, 1998) GROUP BY 1""",
    "dataset_totals": f"""WITH {CATALOG} SELECT dataset, count(DISTINCT (genus, species, year, extern_id)) AS samples,
        count(*) AS spectra, count(DISTINCT genus) AS genera, count(DISTINCT (genus, species)) AS species FROM catalog GROUP BY dataset""",
    "top_species": f"""WITH {CATALOG}, n AS (SELECT dataset, genus, species, count(*) AS total FROM catalog GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total DESC, genus, species) AS rank FROM n QUALIFY rank <= 5""",
    "global_stats": f"""WITH {CATALOG}, n AS (SELECT dataset, genus, species, count(*) AS total FROM catalog GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY total DESC, genus, species) AS rank FROM n QUALIFY rank <= 5)
        SELECT dataset, count(DISTINCT (genus, species, year, extern_id)) AS samples, count(*) AS spectra,
        count(DISTINCT genus) AS genera, count(DISTINCT (genus, species)) AS species, CAST(NULL AS VARCHAR) AS name,
        CAST(NULL AS BIGINT) AS fids, CAST(NULL AS BIGINT) AS amr FROM catalog GROUP BY dataset
        UNION ALL SELECT dataset, NULL, NULL, NULL, NULL, genus || ' ' || species, total, 0 FROM t""",
    "keep_known": f"""WITH {AMR}, {CATALOG} SELECT o_orderkey, extern_id, antibiotic, sir FROM amr
        WHERE extern_id IN (SELECT extern_id FROM catalog WHERE dataset = 'MACHINERY')""",
    "not_found": f"""WITH {AMR}, {CATALOG} SELECT o_orderkey, extern_id FROM amr
        WHERE extern_id NOT IN (SELECT extern_id FROM catalog WHERE dataset = 'MACHINERY')""",
    "match_folders": f"""WITH {FOLDERS} SELECT extern_id, target_position, folder, files,
        CASE WHEN own = 1 THEN 'found' ELSE 'illegal' END AS folder_status FROM valid JOIN first USING (extern_id, target_position)""",
    "missing_folders": f"WITH {FOLDERS} SELECT extern_id, target_position FROM valid ANTI JOIN first USING (extern_id, target_position)",
    "match_labels": f"WITH {LABEL_ROWS} SELECT year, code, o_orderkey FROM rows JOIN have USING (year, code)",
    "missing_labels": f"WITH {LABEL_ROWS} SELECT year, code, o_orderkey FROM rows ANTI JOIN have USING (year, code)",
    "fingerprint": """SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash,
        length(text) > 0 AND length(replace(text, chr(0), '')) = 0 AS is_empty, length(text) = 0 AS no_bytes FROM documents""",
    "duplicate_report": """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents),
        g AS (SELECT *, min(path) OVER (PARTITION BY hash) AS first_path FROM f) SELECT path, first_path, hash FROM g WHERE path <> first_path""",
    "one_per_sample": f"""WITH {CATALOG}, m AS (SELECT *, min(target_position) OVER (PARTITION BY extern_id) AS chosen FROM catalog)
        SELECT extern_id, target_position, replicate, path FROM m WHERE target_position = chosen AND replicate = '1'""",
    "pruned_levels": f"""WITH {CATALOG}, k AS (SELECT * FROM catalog WHERE dataset = 'MACHINERY' AND replicate = '1')
        SELECT 'genus' AS level, genus AS name FROM (SELECT genus FROM catalog EXCEPT SELECT genus FROM k)
        UNION ALL SELECT 'species', genus || '/' || species FROM (SELECT genus, species FROM catalog EXCEPT SELECT genus, species FROM k)
        UNION ALL SELECT 'sample', genus || '/' || species || '/' || extern_id FROM
        (SELECT genus, species, extern_id FROM catalog EXCEPT SELECT genus, species, extern_id FROM k)""",
    "canonical_ids": f"WITH {AMR_WIDE} SELECT sample AS \"Muestra\", CASE WHEN NOT bad THEN {pad8('c_custkey')} END AS extern_id FROM wide",
    "recode_letters": f"WITH {LETTERS} SELECT o_orderkey, {recode('raw', False)} AS merged, {recode('raw', True)} AS kept FROM letters",
    "amr_long": f"""WITH {AMR_WIDE}, l AS ({' UNION ALL '.join(f"SELECT {pad8('c_custkey')} AS extern_id, origin, '{a}' AS antibiotic, {recode(f'a{i}', False)} AS sir FROM wide WHERE NOT bad" for i, a in enumerate(ANTIBIOTICS))})
        SELECT * FROM l WHERE sir IS NOT NULL""",
    "amr_long_by_origin": f"""WITH {AMR_WIDE}, l AS ({' UNION ALL '.join(f"SELECT {pad8('c_custkey')} AS extern_id, origin, '{a}' AS antibiotic, {recode(f'a{i}', True)} AS sir FROM wide WHERE NOT bad" for i, a in enumerate(ANTIBIOTICS))})
        SELECT * FROM l WHERE sir IS NOT NULL AND origin = 'MACHINERY'""",
    "complete_cases": f"""WITH {AMR_WIDE}, l AS (SELECT {pad8('c_custkey')} AS extern_id, {', '.join(f'{recode(f"a{i}", True)} AS "{a}"' for i, a in enumerate(ANTIBIOTICS))} FROM wide WHERE NOT bad)
        SELECT * FROM l WHERE {' AND '.join(f'"{a}" IS NOT NULL' for a in ANTIBIOTICS)}""",
    "sir_counts": f"""WITH {AMR} SELECT antibiotic, count(*) FILTER (sir = 'S') AS "S", count(*) FILTER (sir = 'R') AS "R",
        count(*) FILTER (sir = 'I') AS "I" FROM amr GROUP BY antibiotic""",
    "labelled": f"""WITH {AMR} SELECT CAST(vec_id AS VARCHAR) AS sample_id, extern_id, o_orderkey, sir,
        CASE sir WHEN 'R' THEN 0 ELSE 1 END AS label, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) AS total
        FROM embeddings JOIN amr ON extern_id = {pad8('vec_id')} WHERE antibiotic = '1-URGENT' AND sir IN ('R', 'S')""",
    **{f"joined_{m}_sizes": f"""WITH {AMR}, s AS (SELECT CASE sir WHEN 'R' THEN 0 ELSE 1 END AS label, count(*) AS n
        FROM embeddings JOIN amr ON extern_id = {pad8('vec_id')} WHERE sir IN ('R', 'S') GROUP BY 1)
        SELECT label, (SELECT {f}(n) FROM s) AS n, (SELECT {f}(n) FROM s) AS n_ids FROM s"""
       for m, f in (("random_over", "max"), ("random_under", "min"), ("smote", "max"))},
    "class_distribution": f"WITH {AMR} SELECT sir, count(*) AS count FROM amr GROUP BY sir",
    "evaluate": f"""WITH {SCORES} SELECT round((SELECT sum(n) FILTER (l = p) / sum(n) FROM c), 6) AS accuracy,
        {', '.join(f"round(max({e}) FILTER (cls = {i}), 6) AS {n}_{c}" for i, c in ((0, 'R'), (1, 'S')) for e, n in (('pr', 'precision'), ('re', 'recall'), ('f1', 'f1')))} FROM m""",
    "per_class": f"WITH {SCORES} SELECT cls AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(t AS BIGINT) AS support FROM m",
    "macro_f1": f"WITH {SCORES} SELECT round(avg(f1), 6) AS macro_f1 FROM m",
    "prediction_dump": "SELECT CAST(quality AS INTEGER) AS \"Actual\", CAST(toxic AS INTEGER) AS \"Predicted\" FROM labels",
    "run_summary": """WITH r AS (SELECT avg(value) AS s FROM events GROUP BY user_id)
        SELECT round(avg(s) * 100, 6) AS mean_accuracy, round(stddev_pop(s) * 100, 6) AS std_accuracy FROM r""",
    "histogram": model_free_histogram(),
    "reject_curve": """SELECT t AS threshold, round(avg(CASE WHEN value / 500 < t THEN 1 ELSE 0 END), 6) AS reject_rate,
        round(avg(CASE WHEN value / 500 >= t THEN CASE WHEN (value > 50) = (event_type = 'click') THEN 1 ELSE 0 END END), 6) AS accepted_accuracy
        FROM events, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(t) GROUP BY t""",
    "append_results": f"""WITH {SCORES} SELECT 'none' AS method, round((SELECT sum(n) FILTER (l = p) / sum(n) FROM c), 6) AS accuracy,
        CAST(NULL AS DOUBLE) AS macro_f1 UNION ALL SELECT 'Macro', NULL, round(avg(f1), 6) FROM m""",
    "tof_calibration": """WITH r AS (SELECT *, 2.5e6::DOUBLE + l_quantity AS ml1, 100 + l_tax AS ml2,
          CASE WHEN l_linenumber > 3 THEN 0 ELSE l_discount / 1000 END AS ml3 FROM lineitem),
        q AS (SELECT *, sqrt(1e12::DOUBLE / ml1) AS b, ml2 - l_extendedprice AS c FROM r)
        SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN ml3 = 0 THEN c * c / (b * b)
          ELSE pow((-b + sqrt(b * b - 4 * ml3 * c)) / (2 * ml3), 2) END, 4) AS mz FROM q""",
    "stabilise_sqrt": pointwise("[sqrt(x) FOR x IN y]"), "stabilise_log": pointwise("[ln(x) FOR x IN y]"),
    "stabilise_log2": pointwise("[log2(x) FOR x IN y]"), "stabilise_log10": pointwise("[log10(x) FOR x IN y]"),
    "smooth": spectrum_rows(f"{TAPS_CTE}, {smooth('spectra', 'done')}"),
    "baseline_snip": spectrum_rows(snip("spectra", "done")),
    "tic": spectrum_rows(tic("spectra", "done"), digits=8), "trim": spectrum_rows(trim("spectra", "done")),
    "binarise": pointwise("[CASE WHEN x > 600 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN y]"),
    "scale_by_min": spectrum_rows("""low AS (SELECT min(x) AS low FROM (SELECT unnest(y) AS x FROM spectra) WHERE x <> 0),
        done AS (SELECT spectrum_id, mz, [x * (1.0 / low) FOR x IN y] AS y FROM spectra, low)"""),
    "filter_peaks": spectrum_rows("""p AS (SELECT spectrum_id, unnest(range(64)) AS i, unnest(mz) AS mz, unnest(y) AS y FROM spectra),
        q AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY y DESC, i) AS n FROM p),
        done AS (SELECT spectrum_id, list(mz ORDER BY i) AS mz, list(y ORDER BY i) AS y FROM q WHERE n <= 8 AND y >= 700 GROUP BY spectrum_id)"""),
    "jitter_normal": spectrum_rows(f"""p AS (SELECT spectrum_id, unnest(range(64)) AS i, unnest(mz) AS mz, unnest(y) AS y FROM spectra),
        d AS (SELECT *, {u('spectrum_id', 'CAST(i AS VARCHAR)', "'42'")} AS a, {u('spectrum_id', 'CAST(i AS VARCHAR)', "'-43'")} AS b FROM p),
        done AS (SELECT spectrum_id, list(mz + sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b) ORDER BY i) AS mz, list(y ORDER BY i) AS y
                 FROM d GROUP BY spectrum_id)"""),
    "jitter_uniform": spectrum_rows(f"""p AS (SELECT spectrum_id, unnest(range(64)) AS i, unnest(mz) AS mz, unnest(y) AS y FROM spectra),
        done AS (SELECT spectrum_id, list(mz + 1.5 * (2 * {u('spectrum_id', 'CAST(i AS VARCHAR)', "'42'")} - 1) ORDER BY i) AS mz,
                 list(y ORDER BY i) AS y FROM p GROUP BY spectrum_id)"""),
    "resample_grid": spectrum_rows(regrid("spectra", "done", 1000)),
    "bin_equal": as_filled(binned(unnested("spectra"), EQUAL, 6000, where="mz <= 20000"), SPECTRA),
    "bin_log": as_filled(log_binned(unnested("spectra")), f"{SPECTRA}, {log_edges_cte(100)}"),
    "bin_table": as_filled(table_binned(unnested("spectra")), f"{SPECTRA}, {ranges_cte(EDGES)}"),
    "bin_table_literal": as_filled(table_binned(unnested("spectra")), f"{SPECTRA}, {ranges_cte(EDGES_LITERAL)}"),
    "standard_features": f"""WITH {SPECTRA}, {STANDARD} SELECT * FROM (
        SELECT spectrum_id AS sample_id, CAST({EQUAL} AS BIGINT) AS pos, round(sum(y), 8) AS value
        FROM {unnested('t5')} GROUP BY ALL) WHERE value <> 0""",
    "resampled_chain": spectrum_rows(", ".join([
        root("spectra", "a0"), regrid("a0", "a1", 1000), TAPS_CTE, smooth("a1", "b0"), regrid("b0", "b1", 1000),
        snip("b1", "c0"), regrid("c0", "c1", 1000), tic("c1", "d0"), regrid("d0", "d1", 1000), trim("d1", "e0"),
        regrid("e0", "done", 1000)]), digits=8),
    "trace_steps": f"""WITH {SPECTRA}, {STANDARD}, steps AS ({' UNION ALL '.join(f"SELECT spectrum_id, CAST({i} AS INTEGER) AS step_no, '{n}' AS step, mz, y FROM {t}" for i, (n, t) in enumerate([('raw', 'spectra'), ('sqrt', 't1'), ('smooth', 't2'), ('snip', 't3'), ('tic', 't4'), ('trim', 't5')]))})
        SELECT spectrum_id, step_no, step, CAST(pos AS BIGINT) AS pos, round(mz, 6) AS mz, round(y, 6) AS intensity FROM (
        SELECT spectrum_id, step_no, step, unnest(range(len(mz))) AS pos, unnest(mz) AS mz, unnest(y) AS y FROM steps)""",
    "before_after": f"""WITH {SPECTRA}, {STANDARD}, {regrid('spectra', 'raw', 1000)}, {regrid('t5', 'ready', 1000)},
        both_stages AS (SELECT spectrum_id, 'raw' AS stage, y FROM raw UNION ALL SELECT spectrum_id, 'preprocessed', y FROM ready)
        SELECT spectrum_id, stage, CAST(pos AS BIGINT) AS pos, round(v, 6) AS intensity FROM (
        SELECT spectrum_id, stage, unnest(range(1000)) AS pos, unnest(y) AS v FROM both_stages)""",
    "sequential_steps": spectrum_rows(", ".join([root("spectra", "a1"), snip("a1", "a2"), tic("a2", "a3"), trim("a3", "a4", 3000, 19000),
        """p AS (SELECT spectrum_id, unnest(range(len(mz))) AS i, unnest(mz) AS mz, unnest(y) AS y FROM a4),
        q AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY y DESC, i) AS n FROM p),
        done AS (SELECT spectrum_id, list(mz ORDER BY i) AS mz, list(y ORDER BY i) AS y FROM q WHERE n <= 10 GROUP BY spectrum_id)"""]), digits=8),
    "bin_points_equal": f"WITH {POINTS} {binned('points', EQUAL, 6000, where='mz <= 20000')}",
    "bin_points_log": f"WITH {POINTS}, {log_edges_cte(100)} {log_binned('points')}",
    "bin_points_table": f"WITH {POINTS}, {ranges_cte(EDGES)} {table_binned('points')}",
    "bin_points_table_literal": f"WITH {POINTS}, {ranges_cte(EDGES_LITERAL)} {table_binned('points')}",
    "bin_points_mean": points_stat("avg(y)"), "bin_points_std": points_stat("stddev_pop(y)"),
    "bin_points_median": points_stat("median(y)"), "bin_points_min": points_stat("min(y)"),
    "bin_points_max": points_stat("max(y)"), "bin_points_count": points_stat("count(y)"),
    "densify": f"""WITH {POINTS}, {log_edges_cte(100)}, s AS ({log_binned('points')})
        SELECT spectrum_id, CAST(100 AS BIGINT) AS width, round(sum(value) OVER (PARTITION BY spectrum_id), 6) AS total, bin, value
        FROM s WHERE value <> 0""",
    "feature_stats": f"""WITH {ROWS}, {CELLS} SELECT CAST(feature AS BIGINT) AS feature, count(*) AS n, round(avg(v), 6) AS mean,
        round(min(v), 6) AS min, round(max(v), 6) AS max, round(var_pop(v), 6) AS var_pop,
        round(corr(v, CASE WHEN label = 0 THEN 1 ELSE 0 END), 6) AS corr FROM cells GROUP BY feature""",
    "select_variance": f"""WITH {ROWS}, {CELLS}, r AS (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM cells)
        SELECT CAST(feature AS BIGINT) AS feature, round(var_pop((v - lo) / (hi - lo)), 6) AS var_pop FROM r GROUP BY feature
        HAVING var_pop((v - lo) / (hi - lo)) > 0.025""",
    "select_correlation": f"""WITH {ROWS}, {CELLS}, c AS (SELECT feature, abs(corr(v, CASE WHEN label = 0 THEN 1 ELSE 0 END)) AS r FROM cells GROUP BY feature),
        k AS (SELECT feature, row_number() OVER (ORDER BY r DESC, feature) - 1 AS pos FROM c WHERE r >= 0.05)
        SELECT sample_id, CAST(pos AS BIGINT) AS pos, round(v, 6) AS value FROM cells JOIN k USING (feature)""",
    "min_max": f"""WITH {ROWS}, {CELLS}, r AS (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, max(v) OVER (PARTITION BY feature) AS hi FROM cells)
        SELECT sample_id, CAST(feature AS BIGINT) AS pos, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM r""",
    "standardise": f"""WITH {ROWS}, {CELLS}, r AS (SELECT *, avg(v) OVER (PARTITION BY feature) AS m, stddev_pop(v) OVER (PARTITION BY feature) AS s FROM cells)
        SELECT sample_id, CAST(feature AS BIGINT) AS pos, round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 6) AS value FROM r""",
    "pca_spread": f"""WITH {ROWS}, {CELLS}, r AS (SELECT feature, var_pop(v) AS s FROM cells GROUP BY feature)
        SELECT round(sum(s), 6) AS total_variance, 0.0::DOUBLE AS abs_mean, count(*) AS components FROM r""",
    **{name: f"WITH {ROWS}, {near('nn', 'pts', 'pts', 5, dist)} SELECT src, dst, rank, round(dist, 6) AS dist FROM nn"
       for name, dist in (("knn_join", EUCLID), ("knn_join_blocks", EUCLID), ("knn_join_manhattan", MANHATTAN))},
    "neighbour_graph": f"""WITH {ROWS}, {near('nn', 'pts', 'pts', 10)} SELECT dst, count(*) AS in_degree, round(sum(dist), 6) AS reach
        FROM nn GROUP BY dst""",
    "knn_classify": f"""WITH {ROWS}, tr AS (SELECT * FROM pts WHERE {HASH_SIDE} >= 0.35), te AS (SELECT * FROM pts WHERE {HASH_SIDE} < 0.35),
        {near('nn', 'te', 'tr', 5, other=False)},
        v AS (SELECT src, label, sum(1 / dist) FILTER (dst_label = 0) AS r, sum(1 / dist) FILTER (dst_label = 1) AS s FROM nn GROUP BY ALL)
        SELECT src AS sample_id, label, CASE WHEN coalesce(s, 0) > coalesce(r, 0) THEN 1 ELSE 0 END AS prediction,
        round(coalesce(s, 0) / (coalesce(r, 0) + coalesce(s, 0)), 6) AS share_s FROM v""",
    "silhouette_samples": f"WITH {SILHOUETTE} SELECT sample_id, CAST(label AS INTEGER) AS label, round(s, 6) AS silhouette FROM s",
    "mean_silhouette": f"WITH {SILHOUETTE} SELECT round(avg(s), 6) AS silhouette FROM s",
    "squared_silhouette": f"""WITH {ROWS}, d AS (SELECT a.sample_id, a.label, b.label AS other, pow({EUCLID}, 2) AS dist FROM pts a JOIN pts b
        ON a.sample_id <> b.sample_id), m AS (SELECT sample_id, label, avg(dist) FILTER (label = other) AS a, avg(dist) FILTER (label <> other) AS b FROM d GROUP BY ALL)
        SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""",
    "embedding_sweep": f"""WITH {ROWS}, e AS (SELECT sample_id, label, s AS scale, [x * s FOR x IN f[1:2]] AS f FROM pts, (VALUES (1), (2)) v(s)),
        d AS (SELECT a.scale, a.sample_id, a.label, b.label AS other, {EUCLID} AS dist FROM e a JOIN e b ON a.sample_id <> b.sample_id AND a.scale = b.scale),
        m AS (SELECT scale, sample_id, label, avg(dist) FILTER (label = other) AS a, avg(dist) FILTER (label <> other) AS b FROM d GROUP BY ALL)
        SELECT scale, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m GROUP BY scale""",
    "pike_kernel": """WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, unnest(range(64)) AS i, unnest([CAST(e AS DOUBLE) FOR e IN embedding]) AS v FROM embeddings),
        y AS (SELECT 'g' || label AS id, i, avg(v) AS v FROM x GROUP BY ALL),
        w AS (SELECT a.i, b.i AS j, exp(-pow(281.25 * (a.i - b.i), 2) / 4e4) AS w FROM range(64) a(i), range(64) b(i)),
        d AS (SELECT min(j) AS d FROM w WHERE i = 0 AND w < 1e-6),
        z AS (SELECT x.id, j AS i, sum(v * w) AS v FROM x JOIN w ON x.i = w.i, d WHERE j < w.i + d GROUP BY ALL)
        SELECT z.id AS id_x, y.id AS id_y, round(sum(z.v * y.v) / (4e4 * pi()), 9) AS k FROM z JOIN y ON z.i = y.i GROUP BY ALL""",
    "split_stratified": f"""WITH {ROWS}, r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {HASH_SIDE}, sample_id) - 1 AS rank,
        count(*) OVER (PARTITION BY label) AS n FROM pts)
        SELECT sample_id, CAST(label AS INTEGER) AS label, CASE WHEN rank < floor(n * 0.35::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS side FROM r""",
    "split_plain": f"WITH {ROWS} SELECT sample_id, CAST(label AS INTEGER) AS label, CASE WHEN {HASH_SIDE} < 0.35 THEN 'test' ELSE 'train' END AS side FROM pts",
    "resample_none": f"WITH {ROWS} {IDS} pts",
    "random_under": f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u('sample_id', "'under'", "'42'")}, sample_id) AS rank FROM pts)
        {IDS} r WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pts GROUP BY label))""",
    "random_over": f"""WITH {ROWS}, low AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS rank FROM pts WHERE label = 0),
        n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM pts),
        d AS (SELECT i, CAST(floor({u("CAST(i AS VARCHAR)", "'over0'", "'seed'", "'42'")} * n0) AS BIGINT) AS rank FROM n, range((SELECT n1 - n0 FROM n)) r(i)),
        o AS (SELECT sample_id, label, f FROM pts UNION ALL SELECT 'over:0:' || i, label, f FROM d JOIN low USING (rank))
        {labelled_vectors('o')}""",
    "smote": f"WITH {SMOTE} " + labelled_vectors("smoted"),
    "edited": f"WITH {ROWS}, {edited('e', 'pts')} {IDS} e",
    **{f"{name}{rare}": rounds_of_editing(ROWS.replace("label < 3", "label < 1") if rare else ROWS, ks)
       for rare in ("", "_rare") for name, ks in (("all_knn", (1, 2, 3)), ("repeated_edited", (3,) * 12))},
    "smote_edited": f"WITH {SMOTE}, {edited('e', 'smoted', 3, True)} {IDS} e",
    "stratified_folds": f"""WITH {ROWS} SELECT sample_id, CAST(label AS INTEGER) AS label, CAST((row_number() OVER (PARTITION BY label
        ORDER BY {u('sample_id', "'cv'", "'42'")}, sample_id) - 1) % 5 AS INTEGER) AS fold FROM pts""",
    "tomek": f"""WITH {ROWS}, {near('nn', 'pts', 'pts', 1)}, gone AS (SELECT a.src FROM nn a JOIN nn b ON a.dst = b.src AND b.dst = a.src
        WHERE a.label <> a.dst_label AND a.label = 1) {IDS} pts WHERE sample_id NOT IN (SELECT src FROM gone)""",
    "neighbourhood_cleaning": f"""WITH {ROWS}, {near('nn', 'pts', 'pts', 3)}, bad AS (SELECT src, label FROM nn GROUP BY ALL
          HAVING count(*) FILTER (label = dst_label) < 2),
        gone AS (SELECT src AS id FROM bad WHERE label = 1 UNION SELECT dst FROM nn WHERE src IN (SELECT src FROM bad WHERE label = 0) AND dst_label = 1)
        {IDS} pts WHERE sample_id NOT IN (SELECT id FROM gone)""",
    "near_miss": f"""WITH {ROWS}, lo AS (SELECT * FROM pts WHERE label = 0), hi AS (SELECT * FROM pts WHERE label = 1),
        {near('nn', 'hi', 'lo', 3, other=False)}, m AS (SELECT src, avg(dist) AS d FROM nn GROUP BY src),
        k AS (SELECT src FROM m QUALIFY row_number() OVER (ORDER BY d, src) <= (SELECT count(*) FROM lo))
        {IDS} pts WHERE label = 0 OR sample_id IN (SELECT src FROM k)""",
    "decode_signals": """WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS path, hex(encode(text)) AS h FROM documents),
        n AS (SELECT *, length(h) // 8 AS points FROM b),
        s AS (SELECT path, points, [CAST('0x' || w[7:8] || w[5:6] || w[3:4] || w[1:2] AS UBIGINT)
              FOR w IN regexp_extract_all(h, '.{8}')] AS v FROM n),
        q AS (SELECT sqrt(1e12::DOUBLE / 2.5e6) AS b, 100.0::DOUBLE - 19000 AS c, 0.001::DOUBLE AS a)
        SELECT path, CAST(points AS BIGINT) AS points,
          round(coalesce(list_sum([CASE WHEN x >= 2147483648 THEN 0.0::DOUBLE ELSE CAST(x AS DOUBLE) END FOR x IN v]), 0), 0) AS total,
          CASE WHEN points > 0 THEN round(pow((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 2), 4) END AS first_mz FROM s, q""",
    "persistence": spectrum_rows(PROMINENCE + """,
        done AS (SELECT spectrum_id, list(mz ORDER BY i) AS mz, list(p ORDER BY i) AS y FROM peaks GROUP BY spectrum_id)"""),
    "persistence_peaks": spectrum_rows(PROMINENCE + """,
        done AS (SELECT spectrum_id, list(mz ORDER BY i) AS mz, list(p ORDER BY i) AS y FROM peaks WHERE p <> 0 GROUP BY spectrum_id)"""),
    "adasyn": f"""WITH {ROWS}, low AS (SELECT * FROM pts WHERE label = 0), {near('around', 'low', 'pts', 5)}, {near('nn', 'low', 'low', 5)},
        ratio AS (SELECT src, avg(CASE WHEN dst_label <> label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM around GROUP BY src),
        n AS (SELECT count(*) FILTER (label = 1) - count(*) FILTER (label = 0) AS n FROM pts),
        g AS (SELECT src, CAST(round_even(r / (SELECT sum(r) FROM ratio) * (SELECT n FROM n), 0) AS BIGINT) AS g FROM ratio),
        d AS (SELECT src, unnest(range(1, g + 1)) AS i FROM g WHERE g > 0),
        e AS (SELECT src, i, CAST(floor({u('src', 'CAST(i AS VARCHAR)', "'nn'", "'42'")} * 5) AS BIGINT) + 1 AS k,
              {u('src', 'CAST(i AS VARCHAR)', "'gap'", "'42'")} AS gap FROM d),
        made AS (SELECT 'adasyn:0:' || e.src || '.' || i AS sample_id, [a.f[j] + gap * (b.f[j] - a.f[j]) FOR j IN range(1, 65)] AS f, 0 AS label
          FROM e JOIN low a ON a.sample_id = e.src JOIN nn ON nn.src = e.src AND nn.rank = k JOIN low b ON b.sample_id = nn.dst),
        o AS (SELECT sample_id, f, label FROM pts UNION ALL SELECT sample_id, f, label FROM made) {labelled_vectors('o')}""",
    "borderline_smote": f"""WITH {ROWS}, low AS (SELECT * FROM pts WHERE label = 0), {near('around', 'low', 'pts', 10)},
        edge AS (SELECT src FROM around GROUP BY src HAVING count(*) FILTER (dst_label = 1) >= 5 AND count(*) FILTER (dst_label = 1) < 10),
        seeds AS (SELECT low.*, row_number() OVER (ORDER BY sample_id) - 1 AS rank FROM low JOIN edge ON src = sample_id),
        {near('nn', 'seeds', 'low', 5)}, n AS (SELECT count(*) FILTER (label = 1) - count(*) FILTER (label = 0) AS n FROM pts),
        m AS (SELECT count(*) AS m FROM seeds),
        draws AS (SELECT i, CAST(floor({u("CAST(i AS VARCHAR)", "'border0'", "'seed'", "'42'")} * m) AS BIGINT) AS rank,
          CAST(floor({u("CAST(i AS VARCHAR)", "'border0'", "'nn'", "'42'")} * 5) AS BIGINT) + 1 AS k,
          {u("CAST(i AS VARCHAR)", "'border0'", "'gap'", "'42'")} AS gap FROM m, range((SELECT n FROM n)) r(i)),
        made AS (SELECT 'border:0:' || i AS sample_id, [a.f[j] + gap * (b.f[j] - a.f[j]) FOR j IN range(1, 65)] AS f, 0 AS label
          FROM draws JOIN seeds a ON draws.rank = a.rank JOIN nn ON nn.src = a.sample_id AND nn.rank = k JOIN low b ON b.sample_id = nn.dst),
        o AS (SELECT sample_id, f, label FROM pts UNION ALL SELECT sample_id, f, label FROM made) {labelled_vectors('o')}""",
    "one_sided": f"""WITH {ROWS}, pick AS (SELECT sample_id FROM pts WHERE label = 1 ORDER BY {u('sample_id', "'store'", "'42'")}, sample_id LIMIT 1),
        store AS MATERIALIZED (SELECT * FROM pts WHERE label = 0 OR sample_id IN (SELECT sample_id FROM pick)),
        rest AS MATERIALIZED (SELECT * FROM pts WHERE sample_id NOT IN (SELECT sample_id FROM store)),
        {near('judge', 'rest', 'store', 1, other=False)},
        kept AS MATERIALIZED (SELECT * FROM store UNION ALL SELECT * FROM rest WHERE sample_id IN (SELECT src FROM judge WHERE label <> dst_label)),
        {near('nn', 'kept', 'kept', 1)}, gone AS (SELECT a.src FROM nn a JOIN nn b ON a.dst = b.src AND b.dst = a.src
          WHERE a.label <> a.dst_label AND a.label = 1) {IDS} kept WHERE sample_id NOT IN (SELECT src FROM gone)""",
    "model_knn": f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_SIDE}, sample_id) - 1 AS rank,
          count(*) OVER (PARTITION BY label) AS n FROM pts),
        te AS MATERIALIZED (SELECT sample_id, f, label FROM r WHERE rank < floor(n * 0.35::DOUBLE + 0.5)),
        tr AS MATERIALIZED (SELECT sample_id, f, label FROM r WHERE rank >= floor(n * 0.35::DOUBLE + 0.5)),
        {near('nn', 'te', 'tr', 5, other=False)},
        v AS (SELECT src, label AS l, CASE WHEN coalesce(sum(1 / dist) FILTER (dst_label = 1), 0) > coalesce(sum(1 / dist) FILTER (dst_label = 0), 0)
          THEN 1 ELSE 0 END AS p FROM nn GROUP BY ALL), c AS (SELECT l, p, count(*) AS n FROM v GROUP BY ALL),
        {SCORES.split("FROM labels GROUP BY ALL),")[1].strip()}
        SELECT (SELECT sum(n) FILTER (l = p) / sum(n) FROM c) AS accuracy,
        {', '.join(f"max({e}) FILTER (cls = {i}) AS {n}_{c}" for i, c in ((0, 'R'), (1, 'S')) for e, n in (('pr', 'precision'), ('re', 'recall'), ('f1', 'f1')))} FROM m""",
}
# The block paths answer the same questions.
ORACLE |= {f"{name}_blocks": ORACLE[name] for name in ("silhouette_samples", "pike_kernel")}

TARGETS = """letters AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, unnest(['first', 'second', 'third']) AS target,
    unnest([CASE WHEN label < 3 THEN 0 ELSE 1 END, label % 3, CASE WHEN label % 4 < 3 THEN label % 4 END]) AS letter FROM embeddings)"""
ORACLE |= {
    "target_stats": f"""WITH {ROWS}, {CELLS}, {TARGETS}
        SELECT target, CAST(feature AS BIGINT) AS feature, count(*) AS n, round(corr(v, CASE WHEN letter = 0 THEN 1 ELSE 0 END), 6) AS corr
        FROM cells JOIN letters USING (sample_id) WHERE letter IS NOT NULL GROUP BY target, feature""",
    "target_projection": f"""WITH {ROWS}, {TARGETS},
        s AS (SELECT sample_id, [list_sum([f[i] * cos(i * (j + 2)) FOR i IN range(1, 65)]) FOR j IN range(0, 5)] AS y FROM pts),
        p AS (SELECT sample_id, target, letter AS label, c AS n_components, y[1:c] AS f FROM s JOIN letters USING (sample_id),
              (VALUES (2), (3), (5)) v(c) WHERE letter IS NOT NULL),
        d AS (SELECT a.target, a.n_components, a.sample_id, a.label, b.label AS other, avg({EUCLID}) AS dist FROM p a JOIN p b
              ON a.target = b.target AND a.n_components = b.n_components AND a.sample_id <> b.sample_id GROUP BY ALL),
        m AS (SELECT target, n_components, sample_id, max(dist) FILTER (label = other) AS a, min(dist) FILTER (label <> other) AS b FROM d GROUP BY ALL)
        SELECT target, n_components, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m GROUP BY ALL""",
    "pca_components": "SELECT true AS uncorrelated, true AS ordered, true AS above_features",
    "kernel_products": f"""WITH {ROWS}, l AS (SELECT sample_id, f FROM pts ORDER BY {u('sample_id', "'landmark'", "'42'")}, sample_id LIMIT 40)
        SELECT a.sample_id AS a, b.sample_id AS b, round(pow(0.05 * list_dot_product(a.f, b.f) + 1, 2), 4) AS k
        FROM l a JOIN l b ON a.sample_id <= b.sample_id""",
    "trial_matches": f"""WITH {CHECKED} SELECT extern_id, target_position, g1 AS genus, {cap('sp1')} AS species FROM checked
        WHERE reason IS NULL ORDER BY extern_id, target_position LIMIT 100""",
    "confidence": """SELECT event_id, round(greatest(value / 500 / 2, 1 - value / 500), 6) AS confidence FROM events""",
    "boosting_rounds": f"""WITH {ROWS}, cells AS MATERIALIZED (SELECT sample_id, unnest(range(len(f))) AS feature, unnest(f) AS v FROM pts),
        cuts AS (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2]) AS cut), m0 AS (SELECT sample_id, f, label, 0.0::DOUBLE AS m FROM pts),
        {", ".join(boosting_round(i) for i in range(3))}
        {" UNION ALL ".join(f"""SELECT CAST({i} AS INTEGER) AS round, CAST(feature AS INTEGER) AS feature, CAST(cut AS DOUBLE) AS cut,
        round(gain, 6) AS gain, nl AS left_rows, nt - nl AS right_rows, round(lw, 6) AS left_value, round(rw, 6) AS right_value
        FROM b{i}""" for i in range(3))}""",
    "bayes_predictions": f"""WITH {ROWS}, cells AS MATERIALIZED (SELECT sample_id, label, unnest(range(len(f))) AS feature, unnest(f) AS v FROM pts),
        floor AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(v) AS s FROM cells GROUP BY feature)),
        fitted AS (SELECT label AS c, feature, avg(v) AS mu, var_pop(v) + any_value(e) AS s FROM cells, floor GROUP BY label, feature),
        prior AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM pts)) AS w FROM pts GROUP BY label),
        score AS (SELECT sample_id, c, any_value(w) - 0.5 * sum(ln(2 * pi() * s) + (v - mu) * (v - mu) / s) AS l
            FROM cells JOIN fitted USING (feature) JOIN prior USING (c) GROUP BY sample_id, c),
        both_sides AS (SELECT sample_id, max(l) FILTER (c = 1) - max(l) FILTER (c = 0) AS d FROM score GROUP BY sample_id)
        SELECT sample_id, CAST(CASE WHEN d > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction, round(1 / (1 + exp(-d)), 5) AS p FROM both_sides""",
}
