"""Cut lines against plain sets of sites."""

import random

from peakforge.llm.line_spread import without_spread_lines

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, sites):
    spread = {}
    for _, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            line = line.strip(WHITE)
            if line:
                spread.setdefault(line, set()).add(s)
    wide = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for d, t, s in rows:
        lines = [] if t is None else t.split("\n")
        cut = [x for x in lines if x.strip(WHITE) in wide]
        if 2 * sum(len(x.strip(WHITE)) for x in cut) < sum(len(x.strip(WHITE)) for x in lines):
            out.append((d, "\n".join(x for x in lines if x.strip(WHITE) not in wide), s, len(lines), len(cut)))
        else:
            out.append((d, t, s, len(lines), 0))
    return sorted(out, key=repr)


def test_against_sets(spark):
    rng = random.Random(1)
    common = [f"shared line number {i}" for i in range(30)]
    rows = []
    for i in range(400):
        lines = [f"own words {i} {j} {rng.random()}" for j in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            k = min(int(rng.expovariate(0.15)), 29)
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ", "\t"]) + common[k] + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines), f"site{rng.randrange(30)}"))
    rows += [(900 + i, f"the {i} own words of this page, many of them\nMore.\nRead on", f"x{i}") for i in range(14)]
    rows += [(1000 + i, "short one\nlonger text of this page here\nfooter of all pages", f"x{i}") for i in range(12)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "\n\n", None), (2003, "footer of all pages", None), (5, rows[5][1], rows[5][2]),
             (None, rows[6][1], None), (2004, "word " * 200_000 + "\nfooter of all pages", "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, h int").repartition(4)
    out = without_spread_lines(docs)
    assert out.columns == ["doc_id", "text", "source", "h", "_n_lines", "_n_cut"]
    got = [(r.doc_id, r.text, r.source, r._n_lines, r._n_cut) for r in out.collect()]
    want = brute(rows, 10)
    assert sorted(got, key=repr) == want and sum(r[4] for r in want) > 100


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"own words of page {i}\nfooter of all pages", f"s{i % 15}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    one = sorted(map(repr, without_spread_lines(docs).collect()))
    monkeypatch.setattr("peakforge.llm.line_spread.SMALL_BYTES", 0)
    monkeypatch.setattr("peakforge.llm.common.SMALL_BYTES", 0)
    assert sorted(map(repr, without_spread_lines(docs).collect())) == one and any("_n_cut=1" in x for x in one)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert without_spread_lines(docs).count() == 0
