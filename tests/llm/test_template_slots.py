"""Extracted text against the text pages were made from."""

import html
import random
import re

import pyarrow as pa
import pytest

from peakforge.llm import template_slots
from peakforge.llm.common import table
from peakforge.llm.template_slots import main_text, templates

FRAMES = [
    "<html><head><title>{t}</title><script>var a='</p><article>';</script></head><body><header><h2>Site {m}</h2></header><nav><ul><li>Home</li>"
    "<li>{m}</li></ul></nav><aside class=side>{m}</aside><main><article>{a}</article><section class='comments'><article><p>{m} nice</p>"
    "</article></section></main><form><label>Search {m}</label><input></form><footer>{m}</footer></body></html>",
    "<body><div id='top-menu'>{m}</div><div class=cookie-notice>We use {m}</div><div class='content'>{a}</div><div class='bottom'>{m}</div>"
    "<div class='ad-slot'>{m}</div></body>",
    "<div role=navigation>{m}</div><div class=wrap><div class=left><p>Fixed words here</p>{m}</div><div class=post><!-- x <p>no</p> -->{a}"
    "<div class='share'>tell friends</div><p>Fixed line in every post</p></div></div><noscript>{m}</noscript>",
]


def article(rng, i):
    words = ["tree", "a < b", "R&D", "«été»", "x", "stone", "2 > 1", "\"said\""]
    blocks = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 30))) + f" {i}" for _ in range(rng.randint(3, 6))]
    made = []
    for j, b in enumerate(blocks):
        coded = html.escape(b).replace(" ", rng.choice([" ", "\n  ", "\t"]))
        made.append(f"<h1>{coded}</h1>" if not j else rng.choice(
            ["<p>{}</p>", "<p><b>{}<br>", "<ul><li>{}</ul>", "<div>{}</div>", "<p>{}", "<blockquote><p>{}</p></blockquote>"]).format(coded))
    return blocks, "".join(made)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    pages, want = [], {}
    for i in range(150):
        blocks, body = article(rng, i)
        frame = i % 3
        page = FRAMES[frame].format(t="Title", m=" ".join(rng.choice(["one", "two", "six"]) for _ in range(3)), a=body)
        pages.append((i, f"https://Www.host{frame}.example.com:80/p/{i}", page))
        want[i] = "\n\n".join(" ".join(b.split()) for b in blocks)
    return pages, want


def test_layouts(spark, made):
    pages, want = made
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, n_chars int").repartition(4)
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    wrong = [(r.page_id, r.text, want[r.page_id]) for r in rows if r.text != want[r.page_id]]
    assert len(rows) == 150 and not wrong, wrong[:2]
    assert all(r.n_chars == len(r.text) for r in rows)


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        inner = re.search("<article>(.*)</article>", sources[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner))]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no address", "plain text &amp; more"), (4, None, "<p>one<p>two"), (4, None, "<p>one<p>two"),
            (5, "http://x.example/", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "http://y.example", "<p a='unclosed>text<p>more"),
            (None, "http://z.example", "<script>never closed"), (7, "http://z.example", "<article><p>" + "long text " * 200_000 + "</article>"),
            (8, "//w.example", "a <b>bold</b>word < 3 &copy; <i>x</i>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == got[2] == got[None] == [""] and got[3] == ["plain text & more"] and got[4] == ["one\n\ntwo"] * 2
    assert got[5] == ["deep"] and got[8] == ["a boldword < 3 © x"] and len(got[7][0]) == 1_999_999
    assert main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("frame", [
    "<body><div class='content has-sidebar'>{a}</div><div class=bottom>{m}</div></body>",
    "<body><div id=page class='no-sidebar'><div class=search-result>{a}</div></div><div class=sidebar>{m}</div></body>",
    "<body><div class='search-result'><article>{a}</article></div><div class=bottom>{m}</div></body>",
    "<body><article><div class=widget>{a}</div><div class=share>{m}</div></article></body>",
    "<body><span class=overlay>{a}</span><span class=ad>{m}</span></body>",
    "<body><div class=wrap><div class='comment-box'><main>{a}</main></div></div><div class=related>{m}</div></body>"])
def test_words_do_not_mark_what_holds_the_article(spark, frame):
    pages = [(i, f"http://h.example/{i}", frame.format(a=f"<h1>Title {i}</h1>" + f"<p>Long text of its own {i}, {'word ' * i}end</p>" * 2, m="tell"))
             for i in range(8)] + [(99, "http://alone.example/", frame.format(a="<h1>Title</h1><p>Only text of its host</p>", m="tell"))]
    got = {r.page_id: r.text.split("\n\n") for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[99][:2] == ["Title", "Only text of its host"]
    assert all(got[i][:2] == [f"Title {i}", " ".join(f"Long text of its own {i}, {'word ' * i}end".split())] for i in range(8))


def test_ids_of_headings_and_sections(spark):
    inner = ("<h1>One {i}</h1><p>First text {i}</p><h2 id='related-work'>Related work {i}</h2><p>Second text {i}</p>"
             "<section id='side-effects'><p>Third text {i}</p></section><div class=ad>buy</div>")
    rows = [(i, f"http://h{i % 2}.example/{i}", ("<article>{}</article>" if i % 2 else "<div class=post>{}</div>").format(inner.format(i=i)))
            for i in range(8)]
    for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        assert r.text.split("\n\n") == [f"One {i}", f"First text {i}", f"Related work {i}", f"Second text {i}", f"Third text {i}"]


def test_copies_and_revisions_of_one_article_keep_it(spark):
    frame = "<body><div class=top>Site</div><div class=post><p>Line in every post</p>{}</div></body>"
    article = [f"Block {j} of the article that is copied" for j in range(6)]
    want, rows = {}, []

    def add(host, blocks, tail=""):
        want[len(rows)] = blocks
        rows.append((len(rows), f"http://{host}.example/{len(rows)}", frame.format("".join(f"<p>{b}</p>" for b in blocks)) + tail))
    for i in range(12):
        add("same", article)
    for i in range(12):
        add("revised", [*article[:5], f"Revision {i}"])
    for i in range(40):
        add("mixed", article if i % 8 else [f"Other words of {i} that stand here", f"More of {i} that stands here alone"], f"<!-- {i} -->")
    for i in range(12):
        add("rows", [f"Own words of {i} and a few more", f"Again words of {i} alone"])
    rows += [(1000 + i, *rows[-1][1:]) for i in range(100)]
    got = {r.page_id: r.text.split("\n\n") for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")
                                                              .repartition(4)).collect()}
    line = "Line in every post"
    hosts = {i: rows[i][1].split("//")[1].split(".")[0] for i in want}
    for i, blocks in want.items():
        kept = {"same": ["Site", line], "revised": [line]}.get(hosts[i], [])  # one page in 12 rows has no template
        assert got[i] == [*kept, *blocks], hosts[i]
    assert all(got[1000 + i] == want[75] for i in range(100))


def test_copied_rows_do_not_hide_the_template(spark):
    def page(i, fixed):
        return f"<div class=post><p>Words of page {i} and some more of them</p>{'<p>Fixed line</p><p>Fixed too</p>' if fixed else ''}<p>End of {i}</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i, i < 9)) for i in range(10)] + [(100 + i, "http://h.example/9", page(9, False)) for i in range(90)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Words of page {i} and some more of them\n\nEnd of {i}" for i in range(10))


def test_slot_comes_from_equal_vectors(spark, made, monkeypatch):
    """With numbers that have nothing to do with one another in place of the vectors no class and no slot is left."""
    df = spark.createDataFrame(made[0], "page_id long, url string, html string")
    assert templates(df).filter("slot <> 0").count() == 3
    real = template_slots._tokens

    def unrelated(batches):
        for batch in real(batches):
            at = batch.schema.get_field_index("vector")
            mixed = [hash((p, n, v)) for p, n, v in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "vector")))]
            yield batch.set_column(at, "vector", pa.array(mixed, pa.int64()))
    monkeypatch.setattr(template_slots, "_tokens", unrelated)
    assert templates(df).filter("slot <> 0").count() == 0


def test_single_element_on_some_pages_is_no_class(spark):
    """The wrapper of seven in ten pages has a partner of the same vector; that of eight in ten has none."""
    def page(i):
        inner = f"<p>Text of page {i} that is long enough</p>" + f"<p>More {i}</p>" * (i % 3)
        return f"<div class=post><h1>Title {i}</h1>{inner}</div>" if i % 10 < 7 else f"<div class=other>{inner}</div><p>Outside {i}</p>"

    def alone(i):
        inner = f"<p>Text of page {i} that is long enough</p>" + f"<p>More {i}</p>" * (i % 3)
        return f"<div class=post>{inner}</div>" if i % 10 < 8 else f"<section>{inner}</section>"
    rows = [(i, "http://pair.example/", page(i)) for i in range(20)] + [(100 + i, "http://alone.example/", alone(i)) for i in range(20)]
    slots = {r.host: r.slot for r in templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert slots["pair.example"] != 0 and not slots.get("alone.example")


def test_letters_that_grow_in_lower_case(spark):
    body = "<p>" + "\u0130" * 40 + "</p><SCRIPT>var a = '</scripts>';</Script ><p>After the script</p><style>x</STYLE><p>End</p>"
    rows = [(1, "http://h.example/", f"<article>{body}</article>")]
    text = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text
    assert text == "\u0130" * 40 + "\n\nAfter the script\n\nEnd"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<body><div class=top>x</div><div class=post>{}</div></body>"])
def test_words_inside_the_article(spark, around):
    inner = ("<h1>Title {i}</h1><p>Find the <mark class=search>needle</mark> in page {i}, see <a class='related'>this</a>.</p>"
             "<h2 class=social>Social life {i}</h2><p>Text {i}</p><div id=side>On the side {i}</div><p>Buy <b class=ad>soap</b> end {i}</p>"
             "<p><a class=related>One</a> <a class=related>two</a></p><div id=sidebar>Bar {i}</div><p><span class=share>tell</span></p>")
    rows = [(i, "http://h.example/", around.format(inner.format(i=i))) for i in range(8)]
    for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        assert r.text.split("\n\n") == [f"Title {i}", f"Find the needle in page {i}, see this.", f"Social life {i}", f"Text {i}",
                                        f"On the side {i}", f"Buy end {i}"]
