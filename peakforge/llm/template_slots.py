"""Main text of web pages by deducing each site's template.

Tokens are elements, told apart by the path that leads to them, and text nodes under a path. The pages of one host that share a
template give its tokens the same occurrence vector (how often per page). Vectors are compared by a fingerprint that is
summed over pages in Spark, so a host with a third of all pages is never gathered. Tokens with equal vectors that occur on
at least half of a host's pages form an equivalence class; the page itself is a token, so what is once on every page is of its
class. A class is valid if it has several tokens and its elements occur once in their parent; an element of no such class is
no part of the template. Valid classes nest by paths. The gaps between a template's tokens are its slots; the one that holds
most of the text is the article, and is extracted from every page. Frequent text nodes may be the template's or those of one article in many copies or revisions.
Only pages whose article is for the larger part other text are witnesses, and witnesses with the same other text are one:
what stands on enough distinct witnesses is the template's and no content. Pages with equal bytes count as one throughout.

Elements that never hold an article (menus, forms, scripts, ...) hold no slot. Nor do elements whose class, id or role names
something beside it (adverts, sidebars, ...), unless they turn out to hold the article: see ``_Page.settle``. Such words mark
an inline element only if it is a block of its own or an advert, and inside the article neither a heading nor an anchor.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import SMALL_BYTES, keep, maybe_broadcast

LEAST_PAGES = 3  # a host with fewer pages has no template
ELEMENT_SHARE = 0.5  # pages of a host that an element of its template is on
TEXT_SHARE = 0.8  # pages of a host, and distinct witnesses, that a text node of its template is on

# HTML element names, by how they are treated.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp", "noembed", "noframes"}
OUT = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "audio", "video", "canvas", "map",
       "fieldset", "datalist", "label"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr",
          "img"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}  # their ids are anchors
STATES = {"has", "no", "with", "without"}  # has-sidebar says what a wrapper is laid out for, not what it is
# Words that also name parts of an article: an id of such words only may be an anchor in it.
ANCHORS = {"side", "search", "form", "skip", "promotion"}
# Words that name adverts, also in the midst of a sentence.
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "popup", "hidden"}
# Words in class, id and role that name what is not the article.
SIDE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
        "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "footer", "masthead", "topbar",
        "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
        "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment",
        "comments", "disqus", "reply", "replies", "respond", "search", "searchbox", "pagination", "pager", "widget", "toolbar", "skip",
        "copyright", "complementary", "contentinfo", "form", "dialog", "disclaimer", "hidden"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][\w:-]*)[^>]*>|<[!?/][^>]*>|([^<]+|<)",
                   re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Letters outside ASCII are never folded: some change their number in lower case.
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


def _aside(tag: str, attributes: str, in_article: bool) -> tuple[bool, str, str]:
    """Whether an element cannot hold article text; how its words mark it as beside the article ("side", "slug" or not at all);
    and the name by which pages of a host tell it from others. A slug is a heading, a section's id of several words, or an id
    of words that also name parts of an article. An inline element is "inline" unless its words name an advert."""
    if tag in OUT or tag == "header" and not in_article:
        return True, "", tag
    name, mark = tag, ""
    if attributes:
        for key, *values in NAMES.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, "", tag
            if key == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    return True, "", tag
                continue
            if tag not in ("html", "body") and not (key == "id" and tag in HEADINGS):
                words = set()
                for part in value.split():
                    found = {w.lower() for w in PART.findall(part)}
                    words |= set() if found & STATES else found
                if words & SIDE or "header" in words and not in_article and tag != "h1":
                    named = key == "id" and (tag == "section" and words - SIDE or words & SIDE and words & SIDE <= ANCHORS)
                    kind = "inline" if tag in INLINE and not words & ADVERTS else "slug" if tag in HEADINGS or named else "side"
                    mark = kind if not mark or kind == "side" else mark
            if key == "class" and tag not in INLINE:
                name = f"{tag}.{re.sub('[0-9]+', '', value.split()[0]) if value.split() else ''}"
    return False, mark, name


class _Page:
    """Blocks of one page in order, each with the paths of the elements around it; and the counts of its tokens."""

    def __init__(self, text: str, slot: int = 0):
        self.blocks: list[tuple[str, tuple[int, ...]]] = []
        self.nodes: dict[int, list] = {}  # path: [parent, name, times, characters]
        self.article: int | None = None  # the first article or main element
        self.stack: list[tuple[str, str, int, bool, tuple[int, ...]]] = []  # tag, name, path, aside, marked elements around
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.at: tuple[int, ...] = ()
        self.read: list[tuple[list, tuple[int, ...]]] = []  # parts of a block, paths
        self.opened: list[tuple[str, str, int, int, tuple[int, ...]]] = []  # tag, name, path, parent, marked elements around
        self.marked: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []  # mark or article tag; those around it; paths around it
        self._read(text)
        self.settle(slot)

    def settle(self, slot: int) -> None:
        """Drop the elements that are marked, and count what is left.

        A marked element stays if it holds the host's slot, a main element or more than half of the text: of the article
        element, if one is outside all marked elements, else of the page. Without one outside, it also stays around the largest
        article element that has half as much text as is outside. A slug marks no element inside the article, and words mark
        no inline element that stands in a block with other text.
        """
        sides = {i for i, (mark, *_) in enumerate(self.marked) if mark in ("side", "slug", "inline")}
        if sides:
            within = set()
            for parts, _ in self.read:
                inline = [{i for i in around if self.marked[i][0] == "inline"} for words, around in parts if words.strip()]
                within.update(*(inline if set() in inline else ()))
            sides -= within
        out: set[int] = set()
        if sides:
            size, free, total = [0] * len(self.marked), 0, 0
            for parts, _ in self.read:
                for words, around in parts:
                    n = len(words.strip())
                    total += n
                    free += 0 if any(i in sides for i in around) else n
                    for i in around:
                        size[i] += n
            articles = [i for i in range(len(self.marked)) if self.marked[i][0] in ARTICLE]
            scope = next((i for i in articles if not sides.intersection(self.marked[i][1])), None)
            whole = total if scope is None else size[scope]
            stay = {i for i in sides if 2 * size[i] > whole and (scope is None or scope in self.marked[i][1])}
            for i in articles:
                if self.marked[i][0] == "main":
                    stay.update(self.marked[i][1])
            if scope is None and articles:
                best = max(articles, key=lambda i: (size[i], -i))
                if 2 * size[best] >= free:
                    stay.update(self.marked[best][1])
            if slot:
                for _, _, path, _, around in self.opened:
                    if path == slot:
                        stay.update(around)
            for i in sides:
                mark, around, paths = self.marked[i]
                if mark == "slug" and (slot and slot in paths or any(self.marked[j][0] in ARTICLE for j in around)):
                    stay.add(i)
            out = sides - stay
        for tag, name, path, parent, around in self.opened:
            if not out or out.isdisjoint(around):
                node = self.nodes.setdefault(path, [parent, name, 0, 0])
                node[2] += 1
                if tag in ARTICLE and self.article is None:
                    self.article = path
        for parts, at in self.read:
            block = " ".join(html.unescape("".join(w for w, around in parts if not out or out.isdisjoint(around))).split())
            if block:
                self.blocks.append((block, at))
                for path in at:
                    self.nodes[path][3] += len(block)

    def _flush(self) -> None:
        if self.parts:
            self.read.append((self.parts, self.at))
            self.parts = []

    def _close(self, depth: int) -> None:
        if any(s[0] not in INLINE for s in self.stack[depth:]):
            self._flush()
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
            for ended in ("p", *ENDS.get(tag, ())):
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.stack[depth][0] == ended:
                        self._close(depth)
                        break
                    if self.stack[depth][0] not in INLINE and self.stack[depth][0] not in ENDS.get(tag, ()):
                        break
        inside = any(s[0] in ARTICLE for s in self.stack)
        aside, mark, name = _aside(tag, attributes, inside)
        aside = aside or bool(self.stack) and self.stack[-1][3]
        parent = self.stack[-1][2] if self.stack else 0
        path = parent if tag in INLINE else _hash(parent, name)
        around = self.stack[-1][4] if self.stack else ()
        if not aside and (mark or tag in ARTICLE):
            paths = tuple(s[2] for s in self.stack)
            for kind in (mark, tag if tag in ARTICLE else ""):
                if kind:
                    self.marked.append((kind, around, paths))
                    around = (*around, len(self.marked) - 1)
        self.stack.append((tag, name, path, aside, around))
        if not aside and tag not in INLINE:
            self.opened.append((tag, name, path, parent, around))

    def _read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            found = TOKEN.match(text, at)
            if found is None:  # an unclosed quote: the tag ends at the next bracket
                end = text.find(">", at)
                at = n if end < 0 else end + 1
                continue
            at = found.end()
            opened, attributes, closed, words = found.groups()
            if words is not None:
                if self.stack and not self.stack[-1][3] or not self.stack:
                    if not self.parts:
                        self.at = tuple(dict.fromkeys(s[2] for s in self.stack if s[0] not in INLINE))
                    self.parts.append((words, self.stack[-1][4] if self.stack else ()))
            elif opened:
                tag = opened.lower()
                if tag in RAW:
                    if not attributes.endswith("/"):
                        end = RAW_ENDS[tag].search(text, at)
                        close = text.find(">", end.end()) if end else -1
                        at = n if close < 0 else close + 1
                elif tag in VOID:
                    if tag == "br":
                        self.parts.append((" ", ())) if self.parts else None
                    elif tag == "hr":
                        self._flush()
                elif attributes.endswith("/") and tag not in INLINE:
                    self._flush()
                else:
                    self._open(tag, attributes)
            elif closed:
                tag = closed.lower()
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.stack[depth][0] == tag:
                        self._close(depth)
                        break
        self._flush()


def _host(url):
    """Host of an address, in lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)", 1)), F.lit(""))


TOKENS = "host string, path long, parent long, name string, line long, times int, characters double, vector long, weight double"
WITNESSES = "host string, rest long, line long"


def _tokens(batches):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
    for batch in batches:
        rows = []
        for host, page, text, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
            seen, weight = _Page(text or ""), 1 / copies
            rows.append((host, 0, 0, "", 0, 1, 0.0, _hash(page, 1), weight))
            for path, (parent, name, times, characters) in seen.nodes.items():
                rows.append((host, path, parent, name, 0, times, characters * weight, _hash(page, times), weight))
            counts: dict = {}
            for block, around in seen.blocks:
                key = around[-1] if around else 0, _hash(block)
                counts[key] = counts.get(key, 0) + 1
            for (path, line), times in counts.items():
                rows.append((host, path, 0, None, line or 1, times, 0.0, _hash(page, times), weight))
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in TOKENS.split(", ")])


def _article(text: str | None, slot: int | None) -> list[str]:
    """Blocks of a page under its host's slot, or else of its article or main element, or else all."""
    page = _Page(text or "", slot or 0)
    own = slot if slot and slot in page.nodes else page.article
    if page.article is not None and own != page.article and not any(own in around and page.article in around for _, around in page.blocks):
        own = page.article
    return [block for block, around in page.blocks if own is None or own in around]


def _witnesses(batches):
    """Per witness a row with line 0 and one per frequent line in its article."""
    for batch in batches:
        rows = []
        for host, text, slot, lines in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines, found, rest, held = set(lines), set(), [], 0
            for block in _article(text, slot):
                line = _hash(block) or 1
                if line in lines:
                    found.add(line)
                    held += len(block)
                else:
                    rest.append(block)
            if sum(map(len, rest)) > held:
                mark = _hash(*rest)
                rows += [(host, mark, 0), *((host, mark, line) for line in found)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                         ["host", "rest", "line"])


def _template(frame: pd.DataFrame) -> pd.DataFrame:
    """The slot that holds the article, and the frequent text nodes, from the valid classes of one host."""
    elements = frame[(frame["line"] == 0) & (frame["path"] != 0) & (frame["most"] == 1)]
    children: dict = {}
    for r in elements.itertuples(index=False):
        children.setdefault(r.parent, []).append(r)
    slot, left = 0, None
    while slot in children:
        best = max(children[slot], key=lambda r: (r.characters * (4 if r.name.split(".")[0] in ARTICLE else 1), -r.path))
        if left is not None and best.characters < left / 2 and best.name.split(".")[0] not in ARTICLE:
            break
        slot, left = best.path, best.characters
        if best.name.split(".")[0] in ARTICLE:
            break
    lines = sorted(frame.loc[frame["line"] != 0, "line"].unique().tolist())
    return pd.DataFrame([(frame["host"].iloc[0], slot, lines)], columns=["host", "slot", "lines"])


def _sent(found: DataFrame) -> DataFrame:
    size = found.agg(F.sum(64 + F.char_length("host") + 8 * F.size("lines"))).first()[0] or 0
    return F.broadcast(found) if size <= SMALL_BYTES else found


def templates(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(``host``, ``slot``, ``lines``): per host with enough pages, the path of its article and the texts of its template."""
    body = F.col(text).cast("string")
    marked = pages.select(_host(F.col(url).cast("string")).alias("host"), F.coalesce(body, F.lit("")).alias("_html"))
    marked = marked.withColumns({"m0": F.xxhash64("host", "_html"), "m1": F.xxhash64(F.lit(1), "host", "_html")})
    copies = keep(marked.groupBy("m0", "m1").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    tokens = (marked.join(maybe_broadcast(copies, 64), ["m0", "m1"], "left")
              .select("host", F.concat_ws(":", "m0", "m1").alias("page"), "_html", F.coalesce("copies", F.lit(1)).alias("copies"))
              .mapInArrow(_tokens, TOKENS))
    # Equal vectors have equal fingerprints: every page adds a number drawn from the page and its count. Copies of a page have
    # one page's weight in all; their numbers cancel out, or not, for all tokens alike.
    counted = tokens.groupBy("host", "path", "line").agg(
        F.first("parent").alias("parent"), F.first("name").alias("name"), F.round(F.sum("weight")).cast("long").alias("pages"),
        F.max("times").alias("most"), F.round(F.sum("characters")).cast("long").alias("characters"),
        F.bit_xor("vector").alias("vector"))
    counted = keep(counted.filter((F.col("line") == 0) | (F.col("pages") >= LEAST_PAGES)))
    total = counted.filter("path = 0 and line = 0").select("host", F.col("pages").alias("total")).filter(F.col("total") >= LEAST_PAGES)
    share = F.when(F.col("line") == 0, ELEMENT_SHARE).otherwise(TEXT_SHARE)
    frequent = counted.join(total, "host").filter(F.col("pages") >= share * F.col("total"))
    size = frequent.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("size"))
    # A class of one token is chance, unless it is a text on every page, several times on some.
    valid = frequent.join(size, ["host", "vector", "pages"]).filter(
        (F.col("size") > 1) | (F.col("line") != 0) & (F.col("pages") == F.col("total")))
    found = keep(valid.select("host", "path", "parent", "name", "line", "most", "characters").groupBy("host").applyInPandas(
        _template, "host string, slot long, lines array<long>"))
    seen = (marked.select("host", "_html").join(_sent(found.filter(F.size("lines") > 0)), "host").select("host", "_html", "slot", "lines")
            .mapInArrow(_witnesses, WITNESSES))
    seen = keep(seen.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")))
    total = seen.filter("line = 0").select("host", F.col("pages").alias("total")).filter(F.col("total") >= LEAST_PAGES)
    lines = (seen.filter("line <> 0").join(total, "host").filter(F.col("pages") >= TEXT_SHARE * F.col("total"))
             .groupBy("host").agg(F.collect_list("line").alias("own")))
    return found.join(lines, "host", "left").select("host", "slot", F.coalesce("own", F.array().cast("array<long>")).alias("lines"))


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """The article of every page: id, url, ``text``, ``n_chars`` (its code points).

    Blocks in page order, joined by two line feeds; character references decoded, white space inside a block one space. A
    null or empty page has an empty text. A page without its host's slot, or whose host has too few pages, gives its
    article or main element, or else all blocks outside menus and the like. Repeated pages give equal rows; pages without
    a host share one template. Other columns are not read.
    """
    found = keep(templates(pages, url, text))
    body, address = F.col(text).cast("string"), F.col(url).cast("string")
    joined = (pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"), body.alias("_html"), _host(address).alias("host"))
              .join(_sent(found), "host", "left").select("_id", "_url", "_html", "slot", "lines"))

    def run(batches):
        for batch in batches:
            texts = []
            for source, slot, lines in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                lines = set(lines or ())
                texts.append("\n\n".join(b for b in _article(source, slot) if not (lines and (_hash(b) or 1) in lines)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_column, url, "text", "n_chars"])
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{url}` {kinds[url]}, text string, n_chars long")
