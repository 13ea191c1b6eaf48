"""Main text of web pages by site template removal.

Every element subtree that holds text is hashed (tag, own text, hashes of its children). Spark counts on how many different
pages of a host each hash occurs, with partial sums, so a host with a third of all pages is no bottleneck; pages of a host whose
main text is the same are one page there, however often it was fetched. A subtree that recurs on many pages of its host is
template and is deleted. In an article only blocks are judged by recurrence, not headings nor what stands within a line, and a
share of half of the host's pages is asked for, since articles quote each other and share headings.

What a page says of itself is heeded first: navigation, headers and footers outside the article, asides, forms, scripts and
styles go, and so do elements whose class, id or role names an advert, a notice, a sidebar, a menu, a form or reader comments.
A name says so if it ends in such a word ("user-comments") or has one before words of layout only ("ad-slot"); in an article,
what stands within a line, and headings, go by no name. If there is an article (else a main element), the rest of the page goes
too, but for the headline: an h1 beside an article that has none.

A text's blocks are separated by block elements; white space in a block becomes one space, and blocks are joined by one.

Defined results: a null or empty html gives an empty text; a page without a url belongs to the host ''; rows of equal id are
rows of their own; an empty table gives an empty result; other columns play no part. Unclosed, stray and misnested tags are
closed as browsers mostly do. pages must be a table or a result that is read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut

#: Fixed values of HTML: elements without content, elements that break a block, elements whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""
address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
table tbody td tfoot th thead title tr ul
""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
#: Elements that are never main text.
DROPPED = frozenset("""
head script style noscript template iframe object embed svg canvas audio video map nav aside form button select textarea input
label fieldset datalist dialog menu title footer xmp noembed noframes
""".split())
#: Words in class, id or role that name what isn't main text.
NAMED = frozenset("""
ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
cookie cookies consent gdpr notice notification alert popup modal overlay paywall subscribe subscription newsletter signup login
sidebar sidenav aside menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer
comment comments commentlist reply replies respond discussion disqus
share sharing social related recommended widget search form contentinfo complementary
""".split())
#: Words of layout, which may follow one of those words in a name.
LAYOUT = frozenset("""
area bar block body box button buttons card column container content div first group header heading holder icon icons inner
item items label last left link links list main middle module outer page panel part region right row section site slot small
space super text title top unit view widget widgets wrap wrapper zone
""".split())
#: Elements that stand within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag of the first closes an open element of the second without its end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select", "datalist"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
MIN_PAGES, MIN_SHARE, MIN_SHARE_INSIDE = 5, 0.01, 0.5


def names_clutter(names: str) -> bool:
    """Whether a class, id or role names what isn't main text."""
    for name in names.strip("\"'").split():
        words = [w.lower() for w in _SPLIT.findall(name)]
        if words and (words[-1] in NAMED or (words[0] in NAMED and LAYOUT.issuperset(words[1:]))):
            return True
    return False


class Page:
    """Elements of a page in document order; parts are texts and block breaks with the element that they are in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.named = ["html"], [-1], [False]
        self.parts: list[tuple[int, str | None]] = []
        stack = [0]
        at = 0
        find = _TOKEN.search
        while m := find(html, at):
            if m.start() > at:
                self._text(stack[-1], html, at, m.start())
            at = m.end()
            if (name := m[2]) is None:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCKS:
                    self.parts.append((stack[-1], None))
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in BLOCKS:
                self.parts.append((stack[-1], None))
                self._imply(stack, name)
            if name in VOID:
                continue
            if name == "html":
                continue
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.named.append(bool(m[3]) and name not in ("html", "body", "main") and any(map(names_clutter, _NAMES.findall(m[3]))))
            if m[3].endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            stack.append(len(self.tag) - 1)
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(html, at)
                if name not in DROPPED:
                    self._text(stack[-1], html, at, end.start() if end else len(html))
                at = end.start() if end else len(html)
        if at < len(html):
            self._text(stack[-1], html, at, len(html))

    def _text(self, node: int, html: str, start: int, end: int) -> None:
        text = html[start:end]
        if "<" in text:
            text = _LOOSE.sub(" ", text)  # tags in which a quote isn't closed
        self.parts.append((node, unescape(text) if "&" in text else text))

    def _imply(self, stack: list[int], name: str) -> None:
        """Closes what a block's start tag closes."""
        tag = self.tag
        if name == "body" or (name not in ("title", "head") and tag[stack[-1]] == "head"):
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == "head":
                    del stack[k:]
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] in _SCOPE[name]:
                    break
                if tag[stack[k]] in CLOSES[name]:
                    del stack[k:]
                    break
        elif name not in ("br", "title"):
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == "p":
                    del stack[k:]
                    break
                if tag[stack[k]] in ("td", "th", "table", "button", "article", "section", "div", "body", "li"):
                    break

    def judged(self) -> tuple[list[bool], list[bool]]:
        """Whether each element is dropped for what the page says, and whether it is inside the article (or main)."""
        n = len(self.tag)
        holder = [False] * n
        tops = [i for i in range(n) if self.tag[i] == "article" and not self.named[i]] or [i for i in range(n) if self.tag[i] == "main"]
        for i in tops:
            p = self.parent[i]
            while p >= 0 and not holder[p]:
                holder[p] = True
                p = self.parent[p]
        top = set(tops)
        inside, dropped = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            up_in, up_out = (inside[p], dropped[p]) if p >= 0 else (False, False)
            inside[i] = up_in or i in top
            tag = self.tag[i]
            own = tag in DROPPED or (tag == "header" and not up_in) or (self.named[i] and not (up_in and (tag in INLINE or tag in HEADINGS)))
            dropped[i] = up_out or (own and not (holder[i] and not up_out))
        if tops:
            headed = any(t == "h1" and i and not d for t, i, d in zip(self.tag, inside, dropped, strict=True))
            for i in range(n):  # an h1 beside an article without one belongs to it
                p = self.parent[i]
                holder[i] = holder[i] or (not headed and not inside[i] and (self.tag[i] == "h1" or (p >= 0 and holder[p] and self._under_h1(i))))
            dropped = [d or not (i or h) for d, i, h in zip(dropped, inside, holder, strict=True)]
        return dropped, inside

    def _under_h1(self, i: int) -> bool:
        while i >= 0 and self.tag[i] != "h1":
            i = self.parent[i]
        return i >= 0

    def templates(self, inside: list[bool]) -> Iterator[int]:
        """Elements that recurrence may judge."""
        for i, tag in enumerate(self.tag):
            if tag not in ("html", "body", "article", "main") and not (inside[i] and (tag in INLINE or tag in HEADINGS)):
                yield i

    def hashes(self) -> list[int]:
        """A hash of each subtree; 0 for one without text."""
        n = len(self.tag)
        own: list[list[bytes]] = [[] for _ in range(n)]
        for node, text in self.parts:
            if text and (t := " ".join(text.split())):
                own[node].append(t.encode("utf-8", "surrogatepass"))
        out = [0] * n
        for i in range(n - 1, -1, -1):
            if own[i]:
                out[i] = h = xxhash.xxh3_64_intdigest(b"\0".join([self.tag[i].encode(), *own[i]])) >> 1 or 1
                if self.parent[i] >= 0:
                    own[self.parent[i]].append(b"\1" + h.to_bytes(8, "little"))
        return out

    def text(self, gone: set[int] = frozenset(), dropped: list[bool] | None = None) -> str:
        """The main text without the subtrees whose hashes are in gone."""
        if dropped is None:
            dropped, inside = self.judged()
            if gone:
                hashes = self.hashes()
                found = {i for i in self.templates(inside) if hashes[i] in gone}
                for i in range(len(self.tag)):
                    p = self.parent[i]
                    dropped[i] = dropped[i] or (p >= 0 and dropped[p]) or i in found
        holds: list[str] = []
        blocks: list[str] = []
        for node, text in self.parts:
            if text is None:
                if holds:
                    blocks.append("".join(holds))
                    holds = []
            elif not dropped[node]:
                holds.append(text)
        blocks.append("".join(holds))
        return " ".join(" ".join(blocks).split())


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_share_inside: float = MIN_SHARE_INSIDE) -> DataFrame:
    """id_col, url_col and text of every page."""
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), id_col, F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, list[int], list[int]]] = []
            for url, html in zip(b.column("_url").to_pylist(), b.column("_html"), strict=True):
                page = Page(html.as_py() or "")
                (dropped, inside), hashes = page.judged(), page.hashes()
                judged = {hashes[i]: inside[i] for i in page.templates(inside) if hashes[i]}
                host, own = (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in (host_of(url), page.text(dropped=dropped)))
                out.append((host, own, [h for h, i in judged.items() if not i], [h for h, i in judged.items() if i]))
            made = {k: pa.array([o[j] for o in out], t) for j, (k, t) in enumerate((("host", pa.int64()), ("page", pa.int64()), ("outside", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64()))))}
            yield pa.RecordBatch.from_pydict({"row": b.column("_row"), **made})

    listed = cut(rows.select("_row", "_url", "_html").mapInArrow(hash_all, "row long, host long, page long, outside array<long>, inside array<long>"))
    each = lambda rows, *keys: rows.select(*keys, F.explode("outside").alias("hash"), F.lit(False).alias("inside")).union(rows.select(*keys, F.explode("inside"), F.lit(True)))
    first = listed.groupBy("host", "page").agg(F.min("row").alias("row"))
    hosts = first.groupBy("host").agg(F.count("*").alias("pages"))
    counts = each(listed.join(first, ["host", "page", "row"], "left_semi"), "host").groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).where(F.col("n") >= min_pages)
    template = counts.join(hosts, "host").where(F.col("n") >= F.when(F.col("inside"), min_share_inside).otherwise(min_share) * F.col("pages")).select("host", "hash")
    gone = each(listed, "row", "host").join(template, ["host", "hash"], "left_semi").groupBy("row").agg(F.collect_set("hash").alias("gone"))
    gone = cut(gone)  # what it shuffled leaves the disk before the pages are shuffled
    joined = rows.join(gone, F.col("_row") == F.col("row"), "left").select(id_col, "_url", "_html", "gone")

    @F.pandas_udf("string")
    def extract(html: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([Page(h or "").text(set() if g is None else set(np.asarray(g).tolist())) for h, g in zip(html, gone, strict=True)], dtype=object)

    return joined.select(id_col, F.col("_url").alias(url_col), extract("_html", "gone").alias("text"))
