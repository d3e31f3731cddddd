"""Main text of web pages by composite text density.

The page becomes a tree. For each node: C characters of text, T tags, and LC and LT those within
links, all over its subtree and without page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts). The composite density is

    C / T * ln(C / LC * T / LT) / ln(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with b the body, and the density sum of a node adds up its children (its own text counts as one).
The node of the largest sum is the main text, widened to the article or main element around it; in
pages without one, the smallest density on the path from it to the body is the threshold from which
the other subtrees of that path count too, each by its own node of the largest sum.

Text is cut into blocks at block elements; white space inside a block becomes one space, blocks are
joined by a newline. Defined cases: null or empty html gives an empty text; markup left open runs to
the end of the page; other columns are ignored; repeated rows each keep a row; tables without rows
give no rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, table

# Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br nobr".split())
FURNITURE = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog head title audio video map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert sponsor promo banner sidebar side nav navbar navigation menu footer masthead cookie consent gdpr notice alert popup modal overlay login signin signup respond reply replies disqus pager".split())
DOUBTFUL = frozenset("copyright disclaimer discussion legal related share sharing skip social widget".split())
STEMS = ("comment", "advert", "sponsor", "cookie", "sidebar", "breadcrumb", "recommend", "subscri", "newsletter", "pagina", "promo")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def furniture(tag: str, attrs: str, in_article: bool) -> int:
    """2 for page furniture, 1 for what counts as such if it is mostly links, else 0."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return 2
    if "=" not in attrs and "hidden" not in attrs or tag in ("html", "body", "article", "main"):
        return 0
    doubt = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for w in _PART.findall(value):
                w = w.lower()
                if w in WORDS or w.startswith(STEMS) or w == "header" and not in_article:
                    return 2
                doubt = max(doubt, int(w in DOUBTFUL))
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
    return doubt


class _Tree:
    """Nodes in page order; events are text, or a block's begin or end (None)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.skip, self.doubt = ["body"], [-1], [False], [False]
        self.begin, self.end = [0], [0]
        self.chars, self.links, self.own = [0], [0], [0]
        self.events: list[str | None] = []
        stack, open_, at, size = [0], {}, 0, len(page)
        for m in _TAG.finditer(page):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(page[at : m.start()], stack[-1])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._close(name, stack, open_)
                continue
            if name in ("html", "body"):
                continue
            if name == "br" or name in VOID:
                self.events.append(" " if name in INLINE or name in ("input", "link", "meta") else None)
                self._tags(stack[-1])
                continue
            if name not in INLINE:
                if open_.get("p"):
                    self._close("p", stack, open_)
                for other in CLOSED_BY.get(name, ()):
                    self._implied(other, LISTS[name], stack, open_)
            if name in RAW:
                close = _CLOSE[name].search(page, at)
                at = close.start() if close else size
                continue
            self._open(name, m[3], stack, open_)
        if at < size:
            self._text(page[at:], stack[-1])
        for i in stack:
            self.end[i] = len(self.events)

    def _tags(self, i: int) -> None:
        self.own[i] += 1

    def _open(self, name: str, attrs: str, stack: list[int], open_: dict[str, int]) -> None:
        up = stack[-1]
        self.tag.append(name)
        self.parent.append(up)
        kind = furniture(name, attrs, bool(open_.get("article")))
        self.skip.append(self.skip[up] or kind == 2)
        self.doubt.append(kind == 1)
        if name not in INLINE:
            self.events.append(None)
        self.begin.append(len(self.events))
        self.end.append(-1)
        self.chars.append(0)
        self.links.append(0)
        self.own.append(0)
        stack.append(len(self.tag) - 1)
        open_[name] = open_.get(name, 0) + 1

    def _pop(self, stack: list[int], open_: dict[str, int]) -> None:
        i = stack.pop()
        self.end[i] = len(self.events)
        open_[self.tag[i]] -= 1
        if self.tag[i] not in INLINE:
            self.events.append(None)

    def _close(self, name: str, stack: list[int], open_: dict[str, int]) -> None:
        if not open_.get(name):
            return
        if name in INLINE:  # an end tag of an inline element doesn't close the block it stands in
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == name:
                    break
                if self.tag[stack[k]] not in INLINE:
                    return
        while self.tag[stack[-1]] != name:
            self._pop(stack, open_)
        self._pop(stack, open_)

    def _implied(self, name: str, within: set[str], stack: list[int], open_: dict[str, int]) -> None:
        if open_.get(name):
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag == name:
                    return self._close(name, stack, open_)
                if tag in within:
                    return None
        return None

    def _text(self, s: str, i: int) -> None:
        if self.skip[i]:
            return
        if "&" in s:
            s = _html.unescape(s)
        self.events.append(s)
        n = len(" ".join(s.split()))
        if n:
            self.chars[i] += n


def main_text(page: str | None) -> str:
    if not page:
        return ""
    t = _Tree(page)
    n, skip = len(t.tag), t.skip
    own = list(t.chars)
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[t.parent[i]] or t.tag[i] == "a"
    c, tags, lc, lt = list(own), list(t.own), [x if k else 0 for x, k in zip(own, in_link, strict=True)], [0] * n
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        if t.doubt[i] and not skip[i] and 2 * lc[i] >= c[i]:
            skip[i] = True
            t.events[t.begin[i] : t.end[i]] = [None] * (t.end[i] - t.begin[i])
        if not skip[i]:
            c[p] += c[i]
            tags[p] += tags[i] + 1
            lc[p] += lc[i]
            lt[p] += lt[i] + (t.tag[i] == "a")
    if not c[0]:
        return ""
    for i in range(1, n):
        skip[i] = skip[i] or skip[t.parent[i]]
    share = lc[0] / c[0]

    def density(i: int) -> float:
        if not c[i]:
            return 0.0
        plain = c[i] / max(tags[i], 1)
        base = math.log(math.log(c[i] / max(c[i] - lc[i], 1) * lc[i] + share * c[i] + math.e))
        return plain * math.log(c[i] / max(lc[i], 1) * max(tags[i], 1) / max(lt[i], 1)) / base if base > 1e-9 else plain

    dense = [0.0 if skip[i] else density(i) for i in range(n)]
    total = [float(x) for x in own]
    for i in range(1, n):
        if not skip[i]:
            total[t.parent[i]] += dense[i]

    def largest(lo: int, hi_event: int) -> int:
        best, i = lo, lo
        while i < n and t.begin[i] <= hi_event:
            if not skip[i] and total[i] > total[best]:
                best = i
            i += 1
        return best

    best = largest(0, len(t.events))
    path, around = [], None
    i = best
    while i >= 0:
        path.append(i)
        if t.tag[i] in ("article", "main"):
            around = i
        i = t.parent[i]
    if around is not None:
        chosen = [around]
    else:
        least, on_path = min(dense[i] for i in path), set(path)
        chosen = [best]
        for i in range(1, n):
            if i not in on_path and t.parent[i] in on_path and t.parent[i] != best and not skip[i] and t.tag[i] not in INLINE and dense[i] >= least and c[i] and not (t.begin[best] <= t.begin[i] < t.end[best]):
                hi = t.end[i]
                top = i
                for j in range(i, n):
                    if t.begin[j] > hi:
                        break
                    if not skip[j] and t.end[j] <= hi and total[j] > total[top]:
                        top = j
                chosen.append(top)
    spans = sorted((t.begin[i], t.end[i]) for i in chosen)
    out: list[str] = []
    for lo, hi in spans:
        block: list[str] = []
        for e in [*t.events[lo:hi], None]:
            if e is None:
                if block:
                    if s := " ".join("".join(block).split()):
                        out.append(s)
                    block = []
            else:
                block.append(e)
    return "\n".join(out)


def _extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row; one narrow pass over the pages, no shuffle."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
