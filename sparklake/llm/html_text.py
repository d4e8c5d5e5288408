"""The main text of web pages by tag-path ratios.

Every text node of a page has a path of tags from the root. For each path the text length (without links) and the
punctuation of its nodes are summed and divided by their number; article text has long, punctuated nodes on few paths,
menus and notices short, bare ones on others. Both ratios are put back on the nodes in page order, smoothed by a
Gaussian, fused as a geometric mean and averaged by path again. Elements that are hardly ever article text (menus, forms,
footers, adverts and the like, by tag, role or class) count for a PRIOR share of that; a class that tells a state, such as
has-sidebar, takes nothing from what holds most of the content, and no class (or form) from all of it.

A path's score over the page's mean, each node counting by its length (and PRIOR), is held against THRESHOLD. What a node is beyond
or below it, times its length, is what it adds to its elements: the element to which most is added holds the article, and
the article or main element around it says how far that goes. Of what is in there, the text of unlikely elements whose
paths stay below the threshold goes, so that short paragraphs, headings and lists of the article stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, texts

# Fixed values of HTML: elements without content, elements whose content is not markup, elements that end a line of
# text, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
# What is no part of an article, by tag, by role and by word of a class or id.
NEVER = frozenset("head nav footer aside button select input dialog menu object audio video canvas script style textarea title xmp iframe noembed noframes noscript template svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINT = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|adsense|adbox|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?"
    r"|sidebar|footer|header|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|copyright|disclaimer)(?:$|[-_0-9])",
    re.I,
)
# A word that tells what an element has or how it is set, not what it is: has-sidebar, comments-open.
STATE = re.compile(r"(?:^|[-_])(?:has|with|without|no|shows?|hides?|is)[-_]|[-_](?:open(?:ed)?|closed?|enabled|disabled|allowed|on|off|active|inactive|visible|left|right|none)$", re.I)
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$))", re.S)
LOOSE = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
POINTS = re.compile(r"[,.;:!?…。，、！？；：]")

#: Share of the page's mean fused ratio from which a path is content; what an unlikely element's nodes count for; width
#: of the smoothing kernel in text nodes.
THRESHOLD, PRIOR, SIGMA = 0.75, 0.05, 0.6
#: Share of the mean by nodes from which a node speaks against a class that would leave it out.
HELD = 0.2
KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
KERNEL /= KERNEL.sum()


class Page:
    """The elements and text nodes of a page: elements by number, the root 0."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.never, self.hinted, self.linked = [-1], ["#root"], [""], [False], [False], [False]
        #: whether a hint is one that the content's score can overrule, and whether it only tells a state
        self.soft, self.state = [False], [False]
        #: (element, block, raw text)
        self.nodes: list[tuple[int, int, str]] = []
        self._block, self._open, stack, at, pattern = 0, Counter(), [0], 0, TAG
        while True:
            lt = source.find("<", at)
            if lt < 0:
                self._text(stack, source[at:])
                return
            m = pattern.match(source, lt)
            if m is None and pattern is TAG and source[lt + 1 : lt + 2].isalpha() | source.startswith("</", lt):
                # a quote that never ends: from here on quotes don't protect a >
                if (m := LOOSE.match(source, lt)) is not None:
                    pattern = LOOSE
            if m is None:
                self._text(stack, source[at : lt + 1])
                at = lt + 1
                continue
            self._text(stack, source[at:lt])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(stack, html.escape(m[0][9:].removesuffix("]]>"), False))
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(stack, tag)
            else:
                at = self._start(stack, tag, m[3] or "", source, at)

    def _text(self, stack: list[int], raw: str) -> None:
        if raw:
            if self.tag[stack[-1]] == "head" and not raw.isspace():
                self._cut(stack, len(stack) - 1)
            self.nodes.append((stack[-1], self._block, raw))

    def _start(self, stack: list[int], tag: str, rest: str, source: str, at: int) -> int:
        if self._open["head"] > 0 and tag not in HEAD and tag not in ("html", "head"):  # the end tag of a head may be left out
            self._close_up_to(stack, {"head"}, set())
        if tag == "br":
            self._text(stack, " ")
            return at
        if tag not in INLINE:
            self._block += 1
            self._close_up_to(stack, {"p"}, {"button", "table", "td", "th", "caption", "object"}) if tag not in ("body", "html", "head") else None
        if tag in CLOSES:
            self._close_up_to(stack, CLOSES[tag], HOLDS[tag])
        if tag in VOID:
            return at
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        words = f"{found.get('class', '')} {found.get('id', '')}".split()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
        n = len(self.tag)
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.linked.append(tag == "a" or self.linked[stack[-1]])
        self.label.append(tag + (f".{words[0]}" if words else ""))
        self.never.append(tag in NEVER or tag == "header" and not self._open["article"] + self._open["main"])
        hard, hints = bool(hidden) or found.get("role", "").lower() in ROLES, [w for w in words if HINT.search(w)]
        self.hinted.append(hard or tag == "form" or bool(hints))
        self.soft.append(not hard and self.hinted[-1])
        self.state.append(not hard and tag != "form" and bool(hints) and all(STATE.search(w) for w in hints))
        if tag in RAW:  # skipped whole
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            return end.end() if end else len(source)
        if not rest.rstrip().endswith("/") or tag not in ("path", "g", "rect", "circle"):
            stack.append(n)
            self._open[tag] += 1
        return at

    def _cut(self, stack: list[int], k: int) -> None:
        """Closes the open elements from the k-th on."""
        self._open.subtract(self.tag[e] for e in stack[k:])
        del stack[k:]

    def _close_up_to(self, stack: list[int], tags: set, stop: set) -> None:
        if not any(self._open[t] > 0 for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in tags:
                self._cut(stack, k)
                return
            if self.tag[stack[k]] in stop:
                return

    def _end(self, stack: list[int], tag: str) -> None:
        if tag not in INLINE:
            self._block += 1
        if self._open[tag] <= 0:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                self._cut(stack, k)
                return
            if tag in INLINE and self.tag[stack[k]] not in INLINE:
                return  # an inline end tag closes nothing beyond its block


def left_out(page: Page, hinted: list[bool]) -> list[bool]:
    """Whether each element is no part of the article, with these hints."""
    out = [False] * len(page.tag)
    for e in range(1, len(out)):  # parents come before children
        out[e] = out[page.parent[e]] or page.never[e] or hinted[e] and page.tag[e] not in ("html", "body", "main")
    return out


def scored(page: Page, out: list[bool], path: list[int], solid: list[tuple[int, int, int]], by_nodes: bool = False) -> tuple[list[float], list[float]]:
    """The score of each of solid's nodes, by the tag-path ratios, over the page's mean (by length, or by likely nodes
    alone); what is beyond THRESHOLD in each element."""
    number = {p: i for i, p in enumerate(dict.fromkeys(path[e] for e, _, _ in solid))}
    of, size = np.array([number[path[e]] for e, _, _ in solid]), np.array([n for _, n, _ in solid], float)
    count = np.bincount(of)
    likely = np.array([PRIOR if out[e] else 1.0 for e, _, _ in solid])
    linked = np.array([page.linked[e] for e, _, _ in solid])
    fused = np.ones(len(solid))
    for k, ratio in ((0, np.where(linked, 0, size)), (1, np.array([points for _, _, points in solid]) + 1.0)):
        ratio = np.bincount(of, ratio) / count
        wide = np.pad(ratio[of] * likely, 3, mode="edge")
        fused *= np.convolve(wide, KERNEL, "valid")
    score = (np.bincount(of, np.sqrt(fused) * likely) / count)[of]
    part = (likely == 1.0).astype(float) if by_nodes and (likely == 1.0).any() else size * likely
    score = score * part.sum() / max(1e-9, (score * part).sum())
    # what is beyond the threshold by element, summed up towards the root
    weight = [0.0] * len(page.tag)
    for (e, n, _), x in zip(solid, score.tolist(), strict=True):
        weight[e] += n * (x - THRESHOLD)
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    return score.tolist(), weight


def main_text(source: str) -> str:
    """The article of a page: its blocks in page order, white space within a block as one space, two line feeds between."""
    page = Page(source)
    n = len(page.tag)
    # what holds the page's article is not left out for its class alone; what stands within an article may be
    nested = [False] * n
    for e in range(1, n):
        nested[e] = nested[page.parent[e]] or page.tag[page.parent[e]] == "article"
    path, paths = [0] * n, {}
    for e in range(1, n):
        path[e] = paths.setdefault((path[page.parent[e]], page.label[e]), len(paths) + 1)
    nodes = [(e, b, s) for e, b, s in ((e, b, html.unescape(raw) if "&" in raw else raw) for e, b, raw in page.nodes)]
    solid = [(e, len(s.split()) and len(" ".join(s.split())), len(POINTS.findall(s))) for e, _, s in nodes if not s.isspace()]
    if not solid:
        return ""

    def held(out: list[bool]) -> tuple[list[float], list[float]]:
        """The score of the nodes, and the characters in nodes that are content by element."""
        score, _ = scored(page, out, path, solid, True)
        weight = [0.0] * n
        for (e, size, _), x in zip(solid, score, strict=True):
            weight[e] += size * (x >= HELD and not out[e])
        for e in range(n - 1, 0, -1):
            weight[page.parent[e]] += weight[e]
        return score, weight

    def unhint(kinds: list[bool], weight: list[float]) -> None:
        """Hints of these kinds take nothing from what holds most of the content."""
        for e in range(1, n):
            if kinds[e] and weight[e] > 0.5 * weight[0]:
                page.hinted[e] = False

    if any(page.state):
        unhint(page.state, held(left_out(page, [h and not s for h, s in zip(page.hinted, page.state, strict=True)]))[1])
    for e in range(n):
        if page.tag[e] in ("article", "main", "body") and not nested[e] and not (page.tag[e] == "article" and page.hinted[e]):
            while (e := page.parent[e]) > 0 and page.hinted[e]:
                page.hinted[e] = False
    out = left_out(page, page.hinted)
    if any(h and s for h, s in zip(page.hinted, page.soft, strict=True)):
        # if the hints leave nothing that is content by the score of the whole page, the score decides
        free = left_out(page, [h and not s for h, s in zip(page.hinted, page.soft, strict=True)])
        score, weight = held(free)
        content = [(e, points) for (e, _, points), x in zip(solid, score, strict=True) if x >= HELD and not free[e]]
        if all(out[e] for e, _ in content) and any(points for _, points in content):
            unhint(page.soft, weight)
            out = left_out(page, page.hinted)
    if all(out[e] for e, _, _ in solid):
        return ""
    score, weight = scored(page, out, path, solid)
    # the element to which most is added, the lowest of such; the outermost article, else main element around it
    top = max(range(n), key=lambda e: (weight[e], e))
    around, e = {"article": 0, "main": 0}, top
    while e > 0:
        if page.tag[e] in around and not out[e]:
            around[page.tag[e]] = e
        e = page.parent[e]
    top = around["article"] or around["main"] or top
    while page.tag[top] in INLINE or page.tag[top] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
        top = page.parent[top]
    roots, kept = {top}, {path[e] for (e, _, _), x in zip(solid, score, strict=True) if x >= THRESHOLD}
    inside = [False] * n
    for e in range(n):
        inside[e] = e in roots or e > 0 and inside[page.parent[e]]
    blocks: dict[int, list[str]] = {}
    for e, b, s in nodes:
        if inside[e] and (not out[e] or path[e] in kept):
            blocks.setdefault(b, []).append(s)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def _extract(batches):
    for batch in batches:
        found = [main_text(s) for s in texts(batch.column(2)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row: the main text of the whole page and its code points.

    Null, empty and textless pages give an empty text; a page without an article gives the container of its longest
    punctuated text. Rows don't depend on one another: repeated rows give repeated results, an empty table none. Other
    columns are not looked at.
    """
    bounded_batches(pages.sparkSession)
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")]
    return pages.select(cols).mapInArrow(_extract, "id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
