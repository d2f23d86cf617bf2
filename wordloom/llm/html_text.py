"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element starts a new line. Lines of
elements that never hold article text (scripts, styles, menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, hidden parts) and
lines that are mostly links count no characters. The line-block curve is the
sum of text lengths over windows of :data:`WINDOW` lines. It surges where a
window rises from zero and dives where it is back at zero; the lines from a
surge to its dive are one region, short lines included. :data:`WINDOW` empty
lines stand at the edges of every dropped element and of the article element,
so a region never spans them.

Regions are kept whose peak is at least :data:`PEAK_SHARE` of the highest
window of the page. Article elements (``article``, ``main`` or their roles) are
a hint only: the regions of one are kept or left together, by the highest of
their peaks, and its lines count however much of them is linked. Outside
marked elements a short closing paragraph that a dropped element cuts off from
the text is a region of its own and goes with the other short ones.

Open elements are found by tag, not by walking the stack: time grows with the
page, however deeply it nests.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import map_batches
from wordloom.llm.words import texts_of

WINDOW = 3
PEAK_SHARE = 0.3
LINK_SHARE = 0.6

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"""
    # attributes with balanced quotes, else up to the next bracket
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|([^>]*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "menu", "header", "footer", "aside", "form",
           "button", "select", "textarea", "iframe", "svg", "object", "dialog", "xmp", "noembed", "noframes", "canvas"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
DROPPED_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs",
                 "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "header", "masthead", "menu",
                 "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related",
                 "reply", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
                 "widget"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar",
                 "form", "alertdialog"}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
                "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"article", "main", "div", "section", "body", "html", "table", "ul", "ol", "td", "th", "nav", "aside", "footer",
          "header", "form"}


def is_inline(tag: str) -> bool:
    """Elements that start no line; unknown ones (with a hyphen) are inline."""
    return tag in INLINE or "-" in tag


#: words that say where or how a block stands, not what it holds
LAYOUT_NAMES = {"area", "article", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form",
                "group", "inline", "inner", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "reader",
                "right", "section", "side", "site", "slot", "story", "text", "thread", "top", "unit", "user", "wrap", "wrapper"}


def _names_dropped(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or the id names something that is no article text.
    Outside articles one part of a compound name is enough; inside, all its
    parts must be such names or layout words: ``share-buttons`` goes,
    ``share-price`` stays."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        named = name in DROPPED_NAMES or any(x in DROPPED_NAMES for x in parts)
        if named and (not in_article or name in DROPPED_NAMES or all(
                x in DROPPED_NAMES or x in LAYOUT_NAMES or any(c.isdigit() for c in x) for x in parts)):
            return True
    return False


def is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Elements whose text is no article text. Inside an article a ``header``
    stays, for it holds the headline."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True
    whole = tag in ("html", "body", "article", "main") or re.fullmatch("h[1-6]", tag)
    style = attributes.get("style", "").replace(" ", "").lower()
    return (not whole and _names_dropped(attributes, in_article)) or attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes \
        or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class Line:
    __slots__ = ("parts", "linked", "counts", "article")

    def __init__(self, counts: bool, article: int):
        self.parts, self.linked, self.counts, self.article = [], 0, counts, article


def lines_of(html: str) -> list[Line]:
    """The page's lines in order, with the number of the outermost article
    element around each, 0 outside."""
    lines: list[Line] = []
    # (tag, is dropped, is article) of the open elements
    stack: list[tuple[str, bool, bool]] = []
    # where in the stack the open elements of a tag stand: looked up, never searched
    places: dict[str, list[int]] = {}
    state = {"dropped": 0, "article": 0, "links": 0, "number": 0}

    def number() -> int:
        return state["number"] if state["article"] else 0

    def start_line():
        lines.append(Line(state["dropped"] == 0, number()))

    def barrier():
        for _ in range(WINDOW):
            lines.append(Line(False, number()))
        start_line()

    def close(n: int):
        """Closes the innermost ``n`` elements."""
        for _ in range(n):
            tag, dropped, article = stack.pop()
            places[tag].pop()
            state["links"] -= tag == "a"
            state["dropped"] -= dropped
            state["article"] -= article
            if dropped or article:
                barrier()
            elif not is_inline(tag):
                start_line()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close_within(tags, scopes):
        """Closes the innermost of some elements, unless a scope began after it."""
        depth = innermost(tags)
        if depth >= 0 and depth > innermost(scopes):
            close(len(stack) - depth)

    def text(raw: str):
        if raw and state["dropped"] == 0:
            lines[-1].parts.append(raw)
            if state["links"]:
                lines[-1].linked += len(SPACE.sub("", unescape(raw)))

    start_line()
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close_within((tag,), SCOPES if tag in INLINE or tag in ("p", "li") else ())
            continue
        if tag in ENDS_P:
            close_within(("p",), SCOPES)
        if tag in SELF_CLOSING:
            close_within(SELF_CLOSING[tag], SCOPES - SELF_CLOSING[tag])
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif not is_inline(tag):
                start_line()
            continue
        body = m[3] if m[3] is not None else m[4]
        attributes = {}
        for a in ATTRIBUTE.finditer(body):
            attributes.setdefault(a[1].lower(), unescape((a[2] or "").strip("\"'")))
        dropped = is_dropped(tag, attributes, state["article"] > 0)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            barrier()
            continue
        if body.endswith("/") and ":" in tag:      # an empty element of another vocabulary
            continue
        article = not dropped and (tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
                                   or attributes.get("itemprop", "") == "articleBody")
        state["number"] += article and state["article"] == 0
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, dropped, article))
        state["links"] += tag == "a"
        state["dropped"] += dropped
        state["article"] += article
        if dropped or article:
            barrier()
        elif not is_inline(tag):
            start_line()
    return lines


def main_text(html: str) -> str:
    """The article's blocks, joined by an empty line."""
    lines = lines_of(html)
    blocks, lengths = [], []
    for line in lines:
        block = SPACE.sub(" ", unescape("".join(line.parts))).strip() if line.counts else ""
        letters = len(block.replace(" ", ""))
        if not line.article and letters and line.linked >= LINK_SHARE * letters:
            letters = 0
        blocks.append(block if letters else "")
        lengths.append(letters)
    n = len(lengths)
    curve = [sum(lengths[i:i + WINDOW]) for i in range(n)]
    # a region runs from the first line of a surge to the last before the curve dives to zero
    regions, i = [], 0
    while i < n:
        if curve[i] == 0:
            i += 1
            continue
        surge = i
        while i < n and curve[i] > 0:
            i += 1
        regions.append((surge, i))
    # the peak of a region, for those of one article the highest of them
    article_of = [max(line.article for line in lines[a:b]) for a, b in regions]
    peaks = [max(curve[a:b]) for a, b in regions]
    together: dict[int, int] = {}
    for article, peak in zip(article_of, peaks):
        together[article] = max(peak, together.get(article, 0))
    top = max(peaks, default=0)
    kept = [region for region, article, peak in zip(regions, article_of, peaks)
            if (together[article] if article else peak) >= PEAK_SHARE * top]
    return "\n\n".join(block for a, b in kept for block in blocks[a:b] if block)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(id, keep.., text, n_chars)`` per row, without a shuffle. Null and
    empty pages and pages without an article give the empty text; truncated
    pages keep what they hold; repeated rows come out as often as they came."""
    names = [id_col, *keep]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(h) for h in texts_of(b.column(len(names))).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*b.columns[:len(names)], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
            [*(f"k{i}" for i in range(len(names))), "text", "n_chars"])

    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    got = map_batches(pages.select(*names, html_col), run, f"{kinds}, text string, n_chars bigint")
    return got.withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})
