"""HTML extraction by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags), each with its root-to-leaf path
of block-level tags. Text length, punctuation and link text are summed for each path; the text and
punctuation ratios (sums over the number of blocks with that path) are fused, smoothed over
neighbouring blocks in page order with a Gaussian, and averaged back over each path. Paths over a
threshold relative to the page are content. The smallest element that holds nearly all content
text bounds the article; within it, short or odd blocks that are not mostly links are kept too.

Never content, whatever their ratios: menus, headers, footers, asides, forms and the like by tag or
ARIA role, and hidden elements. A class or id with a word of BOILERPLATE does not remove an element:
it lowers the ratio of the paths below it to MARKED of what it is; if nearly all text of the page is
below such marks, they say nothing.
A headline in the header of an article is kept.

Edge cases: null or empty html -> text "". Unclosed and misnested tags follow the usual recovery
rules; unclosed comments, scripts and tags end with the page. Elements may be nested to any depth.
Repeated rows are answered one by one; a null page_id or url stays null; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Share of the page's text-weighted mean score that a path needs, and the smoothing radius in blocks.
THRESHOLD, SIGMA = 0.12, 1.0
#: Share of the content text that the article element must hold, and link text that makes a block a menu.
HOLDS, LINKS = 0.9, 0.6

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
_DROPPED = set("nav header footer aside form button select option dialog menu head figure-toolbar fieldset legend input datalist output".split())
_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog tablist".split())
_HEADLINES = {f"h{i}" for i in range(1, 7)}
#: Words of a class or id that mark what is not the article.
BOILERPLATE = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline-share comment comments commentlist comments-area cookie cookies consent disclaimer "
    "discussion disqus feedback footer footnav gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification notifications overlay pagination paywall "
    "popup promo promos promoted promotion rail recommendation recommendations recommended related replies reply respond responses share sharing shares sidebar sidenav sidebars skip social sponsor "
    "sponsored sponsors subscribe subscription tags tagcloud teaser teasers toolbar topbar trending widget widgets reader-comments skyscraper alert adslot adunit adcontainer adwrapper".split()
)
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A class such as has-sidebar or no-ads marks a page's layout, not what is to go.
_LAYOUT = set("has no with without".split())
#: What is left of the ratio of a path below a marked element.
MARKED = 0.02
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag ends these open elements, up to the boundary.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = {"table", "td", "th", "button", "caption", "html", "body", "article", "section", "main", "div", "aside", "nav", "header", "footer", "form"}


class Element:
    __slots__ = ("tag", "parent", "dropped", "marked", "path", "own", "depth", "order", "mass", "header", "inside")

    def __init__(self, tag: str, parent: "Element | None", dropped: bool, marked: bool, path: int, order: int):
        self.tag, self.parent, self.dropped, self.marked, self.path, self.order = tag, parent, dropped, marked, path, order
        #: The nearest block-level element, itself included.
        self.own = self if parent is None or tag not in _INLINE else parent.own
        self.depth = parent.depth + 1 if parent else 0
        self.mass, self.inside = 0, False
        # Within the header of an article, but not in a headline.
        self.header = parent is not None and tag not in _HEADLINES and (tag == "header" or parent.header)


class Block:
    __slots__ = ("element", "text", "links", "dropped")

    def __init__(self, element: Element, text: str, links: int, dropped: bool):
        self.element, self.text, self.links, self.dropped = element, text, links, dropped


def _tag_end(page: str, at: int, loose: list[bool]) -> int:
    """Where the tag that begins before `at` ends: its closing > outside quotes; -1 if there is none."""
    if loose[0]:
        return page.find(">", at)
    begin = at
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quote = -1
        for q in ('"', "'"):
            k = page.find("=" + q, at, end)
            if k >= 0 and (quote < 0 or k < quote):
                quote = k
        if quote < 0:
            return end
        close = page.find(page[quote + 1], quote + 2)
        if close < 0:
            loose[0] = True
            return page.find(">", begin)
        if close < end:
            at = close + 1
            continue
        at = close + 1


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _marked(attributes: dict[str, str]) -> bool:
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if _LAYOUT.isdisjoint(parts) and not BOILERPLATE.isdisjoint(parts):
            return True
    return False


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks, and its elements, both in order."""
    out: list[Block] = []
    top = Element("#", None, False, False, 0, 0)
    elements, paths = [top], {}
    stack, pieces, links, loose = [top], [], 0, [False]
    anchors, opened = 0, Counter("#")

    def flush() -> None:
        nonlocal links
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(stack[-1].own, text, min(links, len(text)), stack[-1].dropped))
            pieces.clear()
        links = 0

    def close(upto: int) -> None:
        """Pops the stack down to `upto` elements; the text so far is a block if a block element goes."""
        nonlocal anchors
        if any(e.tag not in _INLINE for e in stack[upto:]):
            flush()
        for e in stack[upto:]:
            anchors -= e.tag == "a"
            opened[e.tag] -= 1
        del stack[upto:]

    def add(text: str) -> None:
        nonlocal links
        if text:
            if stack[-1].dropped and not stack[-1].own.dropped:
                return  # a hidden inline element within a text
            pieces.append(html.unescape(text) if "&" in text else text)
            if anchors:
                links += len(text.strip())

    at, n, lower = 0, len(page), None
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        add(page[at:tag])
        nxt = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
        elif nxt == "/":
            end = page.find(">", tag)
            name = page[tag + 2 : end if end >= 0 else n].strip().lower().split(" ")[0]
            at = n if end < 0 else end + 1
            if not opened[name]:
                if name == "p":
                    flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    close(k)
                    break
                if name in _INLINE and stack[k].tag in _SCOPE:
                    break
        elif m := _NAME.match(page, tag + 1):
            name = m.group().lower()
            end = _tag_end(page, m.end(), loose)
            inner = page[m.end() : end if end >= 0 else n]
            at = n if end < 0 else end + 1
            if name in _RAW:
                if name in ("svg", "math") and inner.endswith("/"):
                    continue
                if name != "noscript":
                    lower = page.lower() if lower is None else lower
                    if len(lower) != n:
                        lower = page.translate({c: c + 32 for c in range(65, 91)})
                    end = lower.find(f"</{name}", at)
                    if end >= 0 or not inner.endswith("/"):
                        at = n if end < 0 else (page.find(">", end) + 1 or n)
                    continue
            if name in ("br", "hr") or name in _VOID:
                if name == "hr":
                    flush()
                elif name != "wbr":
                    add(" ")
                continue
            if name in _INLINE and inner.endswith("/"):
                continue
            if name in _CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag not in _INLINE:
                        break
            if name in _ENDS:
                ends, stops = _ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close(k)
                        if name != "tr":
                            break
                    elif stack[k].tag in stops:
                        break
            attributes = {a.lower(): b or c or d for a, b, c, d in reversed(_ATTRIBUTE.findall(inner))} if "=" in inner or "hidden" in inner else {}
            parent = stack[-1]
            big = name in ("html", "body", "main", "article")
            drop = name in _DROPPED or name == "noscript" or (not big and _hidden(attributes))
            if name == "header" and (opened["article"] or opened["main"]):
                drop = False  # its headline stays; Element.header marks the rest
            path = parent.path
            if name not in _INLINE:
                flush()
                first = _WORDS.findall(attributes.get("class", "").lower())
                path = paths.setdefault((path, name, first[0] if first else ""), len(paths) + 1)
            mark = parent.marked or (not big and name not in _INLINE and _marked(attributes))
            stack.append(Element(name, parent, parent.dropped or drop, mark, path, len(elements)))
            elements.append(stack[-1])
            anchors += name == "a"
            opened[name] += 1
        else:
            add("<")
            at = tag + 1
    flush()
    return out, elements


def scores(found: list[Block]) -> dict[int, float]:
    """The fused, smoothed ratio of each path."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(b.text)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += b.links
        s[3] += 1
    # Fused as a product, smoothed as its logarithm.
    ratio = {p: math.log1p(t / n * math.sqrt(1 + k / n) * (1 - l / t)) for p, (t, k, l, n) in sums.items()}
    x = np.array([ratio[b.element.path] for b in found])
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / SIGMA) ** 2)
    smooth = np.convolve(x, kernel, "full")[2:-2] / np.convolve(np.ones(len(x)), kernel, "full")[2:-2]
    total: dict[int, float] = {}
    for b, s in zip(found, (0.5 * x + 0.5 * smooth).tolist(), strict=True):
        total[b.element.path] = total.get(b.element.path, 0.0) + s
    return {p: total[p] / sums[p][3] for p in sums}


def extract(page: str | None) -> str:
    """The main text: blocks of the article joined by one line break."""
    found, elements = blocks(page or "")
    found = [b for b in found if not b.dropped and not b.element.header]
    if not found:
        return ""
    score = scores(found)
    plain = [b for b in found if not b.element.marked]
    if sum(len(b.text) for b in plain) <= (1 - HOLDS) * sum(len(b.text) for b in found):
        plain = found  # nearly all bears a mark, so it says nothing
    low = MARKED if plain is not found else 1
    # Scores are logarithms, so the threshold compares powers.
    power = {p: math.expm1(x) for p, x in score.items()}
    ratio = [power[b.element.path] * (low if b.element.marked else 1) for b in found]
    mean = sum(power[b.element.path] * len(b.text) for b in plain) / sum(len(b.text) for b in plain)
    content = [r >= THRESHOLD * mean for r in ratio]
    picked = 0
    for b, c in zip(found, content, strict=True):
        if c:
            b.element.mass += len(b.text)
            picked += len(b.text)
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
    holders = [e for e in elements if e.mass and e.own is e]
    semantic = [e for e in holders if e.tag in ("article", "main") and e.mass >= 0.4 * picked]
    if semantic:
        best = max(semantic, key=lambda e: (e.tag == "article", e.mass, -e.order))
        same = [e for e in semantic if e.tag == best.tag]
    else:
        best = max((e for e in holders if e.mass >= HOLDS * picked), key=lambda e: (e.depth, -e.order))
        while best.tag in _HEADLINES | {"p", "li"} and best.parent is not None:
            best = best.parent
        same = [best]
    for e in same:
        e.inside = True
    for e in elements[1:]:
        e.inside = e.inside or e.parent.inside
    marks = low == 1 or any(e.marked for e in same)
    loose = best.tag in ("#", "html", "body")
    out = []
    for b, c in zip(found, content, strict=True):
        odd = not loose and b.links < LINKS * len(b.text) or loose and b.element.tag in _HEADLINES
        if b.element.inside and (c or (odd and (marks or not b.element.marked))):
            out.append(b.text)
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    prepare(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    """The rows of query op1."""
    return extracted(pages)
