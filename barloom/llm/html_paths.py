"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks, each with its path of block tags from the root (with class and id names).  Parts whose
tag or name says that they are no article (menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles) are left out; a part is not left out by its name or as a form when it holds most of the text.  For
every path the length of its text and its punctuation are added up; the two ratios per block are fused into one score,
which is smoothed over neighbouring blocks of the same container.  Paths whose smoothed score reaches a share of the
page's mean (weighted by text) hold the content.  A path counts as a whole, so that a short paragraph stays with its
longer siblings; link text counts against a path, and a path inside ``article`` or ``main`` has a bonus.  The paths find
the place of the content: all blocks of the deepest container of most of that text (or of the ``article`` or ``main`` it
lies in) are kept, short lists, tables and lists of links too.

Cases: null or empty pages, and pages without content, have an empty text; tags that are never closed are closed where
HTML closes them; a tag whose quotes do not close ends at the next ``>``, a tag cut off at the end is no text; an unclosed
script or style goes to the end of the page, any other unclosed element drops no text after it; the time is linear in
the page at any length and depth; rows that repeat give repeated results; extra columns are kept by :func:`extracted`.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.types import STRING

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_VALUE = re.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NUMBER = re.compile(r"&#(0*+)([0-9]++)")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: elements whose content holds no tags
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext object q ruby rt rp s samp small span strike strong sub sup time tt u var nobr".split())
#: tags that close an open paragraph, and the elements beyond which none is looked for
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HOLDS_P = frozenset("article body td div section li blockquote main".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_CLOSED_BY_SAME = frozenset("li dt dd tr td th".split())
_HOLDS_SAME = frozenset("ul ol table dl article body".split())
_NO_CONTENT = frozenset("head nav footer aside button menu dialog fieldset input audio video map svg select template".split())
#: names of parts that are no article
_NO_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager sidebar side aside rail widget header masthead footer copyright legal comment comments commentlist respond disqus reply replies discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending toolbar skip search form".split()
)
#: words that a name of such a part may have besides
_NEUTRAL = frozenset("site global button buttons icon icons text trail column col outer group row panel module unit slot zone left right top bottom list box block wrapper wrap container inner area links link bar section primary secondary main posts post articles items item".split())
_TALK = frozenset("comment comments commentlist respond disqus reply replies discussion".split())
#: words that decide alone when they begin or end a name
_STRONG = _TALK | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo breadcrumb breadcrumbs pagination cookie cookies consent gdpr newsletter share sharing social related recommended recommendations trending".split()
)
#: first and last words of a name that only tells of such a part
_TELLS = (frozenset("no not non has with without is js show hide open close enable disable can".split()), frozenset("free open opened closed enabled disabled allowed on off none".split()))
_STORIES = re.compile(r"^(?:top|more|latest|popular|other)(?:stories|news|articles|posts|reads)$|^mostread$|^youmay(?:also)?like$|^readmore$")
_NO_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_MARKS = re.compile(r"[.,;:!?。、，；：！？…]")
#: share of the page's mean score that a path must reach
THRESHOLD = 0.08
#: weight of text inside an article or main: one that holds less than a third of the scored text is a teaser
BONUS = 10.0
#: share of the text of such paths that the content container must hold
SHARE = 0.8
#: weights of a block and its two neighbours on each side
KERNEL = (0.1, 0.25, 1.0, 0.25, 0.1)


class Block(NamedTuple):
    #: number of its path
    path: int
    text: str
    links: int
    in_article: bool
    #: number of the innermost part around it that is no article by its name
    named: int


class Element(NamedTuple):
    tag: str
    path: int
    drop: bool
    named: int
    #: places on the stack of the open elements that a later tag may close: paragraphs; items, rows and cells
    paragraph: int
    same: dict[str, int]


class Page(NamedTuple):
    """The blocks of a page; paths and named parts as trees, parents before children."""

    blocks: list[Block]
    #: parent, whether it is html or body, whether it is an article or main or lies in one
    paths: list[tuple[int, bool, bool]]
    #: parent, share of the text that it must hold to stay, whether it is readers' talk, whether it lies in an article
    named: list[tuple[int, float, bool, bool]]


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw else {}


def _is_boilerplate(tag: str, attributes: dict[str, str], raw: str, inside_article: bool) -> bool:
    if tag in _NO_CONTENT or tag == "header" and not inside_article:
        return True
    if tag != "form" and attributes.get("role", "").lower() in _NO_ROLE or attributes.get("aria-hidden") == "true":
        return True
    if "hidden" in raw.lower() and _HIDDEN.search(_VALUE.sub("=", raw)):
        return True
    return bool(re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", attributes.get("style", "")))


def _named(tag: str, attributes: dict[str, str], inside_article: bool) -> list[str]:
    """The words of the class or id name that says that an element is no article: all its words do, besides neutral
    ones, or a strong one begins or ends it.  A form counts as such a part."""
    if tag in ("html", "body", "article", "main"):
        return []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        order = [x.lower() for x in _NAME.findall(name)]
        words = set(order)
        own = words & _NO_NAME
        if own and words <= _NO_NAME | _NEUTRAL and not (own <= {"header", "masthead", "footer", "form", "side"} and (inside_article or words & {"post", "main", "section"})):
            return order
        if order and order[0] not in _TELLS[0] and order[-1] not in _TELLS[1] and ({order[0], order[-1]} & _STRONG or _STORIES.match("".join(order))):
            return order
    return ["form"] if tag == "form" else []


def _unescaped(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:  # numbers of any length
        text = _NUMBER.sub(lambda m: "&#" + (m[2] if len(m[2]) < 8 else "1114112") if m[2] else "&#0", text)
    return html.unescape(text)


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, whether it closes, tag name, rest of the tag) of every tag, in time linear in the page; markup
    without a name (comments, declarations) and the end of the page have an empty one."""
    at = 0
    loose = 0  # a tag before this place ends at the next > whatever its quotes: they were seen not to close
    unclosed: set[str] = set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = start + 4 if page.startswith(">", start + 4) else page.find("-->", start + 4) + 2
            end = end if end > start + 2 else len(page)
            yield page[at:start], False, "", ""
            at = end + 1
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            yield page[at:start], False, "", ""
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, start)
        if not m and not page.startswith(("<!", "<?"), start):
            yield page[at : start + 1], False, "", ""
            at = start + 1
            continue
        end = -1
        if m and start >= loose:
            end = _INSIDE.match(page, m.end()).end()
            if not page.startswith(">", end):
                loose, end = end, -1
        if end < 0:
            end = page.find(">", start)
        if end < 0:  # cut off
            yield page[at:start], False, "", ""
            return
        text, at = page[at:start], end + 1
        if not m:
            yield text, False, "", ""
            continue
        tag, raw = m[2].lower(), page[m.end() : end]
        if tag in _RAW and not m[1]:
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(tag)
        yield text, bool(m[1]), tag, raw
    yield page[at:], False, "", ""


def blocks(page: str) -> Page:
    """The blocks of a page outside its boilerplate, in order; those in parts named as boilerplate say so."""
    found = Page([], [(-1, True, False)], [(-1, 0.0, False, False)])
    children: dict[tuple[int, str], int] = {}
    stack = [Element("", 0, False, 0, -1, {})]
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = outside = 0
    in_link = False

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text and not outside:
            top = stack[-1]
            found.blocks.append(Block(top.path, text, min(links, len(text)), found.paths[top.path][2], top.named))
        parts, links = [], 0

    def pop_to(size: int) -> None:
        nonlocal outside
        while len(stack) > size:
            last = stack.pop()
            outside -= last.drop
            opened[last.tag] -= 1

    for text, closes, tag, raw in _tokens(page):
        if text and not outside:
            text = _unescaped(text)
            parts.append(text)
            links += len(text) if in_link else 0
        if not tag:
            continue
        if closes:
            if tag == "a":
                in_link = False
            if tag not in _INLINE and opened.get(tag):
                flush()
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                pop_to(size)
            continue
        if tag in _RAW or tag == "br":
            if tag not in ("script", "style", "noscript"):
                parts.append(" ")
            continue
        if tag == "a":
            in_link = True
        if tag in _INLINE or tag in _VOID and tag != "hr":
            continue
        flush()
        if tag in _CLOSES_P and stack[-1].paragraph >= 0:
            pop_to(stack[-1].paragraph)
        for other in _SAME.get(tag, ()):
            if other in stack[-1].same:
                pop_to(stack[-1].same[other])
        if tag == "hr" or tag == "svg" and raw.endswith("/"):
            continue
        attributes = _attributes(raw)
        step = re.sub(r"\d+", "0", tag + "".join(f".{x}" for k in ("class", "id") for x in attributes.get(k, "").lower().split()))
        top = stack[-1]
        inside = found.paths[top.path][2]
        path = children.setdefault((top.path, step), len(found.paths))
        if path == len(found.paths):
            found.paths.append((top.path, tag in ("html", "body"), inside or tag in ("article", "main")))
        drop = _is_boilerplate(tag, attributes, raw, inside)
        name, number = _named(tag, attributes, inside), top.named
        if name:
            number = len(found.named)
            found.named.append((top.named, 0.9 if _STRONG & set(name) else 0.5, bool(_TALK & set(name)), inside))
        place = len(stack)
        paragraph = place if tag == "p" else -1 if tag in _HOLDS_P else top.paragraph
        same = {} if tag in _HOLDS_SAME else {**top.same, tag: place} if tag in _CLOSED_BY_SAME else top.same
        stack.append(Element(tag, path, drop, number, paragraph, same))
        opened[tag] = opened.get(tag, 0) + 1
        outside += drop
    flush()
    return found


def unnamed(page: Page) -> list[Block]:
    """The blocks outside parts named as boilerplate.  A name alone drops no part with the only ``article`` or ``main``,
    or with most of the punctuated or long text of the article it lies in or of a page without one (talk, adverts: nearly all)."""
    found = page.blocks
    if not any(b.named for b in found):
        return found
    weight = [0] * len(page.named)
    holds = [False] * len(page.named)
    total = of_articles = 0
    for b in found:
        n = len(b.text) - b.links if len(b.text) >= 200 or _MARKS.search(b.text) else 0
        weight[b.named] += n
        holds[b.named] |= b.in_article
        total += n
        of_articles += n if b.in_article else 0
    for x in range(len(page.named) - 1, 0, -1):
        weight[page.named[x][0]] += weight[x]
        holds[page.named[x][0]] |= holds[x]
    # whether a named part lies around the article, and an article without one
    outer = [False] * len(page.named)
    for x, (parent, _, _, inside) in enumerate(page.named[1:], 1):
        outer[x] = not inside or outer[parent]
    free = any(b.in_article and not outer[b.named] for b in found)
    kept = [True] * len(page.named)
    for x, (parent, share, talk, inside) in enumerate(page.named[1:], 1):
        of = of_articles if inside else total
        most = weight[x] > share * of
        kept[x] = kept[parent] and (most if inside else not free and (most or holds[x] and not talk))
    return [b for b in found if kept[b.named]]


def chosen(page: Page, found: list[Block]) -> list[Block]:
    """The blocks of the container whose paths hold the content."""
    if len({b.path for b in found}) < 2:
        return found
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_MARKS.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
        linked[b.path] = linked.get(b.path, 0) + b.links
    score = {p: length[p] / n * (1 - linked[p] / max(1, length[p])) * math.sqrt(1 + marks[p] / n) for p, n in count.items()}
    container = [parent for parent, _, _ in page.paths]
    best: dict[int, float] = {}
    for i, b in enumerate(found):
        total = weight = 0.0
        for j, k in zip(range(i - 2, i + 3), KERNEL):
            if 0 <= j < len(found) and (found[j].path == b.path or container[found[j].path] == container[b.path]):
                total += k * score[found[j].path]
                weight += k
        best[b.path] = max(best.get(b.path, 0.0), total / weight)
    mean = sum(best[p] * length[p] for p in best) / max(1, sum(length.values()))
    keep = {p for p, s in best.items() if s >= THRESHOLD * mean and linked[p] <= 0.7 * length[p]}
    # the deepest container of most of that text: all of it is content, be it as short or as linked as it may
    held = [0.0] * len(page.paths)
    all_held = 0.0
    for p in keep:
        n = length[p] * (BONUS if page.paths[p][2] else 1.0)
        held[container[p] if container[p] >= 0 else p] += n
        all_held += n
    depth = [0] * len(page.paths)
    for p in range(len(page.paths) - 1, 0, -1):
        held[container[p]] += held[p]
    for p in range(1, len(page.paths)):
        depth[p] = depth[container[p]] + 1
    most = [p for p in range(1, len(page.paths)) if not page.paths[p][1] and held[p] >= SHARE * all_held > 0]
    main = max(most, key=depth.__getitem__, default=None)
    if main is None:
        places = [i for i, b in enumerate(found) if b.path in keep]
        span = range(places[0], places[-1] + 1) if places else range(0)
        return [b for i, b in enumerate(found) if b.path in keep or i in span and linked[b.path] <= 0.7 * length[b.path]]
    while page.paths[main][2] and page.paths[container[main]][2]:
        main = container[main]
    under = [False] * len(page.paths)
    for p in range(main, len(page.paths)):
        under[p] = p == main or p > main and under[container[p]]
    if page.paths[main][2]:
        # the other articles beside it, too
        return [b for b in found if under[b.path] or b.in_article]
    return [b for b in found if under[b.path] or b.path in keep]


def main_text(page: str | None) -> str:
    """The text of the content blocks in page order, joined by blanks."""
    cut = blocks(page or "")
    return " ".join(b.text for b in chosen(cut, unnamed(cut)))


@F.arrow_udf(STRING)
def extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extracted(pages: DataFrame, html_column: str = "html", result: str = "text") -> DataFrame:
    """``pages`` with the main text in ``result``."""
    return pages.withColumn(result, extract(F.col(html_column)))
