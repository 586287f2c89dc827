"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one for each block of text. A line weighs as many characters as it has outside links, or nothing where the markup says that
it is furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments); where a page marks its article, lines outside it weigh nothing and those
inside their whole length. Weights are summed over a sliding window of lines. A part of the page begins where the sum surges from nothing and ends where it dives to nothing;
the parts whose sums reach a threshold (the longest part, if none does) are the main text, less the furniture inside them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import arrow_schema, blocks, fresh

# Tags, comments and declarations. A quote counts only after an equals sign; one that is never closed is a character like others.
TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A class or id falls into words at signs and at capitals after small letters.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Elements whose content is no text of the page. The first two reach to the end of the page if they are not closed, the others are ignored then.
SILENT = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in "script style noscript template svg math iframe object canvas audio video textarea select datalist button title map applet frameset".split()}
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends these, if they are the innermost open ones.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What elements, roles and words of classes and ids mark as furniture.
FURNITURE = frozenset("nav aside footer menu dialog form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations outbrain "
    "taboola adslot adbox adunit adsbygoogle comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager toolbar copyright skip search toc paywall".split()
)
# Words that turn the meaning of such a word: "no-sidebar", "has-ads", "with-menu".
TURNING = frozenset("no not has with without hide".split())
# Words beside "header" that make it the head of the article.
ARTICLE = frozenset("article post entry story content section page".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Lines without any marks that are furniture all the same, and headings of parts that are not the article's.
LEGAL = re.compile(r"^(©|\(c\)\s|copyright\b)|\ball rights reserved\b|^(we|this (web)?site) uses? cookies\b|^advertisement$", re.I)
APPENDIX = re.compile(r"^\W*(\d+\s+)?((reader |user )?comments?|responses|replies|leave a (comment|reply)|related (articles|posts|stories|links)|kommentare|commentaires|comentarios)(\s*\(\d+\))?\W*$", re.I)

#: Lines in a window, and the characters a window of the main text reaches where a page marks no article.
WINDOW = 3
SURGE = 80


@dataclass(slots=True)
class Line:
    """A block's text, how many of its characters are in links, the innermost furniture element it is in, its heading level and its article (0: none)."""

    text: str
    linked: int
    furniture: int
    heading: int
    article: int
    main: bool


@dataclass(slots=True)
class Element:
    name: str
    furniture: int = 0
    silent: bool = False
    article: int = 0
    main: bool = False


def marks(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is furniture, whether it is hidden, and whether it is marked as an "article" or the "main" part."""
    furniture = name in FURNITURE or name == "header" and not inside
    role = name if name in ("article", "main") else ""
    hidden = False
    if not attributes or attributes.isspace():
        return furniture, hidden, role
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "role":
            roles = value.lower().split()
            furniture |= not ROLES.isdisjoint(roles)
            role = role or next((r for r in roles if r in ("article", "main")), "")
        elif key in ("class", "id") and name not in ("body", "html", "article", "main"):
            for part in value.split():
                words = [w.lower() for w in PART.findall(part)]
                furniture |= any(w in WORDS and not (k and words[k - 1] in TURNING) for k, w in enumerate(words))
                furniture |= "header" in words and not inside and ARTICLE.isdisjoint(words) and TURNING.isdisjoint(words)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            hidden = True
    return furniture, hidden, role


class Stripper:
    """One pass over a page; tags may be unclosed or crossed, and a page may end anywhere."""

    def __init__(self, page: str) -> None:
        self.lines: list[Line] = []
        self.stack = [Element("")]
        self.opened: dict[str, int] = {}
        self.unclosed: set[str] = set()
        self.text: list[str] = []
        self.linked = self.articles = 0
        self.around = [0]  # the furniture element around each
        self.link = False
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                self.said(page[at:])
                break
            if m.start() > at:
                self.said(page[at : m.start()])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                at = self.ended(name, at) if m[1] else self.began(name, m[3], page, at)
        self.flush()

    def said(self, piece: str) -> None:
        if not self.stack[-1].silent:
            piece = html.unescape(piece) if "&" in piece else piece
            self.text.append(piece)
            if self.link:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                e = self.stack[-1]
                self.lines.append(Line(line, min(self.linked, len(line)), e.furniture, int(e.name[1]) if e.name in HEADINGS else 0, e.article, e.main))
            self.text = []
        self.linked = 0

    def popped(self, upto: int) -> None:
        while len(self.stack) > upto:
            self.opened[self.stack.pop().name] -= 1

    def ended(self, name: str, at: int) -> int:
        if name == "a":
            self.link = False
        elif name not in INLINE:
            self.flush()
            if self.opened.get(name):
                k = len(self.stack) - 1
                while self.stack[k].name != name:
                    k -= 1
                self.popped(k)
        return at

    def began(self, name: str, attributes: str, page: str, at: int) -> int:
        if name in SILENT:
            if name not in self.unclosed and not attributes.endswith("/"):
                m = SILENT[name].search(page, at)
                if m:
                    return max(page.find(">", m.end()), m.end() - 1) + 1
                self.unclosed.add(name)
                return len(page) if name in ("script", "style") else at
            return at
        if name in INLINE:
            if name == "a":
                self.link = True
            elif name == "br":
                self.said(" ")
            return at
        self.flush()
        if name in VOID:
            return at
        stack = self.stack
        if stack[-1].name in ("p", "head"):
            self.popped(len(stack) - 1)
        if name in ENDS and stack[-1].name in ENDS[name]:
            self.popped(len(stack) - 1)
        self.link &= name in HEADINGS
        up = stack[-1]
        furniture, hidden, role = marks(name, attributes, up.article > 0 or up.main)
        e = Element(name, up.furniture, up.silent or hidden or name == "head", up.article, up.main)
        if role == "main":
            e.furniture, e.main = 0, True  # whatever it seems to be in wraps the page, or was never closed
        elif role == "article" and up.article:
            furniture = True  # an article in an article is a reader's comment
        elif role == "article" and (not up.furniture or not self.articles and not self.opened.get("aside")):
            self.articles += 1
            e.furniture, e.article = 0, self.articles
        if furniture and role != "main" and not (role == "article" and e.article != up.article):
            self.around.append(e.furniture)
            e.furniture = len(self.around) - 1
        stack.append(e)
        self.opened[name] = self.opened.get(name, 0) + 1
        return at


def without_furniture(lines: list[Line], around: list[int]) -> list[Line]:
    """Lines outside furniture. What holds the page's first heading and half of its text outside links wraps the page and is no furniture itself."""
    held, headed = [0] * len(around), [False] * len(around)
    for x in lines:
        held[x.furniture] += len(x.text) - x.linked
        headed[x.furniture] |= x.heading == 1
    total = sum(held)
    for part in range(len(around) - 1, 0, -1):  # an element's number is above that of the one around it
        held[around[part]] += held[part]
        headed[around[part]] |= headed[part]
    free = [True] * len(around)
    for part in range(1, len(around)):
        free[part] = free[around[part]] and headed[part] and 2 * held[part] > total
    return [x for x in lines if free[x.furniture]]


def weights(lines: list[Line]) -> tuple[np.ndarray, bool]:
    """What each line weighs, and whether the page marks its article."""
    size = np.array([len(x.text) for x in lines], dtype=np.int64)
    article = np.array([x.article for x in lines])
    marked = article > 0
    if marked.any():
        each = np.bincount(article, weights=size)
        each[0] = 0
        marked = (2 * each >= each.max())[article]  # cards that lead elsewhere are short beside the article
        first = int(np.argmax(marked))
        title = [k for k in range(first) if lines[k].heading == 1]
        marked[title[-1:]] = True
    elif any(x.main for x in lines):
        marked = np.array([x.main for x in lines])
    is_marked = bool(marked.any())
    out = np.where(marked, size, 0) if is_marked else size - np.array([0 if x.heading == 1 else x.linked for x in lines], dtype=np.int64)
    below = 0  # level of the appendix heading that the lines stand under
    for k, x in enumerate(lines):
        if x.heading and (not below or x.heading <= below):
            below = x.heading if x.heading > 1 and APPENDIX.search(x.text) else 0
        if below or not is_marked and LEGAL.search(x.text):
            out[k] = 0
    return out, is_marked


def surges(weight: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of the lines between surge and dive: where window sums are above nothing without a break and reach ``least``; if none does, the heaviest."""
    if not len(weight) or not weight.any():
        return []
    sums = np.convolve(weight, np.ones(window, dtype=np.int64))  # sums[i]: the lines i - window + 1 to i
    edge = np.flatnonzero(np.diff(np.concatenate([[0], sums > 0, [0]])))
    found = [(int(a), int(b) - window + 1, int(sums[a:b].max()), int(weight[a : b - window + 1].sum())) for a, b in zip(edge[0::2], edge[1::2], strict=True)]
    high = [x for x in found if x[2] >= least] or [max(found, key=lambda x: (x[3], -x[0]))]
    return [(a, b) for a, b, _, _ in high]


def main_text(page: str | None, window: int = WINDOW, least: int = SURGE) -> str:
    """The main text of one page; see the module."""
    found = Stripper(page or "")
    lines = without_furniture(found.lines, found.around)
    weight, marked = weights(lines) if lines else (np.zeros(0, dtype=np.int64), False)
    out = []
    for first, end in surges(weight, window, 1 if marked else least):
        if not marked:  # a short line or two before the title only seem to be its beginning
            title = next((k for k in range(first, end) if lines[k].heading == 1), first)
            if weight[first:title].sum() < least:
                first = title
        out += [lines[k].text for k in range(first, end) if weight[k] or not marked and not LEGAL.search(lines[k].text)]
    return "\n\n".join(out)


def extracted(pages: DataFrame, column: str = "html", window: int = WINDOW, least: int = SURGE) -> DataFrame:
    """``pages`` with text in place of the column: the main text of each page, its blocks joined by two line ends; empty if there is none.

    Character references are decoded, white space inside a block becomes one space. A null page is an empty one. Pages are worked on alone, without a shuffle,
    and are read whole; repeated rows give repeated results, other columns pass through (text gets another sign where a column has that name), an empty
    table stays empty.
    """
    rest = [f for f in pages.schema.fields if f.name.lower() != column.lower()]
    name = fresh(pages.select(*(f.name for f in rest)), "text")[0]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` string"])
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column):
            texts = [main_text(x, window, least) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(t) for k, t in enumerate(out.types[:-1])), pa.array(texts, type=out.types[-1])], schema=out)

    return pages.select(*(f.name for f in rest), column).mapInArrow(run, ddl)
