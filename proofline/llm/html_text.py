"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page is read once, from left to right, into blocks: runs of text between block-level tags. A block's features are its number
of words and its link density, those of the blocks before and after it, and its zone: in an article, in a part that is named as
none, or neither. A small decision tree, trained on the labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import map_batches, prepare

SKIP = frozenset(("script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "select", "textarea", "button"))
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
IN_HEAD = frozenset(("title", "meta", "link", "script", "style", "base", "noscript", "template"))
MAIN = frozenset(("article", "main"))
#: Parts that are no main text, whatever is inside; and those in which an article may yet stand.
HARD, SOFT = frozenset(("nav", "footer", "aside", "menu", "dialog")), frozenset(("header", "form"))
#: Words of class, id and role that name such parts.
HARD_WORDS = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "disqus", "footer", "menu", "nav", "navbar", "navigation", "pagination", "recommended", "related", "replies", "reply", "responses", "sidebar", "sponsor", "sponsored"))
SOFT_WORDS = frozenset(("alert", "banner", "consent", "cookie", "cookies", "dialog", "form", "gdpr", "header", "masthead", "modal", "newsletter", "notice", "notices", "popup", "promo", "promotion", "search", "share", "sharing", "signup", "social", "subscribe", "subscription", "toolbar", "topbar", "widget"))
#: Words that may stand beside those in a name of several words, as in site-footer. Other names, like has-sidebar, tell of something else.
BESIDE = frozenset(("area", "article", "bar", "block", "bottom", "box", "buttons", "container", "content", "global", "group", "inner", "item", "left", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "story", "text", "thread", "top", "unit", "user", "wrap", "wrapper"))
#: Elements that a start tag of the same kind closes, as paragraphs do.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "body", "blockquote", "td", "th"))
#: Comments, sections, declarations; end tags; start tags, in which a quote counts only after an equals sign.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?![^\s=])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")

#: Zones. NONE: never main text. BESIDE_MAIN: outside an article that is the lesser part of its page, or in a soft part of a page
#: that has none.
NONE, BESIDE_MAIN, OPEN, IN_MAIN = -2, -1, 0, 1
#: Soft parts in an article or main element, and others, until the whole page is known.
_SOFT_IN_MAIN, _SOFT = -4, -3


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    zone: int


def part_of(attributes: str) -> str:
    """hidden, hard, soft, main or nothing: what the attributes say of their own element."""
    found = ""
    for name, value in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return "hidden"
        if name == "role" and value == "main":
            found = found or "main"
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = set(WORD.findall(token))
                if words and words <= HARD_WORDS | SOFT_WORDS | BESIDE:
                    found = "hard" if words & HARD_WORDS else "soft" if words & SOFT_WORDS and found != "hard" else found
    return found


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, without those of elements whose content is no text.

    Text of hidden and wrongly named inline elements is left out of its block; they end with their block at the latest.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, bool]] = []  # name, zone, skipped
    opened: Counter[str] = Counter()
    text: list[str] = []
    links, zone_of_text, link_depth = 0, OPEN, 0  # link_depth: the stack's height where a link began, 0 outside links

    def flush() -> None:
        nonlocal links
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, joined.count(" ") + 1, links, zone_of_text))
        text.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal link_depth
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        if len(stack) + 1 < link_depth:
            link_depth = 0

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece and not (stack and stack[-1][2]):
            if not text:
                zone_of_text = stack[-1][1] if stack else OPEN
            text.append(piece)
            if link_depth:
                links += len(html.unescape(piece).split())
        if not m:
            break
        at = m.end()
        end, start, attributes = m.groups()
        if end:
            name = end.lower()
            if name not in INLINE:
                flush()
            if name == "a":
                link_depth = 0
            if opened[name] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
        elif start:
            name = start.lower()
            inline = name in INLINE
            if name == "br":
                text.append(" ")
            elif not inline:
                flush()
                while stack and stack[-1][0] in INLINE:  # an inline element that was not closed ends here, but for links
                    opened[stack.pop()[0]] -= 1
            if name in VOID:
                continue
            if opened["head"] > 0 and name not in IN_HEAD and name not in ("head", "html"):
                pop_to(next(k for k, x in enumerate(stack) if x[0] == "head"))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
            _, zone, skipped = stack[-1] if stack else ("", OPEN, False)
            part = "" if name in ("html", "body") else part_of(attributes)
            skipped = skipped or name in SKIP or part == "hidden"
            if inline:
                skipped = skipped or part in ("hard", "soft")
                link_depth = len(stack) + 1 if name == "a" else link_depth
            elif zone != NONE:
                if name in HARD or part == "hard":
                    zone = NONE
                elif name in SOFT or part == "soft":
                    zone = _SOFT_IN_MAIN if zone in (IN_MAIN, _SOFT_IN_MAIN) else _SOFT
                elif name in MAIN or part == "main":
                    zone = IN_MAIN
            if attributes.rstrip().endswith("/") and not inline and name not in RAW:
                continue
            stack.append((name, zone, skipped))
            opened[name] += 1
            if name in RAW:  # no markup inside
                stop = re.compile(f"</{name}", re.I).search(page, at)
                at = stop.start() if stop else n
    flush()
    size = lambda *zones: sum(b.words for b in out if b.zone in zones)
    beside = NONE if size(IN_MAIN) >= size(OPEN) else BESIDE_MAIN  # an article with most of the text is all of it
    final = {_SOFT_IN_MAIN: NONE} | ({_SOFT: NONE, OPEN: beside} if size(IN_MAIN) else {_SOFT: BESIDE_MAIN})
    for block in out:
        block.zone = final.get(block.zone, block.zone)
    return out


#: Labelled blocks: words, link density, words and link density of the block before, of that after, zone; 1: main text.
LABELLED = [
    (6, 1.0, 0, 0.0, 5, 1.0, -2, 0), (1, 1.0, 1, 1.0, 1, 1.0, -2, 0), (9, 0.0, 1, 1.0, 7, 0.0, -2, 0), (40, 0.0, 12, 0.0, 8, 0.0, -2, 0), (120, 0.0, 80, 0.0, 90, 0.0, -2, 0), (15, 0.0, 60, 0.0, 60, 0.0, -2, 0),
    (3, 0.0, 200, 0.0, 0, 0.0, -2, 0), (70, 0.0, 3, 0.0, 60, 0.0, -2, 0), (2, 0.5, 1, 1.0, 12, 0.0, -2, 0), (25, 0.1, 30, 0.0, 0, 0.0, -2, 0),
    (120, 0.0, 0, 0.0, 0, 0.0, -2, 0), (60, 0.0, 5, 0.0, 10, 0.0, -2, 0), (200, 0.0, 90, 0.0, 3, 0.0, -2, 0), (90, 0.05, 30, 0.0, 12, 1.0, -2, 0), (55, 0.0, 60, 0.0, 1, 1.0, -2, 0), (30, 0.0, 90, 0.0, 20, 0.0, -2, 0),
    (18, 0.0, 20, 0.0, 40, 0.0, -2, 0), (80, 0.0, 1, 1.0, 2, 0.0, -2, 0), (65, 0.1, 70, 0.1, 70, 0.1, -2, 0), (12, 0.0, 200, 0.0, 60, 0.0, -2, 0), (48, 0.0, 65, 0.0, 0, 0.0, -2, 0), (110, 0.0, 7, 0.0, 130, 0.0, -2, 0),
    (8, 0.0, 9, 0.0, 70, 0.0, 1, 1), (70, 0.0, 8, 0.0, 90, 0.0, 1, 1), (2, 0.0, 90, 0.0, 40, 0.0, 1, 1), (1, 0.0, 40, 0.0, 1, 0.0, 1, 1), (1, 0.0, 1, 0.0, 30, 0.0, 1, 1), (5, 0.0, 4, 1.0, 3, 0.0, 1, 1),
    (45, 0.05, 1, 0.0, 60, 0.1, 1, 1), (60, 0.3, 45, 0.05, 10, 0.0, 1, 1), (10, 0.4, 60, 0.3, 20, 0.0, 1, 1), (200, 0.0, 3, 0.0, 25, 0.0, 1, 1), (3, 0.0, 0, 0.0, 50, 0.0, 1, 1), (6, 0.5, 30, 0.0, 40, 0.0, 1, 1),
    (4, 1.0, 60, 0.0, 4, 1.0, 1, 0), (3, 1.0, 4, 1.0, 5, 1.0, 1, 0), (5, 1.0, 3, 1.0, 30, 0.0, 1, 0), (12, 0.0, 5, 1.0, 25, 0.0, 1, 1), (30, 0.0, 20, 0.9, 6, 1.0, 1, 1), (2, 1.0, 80, 0.0, 0, 0.0, 1, 1),
    (6, 0.7, 30, 0.0, 40, 0.0, 1, 1), (5, 0.8, 1, 0.0, 50, 0.0, 1, 1), (4, 1.0, 60, 0.0, 30, 0.0, 1, 1), (9, 0.9, 12, 0.0, 0, 0.0, 1, 1), (6, 0.7, 0, 0.0, 3, 0.0, 1, 1), (2, 0.6, 5, 1.0, 4, 1.0, 1, 1), (1, 1.0, 1, 1.0, 2, 1.0, 1, 0),
    (12, 0.0, 5, 1.0, 3, 1.0, 1, 1), (3, 0.0, 1, 1.0, 2, 1.0, 1, 1), (1, 0.0, 4, 1.0, 4, 1.0, 1, 1), (8, 0.0, 40, 0.0, 3, 1.0, 1, 1), (20, 0.2, 6, 1.0, 6, 1.0, 1, 1), (2, 0.0, 0, 0.0, 1, 1.0, 1, 1), (25, 0.0, 60, 0.1, 9, 1.0, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 1, 0), (5, 1.0, 30, 0.0, 6, 1.0, 1, 0), (3, 1.0, 3, 1.0, 0, 0.0, 1, 0), (6, 1.0, 6, 1.0, 80, 0.0, 1, 0), (2, 1.0, 3, 1.0, 9, 0.0, 1, 0), (8, 1.0, 8, 1.0, 8, 1.0, 1, 0), (30, 1.0, 5, 1.0, 4, 1.0, 1, 0),
    (12, 1.0, 25, 0.0, 30, 0.0, 1, 1), (1, 1.0, 9, 0.0, 2, 0.0, 1, 1), (3, 1.0, 0, 0.0, 0, 0.0, 1, 1), (20, 0.9, 60, 0.0, 12, 0.1, 1, 1), (4, 0.9, 3, 1.0, 3, 1.0, 1, 0),
    (4, 1.0, 30, 0.0, 30, 0.0, 0, 0), (6, 1.0, 0, 0.0, 60, 0.0, 0, 0), (3, 1.0, 60, 0.0, 0, 0.0, 0, 0), (9, 0.9, 10, 0.0, 50, 0.0, 0, 0), (25, 0.9, 40, 0.0, 50, 0.0, 0, 0), (60, 0.0, 5, 0.0, 3, 1.0, 0, 1), (45, 0.1, 2, 1.0, 2, 1.0, 0, 1),
    (40, 0.8, 30, 0.2, 1, 1.0, 1, 1), (3, 1.0, 2, 0.3, 90, 0.1, 1, 1), (2, 1.0, 30, 0.0, 2, 1.0, 1, 0), (2, 1.0, 2, 1.0, 0, 0.0, 1, 0), (6, 0.8, 3, 1.0, 70, 0.0, 1, 1),
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 0), (1, 1.0, 2, 1.0, 40, 0.0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0), (5, 0.0, 4, 1.0, 3, 0.0, 0, 0), (4, 0.8, 3, 0.0, 30, 0.0, 0, 0), (4, 0.0, 0, 0.0, 3, 0.0, 0, 0),
    (60, 0.0, 5, 0.0, 70, 0.0, 0, 1), (35, 0.1, 60, 0.0, 20, 0.0, 0, 1), (6, 0.0, 60, 0.0, 55, 0.0, 0, 1), (9, 0.0, 2, 0.0, 60, 0.0, 0, 1), (18, 0.0, 40, 0.0, 35, 0.0, 0, 1), (14, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (80, 0.0, 0, 0.0, 0, 0.0, 0, 1), (22, 0.0, 3, 1.0, 45, 0.0, 0, 1), (7, 0.0, 6, 0.0, 5, 1.0, 0, 0), (20, 0.7, 30, 0.0, 3, 1.0, 0, 0), (10, 0.6, 10, 0.6, 10, 0.6, 0, 0), (2, 0.0, 70, 0.0, 60, 0.0, 0, 1),
    (11, 0.2, 3, 0.0, 2, 0.0, 0, 0), (28, 0.0, 12, 0.0, 2, 0.0, 0, 1), (13, 0.0, 50, 0.0, 40, 0.2, 0, 1),
    (60, 0.0, 8, 0.0, 70, 0.0, -1, 1), (70, 0.0, 60, 0.0, 5, 0.0, -1, 1), (90, 0.05, 70, 0.0, 60, 0.0, -1, 1), (55, 0.0, 90, 0.0, 80, 0.0, -1, 1), (50, 0.1, 55, 0.0, 45, 0.0, -1, 1), (48, 0.0, 65, 0.0, 0, 0.0, -1, 1),
    (6, 0.0, 1, 1.0, 9, 0.0, -1, 0), (12, 0.0, 1, 1.0, 80, 0.0, -1, 0), (25, 0.0, 3, 0.0, 6, 0.0, -1, 0), (30, 0.0, 60, 0.0, 2, 1.0, -1, 0), (3, 0.0, 60, 0.0, 0, 0.0, -1, 0), (20, 0.0, 0, 0.0, 9, 0.0, -1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (45, 0.6, 50, 0.5, 60, 0.6, -1, 0), (35, 0.1, 12, 0.0, 8, 0.0, -1, 0), (8, 0.0, 70, 0.0, 7, 0.0, -1, 0), (15, 0.3, 40, 0.0, 10, 0.9, -1, 0),
    (120, 0.0, 5, 0.0, 4, 0.0, -1, 0), (60, 0.0, 2, 1.0, 12, 0.0, -1, 0), (75, 0.0, 9, 0.0, 1, 1.0, -1, 0), (50, 0.0, 0, 0.0, 6, 0.0, -1, 0), (18, 0.0, 90, 0.0, 12, 0.0, -1, 0), (30, 0.0, 10, 0.0, 60, 0.0, -1, 0), (26, 0.0, 55, 0.0, 70, 0.0, -1, 1),
]


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    share: float = 0.0


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A CART tree by Gini impurity; ties go to the first feature and the smallest cut."""
    node = Node(share=float(y.mean()))
    if depth == 0 or len(set(y.tolist())) == 1:
        return node
    best = None
    for f in (6, *range(6)):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return node
    _, node.feature, node.cut, low = best
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def trained() -> Node:
    rows = np.array(LABELLED, float)
    return grow(rows[:, :7], rows[:, 7])


def is_main(tree: Node, x: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if x[tree.feature] <= tree.cut else tree.high
    return tree.share >= 0.5


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    shape = [(0, 0.0), *((b.words, min(1.0, b.link_words / b.words)) for b in found), (0, 0.0)]
    return "\n".join(b.text for i, b in enumerate(found) if is_main(tree, (*shape[i + 1], *shape[i], *shape[i + 2], b.zone)))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Character references are decoded, white space inside a block is one space, and blocks are joined by line feeds in page order.
    Null, empty and wholly boilerplate pages have an empty text. Unclosed and misplaced tags are read as browsers do, roughly; a
    quote in a tag counts only after an equals sign. A name in class, id or role speaks for its own element, and an article inside
    a form, a header or another soft part is an article still. Headers inside articles are headers.
    Repeated rows each get their row; null ids and urls stay null; an empty table gives no rows. Other columns are not read.
    """
    prepare(pages.sparkSession)
    tree = tree or trained()

    def columns(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html")), columns, "page_id long, url string, text string, n_chars long")
