"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of tokens: words, and the tags between them.  Words score
positive and tags negative.  What an element tells of the words in it (its tag, the words of
its class, id and role, standing in or beside an article) are log odds learned from
labelled pages (:mod:`.html_training`) and summed along the path to it; each feature counts once a path.
Parts with evidence against them score nothing but a single cost.  One linear scan finds
the best contiguous region.

The region, completed to the blocks it begins and ends in, is the main text: character
references decoded, white space inside a block as one space, blocks joined by an empty
line.  Parts inside it with evidence against them (adverts, forms, comments ...) are left out.

Parsing is one pass, linear in the page.  Scripts, styles and other raw elements end at their own end tag
only, whatever they hold; a script or style that never ends takes the rest of the page, another raw
element that never ends takes nothing; a comment that never ends stops at its first ``>``.

Defined results: null or empty html, and pages without any positive region, give
an empty text; truncated pages are read as far as they go; repeated rows are
repeated; ties go to the earlier, then the shorter region; other columns are kept, an input column
named like the result is replaced.  Whole pages are read; nothing is capped.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+(?:[-_][a-z]+)*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no markup; each ends at its own end tag only
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
#: elements whose content is markup, but not shown text
UNSEEN = frozenset("noscript template svg math object".split())
#: elements that stand as a block of their own
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: elements that HTML itself sets apart from the text around them
ASIDE = frozenset("nav header footer aside form button select menu dialog".split())
CONTAINER = frozenset("article main section div td body html center".split())
LISTED = frozenset("li td th dt dd".split())
#: closed by the start of another of their kind
SELF_CLOSING = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = frozenset("article main section div td th table body html ul ol nav header footer aside form blockquote".split())
_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: elements that stand everywhere, and whose tag tells nothing of the place
TEXTUAL = _INLINE | frozenset("html body p h1 h2 h3 h4 h5 h6 blockquote pre center div section table thead tbody tfoot tr td th ul ol li dl dt dd".split())
#: evidence below which a place isn't main text
CUTOFF = -0.5
#: steps of the fit
STEPS = 12


@dataclass(slots=True)
class Node:
    tag: str
    parent: "Node | None"
    #: what it and its names tell, beyond what an open element has told already
    features: tuple[str, ...] = ()
    #: where its words stand: plain, link or list
    local: str = "plain"
    #: in an article or main element
    inside: bool = False
    unseen: bool = False
    start: int = 0
    stop: int = 0
    #: sum of the evidence of itself and the elements around it
    total: float = 0.0
    side: bool = False


@dataclass(slots=True)
class Item:
    """A run of text or a tag, in page order."""

    kind: str
    text: str
    words: int
    node: Node
    brk: bool = False


@dataclass
class Page:
    items: list[Item]
    #: all elements, parents first; the first is the page itself
    nodes: list[Node]


def names_of(attrs: str) -> set[str]:
    """Features of class, id and role values: single words, and the words of compound ones."""
    out: set[str] = set()
    for m in _ATTR.finditer(attrs):
        for name in _NAME.findall(m[1].lower()):
            parts = re.split("[-_]", name)
            out |= {f"name {name}"} if len(parts) == 1 else {f"part {w}" for w in parts}
    return out


def parse(page: str) -> Page:
    """Items in page order; nodes know the range of items they hold.  One pass, linear in the page."""
    root = Node("html", None)
    node, items, nodes = root, [], [root]
    opened: dict[str, int] = {}
    told: dict[str, int] = {}
    at, end = 0, len(page)

    def close(n: Node) -> Node:
        n.stop = len(items)
        opened[n.tag] -= 1
        for f in n.features:
            told[f] -= 1
        return n.parent

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a comment that never ends stops at its first bracket
            at = (page.find(">", at) + 1) or end
            continue
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                items.append(Item("text", text, len(text.split()), node))
            continue
        tag = name.lower()
        block = tag in BLOCK
        if m[1]:  # an end tag
            if opened.get(tag):
                while node.tag != tag:
                    node = close(node)
                node = close(node)
            items.append(Item("</" + tag, "", 0, node, block))
            continue
        empty = m[3].rstrip().endswith("/")
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            if stop:
                at = stop.end()
            elif tag in ("script", "style"):
                at = end
            continue
        closes = [t for t, by in SELF_CLOSING.items() if tag in by and opened.get(t)]
        if closes:  # an open paragraph or cell inside the nearest scope ends here
            up = node
            while up is not root and up.tag not in closes and up.tag not in SCOPE and up.tag in BLOCK | _INLINE:
                up = up.parent
            if up.tag in closes and up is not root:
                while node is not up:
                    node = close(node)
                node = close(node)
        items.append(Item(tag, "", 0, node, block))
        if tag in VOID or empty:
            continue
        found = names_of(m[3]) if m[3] else set()
        if tag not in TEXTUAL:
            found.add(f"tag {tag}")
        new = tuple(sorted(f for f in found if not told.get(f)))
        local = "link" if tag == "a" else node.local if tag not in CONTAINER and node.local == "link" else "list" if tag in LISTED else "plain" if tag in CONTAINER else node.local
        node = Node(tag, node, new, local, node.inside or tag in ("article", "main"), node.unseen or tag in UNSEEN, len(items))
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        for f in new:
            told[f] = told.get(f, 0) + 1
    while node is not None:
        node.stop = len(items)
        node = node.parent
    return Page(items, nodes)


def place(page: Page, weights: "Weights") -> None:
    """Sum the evidence of every element, and mark those that aren't main text."""
    own = [sum(weights.places.get(f, 0.0) for f in n.features) for n in page.nodes]
    for k in wrappers(page, own):
        own[k] = 0.0
    beside = False
    for n, e in zip(page.nodes, own, strict=True):
        n.total = (n.parent.total if n.parent else 0.0) + e
        beside |= n.tag in ("article", "main") and n.total >= CUTOFF
    for n in page.nodes:
        kind = "none" if not beside else "in" if n.inside else "out"
        n.side = n.unseen or n.total + weights.places.get(f"kind {kind}", 0.0) < CUTOFF


def wrappers(page: Page, own: list[float]) -> list[int]:
    """Elements whose evidence against them says nothing, as they wrap the main text itself.

    Forms, and elements whose names only sound like something else.  Such a wrapper holds a main element; or all
    articles, and all h1 or most words (several articles beside an h1 are comments); without these, all h1 and most
    words, or most words of a page that has no word beside.  A part of an article isn't one.
    """
    nodes, items = page.nodes, page.items
    soft = [k for k, n in enumerate(nodes) if own[k] < 0 and (n.tag == "form" or n.tag not in ASIDE)]
    if not soft:
        return []
    apart: dict[int, bool] = {}
    against: dict[int, bool] = {}
    for k, n in enumerate(nodes):
        apart[id(n)] = n.tag in ASIDE and n.tag != "form" or bool(n.parent) and apart[id(n.parent)]
        against[id(n)] = own[k] < CUTOFF or bool(n.parent) and against[id(n.parent)]
    before = [0]
    for x in items:
        before.append(before[-1] + (0 if apart[id(x.node)] else x.words))
    spans = {t: [(n.start, n.stop) for n in nodes if n.tag == t and not apart[id(n)]] for t in ("main", "article", "h1")}
    plain = any(x.words and not against[id(x.node)] for x in items)
    starts = sorted(s for s, _ in spans["main"])
    reach = {t: (min(s for s, _ in v), max(e for _, e in v)) for t, v in spans.items() if v}
    in_main: dict[int, bool] = {}
    for n in nodes:
        in_main[id(n)] = bool(n.parent) and (n.parent.tag == "main" or in_main[id(n.parent)])

    def all_of(n: Node, t: str) -> bool:
        return t in reach and n.start <= reach[t][0] and reach[t][1] <= n.stop

    def wraps(n: Node) -> bool:
        k = bisect.bisect_left(starts, n.start)
        if k < len(starts) and starts[k] < n.stop:
            return True
        if starts and not in_main[id(n)]:
            return False
        most = 2 * (before[n.stop] - before[n.start]) > before[-1]
        if spans["article"]:
            return all_of(n, "article") and (all_of(n, "h1") or (most and not (spans["h1"] and len(spans["article"]) > 1)))
        return most and (all_of(n, "h1") if spans["h1"] else not plain)

    return [k for k in soft if wraps(nodes[k])]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous region with the greatest positive sum; (0, 0) if none."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def score(page: Page, weights: "Weights") -> list[float]:
    """A score for every item: words by where they stand, tags by their name.

    A part that isn't main text costs once as a whole, so that an advert inside a text doesn't outweigh the text.
    """
    out = []
    for x in page.items:
        if x.node.side:
            out.append(0.0)
        elif x.kind == "text":
            out.append(x.words * weights.words[x.node.local])
        else:
            out.append(weights.tags.get(x.kind.lstrip("/<"), weights.other))
    for n in page.nodes:
        if n.side and n.start < len(out) and not (n.parent and n.parent.side):
            out[n.start] += weights.side
    return out


def blocks_of(items: list[Item], start: int, stop: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(_html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    for x in items[start:stop]:
        if x.kind == "text":
            if not x.node.side:
                held.append(x.text)
        elif x.brk:
            close()
    close()
    return out


def extract_text(page: str | None, weights: "Weights | None" = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    w = weights or default_weights()
    parsed = parse(page)
    place(parsed, w)
    items = parsed.items
    start, stop = best_region(score(parsed, w))
    if start == stop:
        return ""
    # to the ends of the blocks that the region begins and ends in
    while start > 0 and not items[start - 1].brk:
        start -= 1
    while stop < len(items) and not items[stop].brk:
        stop += 1
    return "\n\n".join(blocks_of(items, start, stop))


@dataclass(frozen=True)
class Weights:
    #: evidence for main text of an element's tag and names, and of standing in or beside an article
    places: dict[str, float]
    #: score of a word of the main text: plain, in a list, in a link
    words: dict[str, float]
    #: score of a tag by its name
    tags: dict[str, float]
    #: score of any other tag
    other: float
    #: score of a part that isn't main text
    side: float


def learn(pages: list[tuple[str, str]], prior: float = 0.5, scale: float = 0.1, ridge: float = 0.1) -> Weights:
    """Weights from labelled pages: (html, its main text).

    The evidence of the features under which a run of text stands is fitted so that its sum is the log odds of the
    run being main text.  A word scores more than a tag costs, by the share of such words that are main text; a tag costs
    ``scale`` times one plus its log odds against main text, twice ``scale`` at most.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    runs: list[set[str]] = []
    hits: list[bool] = []
    for page, main in pages:
        parsed = parse(page)
        left = main.replace("\n\n", " ")  # the runs of main text, in order
        beside = any(n.inside for n in parsed.nodes)
        for x in parsed.items:
            if x.kind != "text":
                (inside if 0 < len(left) < len(main) else outside)[x.kind.lstrip("</")] += 1
                continue
            text = " ".join(_html.unescape(x.text).split())
            if not text:
                continue
            hit = left.startswith(text)
            if hit:
                left = left[len(text) :].lstrip()
            (inside if hit else outside)[f"w {x.node.local}"] += 1
            seen = {"kind " + ("none" if not beside else "in" if x.node.inside else "out")}
            n = x.node
            while n is not None:
                seen.update(n.features)
                n = n.parent
            runs.append(seen)
            hits.append(hit)

    def odds(f: str) -> float:
        return math.log((inside[f] + prior) / (outside[f] + prior))

    # log odds that are right together: ridge regression, by Newton's method
    names = sorted(set().union(*runs)) if runs else []
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(runs), len(names)))
    for k, seen in enumerate(runs):
        x[k, [at[f] for f in seen]] = 1.0
    y, w = np.array(hits, float), np.zeros(len(names))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge * np.eye(len(w)), grad)
    places = {f: float(w[at[f]]) for f in names}
    words = {k: 5 * scale + 1 / (1 + math.exp(-odds(f"w {k}"))) for k in ("plain", "link", "list")}
    tags = {f: -scale * min(2.0, 1 + max(0.0, -odds(f))) for f in {*inside, *outside} if not f.startswith("w ")}
    return Weights(places, words, tags, -scale, -scale)


def default_weights() -> Weights:
    """The weights of the labelled pages that come with the package."""
    from .html_training import LABELLED

    return learn(list(LABELLED))


def main_text(html: Column, weights: Weights | None = None) -> Column:
    w = weights or default_weights()  # learned once, on the driver

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract_text(p, w) for p in pages], dtype=object)

    return run(F.coalesce(html, F.lit("")))


def extract(df: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``df`` with the main text of every page in column ``to``."""
    return df.withColumn(to, main_text(F.col(f"`{html_col}`")))
