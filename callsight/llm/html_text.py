"""Main text of web pages: flat blocks of text, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each has its word count,
its link density, those of the blocks before and after it, its tag's kind and whether it
stands in a part of the page that names itself (`nav`, `footer`, `aside`, a class like
`sidebar`). A class only names a part if the whole token does (`site-footer`, not
`has-sidebar`), and neither names nor tags count on a container of the page's text (`_void`). A
decision tree, grown on the small labelled table below, says which blocks are main text; these are
joined in page order.

Defined cases: a null or empty html has no text; an unclosed script or style ends with the
page, any other unclosed tag is a container like others; unknown references stay as they are;
nothing is cut off. Rows that repeat are each answered; of blocks with equal features all or none
are main text; columns of the input named `text` or `n_chars` are replaced.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<closed>noscript|template|textarea|iframe|title)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"(?:(?!<(?P=closed)[\s/>]).)*?</(?P=closed)\s*>"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.I | re.S,
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = {"nav", "footer", "aside", "menu", "dialog", "header"}
# Parts of a form or a picture; a page may lie in one as a whole, or one may be left open.
LOOSE_TAGS = {"form", "fieldset", "button", "select", "object", "svg", "textarea", "iframe", "noscript", "template"}
MAIN_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAF_TAGS = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HINT = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|"
    r"newsletter|subscri\w*|sidebar|side|widgets?|menu|nav\w*|breadcrumbs?|header|masthead|footer|foot|"
    r"comments?|replies|reply|disqus|social|share|sharing|related|recommend\w*|login|signup|search|"
    r"pagination|pager|tags?|copyright|legal|skip"
)
# Words that a token may have beside a hint.
PLAIN = set(
    "site page main top bottom left right primary secondary global list box block wrapper wrap container area "
    "section item items link links bar inner outer col column row slot unit icons icon buttons button form "
    "text label title group panel cloud news post posts article articles entry story stories".split()
)
TEXT_WORDS = {"post", "article", "entry", "story"}  # their header is the text's
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = {"class", "id", "role", "aria-label"}
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool  # in a part that names itself something else than main text
    main: bool  # in an article or main element
    heading: bool
    item: bool  # list item or table cell


def _is_hint(token: str) -> bool:
    parts = [part for part in re.split(r"[\d_-]+", token) if part]
    hints = {part for part in parts if HINT.fullmatch(part)}
    if not hints or (hints <= {"header", "tag", "tags"} and TEXT_WORDS.intersection(parts)):
        return False
    return all(part in hints or part in PLAIN for part in parts)


def _attributes(attrs: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attrs)}


def _is_hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attrs.get("style", "")))


def _is_named_boiler(attrs: dict[str, str]) -> bool:
    """Whether a class, id, role or label says so."""
    named = [value.lower() for name, value in attrs.items() if name in NAMING]
    return any(n.strip() in ROLES or any(map(_is_hint, n.split())) for n in named)


def _kind(name: str, attrs: dict[str, str], in_main: bool) -> str:
    """What a container is by its tag and names: `sure` boilerplate, `loose` boilerplate, or nothing."""
    if name in MAIN_TAGS or name in ("body", "html"):
        return ""
    if (name in BOILER_TAGS and not (name == "header" and in_main)) or _is_hidden(attrs):
        return "sure"
    return "loose" if name in LOOSE_TAGS or _is_named_boiler(attrs) else ""


def _void(found: list[Block], within: list[tuple], holders: dict[int, tuple], mains: set[int], sure: set[int]) -> set[int]:
    """The containers whose kind does not count, as they hold the page's text: the main
    element, or the longest article if it is longer than all text outside of such parts and
    little of that is in articles (else it may be a long comment). On a page without either:
    those with most of its words and little beside them, unless their tag makes them `sure`."""
    named, articles, free, free_main, total = {}, {}, 0, 0, 0
    for block, (hints, inside) in zip(found, within, strict=True):
        total += block.words
        if not hints:
            free += block.words
            free_main += block.words if block.main else 0
        for h in hints:
            named[h] = named.get(h, 0) + block.words
        for a in inside:
            articles[a] = articles.get(a, 0) + block.words
    if holders:
        longest = max(articles, key=lambda a: (articles[a], -a), default=-1)
        held = {longest} if articles.get(longest, 0) > max(free, 4 * free_main) else set()
        return {h for a, hints in holders.items() if a in mains or a in held for h in hints}
    return {h for h, words in named.items() if h not in sure and 2 * words > total and 4 * free < words}


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, markup, scripts and styles left out."""
    found: list[Block] = []
    # name, main, boilerplate containers, articles
    stack: list[tuple[str, bool, tuple, tuple]] = []
    within: list[tuple] = []  # of each block, the last two
    holders: dict[int, tuple] = {}  # article or main element -> boilerplate containers around it
    mains: set[int] = set()
    sure: set[int] = set()
    n_named = 0
    parts: list[str] = []
    linked_parts: list[str] = []
    links = 0

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            linked = len(references.unescape("".join(linked_parts)).split())
            names = [part[0] for part in stack[-3:]]
            within.append(stack[-1][2:] if stack else ((), ()))
            found.append(
                Block(
                    text,
                    text.count(" ") + 1,
                    linked,
                    False,
                    bool(stack) and stack[-1][1],
                    any(n in HEADINGS for n in names),
                    any(n in ("li", "td", "th", "dd", "dt") for n in names),
                )
            )
        parts.clear()
        linked_parts.clear()

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked_parts.append(text)

    at = 0
    for tag in TAG.finditer(page):
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            if tag["raw"] or tag["closed"]:
                flush()
            continue
        closing, attrs = bool(tag["end"]), tag["attrs"] or ""
        if name == "a":  # a new anchor ends the one before, and one without a target is no link
            links = 0 if closing else int("href" in _attributes(attrs))
        elif name not in INLINE:
            flush()
            links = links if closing or name not in MAIN_TAGS else 0
        if name in LEAF_TAGS or attrs.endswith("/"):
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif name != "a" and (name not in INLINE or attrs):
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            _, main, hints, inside = stack[-1] if stack else ("", False, (), ())
            kind = _kind(name, _attributes(attrs) if attrs else {}, main)
            if name in MAIN_TAGS:
                here = len(holders)
                holders[here], inside = hints, (*inside, here)
                if name == "main":
                    mains.add(here)
            elif kind:
                if kind == "sure":
                    sure.add(n_named)
                hints, n_named = (*hints, n_named), n_named + 1
            stack.append((name, main or name in MAIN_TAGS, hints, inside))
    if at < len(page):
        add(page[at:])
    flush()
    if n_named:
        void = _void(found, within, holders, mains, sure)
        for block, (hints, _) in zip(found, within, strict=True):
            block.boiler = not void.issuperset(hints)
    return found


def features(page: list[Block]) -> np.ndarray:
    """A row per block: the flags, then own, previous and next word count and link density."""
    words = np.array([0, *(b.words for b in page), 0], float)
    density = np.array([0, *(b.linked / b.words for b in page), 0], float)
    flags = np.array([(b.boiler, b.main, b.heading, b.item) for b in page], float).reshape(-1, 4)
    some_main = np.full((len(page), 1), float(any(b.main and not b.boiler for b in page)))
    return np.column_stack(
        [flags, some_main, words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]]
    )


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    share: float = 0.0


def _impurity(ones, count):
    p = ones / np.maximum(count, 1)
    return count * 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1) -> Node:
    """A classification tree by Gini impurity; ties go to the first feature and lowest limit."""
    node = Node(share=float(y.mean()) if len(y) else 0.0)
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (_impurity(y.sum(), len(y)) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(values[1:] > values[:-1]) + 1
        cuts = cuts[(cuts >= least) & (len(y) - cuts >= least)]
        if len(cuts):
            cost = _impurity(ones[cuts - 1], cuts) + _impurity(ones[-1] - ones[cuts - 1], len(y) - cuts)
            k = int(np.argmin(cost))
            if cost[k] < best[0] - 1e-9:
                best = (float(cost[k]), f, float((values[cuts[k] - 1] + values[cuts[k]]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.limit = best[1], best[2]
    low = x[:, node.feature] <= node.limit
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.share > 0.5)
    out = np.empty(len(x), bool)
    low = x[:, node.feature] <= node.limit
    out[low], out[~low] = predict(node.low, x[low]), predict(node.high, x[~low])
    return out


MARK = "@@"  # starts a block of main text in the labelled pages
LONG = "the river rose after the storm and the old bridge near the mill was closed for a week while workers cleared it"
LABELLED = [
    f"<nav><ul><li><a href=x>home</a><li><a href=x>news</a></ul></nav><article><h1>{MARK}flood in town</h1><p>{MARK}{LONG}</p><p>{MARK}short end.</p></article><footer>about us, all rights</footer>",
    f"<header><a href=x>site name</a> <p>daily paper</p></header><div class=ad>buy two get one now</div><main><p>{MARK}{LONG}<p>{MARK}so it went.<p>{MARK}{LONG} {LONG}</main><aside><p>{LONG}</p></aside>",
    f"<div id=menu><a href=x>one</a> <a href=x>two</a></div><div><h2>{MARK}a plain page</h2><p>{MARK}{LONG}</p><p>{MARK}{LONG}</p></div><div class=footer><p>made by us in a small town by the sea</p></div>",
    f"<article><p>{MARK}{LONG}</p><div class=ad>now cheaper than ever, only this week</div><p>{MARK}{LONG}</p><ul><li>{MARK}first a point</ul></article><div class=comments><p>{LONG}</p><p>me too</p></div>",
    f"<div class='cookie notice'><p>we use small files to make this site work as you would like it to work</p></div><article><h1>{MARK}two words</h1><p>{MARK}<a href=x>a link only</a></p><p>{MARK}{LONG}</p></article><section class=related><a href=x>more of this kind for you to read</a></section>",
    f"<form><label>your name</label><p>send us a line and we will answer you within a day or two if we can</p></form><div><p>{MARK}{LONG}</p></div>",
    f"<div><a href=x>home</a></div><div><a href=x>about the firm</a> <a href=x>work with us</a></div><div>{MARK}{LONG} <a href=x>source</a></div><div>{MARK}{LONG}</div><div>terms</div>",
    f"<table><tr><td><a href=x>a</a><td><a href=x>b</a></table><p>{MARK}{LONG}<p>{MARK}{LONG}<p><a href=x>next page</a> <a href=x>last page</a>",
    f"<body><p>{MARK}{LONG}</p></body>",
    f"<div class=sidebar><h3>top stories</h3><p>{LONG}</p></div><article><p>{MARK}yes.</p></article><footer><p>{LONG}</p><a href=x>contact</a></footer>",
    f"<article><h2>{MARK}part one</h2><p>{MARK}it is so.</p><blockquote>{MARK}{LONG}</blockquote><div class='share'>tell your friends</div></article><p>all material is ours and may not be used</p><div>seen by many people here today</div>",
    f"<nav><a href=x>all</a></nav><article><h1>{MARK}title</h1><p>{MARK}a few words and more.</p></article><div class=ad>not for sale</div>",
    f"<article><h1>{MARK}{LONG}</h1><p>{MARK}to be brief</p><div class=promo><p>{LONG}</p></div><p>{MARK}{LONG}</p><h2>{MARK}and on</h2><p>{MARK}<a href=x>see there</a></p></article><p>{LONG}</p><footer>the end</footer>",
    f"<div class=menu><p>{LONG}</p></div><main><h1>{MARK}notes</h1><ul><li>{MARK}<a href=x>first</a></li><li>{MARK}<a href=x>second</a></li></ul></main><div><a href=x>back to the top of this page</a></div>",
    f"<div><h1>{MARK}no article here</h1><p>{MARK}{LONG}</p><h2>{MARK}part two of it</h2><p>{MARK}{LONG}</p></div><div class=login><p>{LONG}</p></div>",
    f"<article><h1>{MARK}<a href=x>the old bridge near the mill is closed</a></h1><p>{MARK}{LONG} <a href=x>source</a></p><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li><li><a href=x>all that we know about the mill</a></li></ul><p>{MARK}{LONG}</p></article>",
    f"<article><p>{MARK}{LONG}</p><div>now cheaper than ever <a href=x>buy it here today and save half of it</a></div><p>{MARK}so it <a href=x>went</a> on for days.</p><p>{MARK}{LONG}</p></article>",
    f"<article><h1>{MARK}flood in town</h1><p>{MARK}in short.</p></article><div><p>{MARK}{LONG} {LONG}</p><p>{MARK}{LONG} {LONG}</p><p>{MARK}{LONG} {LONG} <a href=x>source</a></p></div><div><a href=x>{LONG} {LONG}</a></div>",
    f"<article><h1>{MARK}a title</h1><p>{MARK}a few words and more.</p></article>",
    f"<main><p>{MARK}all is well.</p><p>{MARK}{LONG}</p></main><p>{LONG}</p>",
    f"<div><p>{LONG}</p></div><article><p>{MARK}yes, so it is</p><p>{MARK}no</p></article><p>{LONG}</p>",
    f"<article><p>{MARK}{LONG}</p></article><div><p>{LONG}</p><p>{LONG}</p></div>",
    f"<article><h1>{MARK}flood</h1><p>{MARK}in short, all went well in the end</p></article><p>{MARK}{LONG} {LONG}</p>",
    f"<article><p>{MARK}all went well in the end</p><ul><li>{MARK}one</li><li>{MARK}and two of them</li></ul></article><p>seen by us</p>",
    f"<article><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li></ul><h1>{MARK}flood</h1><p>{MARK}in short</p><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li></ul></article>",
    f"<main><h1>{MARK}flood</h1><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li></ul><p>{MARK}{LONG}</p><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li></ul></main><ul><li><a href=x>more about the storm of last year</a></li><li><a href=x>who pays for the new bridge now</a></li></ul>",
    f"<main><p>{MARK}{LONG}</p><p>{MARK}<a href=x>so they say</a></p><ul><li>{MARK}<a href=x>third</a></li></ul></main>",
    f"<div class='content has-sidebar'><article><p>{MARK}{LONG}</p></article><div class=sidebar><p>{LONG} {LONG}</p></div></div>",
    f"<main><ul><li>{MARK}eggs and flour</li><li>{MARK}two cups of milk</li></ul><p>{MARK}mix well.</p></main><div><p>{LONG}</p></div>",
]


# Pages without an article, where a short line is told by its neighbours alone. A block is its label (`+` main
# text), its number of words, `a` if they are a link, `h` if it is a heading.
LINED = [
    "-2a -2a -3a +2h +45 +30 -3a -2",
    "-1a -1a -6 -2a +1h +52 +6 +41 -5a -4a",
    "-3a -2a +3 +36 +28 +4 +60 -2a -3",
    "+1h +40 +33 -4a",
    "-4a -9 -4a -8a +5h +25 +48 +9 +31 -7a -5 -6a",
    "-2a -3 -2a -2a +70 +5 +22 +80 -10a -4 -9a",
    "-6 -3a -12a -7 -12a +4h +39 +12 +35 -3a -9 -2a",
    "-5a -1 -5a +2h +31 +1 +27 +2h +64 -1a -1a",
    "-2a -2a +8 +90 +10 +24 +3h +29 -2a -8 -2a",
    "-1a -11 -1a -11 -1a +6h +23 +55 -20a -11",
    "+3h +34 +8 +47 +2 +21 -14a -14a -6",
    "-3a -10 -15a -4 -3a +1 +58 +26 -6a -2 -3a",
    "+23 +26 -1a",
    "+40 +5 +19 -2a -2a",
    "+18 -3a",
    "-5 -2a -5a +33 +21",
    "-3 +4h +22 +27",
]


def _lined(spec: str) -> str:
    def block(part: str) -> str:
        count = int(re.sub(r"\D", "", part))
        words = (MARK if part[0] == "+" else "") + " ".join((LONG.split() * 5)[:count])
        return f"<h2>{words}</h2>" if part[-1] == "h" else f"<div><a href=x>{words}</a></div>" if part[-1] == "a" else f"<div>{words}</div>"

    return "".join(map(block, spec.split()))


LABELLED += map(_lined, LINED)


def trained() -> Node:
    """The tree of the labelled pages above."""
    x, y = [], []
    for page in LABELLED:
        found = blocks(page)
        x.append(features(found))
        y.extend(b.text.startswith(MARK) for b in found)
    return grow(np.vstack(x), np.array(y, float))


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    if not found:
        return ""
    chosen = predict(tree, features(found))
    return " ".join(b.text for b, keep in zip(found, chosen, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with the main text of `html` and its number of code points."""
    tree = trained()

    @F.arrow_udf("string")
    def texts(page: pa.Array) -> pa.Array:
        return pa.array([main_text(p or "", tree) for p in page.to_pylist()], pa.string())

    others = [c for c in pages.columns if c not in ("text", "n_chars", "__text")]
    return (
        pages.withColumn("__text", texts(F.col("html")))
        .select(*others, F.col("__text").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
