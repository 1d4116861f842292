"""Main text of web pages by composite text density.

Every node of a page's DOM gets a link-adjusted density of characters per tag. A block's density sum is that of its text
blocks (those without further blocks) and of the text between them; the block with the greatest sum holds the article. The
least density on the path from it up to the body is a threshold: another part of the page counts as text too if its
density reaches that and its density sum a third of the article's. Headings that stand beside the path go with what they head.

So menus, headers, footers and short adverts are told by their densities. Names are asked twice: before, for prose that is
not the article's and that no density tells from it (reader comments, notices, forms, sidebars, hidden text); and at the
end, for what the densities have let through (:func:`is_furniture`). Prose that only a name (a class or id of nothing but
such words and neutral ones) or a ``form`` tag speaks against is left where it holds an ``article`` or ``main`` or, on a
page with neither, most of the text outside links.

Pages are independent rows: no shuffle, and memory is that of one page. Elements nested deeper than :data:`MOST_DEPTH`
count as part of the element around them (as browsers treat them), so that broken markup costs linear time.
Defined results: null or empty html, or a page with nothing but boilerplate, gives an empty text; unclosed and cut-off
markup is closed at the end; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements, roles and words of prose that is not the article's.
DROPPED = frozenset("aside form button select option svg math canvas audio video object dialog label fieldset head".split())
DROPPED_ROLES = frozenset("complementary search form dialog alertdialog alert".split())
DROPPED_WORDS = frozenset(
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert sidebar side comment comments disqus discussion replies reply respond "
    "related recommended recommendations newsletter subscribe subscription signup popup modal overlay login widget".split()
)
#: And of what stands around an article; densities tell it, names only confirm.
FURNITURE = frozenset("nav footer menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner menu nav navbar navigation breadcrumb breadcrumbs footer foot share sharing social toolbar masthead copyright pagination pager skip tags".split()
)
#: These may stand beside such words in a name; alone they say nothing.
NEUTRAL_WORDS = frozenset(
    "area article bar block bottom box container entry global group inner item left list outer panel post primary reader right secondary section site slot unit user wrap wrapper zone".split()
)
#: These name boilerplate only outside an article.
OUTER_WORDS = frozenset("header head top topbar".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("html head base link meta script style title noscript template".split())
#: Their ids are slugs of titles inside an article.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot".split())
CLOSES_P = BLOCK - {"body", "html"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")

NAME = re.compile(r"[a-z]+")
RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9-])[^>]*>?", re.I) for tag in RAW}
MOST_DEPTH = 512
#: A part beside the article's path needs this share of the article's density sum.
SHARE = 1 / 3


class Node:
    """An element; the counts are its own at first, and those of its whole subtree after :func:`densities`."""

    __slots__ = ("block", "chars", "dropped", "furniture", "holds", "link_chars", "link_tags", "named", "parent", "tag", "tags", "until")

    def __init__(self, tag: str, parent: int, dropped: bool, named: bool = False, furniture: bool = False):
        self.tag, self.parent, self.dropped, self.named, self.furniture, self.block = tag, parent, dropped, named, furniture, tag in BLOCK
        self.chars = self.tags = self.link_chars = self.link_tags = self.until = 0
        self.holds = False  # further blocks


def attribute_words(tag: str, attributes: str, in_article: bool) -> Iterator[tuple[str, str | list[str]]]:
    """Roles, hidden marks, and the parts of every class and id (ids of titles inside an article say nothing)."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            yield "role", value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            yield "hidden", value
        elif name == "class" or name == "id" and not (in_article and tag in TITLED):
            for word in value.split():
                yield "name", NAME.findall(word)


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds prose that is not the article's, judged by its tag and attributes alone; whether no more than its name says so."""
    if tag in DROPPED and tag != "form":
        return True, False
    named = tag == "form"
    if not attributes or tag in ("html", "body", "article", "main"):
        return named, named
    for kind, value in attribute_words(tag, attributes, in_article):
        if kind == "hidden" or kind == "role" and value in DROPPED_ROLES:
            return True, False
        named = named or kind == "name" and names_only(value, DROPPED_WORDS)
    return named, named


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag, role or name says that it is a menu, header, footer or advert."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for kind, value in attribute_words(tag, attributes, in_article):
        if kind == "role" and value in FURNITURE_ROLES or kind == "name" and (names_only(value, FURNITURE_WORDS) or not in_article and names_outside(value)):
            return True
    return False


def names_only(parts: list[str], words: frozenset[str]) -> bool:
    """Whether the parts of one class or id (``comment-list``) are among ``words``, or neutral, and one is not neutral."""
    return not words.isdisjoint(parts) and all(p in words or p in NEUTRAL_WORDS or p in DROPPED_WORDS or p in FURNITURE_WORDS for p in parts)


def names_outside(parts: list[str]) -> bool:
    """Whether a class or id names the top of a page (but not of an entry), and nothing else."""
    return not OUTER_WORDS.isdisjoint(parts) and all(p in OUTER_WORDS or p in DROPPED_WORDS or p in FURNITURE_WORDS or p in ("site", "global") for p in parts)


def settle(nodes: list[Node], articles: set[int]) -> None:
    """Drops what is boilerplate by name, except what holds an article or, on a page without one, most of the text outside links."""
    text = [0 if x.dropped else x.chars - x.link_chars for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        text[nodes[k].parent] += text[k]
    articles = {k for k in articles if not nodes[k].dropped}
    for k in articles:
        while k and not nodes[k].dropped:
            nodes[k].named = False
            k = nodes[k].parent
    for k, x in enumerate(nodes):
        if k:
            x.dropped = x.dropped or nodes[x.parent].dropped or x.named and (bool(articles) or 2 * text[k] <= text[0])


def parse(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in document order, and the texts with the number of their node; None stands for a block's edge."""
    nodes = [Node("body", -1, False)]
    items: list[tuple[int, str | None]] = []
    open_: list[tuple[str, int]] = [("body", 0)]  # every open element with its node
    count: Counter = Counter()  # how many of a tag are open
    deeper: Counter = Counter()  # and how many were too deep to be opened
    holders: set[int] = set()
    at, end = 0, len(html)

    def close(to: int) -> None:
        while len(open_) > to:
            tag, _ = open_.pop()
            count[tag] -= 1
            if tag in BLOCK:
                items.append((open_[-1][1], None))

    def close_last(tags: set[str], stops: frozenset[str]) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``stops`` lies within it."""
        if any(count[t] for t in tags):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in tags:
                    close(k)
                    return
                if open_[k][0] in stops:
                    return

    def add(text: str) -> None:
        if open_[-1][0] == "head" and text.strip():
            close(len(open_) - 1)
        node = open_[-1][1]
        if nodes[node].dropped or not text:
            return
        text = unescape(text)
        items.append((node, text))
        n = len(" ".join(text.split()))
        nodes[node].chars += n
        if count["a"]:
            nodes[node].link_chars += n

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        m = TOKEN.match(html, lt)
        if m is None:  # a bare "<" is text
            add(html[at : lt + 1])
            at = lt + 1
            continue
        add(html[at:lt])
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if closing:
            if deeper[tag]:
                deeper[tag] -= 1
            else:
                close_last({tag}, frozenset())
            continue
        if tag not in IN_HEAD and open_[-1][0] == "head":
            close(len(open_) - 1)
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSES_P:
            close_last({"p"}, BLOCK)
        if tag in SAME_LEVEL:
            close_last(SAME_LEVEL[tag], LISTS)
        parent = open_[-1][1]
        dropped = nodes[parent].dropped
        if not dropped:
            nodes[parent].tags += 1
            nodes[parent].link_tags += tag == "a"
        if tag == "br":
            items.append((parent, " "))
        if tag in VOID:
            if tag == "hr":
                items.append((parent, None))
            continue
        if len(open_) > MOST_DEPTH:
            deeper[tag] += 1
            if tag in BLOCK:
                items.append((parent, None))
            continue
        inside = count["article"] + count["main"] > 0
        bad, named = (True, False) if dropped else is_boilerplate(tag, m.group(3), inside)
        nodes.append(Node(tag, parent, bad and not named, named, is_furniture(tag, m.group(3), inside)))
        node = len(nodes) - 1
        if tag in BLOCK:
            items.append((node, None))
        if tag in ("article", "main"):
            holders.add(node)
        count[tag] += 1
        open_.append((tag, node))
    close(1)
    settle(nodes, holders)
    return nodes, items


def _composite(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Characters per tag, less for link text; ``page_share`` is the share of link text in the body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_share * chars + math.e)
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(ratio, 1.0)) / math.log(1 + base)


def densities(nodes: list[Node]) -> tuple[list[float], list[float]]:
    """Composite density of every node, and every block's sum of those of its text blocks and of its text between blocks."""
    inline = [[x.chars, x.tags, x.link_chars, x.link_tags] for x in nodes]  # of the text outside child blocks
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        x.until = max(x.until, k + 1)
        if k:
            p = nodes[x.parent]
            p.until = max(p.until, x.until)
            if not x.dropped:
                p.chars, p.tags, p.link_chars, p.link_tags = p.chars + x.chars, p.tags + x.tags, p.link_chars + x.link_chars, p.link_tags + x.link_tags
                p.holds = p.holds or x.block or x.holds
                if not x.block:
                    inline[x.parent] = [a + b for a, b in zip(inline[x.parent], inline[k], strict=True)]
    share = nodes[0].link_chars / max(nodes[0].chars, 1)
    own = [0.0 if x.dropped else _composite(x.chars, x.tags, x.link_chars, x.link_tags, share) for x in nodes]
    total = [0.0 if x.dropped or not x.block else _composite(*i, share) for x, i in zip(nodes, inline, strict=True)]
    holder = [0] * len(nodes)  # the nearest block around a node
    for k in range(1, len(nodes)):
        parent = nodes[k].parent
        holder[k] = parent if nodes[parent].block else holder[parent]
        if nodes[k].block and not nodes[k].holds:
            total[holder[k]] += own[k]
    return own, total


def select(nodes: list[Node], own: list[float], total: list[float]) -> list[bool]:
    """Which nodes belong to the article: the block of the greatest sum, headings beside its path, and parts that reach the thresholds."""
    best = max(range(len(nodes)), key=lambda k: (total[k], k)) if max(total) > 0 else 0  # text too short for any density is the body's
    least, k = own[best], best
    while k:
        k = nodes[k].parent
        least = min(least, own[k])
    children: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        children.setdefault(nodes[k].parent, []).append(k)
    inside = [False] * len(nodes)
    stack = [0]
    while stack:
        k = stack.pop()
        if k < best < nodes[k].until:  # on the path to the article: look at each child
            stack += children[k]
        elif k == best or not nodes[k].dropped and not nodes[k].furniture and (nodes[k].tag in HEADINGS or own[k] >= least > 0 and max(total[k : nodes[k].until]) >= SHARE * total[best]):
            inside[k : nodes[k].until] = [True] * (nodes[k].until - k)
    cut = [False] * len(nodes)
    for k in range(1, len(nodes)):  # names confirm what is furniture within
        cut[k] = inside[k] and (cut[nodes[k].parent] or nodes[k].furniture and k != best)
    return [i and not c for i, c in zip(inside, cut, strict=True)]


def main_text(html: str | None) -> str:
    """Blocks of the page's main text, joined by line feeds."""
    if not html:
        return ""
    nodes, items = parse(html)
    own, total = densities(nodes)
    if not nodes[0].chars:
        return ""
    inside = select(nodes, own, total)
    blocks, part = [], []
    for k, text in [*items, (0, None)]:
        if text is None:
            if joined := " ".join("".join(part).split()):
                blocks.append(joined)
            part = []
        elif inside[k] and not nodes[k].dropped:
            part.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns, ``text`` and ``n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(carry))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return pages.select(*carry, html).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", text string, n_chars bigint")
