"""Blocks of a web page: runs of text between block-level tags, each with its place in the element tree and what speaks for or against it."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:["'][^>]*)?>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no markup and no visible text, and those that show no text of the page whatever they hold.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
MUTED = frozenset("svg select button template object canvas audio video datalist option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary "
    "table caption tbody thead tfoot tr ul".split()
)
#: Tags that end an open element of these kinds when they begin, up to the nearest of the others.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Costs. Fixed, as no table labels pages: in units of the log odds of a block being part of the article.
HARD, NAMED, SOFT_HEADER, HIDDEN = -8.0, -8.0, -1.5, -8.0
IN_ARTICLE, OUT_OF_ARTICLE, WELL_NAMED = 3.0, -2.5, 1.5
BIAS, LINKED, SENTENCE, CUE = -1.0, -4.0, 0.5, -3.0
TAGS = {"p": 1.0, "h1": 1.5, "h2": 0.7, "h3": 0.7, "h4": 0.7, "h5": 0.7, "h6": 0.7, "blockquote": 0.5, "pre": 0.5, "tr": 0.5, "dd": 0.5, "figcaption": 0.5}
_HARD_TAGS = frozenset("nav aside footer dialog menu".split())
_HARD_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert banner menu menubar toolbar".split())
#: Words of class and id that name boilerplate, and those that name the article.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner sidebar menu nav navbar topnav sidenav subnav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus widget widgets toolbar pagination pager copyright popup "
    "modal overlay search tagcloud skip".split()
)
GOOD_NAMES = frozenset("article content main post entry story body text".split())
_OPENINGS = ("©", "(c) ", "copyright", "advertisement", "sponsored", "share this", "read more", "related articles", "related posts", "related stories", "leave a comment", "leave a reply")
_PHRASES = ("all rights reserved", "we use cookies", "this website uses cookies", "this site uses cookies", "subscribe to our newsletter")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    cost: float = 0.0  # what its own markup says
    soft: bool = False  # no word where the element holds the article or most of the page
    header: bool = False
    good: bool = False
    article: int = 0  # 2 an article element, 1 a main element
    size: int = 0  # code points outside links below it


@dataclass(slots=True)
class Block:
    node: int
    text: str
    linked: float
    score: float = 0.0
    links: list[tuple[int, float]] = field(default_factory=list)


def _new_node(tag: str, attributes: str, parent: int, depth: int) -> Node:
    node = Node(tag, parent, depth)
    names: set[str] = set()
    role, hidden = "", False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names.update(w.lower() for w in _WORD.findall(value))
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    if tag in ("html", "body"):
        return node
    if tag in _HARD_TAGS or role in _HARD_ROLES:
        node.cost += HARD
    elif tag == "form":
        node.cost, node.soft = node.cost + HARD, True
    if tag == "header" or "header" in names:
        node.header = True
    if names & BAD_NAMES:
        node.cost, node.soft = node.cost + NAMED, True
    node.good = bool(names & GOOD_NAMES) and not names & BAD_NAMES
    node.cost += HIDDEN * hidden
    if node.cost == 0:
        node.article = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
    return node


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The block-level elements of a page and its blocks in page order. Never fails: what is no markup is text."""
    nodes, blocks = [Node("", -1, 0)], []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements, each with the block-level one that holds its text
    parts: list[str] = []
    chars, in_links, muted, at_node, pos = 0, 0, 0, 0, 0
    total = 0

    def end_block() -> None:
        nonlocal chars, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(at_node, text, min(1.0, chars / max(1, total))))
            parts.clear()
            chars = total = 0

    def pop_to(depth: int) -> None:
        nonlocal in_links, muted
        for tag, _ in stack[depth:]:
            in_links -= tag == "a"
            muted -= tag in MUTED
            if tag in BLOCK:
                end_block()
        del stack[depth:]

    while match := _TOKEN.match(page, pos):
        pos = match.end()
        tag = match[2]
        if tag is None:
            token = match[0]
            if token[0] == "<" and len(token) > 1 or muted:
                continue
            text = html.unescape(token) if "&" in token else token
            if not parts:
                at_node = stack[-1][1]
            parts.append(text)
            n = len(text) - text.count(" ")
            total += n
            chars += n * (in_links > 0)
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "p" and tag not in (t for t, _ in stack):
                end_block()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth][0]
                if open_tag == tag:
                    pop_to(depth)
                    break
                if open_tag in BLOCK and tag not in BLOCK:
                    break  # an inline end tag ends no block
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else len(page)
            continue
        if tag == "br" or tag in ("td", "th"):
            if parts:
                parts.append(" ")
        if tag in BLOCK:
            end_block()
            for depth in range(len(stack) - 1, 0, -1):  # an open paragraph ends
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if tag in _ENDS:
            kinds, stop = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in kinds:
                    pop_to(depth)
                    break
                if stack[depth][0] in stop:
                    break
        if tag in VOID:
            continue
        holder = stack[-1][1]
        if tag in BLOCK:
            nodes.append(_new_node(tag, match[3], holder, nodes[holder].depth + 1))
            holder = len(nodes) - 1
        in_links += tag == "a"
        muted += tag in MUTED
        stack.append((tag, holder))
    end_block()
    return nodes, blocks


def _cued(text: str) -> bool:
    return text.startswith(_OPENINGS) or any(p in text for p in _PHRASES)


def score(nodes: list[Node], blocks: list[Block]) -> None:
    """Give each block its log odds of being content, from its words and from the elements around it."""
    for b in blocks:
        nodes[b.node].size += round(len(b.text) * (1 - b.linked))
    for node in reversed(nodes[1:]):  # children follow their parents
        nodes[node.parent].size += node.size
    under = [0] * len(nodes)  # elements around each that speak against it
    for i, n in enumerate(nodes[1:], 1):
        under[i] = under[n.parent] + (n.cost < 0)
    main: set[int] = set()
    for kind in (1, 2):  # the least doubtful article elements, but for teasers beside a larger one; else main elements
        found = [i for i, n in enumerate(nodes) if n.article == kind and n.size]
        found = [i for i in found if under[i] == min(under[j] for j in found)]
        main = {i for i in found if 2 * nodes[i].size >= max(nodes[j].size for j in found)} or main
    holds = set()
    for i in main:
        while i >= 0 and i not in holds:
            holds.add(i)
            i = nodes[i].parent
    around, inside, good = [0.0] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        inside[i] = inside[n.parent] or i in main
        void = n.soft and (i in holds or 5 * n.size > 3 * nodes[0].size)
        cost = 0.0 if void else n.cost
        if n.header and not (i in holds or 5 * n.size > 3 * nodes[0].size):
            cost += SOFT_HEADER if inside[i] else HARD
        around[i] = around[n.parent] + cost
        good[i] = good[n.parent] or n.good
    for b in blocks:
        words = b.text.count(" ") + 1
        b.score = (
            BIAS + around[b.node] + TAGS.get(nodes[b.node].tag, 0.0) + LINKED * b.linked + min(2.0, 0.5 * math.log2(1 + words / 8)) + WELL_NAMED * good[b.node] + (IN_ARTICLE if inside[b.node] else OUT_OF_ARTICLE if main else 0.0)
            + (SENTENCE if b.text[-1] in ".!?…。！？" else 0.0) + (CUE if words < 60 and _cued(b.text.lower()) else 0.0)
        )


def distance(nodes: list[Node], a: int, b: int) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a != b:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return steps
