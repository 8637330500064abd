"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from . import text as T

#: Element names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select button canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that an element of a kind ends.
PEERS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CLOSES_P = BLOCK - frozenset("body html caption option optgroup legend summary td th tr tbody thead tfoot li dd dt".split())
#: Elements that can hold an article.
HOLDERS = frozenset("html article main section div td center blockquote details dd table tbody tr".split())
#: Words in class, id and role that mark what is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets masthead skip pagination pager toolbar complementary contentinfo search form dialog".split())
#: Those of them that also name a paragraph or phrase of an article; they count on containers only.
CONTAINED = frozenset("search form social related recommended recommendations banner menu nav navigation notice notices alert dialog skip share sharing reply replies respond comment comments promo promotion subscribe subscription signup footer toolbar widget widgets overlay complementary contentinfo".split())
TEXT_LEVEL = frozenset("p span a b i em strong small u s q abbr cite code mark time sub sup label blockquote pre figcaption caption dt dd td th tr h1 h2 h3 h4 h5 h6".split())
#: Elements that carry an article's text among others of their kind.
FLOW = frozenset("p blockquote pre figure table ul ol dl section hr".split()) | HEADINGS
#: Words that may stand beside one of these in a name.
BESIDE = frozenset("list box block section area wrap wrapper container bar item items slot unit links link top bottom left right inner outer site page main post posts thread primary secondary sticky small large header".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class _Node:
    """An element: its own and all its text, links and tags below it, for the density."""

    __slots__ = ("tag", "up", "down", "out", "block", "depth", "chars", "links", "tags", "link_tags", "density", "sum")

    def __init__(self, tag: str, up, out: bool):
        self.tag, self.up, self.out, self.depth = tag, up, out, 0 if up is None else up.depth + 1
        self.block = self if up is None or tag in BLOCK else up.block  # the nearest block around
        self.down: list = []  # nodes, and texts between them
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def _names_boilerplate(name: str, tag: str) -> bool:
    """Whether a class, id or role says so in all of its words: ``comment-list`` does, ``related-work`` doesn't."""
    words = [w.lower() for w in _NAME.findall(name)]
    marks = MARKS - CONTAINED if tag in TEXT_LEVEL else MARKS
    return not marks.isdisjoint(words) and all(w in marks or w in BESIDE for w in words)


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its name or attributes; a header inside an article is part of it."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main", "article") or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role") and tag not in HEADINGS and any(_names_boilerplate(v, tag) for v in value.split()):
            return True
    return False


def parse(page: str) -> _Node:
    """The tree of a page, forgiving: unclosed paragraphs and items end where HTML ends them, stray ends are ignored.

    Each element is opened and closed once, so the time grows with the page's length.
    """
    root = here = _Node("html", None, False)
    at, still_open = 0, Counter()

    def close(node: _Node) -> None:
        nonlocal here
        while here is not node.up:
            still_open[here.tag] -= 1
            here = here.up

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            here.down.append(page[at:end])
        if not m:
            break
        at = max(m.end(), at + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if still_open[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.up
                close(node)
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = shut.end() if shut else len(page) if tag in ("script", "style", "title", "textarea") else at
            continue
        peers = PEERS.get(tag, ())
        if tag in CLOSES_P or peers:
            node = here.block
            if node is not root and (node.tag == "p" or node.tag in peers):
                close(node)
                if here.tag == "tr" and tag == "tr":
                    close(here)
        node = _Node(tag, here, here.out or _marked(tag, m[3], still_open["article"] + still_open["main"] > 0))
        here.down.append(node)
        if tag not in VOID:
            here = node
            still_open[tag] += 1
    return root


def _measure(root: _Node) -> list[_Node]:
    """Fill in characters, links, tags, densities and their sums, from the leaves up; the nodes outside boilerplate."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.down if isinstance(x, _Node) and not x.out]
    for node in reversed(order):
        for x in node.down:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.out:
                node.chars += x.chars
                node.links += x.links
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    for node in reversed(order):
        node.density = density(node, root)
        node.sum = sum(x.density for x in node.down if isinstance(x, _Node) and not x.out)
    return order


def density(node: _Node, body: _Node) -> float:
    """Characters a tag, times a logarithm that falls as the share of links among them grows."""
    if not node.chars:
        return 0.0
    c, plain, lc, t, lt = node.chars, max(1, node.chars - node.links), node.links, max(1, node.tags), max(1, node.link_tags)
    base = math.log(c * lc / plain + body.links * c / max(1, body.chars) + math.e)
    return c / t * max(0.0, math.log(max(1.0, c * t / (max(1, lc) * lt)))) / max(1.0, math.log(base) if base > math.e else 1.0)


def _runs_on(node: _Node, core: _Node, share: float = 0.1) -> bool:
    """Whether a block has text and isn't a list of links: three or more that bring the link adjustment of its
    density (its density over its plain characters a tag) under ``share`` of the core's."""
    plain = lambda n: n.chars / max(1, n.tags)
    return bool(node.chars) and (node.link_tags < 3 or node.density * plain(core) >= share * core.density * plain(node))


def contents(root: _Node, slack: float = 0.5) -> list[_Node]:
    """The nodes whose text is the article, in page order.

    The element with the largest sum of its children's densities is its core (of equal ones an article or main element,
    then the deeper). What stands beside the core, or beside an element around it, belongs to it if its density is
    ``slack`` of the body-path threshold or more: the least density on the path from the core to the body, the body
    itself apart, and it isn't a list of links. So do headings there. Short parts of the article fall under any threshold: a block beside the core
    in the same parent that carries text as it does (a section beside a section, a paragraph, list or table), and all
    blocks within an article element around the core, belong to it unless they are lists of links. Nothing
    beside an article or main element does.
    """
    nodes = [n for n in _measure(root) if n.tag in HOLDERS]
    best = max(nodes, key=lambda n: (round(n.sum, 6), n.tag in ("article", "main"), n.depth))
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = slack * min([n.density for n in path[:-1]] or [0.0])
    inside = sum(n.tag == "article" for n in path[1:])  # article elements still around
    core = [best]
    for child, parent in zip(path, path[1:]):
        if child.tag in ("article", "main") and not inside:
            break
        close = child is best and parent is not root

        def belongs(x: _Node) -> bool:
            if x is child or x.chars and x.tag in HEADINGS:  # noqa: B023
                return True
            near = inside > 0 or close and x.tag in FLOW and (x.tag != "section" or child.tag == "section")  # noqa: B023
            return _runs_on(x, best) and (near or x.density >= threshold)

        # text between elements of an article is its own too
        beside = [x for x in parent.down if (x.strip() and inside > 0 if isinstance(x, str) else not x.out and belongs(x))]
        where = next(i for i, x in enumerate(beside) if x is child)
        core = beside[:where] + core + beside[where + 1 :]
        inside -= parent.tag == "article"
    return core


def main_text(page: str) -> str:
    """Text of the article of a page (see ``contents``), without boilerplate elements; empty if it has none."""
    top = contents(parse(page))
    blocks, now = [], []

    def close():
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list = [(x, False) for x in reversed(top)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            now.append(x)
            continue
        if x.out:
            continue
        block = x.tag in BLOCK
        if block:
            close()
        elif x.tag == "br":
            now.append(" ")
        if not done:
            if block:
                stack.append((x, True))
            stack += [(y, False) for y in reversed(x.down)]
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html); a null page is an empty one.

    Rows stay one to one; a page is parsed whole by the task that reads it.
    """
    ddl = "page_id long, url string, text string, n_chars long"
    emit = T.emitter(ddl)

    def run(batches):
        for part in T.slices(batches, "html"):
            text = [main_text(h) for h in part.column("html").to_pylist()]
            yield emit({"page_id": part.column("page_id"), "url": part.column("url"), "text": text, "n_chars": [len(t) for t in text]})

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, ddl)
