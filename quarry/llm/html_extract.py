"""Main-text extraction from HTML by tree scoring.

The page becomes a light tree (tags, attributes, text in page order; missing end tags are inferred for paragraphs, items, cells and
the like). Subtrees that can't be article text go first: scripts, styles, menus, headers, footers, sidebars, forms, notices,
adverts, reader comments, told by tag, role or the words of class and id. A name alone doesn't drop an element with another name that means
article text ("content no-sidebar") or one around the page's ``main``. Nor does a compound name ("has-sidebar"; not "sidebar") drop an element around the
page's only articles, or with most of its paragraph text and no other article or main beside it; their score decides, and those apart from the best container go. Each paragraph then passes points (one, one for each
comma, one for each 100 characters up to three) to its ancestors: the parent in full, and half as many at each level above; points are
discounted by the share of the container's text that is link text. The best
container is kept, or the ``article`` or ``main`` element around it, and with it its sibling blocks that have text of their own
which isn't mostly links.

The text is what is left: character references decoded, white space inside a block one space, trimmed, blocks joined in page order by
one space. Nothing is cut: pages of any size are read whole, one at a time, in time that grows in proportion however deep elements are nested and
however many stray tags there are.

Defined results: a null or empty page gives an empty text; a page that breaks off inside a tag loses that tag alone; unclosed elements end
with their parent; a page without paragraphs is scored on its bare blocks; repeated rows get equal results; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROP_TAGS = set("script style nav header footer aside form noscript template iframe button select textarea input option svg canvas object embed dialog menu head title audio video map label fieldset noembed noframes xmp".split())
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note", "status"}
#: Words of class and id that mark what isn't the article.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adbox|adslot|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|topbar|breadcrumbs?|header|masthead|footer|foot|sidebar\w*|side|aside|widgets?|related|recommend\w*|popular|trending|share|sharing|social|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe\w*|signup|login|comments?|commentlist|respond|replies|disqus|discussion|feedback|form|search\w*|pagination|pager|toolbar|skip|copyright|legal|disclaimer|paywall|tags)(?:$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body|text|blog)(?:$|[\s_-])", re.I)
#: What an opening tag ends, and the elements beyond which it doesn't look.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_BARRIER = {"table", "td", "th", "caption", "button", "object", "template", "html"}
#: The different entries of _ENDS, and which of them an opening tag asks for.
_GROUPS = sorted({(tuple(sorted(e)), tuple(sorted(s))) for e, s in _ENDS.values()})
_GROUP_OF = {tag: _GROUPS.index((tuple(sorted(e)), tuple(sorted(s)))) for tag, (e, s) in _ENDS.items()}


class Node:
    """``paragraph`` is the open paragraph it lies in (itself included), ``ends`` what each of _GROUPS would end there, ``open`` the open tags
    by name since the last barrier."""

    __slots__ = ("tag", "parent", "children", "dropped", "good", "named", "spared", "score", "chars", "links", "commas", "paragraph", "ends", "open")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.dropped = self.good = self.spared = False
        self.named = 0
        self.score, self.chars, self.links, self.commas = 0.0, 0, 0, 0
        self.paragraph: Node | None = None
        self.ends: tuple = (None,) * len(_GROUPS)
        self.open: Counter = Counter()

    def enter(self) -> None:
        """Takes over from the parent what is open around it, without a walk."""
        up, tag = self.parent, self.tag
        self.paragraph = self if tag == "p" else None if tag in _BARRIER else up.paragraph
        if tag in _ENDING:
            self.ends = tuple(None if tag in stops else (above or self) if tag in ends else above for (ends, stops), above in zip(_GROUPS, up.ends))
        else:
            self.ends = up.ends
        self.open = Counter() if tag in _BARRIER else up.open


_ENDING = {tag for ends, stops in _GROUPS for tag in (*ends, *stops)}


def _unwanted(tag: str, attrs: str) -> tuple[bool, bool, int]:
    """Whether a tag opens something that can't be article text, whether it looks like an article, and whether its name alone speaks against it (1: part of a name, 2: a whole one)."""
    if tag in DROP_TAGS:
        return True, False, 0
    if not attrs.strip() or tag in ("html", "body"):
        return False, tag in ("article", "main"), 0
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{got.get('class', '')} {got.get('id', '')}"
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return True, False, 0
    if got.get("role", "").lower() in DROP_ROLES:
        return True, False, 0
    good = tag in ("article", "main") or got.get("role", "").lower() in ("main", "article") or bool(_GOOD.search(names))
    words = names.split()
    if got.get("role", "").lower() in ("main", "article") or not any(_BAD.search(w) for w in words) or any(_GOOD.search(w) and not _BAD.search(w) for w in words):
        return False, good, 0
    return False, good, 2 if any(_BAD.fullmatch(w) for w in words) else 1


def parse(page: str) -> Node:
    """The tree of a page; text is str children, ``br`` a blank."""
    root = Node("#root", None)
    at, top, end, every = 0, root, len(page), Counter()
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            top.children.append(page[at:lt])
            at = lt
            continue
        m = _TOKEN.match(page, at)
        if m is None:
            if page.startswith("</", at):  # a stray or broken end tag
                gt = page.find(">", at)
                at = end if gt < 0 else gt + 1
            elif at + 1 < end and page[at + 1].isalpha():  # it breaks off inside a quoted value
                at = end
            else:
                top.children.append("<")
                at += 1
            continue
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            # a block is looked for among all open tags, others up to the last barrier
            if not (every if tag in BLOCK else top.open)[tag] and not (tag in _BARRIER and every[tag]):
                continue
            node = top
            while node.tag != tag:
                node = node.parent
            top = _close(top, node, every)
            continue
        if (tag in BLOCK and tag not in _ENDS or tag == "p") and top.paragraph is not None:
            top = _close(top, top.paragraph, every)
        if tag in _ENDS and top.ends[_GROUP_OF[tag]] is not None:
            top = _close(top, top.ends[_GROUP_OF[tag]], every)
        node = Node(tag, top)
        node.dropped, node.good, node.named = _unwanted(tag, m[3])
        top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            node.enter()
            every[tag] += 1
            node.open[tag] += 1
            top = node
    return root


def _close(top: Node, node: Node, every: Counter) -> Node:
    """Closes everything from ``top`` up to ``node``; what is open then."""
    last = node.parent
    while top is not last:
        every[top.tag] -= 1
        top.open[top.tag] -= 1
        top = top.parent
    return last


def _measure(node: Node, in_link: bool = False) -> list[Node]:
    """Characters, link characters and commas of each kept subtree, without recursion; the nodes, parents first."""
    stack = [(node, in_link, 0)]
    order = []
    while stack:
        n, link, _ = stack.pop()
        link = link or n.tag == "a"
        order.append(n)
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                n.chars += size
                n.links += size * link
                n.commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.dropped:
                stack.append((c, link, 0))
    for n in reversed(order):
        if n.parent is not None and n is not node:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.commas += n.commas
    return order


_INLINE_PARAGRAPH = {"p", "pre", "td", "blockquote", "dd"}


def _paragraphs(root: Node) -> list[Node]:
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        kids = [c for c in n.children if not isinstance(c, str)]
        bare = n.tag in BLOCK | {"#root"} and not (n.tag in _INLINE_PARAGRAPH) and sum(len(c.strip()) for c in n.children if isinstance(c, str)) >= 80
        if n.tag in _INLINE_PARAGRAPH and not any(k.tag in _INLINE_PARAGRAPH for k in kids) or bare:
            found.append(n)
        stack += reversed(kids)
    return found


def _settle(root: Node) -> None:
    """Drops the elements whose name speaks against them, but for those that the page's text lies in."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            order.append(n)
            stack += [c for c in n.children if not isinstance(c, str)]
    suspects = [n for n in order if n.named and n.tag not in ("article", "main")]
    if not suspects:
        return
    text, mains, articles = ({id(n): 0 for n in order} for _ in range(3))
    told, within = {id(n) for n in _paragraphs(root)}, set()
    for n in order:  # parents come first
        up = n.parent
        if id(up) in told:
            told.add(id(n))
        if up is not None and (id(up) in within or up.tag in ("article", "main")):
            within.add(id(n))
        text[id(n)] = sum(len(c.strip()) for c in n.children if isinstance(c, str)) if id(n) in told else 0
        mains[id(n)], articles[id(n)] = int(n.tag == "main"), int(n.tag == "article" and not n.named)
    for n in reversed(order):
        if n.parent is not None:
            for count in (text, mains, articles):
                count[id(n.parent)] += count[id(n)]
    top = id(root)
    for n in suspects:
        only = articles[id(n)] == articles[top] and not mains[top]
        most = 2 * text[id(n)] > text[top] and (only or id(n) in within)
        if not mains[id(n)]:
            n.spared = n.named == 1 and (only and articles[id(n)] > 0 or most)
            n.dropped = not n.spared


def _part(root: Node, core: Node) -> None:
    """Drops the spared elements that neither hold the best container nor lie in it."""
    above, up = set(), core
    while up is not None:
        above.add(id(up))
        up = up.parent
    stack = [root]
    while stack:
        n = stack.pop()
        if n is not core and not n.dropped:
            n.dropped = n.spared and id(n) not in above
            stack += [c for c in n.children if not isinstance(c, str)]


def _density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def choose(root: Node) -> list[Node]:
    """The nodes that make up the article, in page order."""
    _settle(root)
    order = _measure(root)
    scored: dict[int, Node] = {}
    for p in _paragraphs(root):
        if p.chars:
            up = p.parent or p
            up.score += 1 + p.commas + min(p.chars / 100, 3)
            scored[id(up)] = up
    for n in reversed(order):  # children before their parents: half of what a container has goes on to the one around it
        if n.score and n.parent is not None:
            n.parent.score += n.score / 2
            scored[id(n.parent)] = n.parent
    if not scored:
        scored = {id(n): n for n in _blocks(root) if n.good and n.chars} or {id(root): root}
        for n in scored.values():
            n.score = n.chars
    best = max(scored.values(), key=lambda n: n.score * (1 - _density(n)) * (1.25 if n.good else 1))
    _part(root, best)
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        keep = [best]
        if best.tag == "article" and best.parent is not None:  # an article in parts
            keep = [c for c in best.parent.children if c is best or not isinstance(c, str) and c.tag == "article" and not c.dropped and c.chars and _density(c) < 0.3 and c.score * (1 - _density(c)) >= 0.4 * best.score * (1 - _density(best))]
        return keep
    least = max(10.0, 0.2 * best.score)
    keep = []
    for c in best.parent.children:
        if isinstance(c, str):
            if c.strip() and len(c.strip()) >= 80:
                keep.append(c)
        elif c is best:
            keep.append(c)
        elif not c.dropped and c.chars and (c.score * (1 - _density(c)) >= least or c.tag in _INLINE_PARAGRAPH | {"h1", "h2", "h3", "ul", "ol", "table", "figure", "section"} and _density(c) < 0.3):
            keep.append(c)
    return keep


def _blocks(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            yield n
            stack += [c for c in n.children if not isinstance(c, str)]


def render(nodes: list[Node | str]) -> str:
    """Text of the nodes: blocks in page order, joined by one space."""
    blocks: list[list[str]] = [[]]
    stack: list = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n is None:
            blocks.append([])
        elif isinstance(n, str):
            blocks[-1].append(n)
        elif n.dropped:
            continue
        elif n.tag in ("br", "hr", "wbr"):
            blocks[-1].append("" if n.tag == "wbr" else " ")
        elif n.tag in BLOCK:
            blocks.append([])
            stack.append(None)
            stack += reversed(n.children)
        else:
            stack += reversed(n.children)
    texts = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def extract(page: str | None) -> str:
    """The main text of one page."""
    return render(choose(parse(page))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""

    ship(pages.sparkSession)
    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([extract(p) for p in found], dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
