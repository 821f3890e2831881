"""Main text of HTML pages by tree scoring.

A page is read into a tree.  Parts that are never article text by their tag,
role or class (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments of readers) are left out.  Every paragraph then passes
points for its length and its commas to its ancestors, less with distance;
points are discounted by the share of link text.  The best container is kept,
or the article element around it.  Without an article element all its siblings
(headings, paragraphs, blocks of any length and text between them) stay with it,
but for those that are mostly links and score low.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANCESTORS = 5
SIBLING_SHARE = 0.2
SIBLING_POINTS = 10.0
SIBLING_LINKS = 0.5
MENU_LINKS = 3
MENU_SHARE = 0.66

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search
section summary table tbody td tfoot th thead tr ul""".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 td th pre blockquote dd dt figcaption caption summary address".split())
DROPPED = frozenset("""head nav header footer aside form button select option input label fieldset menu dialog template
svg math canvas object embed applet audio video map script style textarea title xmp iframe noembed noframes noscript
search""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                          "toolbar status".split())
# words of class and id names of parts that are not article text
DROPPED_NAMES = frozenset("""ad adbox adcontainer ads adsense adslot adunit adv advert advertisement advertisements
advertising adverts alert banner bottombar breadcrumb breadcrumbs comment commentform commentlist comments consent cookie
cookiebanner cookiebar cookies copyright crumbs discussion disqus footer footers gdpr header hidden legal login masthead
menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promos
promotion recommended recommendations related remark replies reply respond responses share sharing shoutbox sidebar
sidebars signin signup sitefooter siteheader sitenav skip social sponsor sponsored sponsors subnav subscribe subscription
toolbar topbar topnav tracking widget widgets""".split())
COMMENT_NAMES = frozenset("comment comments reply replies response responses".split())
# first words of names that speak of another element ("has-sidebar", "no-comments")
ABOUT = frozenset("has no not with without hide show".split())
KEPT_ANYWAY = frozenset("html body main".split())
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3,
              "dl": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
CLOSED_BY = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}),
             "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
             "tbody": ("thead tbody tfoot tr td th", {"table"}), "tfoot": ("thead tbody tfoot tr td th", {"table"}),
             "thead": ("thead tbody tfoot tr td th", {"table"})}
P_SCOPE = frozenset("td th caption table html button object".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)
|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S | re.X)
# one attribute after another, so that what stands in a value is never taken for a name
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "points", "chars", "link_chars", "links", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.points, self.chars, self.link_chars, self.links = 0.0, 0, 0, 0

    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    def score(self) -> float:
        return (self.points + TAG_POINTS.get(self.tag, 0)) * (1.0 - self.density()) if self.points else 0.0


def is_boilerplate(tag: str, attributes: str, by_name: bool) -> bool:
    """True for an element that is never article text, by its tag, role, hidden mark or names."""
    if tag in DROPPED:
        return True
    if not attributes or tag in KEPT_ANYWAY:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if by_name and name in ("class", "id"):
            unwanted = COMMENT_NAMES if tag == "article" else DROPPED_NAMES
            for one in value.split():
                words = [w.lower() for w in NAME_WORDS.findall(one)]
                # "sideBar" and "side-bar" are one word as well
                joined = map("".join, zip(words, words[1:]))
                if words and words[0] not in ABOUT and not (unwanted.isdisjoint(words) and unwanted.isdisjoint(joined)):
                    return True
    return False


class Page:
    """The tree of a page: its open elements while it is read, and its blocks of text in page order."""

    def __init__(self, by_name: bool):
        self.by_name = by_name
        self.root = Node("html", None)
        self.stack = [self.root]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[Node, str, int]] = []
        self.pieces: list[tuple[str, bool]] = []

    def read(self, source: str) -> Page:
        at, lower = 0, None
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                break
            self.text(source[at:m.start()])
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
            elif m[2] or m[4]:
                tag, attributes = (m[2] or m[4]).lower(), m[3] if m[2] else m[5]
                if tag in RAW:
                    # raw text lasts to its own end tag, whatever it holds
                    lower = lower or source.lower()
                    close = lower.find(f"</{tag}", at) if len(lower) == len(source) else source.find(f"</{tag}", at)
                    after = source.find(">", close) if close >= 0 else -1
                    at = after + 1 if after >= 0 else len(source)
                else:
                    self.start(tag, attributes)
        if at < len(source):
            self.text(source[at:])
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        return self

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].dropped:
            self.pieces.append((html.unescape(raw) if "&" in raw else raw, self.open.get("a", 0) > 0))

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.pieces.append((" ", False))
            return
        if tag in BLOCK:
            self.flush()
            if self.open.get("p"):
                self.close({"p"}, P_SCOPE)
            if tag in CLOSED_BY:
                tags, scope = CLOSED_BY[tag]
                self.close(set(tags.split()), scope)
        if tag in VOID:
            return
        if tag == "a":
            if self.open.get("a"):
                self.end("a")
            node = self.stack[-1]
            node.links += 1
        parent = self.stack[-1]
        node = Node(tag, parent, parent.dropped or is_boilerplate(tag, attributes, self.by_name))
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, tags: set, scope) -> None:
        """Close the outermost open element of ``tags`` within the nearest one of ``scope``."""
        cut = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in scope:
                break
            if self.stack[i].tag in tags:
                cut = i
                if len(tags) == 1:
                    break
        while cut is not None and len(self.stack) > cut:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            # an inline end tag does not close the blocks around it
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return

    def pop(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCK:
            self.flush()
        self.stack.pop()
        self.open[node.tag] -= 1
        if not node.dropped:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.links += node.links

    def flush(self) -> None:
        """The text gathered so far becomes a block of the innermost open block element."""
        if not self.pieces:
            return
        text = " ".join("".join(t for t, _ in self.pieces).split())
        linked = sum(len("".join(t.split())) for t, link in self.pieces if link)
        self.pieces = []
        node = next((n for n in reversed(self.stack) if n.tag in BLOCK), self.root)
        if text and not node.dropped:
            node.chars += len(text)
            node.link_chars += min(linked, len(text))
            self.blocks.append((node, text, linked))


def _within(node: Node | None, tops: set[int]) -> bool:
    while node is not None:
        if id(node) in tops:
            return True
        node = node.parent
    return False


def _is_menu(node: Node) -> bool:
    return node.links >= MENU_LINKS and node.density() > MENU_SHARE


def _select(page: Page) -> list[str]:
    blocks = page.blocks
    for node, text, linked in blocks:
        points = (1.0 + len(COMMA.findall(text)) + len(text) / 100.0) * (1.0 - min(1.0, linked / len(text)))
        holder = node.parent if node.tag in LEAF and node.parent is not None else node
        for level in range(ANCESTORS):
            if holder is None:
                break
            holder.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            holder = holder.parent
    seen: dict[int, Node] = {}
    for node, _, _ in blocks:
        while node is not None and id(node) not in seen:
            seen[id(node)] = node
            node = node.parent
    if not seen:
        return []
    best = max(seen.values(), key=Node.score)
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    best = around or best
    tops, between = {id(best)}, set()
    if best.tag != "article" and best.parent is not None:
        least = max(SIBLING_POINTS, best.score() * SIBLING_SHARE)
        children: dict[int, list[Node]] = {}
        for node in seen.values():
            if node.parent is not None:
                children.setdefault(id(node.parent), []).append(node)
        # up to the last ancestor of which another part scores like article text
        path, last, node = [], 1, best
        while node.parent is not None:
            beside = [n for n in children[id(node.parent)] if n is not node]
            path.append((node.parent, beside))
            if any(n.density() <= SIBLING_LINKS and n.score() >= least for n in beside):
                last = len(path)
            node = node.parent
        for parent, beside in path[:last]:
            between.add(id(parent))
            tops |= {id(n) for n in beside if n.density() <= SIBLING_LINKS or n.score() >= least}
    out = []
    for node, text, linked in blocks:
        if id(node) in between and linked <= SIBLING_LINKS * len(text):
            out.append(text)
        elif _within(node, tops):
            holder, menu = node, False
            while holder is not None and id(holder) not in tops:
                menu = menu or _is_menu(holder)
                holder = holder.parent
            if not menu:
                out.append(text)
    return out


def main_text(source: str | None) -> str:
    """Blocks of the article of a page, joined by one newline; empty without text (null, empty, markup only).

    The best container is the article it stands in, if there is one; of several
    articles side by side that is the one whose parts score best (ties: the
    first), since the others of a page are teasers or comments.  Without an
    article element, the container's siblings stay, and those of its ancestors
    up to the last of which another part scores like article text; parts that
    are mostly links go.  If the names of classes rule out everything, a second
    reading goes by tags and roles only.  Equal pages give equal texts; a very
    long page is read whole.
    """
    if not source:
        return ""
    return "\n".join(_select(Page(True).read(source)) or _select(Page(False).read(source)))


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def main_text_column(source: Column) -> Column:
    """``main_text`` as a column (null: empty), evaluated in Arrow batches."""
    return F.pandas_udf(_extracted, "string")(source)
