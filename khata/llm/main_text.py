"""Main text of web pages by tree scoring.

A page becomes a tree in one pass over its tags, with the ends that HTML implies. Runs of text belong to the innermost block
around them. Every paragraph gives points for its length and its commas to its container, half of them to the one above and
ever less further up; a container's sum is discounted by its share of link text. The best container is kept, with siblings
that score well or read like paragraphs.

What is no article is left out first, by its element, role or class names: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. If class names would leave nothing, they are not heeded.

Nulls and empty texts give an empty text. Broken and cut markup is read as browsers read it; no depth or length is too
large, as nothing recurses and every step costs the same. Rows are independent, so repeated rows give repeated results, and
an empty table gives none. Columns of any name pass in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.llm.frames import packed, schema_with

# What HTML says about its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
ENDS_PARAGRAPH = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul dd dt""".split())
BLOCK = ENDS_PARAGRAPH | set("html body caption thead tbody tfoot tr td th option optgroup select legend template object".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BARRIER = set("table td th caption template object html".split())
#: An element that starts ends an open one of these, up to the element that bounds them.
IMPLIED = {"li": "li", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "tr": "line", "thead": "part", "tbody": "part",
           "tfoot": "part", "option": "option"}
BOUNDS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("item",), "tr": ("cell",), "table": ("li", "item", "cell", "line", "part"),
          "td": ("li", "item"), "th": ("li", "item"), "select": ("option",), "thead": ("line",), "tbody": ("line",), "tfoot": ("line",)}
UNBOUNDED = {"li": -1, "item": -1, "cell": -1, "line": -1, "part": -1, "option": -1}

# What is never an article's text.
NEVER = set("""head title script style noscript template iframe object embed svg canvas audio video nav aside footer button select
    textarea datalist dialog menu map noembed noframes""".split())
NEVER_ROLES = set("""navigation banner contentinfo complementary search menu menubar dialog alertdialog alert toolbar tooltip form
    status""".split())
NOISE = set("""ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit adwrap sponsor sponsored
    sponsors promo promos promotion promotions promoted banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs
    pagination pager topbar toolbar sidebar sidebars rail widget widgets masthead footer foot footnav cookie cookies consent gdpr
    notice notices notification notifications alert alerts popup popups modal overlay subscribe subscription newsletter signup signin
    login register paywall comment comments commentlist commenting disqus respond reply replies discussion discussions feedback share
    sharing sharebar social related recommended recommendations trending popular outbrain taboola copyright disclaimer legal skip
    search form hidden kommentar kommentare commentaire commentaires comentario comentarios""".split())
HEADER = {"header", "topheader", "siteheader", "pageheader"}
#: A name with one of these tells of what is around or may come.
ABOUT = set("with has no without open enabled disabled".split())
#: An article with one of these is none; its other names may be categories.
NO_ARTICLE = set("comment comments ad ads advert advertisement sponsored promo related teaser".split())
GOOD = set("article articles body content entry hentry main story post text blog".split())
COMMENT_TITLE = re.compile(r"(?:\d+ )?(?:(?:reader |user )?comments?|responses?|leave a (?:reply|comment)|related(?: \w+)?|newsletter"
                           r"|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?", re.IGNORECASE)

#: Points of a container by its element, and by its class names.
POINTS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "address": -3.0,
          "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0, "th": -5.0, "body": 0.0}
GOOD_NAME = 15.0
PARAGRAPHS = set("p pre li dd dt td th blockquote figcaption summary address caption center".split())
#: Blocks that are containers of nothing but a table's rows.
ROWS = set("tr thead tbody tfoot".split())
#: Ancestors that get points: shares of the container, the one above, and so on.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: A sibling stays with this share of the best points, or as a paragraph of so many characters.
SIBLING_SHARE, SIBLING_POINTS, SIBLING_CHARS, SIBLING_LINKS = 0.2, 10.0, 80, 0.25
#: Lists and boxes of at least so many links that are mostly links are menus.
MENU_LINKS, MENU_SHARE = 3, 0.66
MENUS = set("ul ol dl div section table".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAIL = re.compile(r"[^>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،、，]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: What a run is: of the article perhaps, out by class name, in a header, or out.
KEEP, MAYBE, HEAD, OUT = range(4)


class Node:
    """An element: its own state, and that of what is around; sums of its text are worked out later."""

    __slots__ = ("name", "parent", "own", "state", "inline", "block", "good", "main", "article", "kin",
                 "points", "chars", "linked", "links", "runs", "first")

    def __init__(self, name: str, parent: int, own: int, block: int):
        self.name, self.parent, self.own, self.state, self.block = name, parent, own, own, block
        self.inline, self.good, self.main, self.article, self.kin, self.first = KEEP, False, False, False, "", ""


def names_of(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether class names and id tell of noise, of a header, of an article."""
    noise = header = good = False
    bad = NO_ARTICLE if name == "article" else NOISE
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {p.lower() for p in _PART.findall(label)}
        good |= bool(parts & GOOD)
        if not parts & ABOUT:
            noise |= bool(parts & bad)
            header |= bool(parts & HEADER)
    return noise, header, good


class Page:
    """Nodes in page order, and runs (node, text, characters of links) of what is not out."""

    def __init__(self, html: str):
        self.nodes = [Node("", -1, KEEP, 0)]
        self.runs: list[tuple[int, str, int]] = []
        self._stack = [0]
        self._scopes = [(-1, 0, UNBOUNDED)]  # open p, barrier, open list items and cells: places in the stack
        self._open: dict[str, list[int]] = {}
        self._pieces: list[tuple[str, bool]] = []
        self._read(html)
        self._flush()

    # tags

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            mark = html.find("<", at)
            if mark < 0 or mark + 1 >= end:
                self._text(html[at:])
                return
            if mark > at:
                self._text(html[at:mark])
            following = html[mark + 1]
            if following.isascii() and following.isalpha():
                at = self._start(html, mark + 1)
            elif following == "/" and (name := _NAME.match(html, mark + 2)):
                at = html.find(">", name.end())
                if at < 0:
                    return
                at += 1
                self._end(name.group().lower())
            elif html.startswith("<!--", mark):
                if html.startswith(">", mark + 4) or html.startswith("->", mark + 4):
                    at = html.index(">", mark) + 1
                else:
                    at = html.find("-->", mark + 4)
                    if at < 0:
                        return
                    at += 3
            elif following in "!?/":
                at = html.find(">", mark)
                if at < 0:
                    return
                at += 1
            else:
                self._text("<")
                at = mark + 1

    def _start(self, html: str, at: int) -> int:
        found = _NAME.match(html, at)
        name, at, attributes = found.group().lower(), found.end(), {}
        while (a := _ATTRIBUTE.match(html, at)):
            attributes.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
            at = a.end()
        at = _TAIL.match(html, at).end()
        if at >= len(html):  # cut within the tag
            return at
        self._open_tag(name, attributes)
        at += 1
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            return close.start() if close else len(html)
        return at

    # tree

    def _open_tag(self, name: str, attributes: dict[str, str]) -> None:
        if name in ("html", "body") and self._open.get(name):
            return
        if name == "br":
            self._text(" ")
            return
        block = name in BLOCK
        if block:
            self._flush()
        if name in ENDS_PARAGRAPH and (p := self._scopes[-1][0]) >= 0:
            self._pop(p)
        if name in HEADINGS and self.nodes[self._stack[-1]].name in HEADINGS:
            self._pop(len(self._stack) - 1)
        if (kind := IMPLIED.get(name)) and (place := self._scopes[-1][2][kind]) >= 0:
            self._pop(place)
        if name in VOID:
            return
        if name == "a" and (places := self._open.get("a")) and self._inner(places[-1]):
            self._pop(places[-1])
        parent = self.nodes[self._stack[-1]]
        noise, header, good = names_of(name, attributes) if "class" in attributes or "id" in attributes else (False, False, False)
        role = attributes.get("role", "").lower()
        own = KEEP
        if name in NEVER or role in NEVER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or (
                "style" in attributes and _UNSEEN.search(attributes["style"])):
            own = OUT
        elif name == "header" or header and name not in HEADINGS:
            own = HEAD
        elif (noise and name not in ("html", "body", "main")) or name == "form":
            own = MAYBE
        index = len(self.nodes)
        node = Node(name, self._stack[-1], own, index if block else parent.block)
        node.state = OUT if parent.state == OUT else own
        node.inline = KEEP if block else max(own, parent.inline)
        node.main = name == "article" and own == KEEP or attributes.get("itemprop") == "articleBody"
        node.article = node.main or parent.article
        node.main |= name == "main" or role == "main"
        node.good, node.kin = good, f"{name} {attributes.get('class', '')}"
        self.nodes.append(node)
        place = len(self._stack)
        p, barrier, kinds = self._scopes[-1]
        if name in BARRIER:
            p, barrier = -1, place
        elif name == "p":
            p = place
        if kind or name in BOUNDS:
            kinds = dict(kinds)
            for bounded in BOUNDS.get(name, ()):
                kinds[bounded] = -1
            if kind:
                kinds[kind] = place
        self._stack.append(index)
        self._scopes.append((p, barrier, kinds))
        self._open.setdefault(name, []).append(place)

    def _inner(self, place: int) -> bool:
        """Whether an open element lies within the innermost block."""
        return self._stack[place] > self.nodes[self._stack[-1]].block

    def _end(self, name: str) -> None:
        if name in ("html", "body") or name in VOID:
            return
        places = self._open.get(name)
        if not places:
            return
        place = places[-1]
        if name in BLOCK:
            if place < self._scopes[-1][1] and name not in BARRIER:
                return
            self._flush()
        elif not self._inner(place):
            return
        self._pop(place)

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            self._open[self.nodes[self._stack.pop()].name].pop()
            self._scopes.pop()

    # text

    def _text(self, text: str) -> None:
        top = self.nodes[self._stack[-1]]
        if top.state != OUT and top.inline == KEEP:
            self._pieces.append((unescape(text) if "&" in text else text, bool(self._open.get("a"))))

    def _flush(self) -> None:
        words = "".join(t for t, _ in self._pieces).split()
        if words:
            linked = sum(len(" ".join(t.split())) for t, link in self._pieces if link)
            self.runs.append((self.nodes[self._stack[-1]].block, " ".join(words), linked))
        self._pieces.clear()


def _menus(nodes: list[Node]) -> set[int]:
    """Lists and boxes that are mostly links."""
    return {i for i, n in enumerate(nodes) if n.name in MENUS and not n.main and n.links >= MENU_LINKS and _density(n) > MENU_SHARE}


def _gather(page: Page, allowed: set[int], without: set[int] = frozenset()) -> list[tuple[int, str, int]]:
    """Runs that count, in a page whose nodes get their sums from them: those of allowed states, but none in ``without``."""
    nodes = page.nodes
    left_out = _inside(nodes, without)
    for node in nodes:
        node.points, node.chars, node.linked, node.runs, node.first = 0.0, 0, 0, 0, ""
        node.links = int(node.name == "a" and node.state in allowed)
    runs = [r for r in page.runs if nodes[r[0]].state in allowed and not left_out[r[0]]]
    for at, text, linked in runs:
        node = nodes[at]
        node.chars += len(text)
        node.linked += min(linked, len(text))
        node.runs += 1
        if not node.first:
            node.first = text
        if node.name in HEADINGS:
            continue
        points = min(len(text), 100) / 100 + len(_COMMA.findall(text)) + min(len(text) // 100, 3)
        at = node.parent if node.name in PARAGRAPHS else at
        for share in SHARES:
            while at > 0 and (nodes[at].name not in BLOCK or nodes[at].name in ROWS):
                at = nodes[at].parent
            if at < 0:
                break
            nodes[at].points += points * share
            at = nodes[at].parent
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[i].parent]
        up.chars += nodes[i].chars
        up.linked += nodes[i].linked
        up.links += nodes[i].links
        up.runs += nodes[i].runs
    return runs


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(node: Node) -> float:
    own = POINTS.get(node.name, 0.0) + (GOOD_NAME if node.good else 0.0) + (POINTS["article"] if node.main and node.name != "article" else 0.0)
    return (node.points + own) * (1 - _density(node)) if node.points else 0.0


def _inside(nodes: list[Node], roots: set[int]) -> list[bool]:
    """Whether each node lies in one of ``roots``; parents stand before their children."""
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i in roots or node.parent >= 0 and inside[node.parent]
    return inside


def _settle(page: Page) -> None:
    """The state of every node within what is around it.

    Boxes that a heading names as comments count as named so. If all that is marked as an article lies in boxes with names
    of noise, the boxes around the first are none. Of a header within an article, headings stay.
    """
    nodes = page.nodes
    for at, text, _ in page.runs:
        if nodes[at].name in HEADINGS and COMMENT_TITLE.fullmatch(text):
            box = nodes[nodes[at].parent]
            if box.name in ("div", "section", "ul", "ol") and not box.main and not box.good:
                box.own = max(box.own, MAYBE)
    chief, freed = [], False
    for node in nodes[1:]:
        up = nodes[node.parent].state
        node.state = max(node.own, up) if {node.own, up} != {HEAD, MAYBE} else OUT
        if up == HEAD and node.own == KEEP and node.article and node.name in HEADINGS:
            node.state = KEEP
        if node.main:
            chief.append(node)
    if chief and all(n.state == MAYBE for n in chief):
        node, freed = chief[0], True
        while node.parent >= 0:
            node.own = KEEP if node.own == MAYBE else node.own
            node = nodes[node.parent]
    if freed:
        _settle(page)


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by line ends; each has single spaces only."""
    page = Page(html or "")
    _settle(page)
    for allowed in ({KEEP}, {KEEP, MAYBE}):
        runs = whole = _gather(page, allowed)
        if menus := _menus(page.nodes):
            runs = _gather(page, allowed, menus)
        if any(page.nodes[r[0]].name not in HEADINGS for r in runs):
            break
    else:
        runs = _gather(page, allowed) if whole else runs
    if not runs:
        return ""
    nodes = page.nodes
    best = max(range(len(nodes)), key=lambda i: (_score(nodes[i]), -i) if nodes[i].name in BLOCK or not i else (-1.0, 0))
    up = best
    while up > 0:
        if nodes[up].name == "article" and nodes[up].main:
            best = up
            break
        up = nodes[up].parent
    roots = {best}
    parent = nodes[best].parent
    if parent >= 0:
        siblings = [i for i in range(1, len(nodes)) if nodes[i].parent == parent and nodes[i].runs]
        least = max(SIBLING_POINTS, SIBLING_SHARE * nodes[best].points)
        for i in siblings:
            node = nodes[i]
            if node.name in HEADINGS:
                continue
            kin = node.kin == nodes[best].kin and " " in node.kin.strip()
            if nodes[best].name != "article":
                enough = node.points * (1 - _density(node)) + (SIBLING_SHARE * nodes[best].points if kin else 0) >= least
                long = node.chars > SIBLING_CHARS and _density(node) < SIBLING_LINKS
                if enough or node.name == "p" and (long or not node.linked and node.first.endswith((".", "!", "?"))):
                    roots.add(i)
        for i, following in zip(siblings, [*siblings[1:], -1], strict=True):
            if nodes[i].name in HEADINGS and following in roots:
                roots.add(i)
    inside = _inside(nodes, roots)
    return "\n".join(text for at, text, _ in runs if inside[at])


#: Characters of pages that are turned to text before a batch is handed on.
BATCH_CHARS = 4 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, pages = batch.column("row"), batch.column("html")
        start, texts, size = 0, [], 0
        for i in range(len(pages)):
            html = pages[i].as_py()
            texts.append(main_text(html))
            size += len(html or "")
            if size >= BATCH_CHARS or i + 1 == len(pages):
                yield pa.RecordBatch.from_arrays([rows.slice(start, len(texts)), pa.array(texts, pa.string()),
                                                  pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])
                start, texts, size = i + 1, [], 0


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, text, n_chars) of every page; ``row`` has all columns but ``html``."""
    rest = pages.drop(html)
    both = packed(pages, html=F.col(f"`{html}`").cast("string"))
    slim = both.select(F.struct(*[F.col(f"row.`{c}`").alias(c) for c in rest.columns]).alias("row"), "html")
    return slim.mapInArrow(_texts, schema_with(slim.select("row"), ("text", T.StringType()), ("n_chars", T.LongType())))
