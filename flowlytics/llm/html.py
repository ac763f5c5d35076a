"""Main-text extraction from web pages by tree scoring.

The page becomes a tree of its block elements. Paragraphs pass points for their length and commas to their ancestors, fully
to the parent and less with each level; a container's points are discounted by the share of link text in it. The best
container is widened to its parent while most of the other text there is not link text; it and those of its siblings that
are good enough are kept, without menus, headers, footers, sidebars, notices, adverts, forms and comments inside.

Elements that are such by their tag, their role or a whole class name never count. A form, and an element of which only a part
of a class name says so (``with-sidebar``, ``comments-open``), goes unless it holds an article or main element or most of the
page's text. Inside an article only whole class names count, and headings and paragraphs never go by their class.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.llm import texts

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span "
                   "strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup "
                   "munder mover munderover mtable mtr mtd semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SAME_CLOSED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# what is never the main text: elements, roles, and words of class and id
DROPPED = frozenset("nav header footer aside form script style textarea title noscript iframe noembed noframes xmp template button select "
                    "svg menu head fieldset input audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts "
                          "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
                          "overlay newsletter subscribe signup login social share sharing related recommended comment comments commentlist disqus "
                          "respond reply replies pagination pager toolbar".split())
# elements that may be wrapped around a page
WRAPPERS = frozenset(("form", "fieldset"))
# words that go with those above in the class of boilerplate
COMPANIONS = frozenset("posts post articles items item stories content inner wrap wrapper box block section area list links link bar buttons button form site page main "
                       "top bottom left right primary secondary container body meta author text title head header icon icons count".split())
# an id is a name of these and of the words above; one with other words is the slug of a section
PLACE_WORDS = frozenset("site page main top bottom left right primary secondary container wrapper section box bar list area block links buttons form".split())
# classes and ids of inline elements that mean nothing else
INLINE_NAMES = frozenset("ad ads advert advertisement navbar breadcrumb breadcrumbs pagination cookie-notice cookie-banner share-buttons social-share".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_TAGS = frozenset(("html", "body", "main"))
MAIN_TAGS = ("article", "main")
TEXT_TAGS = HEADINGS | {"p"}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_NAME = re.compile(r"[a-z0-9]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMA = re.compile("[,،、，;；]")


KEPT, UNSURE, GONE = range(3)


class Node:
    """A block element: points of its paragraphs, and characters of text and of links inside."""

    __slots__ = ("tag", "parent", "dropped", "unsure", "in_article", "points", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, kind: int):
        self.tag, self.parent = tag, parent
        self.dropped = kind == GONE or parent is not None and parent.dropped
        self.unsure = kind == UNSURE
        self.in_article = tag in MAIN_TAGS or parent is not None and parent.in_article
        self.points = self.chars = self.link_chars = 0.0

    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0

    def score(self) -> float:
        return self.points * (1 - self.density())


def _by_class(tag: str, value: str, in_article: bool) -> int:
    """What the class names say. A name of these words alone, or with companions only, marks boilerplate."""
    sure = unsure = False
    for name in value.split():
        words = _NAME.findall(name)
        if not DROPPED_WORDS.isdisjoint(words):
            sure = sure or all(w in DROPPED_WORDS or w in COMPANIONS for w in words)
            unsure = True
    if in_article:
        if tag in TEXT_TAGS or not sure:
            return KEPT
        names = value.split()
        return GONE if all(w in DROPPED_WORDS or w in COMPANIONS for n in names for w in _NAME.findall(n)) else KEPT
    if tag in MAIN_TAGS and unsure:  # a comment as an article has no other name
        return GONE if all(not DROPPED_WORDS.isdisjoint(_NAME.findall(n)) for n in value.split()) else KEPT
    if sure:
        return GONE if len(value.split()) == 1 or any(n in DROPPED_WORDS for n in value.split()) else UNSURE
    return UNSURE if unsure else KEPT


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in WRAPPERS:
        return GONE if in_article else UNSURE
    if tag in DROPPED:
        return GONE
    if tag in KEPT_TAGS or not attributes.strip():
        return KEPT
    found = KEPT
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role" and value.strip() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value):
            return GONE
        if name in ("class", "id") and tag in INLINE:
            found = max(found, KEPT if INLINE_NAMES.isdisjoint(value.split()) else GONE)
        elif name == "class":
            found = max(found, _by_class(tag, value, in_article))
        elif name == "id" and tag not in HEADINGS:  # an id with other words is the slug of a section
            words = _NAME.findall(value)
            if not DROPPED_WORDS.isdisjoint(words) and all(w in DROPPED_WORDS or w in PLACE_WORDS for w in words):
                found = GONE
    return found


class Page:
    """Builds the tree and its blocks (node, text, link characters) from the marks of a page."""

    def __init__(self, source: str):
        self.nodes = [Node("html", None, KEPT)]
        self.blocks: list[tuple[Node, str, int]] = []
        self.open: list[tuple[str, Node]] = [("html", self.nodes[0])]  # open elements, each with the block element it is in
        self.links = self.inline_drops = 0
        self.names = Counter(["html"])  # of the open elements
        self.text: list[str] = []
        self.link_text: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, length = 0, len(source)
        while at < length:
            m = _MARK.search(source, at)
            self._add(source[at:m.start() if m else length])
            if not m:
                break
            at = m.end()
            end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._add(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
                continue
            if tag in RAW:  # never read, and no end of a block
                close = _RAW_ENDS[tag].search(source, at)
                at = close.end() if close else length
                continue
            self._start(tag, attributes)
        self._flush()

    def _add(self, text: str) -> None:
        if text and not self.inline_drops and not self.open[-1][1].dropped:
            self.text.append(text)
            if self.links:
                self.link_text.append(text)

    def _flush(self) -> None:
        """Ends the block: references decoded, white space in one blank each."""
        if not self.text:
            return
        text = " ".join(html.unescape("".join(self.text)).split())
        if text:
            self.blocks.append((self.open[-1][1], text, len(" ".join(html.unescape("".join(self.link_text)).split())) if self.link_text else 0))
        self.text, self.link_text = [], []

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        around = self.open[-1][1]
        if tag in INLINE:
            if tag not in VOID and not attributes.endswith("/"):
                dropped = _kind(tag, attributes, around.in_article) == GONE
                self._open("!" + tag if dropped else tag, around)
                self.links += tag == "a"
                self.inline_drops += dropped
            return
        self._flush()
        if tag in CLOSES_P:
            self._close("p", ("table", "td", "th", "button"))
        if tag in SAME_CLOSED:
            for same in SAME_CLOSED[tag]:
                self._close(same, FENCE[tag])
        if tag in VOID or tag in ("html", "body") and self.names[tag]:
            return
        parent = self.open[-1][1]
        node = Node(tag, parent, _kind(tag, attributes, parent.in_article))
        self.nodes.append(node)
        self._open(tag, node)

    def _open(self, name: str, node: Node) -> None:
        self.open.append((name, node))
        self.names[name] += 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
        elif tag in INLINE:
            if not self.names[tag] and not self.names["!" + tag]:
                return
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in (tag, "!" + tag):
                    self._forget(self.open.pop(i)[0])
                    break
                if self.open[i][0] not in INLINE and self.open[i][0][0] != "!":
                    break
        elif tag not in ("html", "body"):
            self._flush()
            self._close(tag, ())

    def _close(self, tag: str, fences: tuple[str, ...]) -> None:
        """Closes the innermost open element of that name, and all inside it, unless a fence lies between."""
        if not self.names[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                for gone, _ in self.open[i:]:
                    self._forget(gone)
                del self.open[i:]
                return
            if name in fences:
                return

    def _forget(self, name: str) -> None:
        self.names[name] -= 1
        self.links -= name in ("a", "!a")
        self.inline_drops -= name[0] == "!"

    def settle(self) -> None:
        """Decides on elements that are only perhaps boilerplate, and leaves the blocks that stay."""
        held = dict.fromkeys(map(id, self.nodes), 0)
        mains = dict.fromkeys(map(id, self.nodes), False)
        for node, text, _ in self.blocks:
            held[id(node)] += len(text)
        for n in reversed(self.nodes):  # children come after their parents
            if n.parent is not None:
                held[id(n.parent)] += held[id(n)]
                mains[id(n.parent)] |= not n.dropped and (n.tag in MAIN_TAGS or mains[id(n)])
        half = held[id(self.nodes[0])] / 2
        for n in self.nodes[1:]:
            n.dropped = n.dropped or n.parent.dropped or n.unsure and not mains[id(n)] and held[id(n)] <= half
        self.blocks = [b for b in self.blocks if not b[0].dropped]


def main_text(source: str) -> str:
    """The blocks of the main text, joined by empty lines; empty where a page has none."""
    page = Page(source)
    page.settle()
    if not page.blocks:
        return ""
    for node, text, links in page.blocks:
        node.chars += len(text)
        node.link_chars += links
        points = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - links / len(text))
        # a paragraph's own element holds no other; its points go to the elements around it
        at, level = (node.parent if node.parent is not None and node.tag in ("p", "pre", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") else node), 0
        while at is not None and level < 6:
            at.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at, level = at.parent, level + 1
    for node in reversed(page.nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    best = max((n for n in page.nodes if not n.dropped), key=Node.score)
    least = best.score() / 5
    around = []
    up = best
    while up is not None:
        around.append(up)
        up = up.parent
    article = next((n for tag in MAIN_TAGS for n in around if n.tag == tag), None)
    best, menus = (article, set()) if article else _widened(page, around)
    kept = {id(best)}
    if best.parent is not None:
        for n in page.nodes:
            if n.parent is best.parent and not n.dropped and n is not best and (
                    n.score() >= least or n.tag in TEXT_TAGS and n.chars and n.density() < 0.25):
                kept.add(id(n))
    inside: dict[int, bool] = {}
    for n in page.nodes:
        inside[id(n)] = id(n) not in menus and (id(n) in kept or n.parent is not None and inside[id(n.parent)])
    return "\n\n".join(text for node, text, _ in page.blocks if inside[id(node)])


def _widened(page: Page, around: list[Node]) -> tuple[Node, set[int]]:
    """The first of ``around`` (a container, then what it lies in), or the widest whose further text is mostly not of links.

    Also the menus in it: lists of links right below the containers, but those that a heading or paragraph leads in to.
    """
    children: dict[int, list[Node]] = {}
    for n in page.nodes:
        if n.parent is not None and not n.dropped:
            children.setdefault(id(n.parent), []).append(n)
    best, menus = around[0], _menus(children.get(id(around[0]), []), None)
    for outer in around[1:]:
        rest = outer.chars - best.chars
        linked = sum(n.chars for n in children[id(outer)] if n is not best and n.density() > 0.25)
        if linked > rest / 2:
            break
        menus |= _menus(children[id(outer)], best)
        best = outer
    return best, menus


def _menus(children: list[Node], after: Node | None) -> set[int]:
    """Lists of links among the children, but those led in to by a heading or paragraph that comes ``after`` the main part."""
    found, before, begun = set(), None, after is None
    for n in children:
        if n.tag in ("div", "ul", "ol") and n is not after and n.density() > 0.5 and not (begun and before in TEXT_TAGS):
            found.add(id(n))
        begun = begun or n is after
        before = n.tag if n.chars else before
    return found


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    The whole source is read; a null or empty one, or one without main text, gives an empty text. Repeated rows are
    extracted each; an empty table gives no row. Other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in texts.slices(batches, "html"):
            found = [main_text(r.decode("utf-8", "replace")) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
