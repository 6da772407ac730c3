"""Main text of web pages: site templates are found by counting element subtrees per host.

Every element subtree outside an article's text blocks gets a hash of its tags and text. Spark counts on how many
different pages of a host each subtree stands; those that recur are the site's template and are deleted, along with
elements whose tag, role or class says that they are no part of the article.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

# HTML's own vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCK = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements, roles and class words that are no part of an article.
FURNITURE = frozenset("aside button dialog embed footer form head header iframe input menu nav noscript object script select "
                      "style svg template textarea title audio video canvas".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MARKS = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                  "copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
                  "overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing "
                  "sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
COMMENT_MARKS = frozenset(["comment", "comments", "reply", "replies", "respond", "disqus"])
HEADER_MARKS = frozenset(["header", "masthead"])
#: Known compounds: a place or purpose before a mark, and a mark before a word for its box.
PLACES = frozenset("site page main global top bottom left right primary secondary mobile".split())
PLACED = frozenset("ad ads banner breadcrumb breadcrumbs footer header menu nav navbar navigation sidebar toolbar".split())
BOXED = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie cookies consent footer gdpr login menu modal nav "
                  "navbar navigation newsletter notice pagination popup promo recommended reply share sharing sidebar signup social "
                  "sponsored subscribe toolbar widget".split())
BOXES = frozenset("area banner bar block box button buttons container form holder icons inner items links list menu modal notice overlay "
                  "panel popup respond signup slot thread unit wrap wrapper".split())
COMPOUNDS = frozenset(["-".join(pair) for places, words in ((PLACES, PLACED), (BOXED, BOXES)) for pair in ((x, y) for x in places for y in words)]
                      + "adsbygoogle comment-respond nav-links nav-menu recommended-articles recommended-posts related-articles related-content "
                        "related-links related-posts related-stories share-this sharedaddy social-media social-share social-sharing".split())
KEEPS_CLASS = frozenset(["html", "body", "main"])
LINK_LISTS = frozenset("dl menu ol ul".split())
#: Pages of different text that make a subtree template, however large the host is.
RECURRING_PAGES = 5
#: Parts of tables and headings keep their text whatever their class says.
KEEPS_TEXT = HEADINGS | frozenset("dd dt figcaption tbody td tfoot th thead tr".split())
#: Elements that are no furniture where they hold the article or most of the page's text blocks.
WRAPS = frozenset(["form", "header"])
#: Class words that such a wrapper may carry too.
WRAP_MARKS = frozenset("header login masthead menu modal overlay popup widget widgets".split())
#: Recurring boxes with this many times the text of all else on a page make it a near copy.
MOST = 4
#: Parts that the pages with one subtree are dealt to, so that a menu on a third of all pages is many tasks.
SUBTREE_PARTS = 64

_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_-]+")
_NUMBER = re.compile(r"-?\d+(x\d+)?$")


def _names(value: str) -> set[str]:
    """Whole names of a class or id: lower case, parts joined by one hyphen, without a number at the end."""
    return {_NUMBER.sub("", "-".join(p for p in _HUMPS.split(name) if p).lower()) for name in value.split()}


def _header_names(names: set[str]) -> set[str]:
    return {n for n in names if n in HEADER_MARKS or (n in COMPOUNDS and n.rpartition("-")[2] in HEADER_MARKS and n.partition("-")[0] in PLACES)}


class _Node:
    __slots__ = ("tag", "parent", "pieces", "dropped", "hash", "article", "main", "pinned",
                 "pins", "size", "linked", "links", "prose", "box", "menu", "head", "wraps", "own", "edge")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.pieces = tag, parent, []
        self.dropped = self.article = self.main = self.pinned = self.pins = self.box = self.menu = self.head = self.wraps = self.edge = False
        self.hash = self.size = self.linked = self.links = self.prose = self.own = 0


class _Tree(HTMLParser):
    """A tree of block elements; inline elements only count where they are furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = _Node("html", None)
        self.link: _Node | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.at.pieces.append(" ")
            return
        if tag == "a":
            self.link = self.at
            self.at.links += 1
        attrs = {k: v or "" for k, v in attrs}
        marks, shut = self._marks(tag, attrs)
        titles = _header_names(marks)
        if tag in KEEPS_TEXT:
            marks = set()
        dropped = tag in FURNITURE or shut or bool(marks)
        if tag in VOID:
            if tag in BLOCK:
                self.at.pieces.append(None)
            return
        if tag in ("html", "body"):
            return
        if tag not in BLOCK and not dropped:
            return
        if tag in BLOCK:
            self._close(CLOSED_BY_BLOCK, stop=BLOCK - CLOSED_BY_BLOCK)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], stop={"ul", "ol", "dl", "table", "select"})
        node = _Node(tag, self.at)
        node.dropped = dropped
        node.wraps = dropped and not shut and (tag in WRAPS or tag not in FURNITURE) and (marks <= titles or marks <= WRAP_MARKS)
        node.head = dropped and not shut and (tag == "header" or tag not in FURNITURE) and marks <= titles
        node.article = tag == "article" and not dropped
        node.main = (tag == "main" or attrs.get("role", "").lower() == "main") and not dropped
        self.at.pieces.append(node)
        self.at = node

    def _marks(self, tag, attrs) -> tuple[set[str], bool]:
        """(names that mark furniture, whether it is hidden or has such a role). Ids of headings and text blocks are anchors."""
        if tag in KEEPS_CLASS:
            return set(), False
        shut = ("hidden" in attrs or attrs.get("role", "").lower() in ROLES
                or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I)))
        names = _names(attrs.get("class", "") + ("" if tag in TEXT_BLOCK else " " + attrs.get("id", "")))
        return {n for n in names if (n in COMMENT_MARKS if tag == "article" else n in MARKS or n in COMPOUNDS)}, shut

    def _close(self, tags, stop):
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in stop:
                return
            node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.pieces.append(data)
        # a link that is never closed ends with its block
        if self.link is not None and self.link in (self.at, self.at.parent):
            self.at.linked += len("".join(data.split()))


def _parsed(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.top


def _walk(top: _Node) -> list[_Node]:
    """All nodes, parents first; no recursion, so deep nesting is fine."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in reversed(node.pieces) if isinstance(p, _Node))
    return out


def _hashed(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        digest = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for piece in node.pieces:
            if isinstance(piece, _Node):
                digest.update(b"\x00%d" % piece.hash)
            elif piece and not piece.isspace():
                digest.update(b"\x01" + " ".join(piece.split()).encode("utf-8", "surrogatepass"))
        node.hash = int.from_bytes(digest.digest(), "little", signed=True)


def _weighed(nodes: list[_Node]) -> None:
    """``own``: characters of a node's text blocks outside links and furniture; wrappers of the page's text are no furniture."""
    inside: dict[int, tuple[int, int]] = {}
    holds: set[int] = set()

    def weigh() -> None:
        inside.clear()
        holds.clear()
        for node in reversed(nodes):
            size, linked, node.own = sum(len("".join(p.split())) for p in node.pieces if isinstance(p, str)), node.linked, 0
            for piece in node.pieces:
                if isinstance(piece, _Node):
                    if piece.dropped and not piece.wraps:
                        continue
                    more = inside[id(piece)]
                    size, linked = size + more[0], linked + more[1]
                    node.own += piece.own
                    if id(piece) in holds or (piece.article or piece.main) and piece.own > 0:
                        holds.add(id(node))
            inside[id(node)] = size, linked
            if node.tag in TEXT_BLOCK and node.tag not in HEADINGS:
                node.own = max(0, size - linked)

    weigh()
    total = nodes[0].own
    for node in nodes:
        if node.dropped and node.wraps and node.own and (2 * node.own > total or (node.tag in WRAPS and id(node) in holds)):
            node.dropped = node.head = False
        node.wraps = False
    weigh()


def _roots(nodes: list[_Node]) -> list[_Node]:
    """Where the page's text is: the outermost articles, the outermost main elements, or the whole page.

    Articles count if they hold half of the text blocks of main elements around them and a quarter of the page's, main
    elements if they hold a quarter of the page's. Without text blocks anywhere, the first kind with text counts.
    """
    kinds, size = {}, {}
    for node in reversed(nodes):
        size[id(node)] = sum(len("".join(p.split())) if isinstance(p, str) else 0 if p.dropped else size[id(p)] for p in node.pieces if p)
    for kind in ("article", "main"):
        found, inside = [], set()
        for node in nodes:
            if node.parent is not None and (id(node.parent) in inside or node.parent.dropped):
                inside.add(id(node))
                continue
            if getattr(node, kind):
                found.append(node)
                inside.add(id(node))
        kinds[kind] = found
    weight = (lambda found: sum(n.own for n in found)) if nodes[0].own else (lambda found: sum(size[id(n)] for n in found))
    articles, main, page = weight(kinds["article"]), weight(kinds["main"]), weight(nodes[:1])
    if articles and 2 * articles >= main and 4 * articles >= page:
        return kinds["article"]
    if main and 4 * main >= page:
        return kinds["main"]
    return nodes[:1]


def _spread(nodes: list[_Node], roots: list[_Node]) -> None:
    """Push `dropped` and `pinned` down: furniture below a dropped element goes too, an article's text blocks stay.

    A header inside an article, by tag or by class, loses all but its headings. Text blocks of an article are never template, because
    documents may share passages.
    """
    tops = {id(r) for r in roots if r.article or r.main}
    inside: set[int] = set()
    for node in nodes:
        if id(node) in tops or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
            node.pinned = id(node) in tops or node.tag in TEXT_BLOCK or (node.parent.pinned and node.parent.tag in TEXT_BLOCK)
        if node.parent is not None and node.parent.dropped:
            if node.dropped:
                node.head &= node.parent.head
            else:
                node.dropped = not (node.tag in HEADINGS and node.parent.head and id(node) in inside)
                node.head = node.dropped and node.parent.head


def _measure(nodes: list[_Node]) -> None:
    """Sizes of what is shown (characters without white space), and `box` where a subtree may be template.

    Template may be any subtree without text blocks of an article; a text block outside articles only at the start or the
    end of a page (``edge``), because documents may share passages. A list of links is furniture inside an article too.
    """
    for node in reversed(nodes):
        if node.dropped:
            # only headings are left below a dropped element
            node.linked = node.links = 0
        for piece in node.pieces:
            if isinstance(piece, _Node):
                node.size += piece.size
                node.linked += piece.linked
                node.links += piece.links
                node.prose += piece.prose
                node.pins |= piece.pins
            elif piece and not node.dropped:
                node.size += len("".join(piece.split()))
        if node.dropped:
            continue
        node.pins |= node.pinned and node.size > 0
        if node.tag in LINK_LISTS and node.links > 1 and 10 * node.linked >= 9 * node.size:
            node.pins = False
        if node.tag in TEXT_BLOCK and node.tag not in HEADINGS:
            node.prose = max(0, node.size - node.linked)
        node.menu = node.links > 1 and 3 * node.linked >= 2 * node.size
        node.box = node.parent is not None and node.size > 0 and not node.pins
        node.edge = node.box and not node.menu and (node.tag in TEXT_BLOCK or node.prose > 0)


def _prepared(html: str | None) -> tuple[list[_Node], list[_Node]]:
    nodes = _walk(_parsed(html))
    _hashed(nodes)
    _weighed(nodes)
    roots = _roots(nodes)
    _spread(nodes, roots)
    _measure(nodes)
    return nodes, roots


def page_subtrees(html: str | None) -> tuple[int, list[int]]:
    """(hash of the page's own text, distinct hashes of the subtrees that may be template)."""
    nodes, roots = _prepared(html)
    own = hashlib.blake2b("\n".join(_blocks(roots, frozenset())).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(own.digest(), "little", signed=True), sorted({n.hash for n in nodes if n.box})


def _at_edges(roots: list[_Node], found: list[_Node]) -> list[_Node]:
    """``found`` without recurring text blocks that other text surrounds: those are passages that documents share."""
    if not any(n.edge for n in found):
        return found
    known = {id(n) for n in found}
    order: list[_Node | None] = []  # what is shown in page order: template subtrees, and None for other text
    todo: list = list(reversed(roots))
    while todo:
        piece = todo.pop()
        if isinstance(piece, str):
            if not piece.isspace():
                order.append(None)
        elif piece is not None:
            if id(piece) in known:
                order.append(piece)
            elif not piece.dropped or piece.head:
                todo.extend(reversed(piece.pieces))
    keep: set[int] = set()
    for run in (order, order[::-1]):
        for node in run:
            if node is None:
                break
            keep.add(id(node))
    return [n for n in found if not n.edge or id(n) in keep]


def _template_nodes(roots: list[_Node], template: frozenset[int]) -> set[int]:
    """The outermost boxes of a page that are template.

    Boxes with most of the page's main text are not: then the page is a near copy of others. Main text is what stands in
    text blocks other than headings and in no link, or all text where there is none; beside main text, links are none.
    """
    if not template:
        return set()
    prose = sum(r.prose for r in roots)

    def outermost(may) -> list[_Node]:
        found, todo = [], list(roots)
        while todo:
            node = todo.pop()
            if node.box and node.hash in template and may(node):
                found.append(node)
            else:
                todo.extend(p for p in node.pieces if isinstance(p, _Node))
        return found

    weight = (lambda n: 0 if n.menu else n.prose) if prose else (lambda n: n.size)
    found = _at_edges(roots, outermost(lambda n: True))
    if 2 * sum(map(weight, found)) > (prose or sum(r.size for r in roots)):
        found = _at_edges(roots, outermost(lambda n: not weight(n)))
    gone, shown = sum(n.size for n in found if not n.menu), sum(r.size for r in roots)
    if gone > MOST * (shown - gone):
        found = [n for n in found if n.menu]
    return {id(n) for n in found}


def _blocks(roots: list[_Node], template: frozenset[int]) -> list[str]:
    out: list[str] = []
    text: list[str] = []
    gone = _template_nodes(roots, template)

    def end():
        block = " ".join("".join(text).split())
        if block:
            out.append(block)
        text.clear()

    for root in roots:
        todo: list = [root]
        while todo:
            piece = todo.pop()
            if piece is None:
                end()
            elif isinstance(piece, str):
                text.append(piece)
            elif id(piece) in gone:
                end()
            elif piece.dropped:
                # only headings of an article's header are left below a dropped element
                todo.extend(p for p in reversed(piece.pieces) if isinstance(p, _Node) and (p.head or not p.dropped))
            else:
                end()
                todo.append(None)
                todo.extend(reversed(piece.pieces))
        end()
    return out


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks, one a line, without furniture and without the given template subtrees."""
    return "\n".join(_blocks(_prepared(html)[1], template))


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("row"))


def site_templates(pages: DataFrame, least_pages: int = RECURRING_PAGES) -> DataFrame:
    """(row, template): of every row that has some, the subtree hashes that recur on pages of its host.

    Pages with the same text count once, so copies of an article do not turn it into template. A row gets only hashes
    that stand on its page, so nothing grows with the number of templates of a host.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_subtrees(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["row", "host", "page", "subtrees"])

    seen = _hosts(pages).select("row", "host", "html").mapInArrow(subtrees, "row long, host string, page long, subtrees array<long>")
    seen = materialize(seen.filter(F.size("subtrees") > 0), "subtrees")  # hashes only; counts and hits read them
    part = F.pmod(F.col("page"), F.lit(SUBTREE_PARTS)).cast("int").alias("part")
    stands = (seen.select("row", "host", "page", part, F.explode("subtrees").alias("subtree"))
              .select("row", "page", "part", "subtree", F.xxhash64("host", "subtree").alias("at")))
    # a page's text decides its part, so that the pages counted in the parts add up
    counts = stands.select("at", "part", "page").distinct().groupBy("at", "part").agg(F.count("*").alias("on"))
    recurring = counts.groupBy("at").agg(F.sum("on").alias("on"), F.collect_list("part").alias("parts")).filter(F.col("on") >= least_pages)
    recurring = recurring.select("at", F.explode("parts").alias("part"))
    return stands.select("row", "part", "subtree", "at").join(recurring, ["at", "part"]).groupBy("row").agg(F.collect_set("subtree").alias("template"))


def extracted(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points), host.

    The article (or main element, or else the page) without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles, reader comments and the host's template. Character references are decoded, white space
    in a block is one space, blocks are joined by a line feed in page order. Null and empty html give an empty text;
    a null url is a host of its own name. Repeated rows are extracted one by one; an empty table gives an empty
    result; other columns are not read.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(html, frozenset(template or ())) for html, template in zip(*(batch.column(k).to_pylist() for k in (3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64()), batch.column(2)],
                                             ["page_id", "url", "text", "n_chars", "host"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # rows are keyed one by one, so that neither a host nor a copied page is one task
    joined = _hosts(pages).join(site_templates(pages), "row", "left")
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long, host string")
