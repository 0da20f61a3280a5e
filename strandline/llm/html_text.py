"""Main text of web pages by removal of site templates.

Pages are parsed into element trees. Every block subtree is hashed in two forms:
exactly, and by its shape (tags and classes, texts masked, equal neighbours
once), since menus and footers keep their shape where their words vary. Spark
counts in how many different pages of a host each hash occurs; subtrees that
recur are the site's template and are deleted, however many other pages the host
has (a section's notice is on few of a large host's pages). Shapes count outside
of articles only, and where no element marks the article for subtrees that are
mostly links. On hosts with enough pages the counts alone decide; what they
cannot show where a host has few follows from element names, roles and class
names. Running text inside an
article (paragraphs, headings, quotations) is never taken for template, so that
passages which articles share stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialise

#: A subtree is template if it occurs in this many different pages of its host at least.
MANY = 3
#: Different pages of a host from which on counts alone decide what is template; and what stands for a host among its subtrees, whose hashes are odd.
ENOUGH, HOST = 8, 0
#: Template hashes that are sent to every executor (8 MB), the most frequent ones; the others are joined, equal pages in parts of so many copies.
SENT_HASHES, COPIES = 1_000_000, 1024

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_SHAPE = 0x5AFE5AFE5AFE5AFE
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no text to read, and those that surround an article.
UNREAD = frozenset("script style noscript template textarea title head button select option input label fieldset iframe noembed noframes object embed svg canvas audio video map".split())
DROPPED = UNREAD | frozenset("nav footer aside form dialog menu search".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
#: Words in class and id names of what surrounds an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead footer foot comment comments commentlist disqus respond replies reply discussion feedback related recommended recommendations share sharing social newsletter subscribe subscription signup login pagination pager widget widgets toolbar skip hidden paywall disclaimer toc outbrain taboola".split()
)
#: With one of these a class names a layout; after a word of NAMES these name a part of it.
LAYOUT = frozenset("with without no has".split())
PARTS = frozenset(
    "top bottom left right primary secondary main links link items item list lists icons icon posts post stories story articles article bar box section area wrap wrapper container block panel form inner holder unit slot row col column grid group title header heading text message button buttons count body content meta author thread zone space label".split()
)
#: Words that name their surroundings wherever they stand in a class.
STRONG = frozenset("ad ads advert adverts advertisement comment comments commentlist sponsored".split())
#: What an opening element closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_SCOPE = frozenset("td th table caption object button html body".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "hash", "shape", "chars", "linked", "inside", "dropped")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items, self.dropped = tag, attrs, parent, [], False
        self.hash, self.shape, self.chars, self.linked, self.inside = 0, 0, 0, 0, False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t\r") else {}


class Stack:
    """Open elements, with the places of each tag, so that no search walks down."""

    BARRIERS = ("td", "th", "article", "body", "main")

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            i = len(self.nodes) - 1
            own = self.at[self.nodes.pop().tag]
            if own and own[-1] == i:  # else it was closed out of turn
                own.pop()
            if self.blocks and self.blocks[-1] == i:
                self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tag: str) -> None:
        i = self.last((tag,))
        if not i or (tag not in BLOCK and self.last(self.BARRIERS) > i):
            return
        if tag in BLOCK or not self.blocks or self.blocks[-1] <= i:
            self.cut(i)
        else:
            self.at[tag].pop()  # blocks inside stay open, this one is never found again

    def open(self, tag: str) -> None:
        """Close what an opening element closes."""
        if tag in BLOCK:
            i = self.last(("p",))
            if i > self.last(_SCOPE):
                self.cut(i)
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            i = self.last(closed)
            if i > self.last(stop):
                self.cut(i)
        if tag in HEADINGS and self.nodes[-1].tag in HEADINGS:
            self.cut(len(self.nodes) - 1)


def parse(page: str) -> list[Node]:
    """The elements of a page in document order, the root first; texts are items of their elements. Linear in the page."""
    root = Node("#root", {}, None)
    nodes, stack, at = [root], Stack(root), 0

    def text(s: str) -> None:
        if s:
            stack.nodes[-1].items.append(html.unescape(s) if "&" in s else s)

    for_end = {}
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return nodes
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            stack.nodes[-1].items.append(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            stack.close(tag)
            continue
        stack.open(tag)
        node = Node(tag, _attributes(m["attrs"] or ""), stack.nodes[-1])
        stack.nodes[-1].items.append(node)
        nodes.append(node)
        if tag in RAW:
            if tag not in for_end:
                for_end[tag] = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
            e = for_end[tag].search(page, at)
            at = e.end() if e else len(page)
        elif tag not in VOID and not (m["attrs"] or "").endswith("/") or tag in BLOCK and tag not in VOID:
            stack.push(node)


@lru_cache(4096)
def _names_surroundings(name: str, running: bool) -> bool:
    """Whether a class or id names what surrounds an article; of running text only if it names nothing else."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    if not words or LAYOUT.intersection(words):
        return False
    if running:
        return all(w in NAMES for w in words)
    if words[-1] in NAMES or STRONG.intersection(words):
        return True
    return words[0] in NAMES and all(w in NAMES or w in PARTS for w in words[1:])


def _named(node: Node) -> bool:
    running = node.tag in RUNNING
    return any(_names_surroundings(name, running) for name in [*node.attrs.get("class", "").split(), node.attrs.get("id", "")])


def surrounds(node: Node, article: bool, guess: bool = True) -> bool:
    """Whether an element by itself is no main text; with ``guess`` its class and id say so too."""
    a = node.attrs
    if node.tag in DROPPED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag == "header" and not article:
        return True
    style = a.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style or (guess and node.tag not in ("html", "body", "main") and bool(a) and _named(node))


def _is_article(n: Node) -> bool:
    return n.tag == "article" or n.attrs.get("role") == "article"


def _is_main(n: Node) -> bool:
    return n.tag == "main" or n.attrs.get("role") == "main"


def regions(nodes: list[Node], guess: bool = True) -> tuple[list[Node], bool]:
    """Where the main text is, and whether articles or a main element mark it; elements outside main text are marked as dropped."""
    for n in nodes:
        up = n.parent
        article = up is not None and up.inside
        n.dropped = up is not None and (up.dropped or surrounds(n, article, guess))
        n.inside = article or _is_article(n) or _is_main(n)
    for test in (_is_article, _is_main):
        under: set[int] = set()
        top = []
        for n in nodes:
            if n.parent is not None and id(n.parent) in under:
                under.add(id(n))
            elif not n.dropped and test(n):
                under.add(id(n))
                top.append(n)
        if top:
            return top, True
    return nodes[:1], False


def _own(s: str) -> str:
    return " ".join(s.split())


def hash_subtrees(nodes: list[Node]) -> None:
    """Hashes of tag, texts and child subtrees, children first, and of shapes; contents of scripts, styles and comments do not count."""
    for n in reversed(nodes):
        if n.tag in ("script", "style"):
            continue
        exact = xxhash.xxh64(n.tag)
        shape = xxhash.xxh64(n.tag + "\x02" + _DIGITS.sub("", n.attrs.get("class", "")))
        last = None
        for x in n.items:
            if isinstance(x, str):
                x = _own(x)
                if x:
                    exact.update("\x01" + x)
                    n.chars += len(x)
                mask = b"\x01" if x else last
            else:
                if x.hash:
                    exact.update(x.hash.to_bytes(8, "little"))
                n.chars += x.chars
                n.linked += x.linked
                mask = x.shape.to_bytes(8, "little") if x.shape else last
            if mask is not None and mask != last:  # equal neighbours count once
                shape.update(mask)
                last = mask
        if n.tag == "a":
            n.linked = n.chars
        n.hash, n.shape = exact.intdigest() | 1, (shape.intdigest() ^ _SHAPE) | 1


def _by_shape(n: Node, marked: bool) -> bool:
    """Whether a subtree's shape can tell that it is template: outside of articles, or mostly links."""
    return not n.inside if marked else 2 * n.linked > n.chars > 0


def counted(nodes: list[Node], marked: bool, top: list[Node]) -> Iterator[int]:
    """Hashes of block subtrees that may be template: all but the page's frame, what holds the article, and its running text."""
    frame = {id(nodes[0])}
    for n in top:
        up: Node | None = n
        while up is not None and id(up) not in frame:
            frame.add(id(up))
            up = up.parent
    for n in nodes:
        if n.tag in BLOCK and n.tag not in ("html", "body") and id(n) not in frame and n.hash:
            if not (marked and n.inside and n.tag in RUNNING):
                yield n.hash
            if _by_shape(n, marked):
                yield n.shape


def blocks(top: list[Node], template: Container[int], marked: bool) -> list[str]:
    """Texts of the blocks of the main text, in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        s = _own("".join(now))
        now.clear()
        if s:
            out.append(s)

    def is_template(x: Node) -> bool:
        return (x.hash in template and not (marked and x.inside and x.tag in RUNNING)) or (_by_shape(x, marked) and x.shape in template)

    for start in top:
        todo: list = [(start, False, False)]
        while todo:
            x, closing, header = todo.pop()
            if isinstance(x, str):
                if not header:
                    now.append(x)
                continue
            block = x.tag in BLOCK
            if closing:
                flush()
                continue
            if block:
                flush()
            if x.tag in ("br", "wbr"):
                now.append(" " if x.tag == "br" else "")
                continue
            if x.dropped or (x is not start and block and x.tag not in ("html", "body") and is_template(x)):
                continue
            inner = (header or (x.tag == "header" and marked)) and x.tag not in HEADINGS  # of an article's header, headings only
            if block:
                todo.append((x, True, False))
            todo.extend((y, False, inner) for y in reversed(x.items))
    flush()
    return out


class Known:
    """Hashes of a host's template, among the sorted ``sent`` ones of all hosts and some ``more``."""

    def __init__(self, host_hash: int, sent: np.ndarray, more: Container[int]):
        self.host_hash, self.sent, self.more = host_hash, sent, more

    def __contains__(self, subtree: int) -> bool:
        h = (subtree ^ self.host_hash) - (1 << 63)
        i = int(self.sent.searchsorted(np.int64(h)))
        return (i < len(self.sent) and int(self.sent[i]) == h) or h in self.more


def extract(page: str, template: Container[int], names: bool = True, guess: bool = True) -> str:
    """The main text of a page, given the hashes of its site's template.

    Without ``guess`` classes and ids say nothing: counts decide, and elements
    that mean no main text wherever they stand. Without ``names`` the template
    alone decides: neither elements nor the place of the article say what stays.
    """
    nodes = parse(page)
    top, marked = regions(nodes, guess)
    if template:
        hash_subtrees(nodes)
    if not names:
        top = nodes[:1]
        for n in nodes[1:]:
            n.dropped = n.parent.dropped or n.tag in UNREAD
    return "\n\n".join(blocks(top, template, marked))


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _host_hash(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host(url)) & ~1


def _subtrees(batches) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for a in range(0, len(rb), 256):
            part = rb.slice(a, 256)
            pages, hashes = [], []
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                nodes = parse(page or "")
                hash_subtrees(nodes)
                top, marked = regions(nodes)
                own = _host_hash(url)
                pages.append((nodes[0].hash ^ own) - (1 << 63))
                hashes.append(sorted({(h ^ own) - (1 << 63) for h in (HOST, *counted(nodes, marked, top))}))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["key", "page", "hashes"])


def _extract(sent):
    def run(batches):
        for rb in batches:
            for a in range(0, len(rb), 256):
                part = rb.slice(a, 256)
                texts = []
                for url, page, more in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    known = Known(_host_hash(url), sent.value, frozenset(more or ()))
                    texts.append(extract(page or "", known, names=HOST not in known))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def subtrees(pages: DataFrame) -> DataFrame:
    """``(key, page, hashes)`` for every row of ``pages(url, html)``: hashes of the row, of its host and tree, of its host and each countable subtree."""
    return pages.select(F.xxhash64("url", "html").alias("key"), "url", "html").mapInArrow(_subtrees, "key bigint, page bigint, hashes array<bigint>")


def _different(trees: DataFrame) -> DataFrame:
    return trees.groupBy("page").agg(F.first("hashes").alias("hashes")).select("page", F.explode("hashes").alias("hash"))


def templates(trees: DataFrame, many: int = MANY, enough: int = ENOUGH) -> DataFrame:
    """``(hash, n)``: the subtrees that recur on a host, and on how many of its different pages; pages with equal trees count as one. A host of ``enough`` pages has a hash of its own, an even one."""
    least = F.when(F.pmod("hash", F.lit(2)) == 0, enough).otherwise(many)
    return _different(trees).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _sent_from(known: DataFrame) -> int:
    """The least power of two so that at most ``SENT_HASHES`` templates are on as many pages."""
    held, least = 0, 62
    for r in known.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count(F.lit(1)).alias("hashes")).orderBy(F.desc("power")).collect():
        held += r.hashes
        if held > SENT_HASHES:
            return 1 << least
        least = r.power
    return 0


def main_text(pages: DataFrame, many: int = MANY, enough: int = ENOUGH) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Subtrees that recur on ``many`` different pages of their host go. On hosts
    of ``enough`` pages that is all that decides; where a host has fewer, so
    that little can recur, names and roles of elements, classes and the place of
    the article decide too.

    A null html counts as empty and gives an empty text; a null or broken url
    belongs to a host of its own name, the empty one. Repeated rows, and rows
    without an id, each get a row; pages with equal trees count as one. Very
    long or deep pages are parsed in time linear in their length, one at a
    time. An empty table gives an empty result; other columns, whatever their
    names, are not read. The text's blocks are separated by a blank line.
    """
    base = pages.select("page_id", "url", "html")
    kind = base.schema["page_id"].dataType.simpleString()
    trees = materialise(subtrees(base), "subtrees")
    known = materialise(templates(trees, many, enough), "templates")
    least = _sent_from(known)
    sent = np.sort(known.where(F.col("n") >= least).select("hash").toPandas()["hash"].to_numpy(np.int64))
    if not least:
        rows = base.withColumn("template", F.lit(None).cast("array<bigint>"))
    else:  # the templates that are left are on few pages each: every page gets its own ones
        found = _different(trees).join(known.where(F.col("n") < least).select("hash"), "hash").groupBy("page").agg(F.collect_list("hash").alias("template"))
        keys = trees.groupBy("key").agg(F.first("page").alias("page"), F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("parts"))
        lists = materialise(keys.join(found, "page").select("key", "parts", "template"), "lists")
        wide = lists.where("parts > 1").select("key", "parts")
        wide = F.broadcast(wide) if wide.count() <= SENT_HASHES else wide
        dealt = base.withColumn("key", F.xxhash64("url", "html")).join(wide, "key", "left")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        rows = dealt.join(lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["key", "part"], "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(_extract(base.sparkSession.sparkContext.broadcast(sent)), f"page_id {kind}, url string, text string, n_chars bigint")
