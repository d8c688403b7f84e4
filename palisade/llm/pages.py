"""Main text of web pages, by site template removal.

Each page is parsed into a tree whose element subtrees are hashed bottom-up (tag, class and id, texts, children).
Spark counts in how many different articles of a host each hash occurs (pages with the same text are one, so copies of
a page are no template); subtrees that recur in a large share of them are the host's template and are deleted.  What is left of the article (or else of the main element, the body) is its text,
without elements whose tag, role, class or id says menu, header, footer, sidebar, notice, advert, form, comments.

The article's own paragraphs are safe: inside it a subtree goes only if it recurs in nearly all articles of a host, or
in half of them as one of the first or last blocks, where sites put their notices, adverts and sign-ups.  Headings in
its own header are its title and stay.  If the only articles carry marks themselves (class related-post), the largest
counts, unless more text stands beside it.

Defined cases: null or empty html gives an empty text; pages with a null or odd url share no host, so nothing recurs;
pages without an article or main element use the body, and without tags the whole text; unclosed elements end with their
parents; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import lean, settle, table

#: A subtree is template if it is in so many different articles of a host, and in such a share of them: outside the article,
#: inside it, and as one of the EDGE first or last blocks inside it.
LEAST_PAGES, SHARE = 5, 0.3
INNER_PAGES, INNER_SHARE = 10, 0.8
EDGE_PAGES, EDGE_SHARE, EDGE = 3, 0.5, 2
FLUSH = 200_000
#: Template hashes (8 bytes each) of all hosts that may be broadcast.
BROADCAST_HASHES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg object canvas audio video xmp noembed noframes".split())
DROP = RAW | frozenset("head nav header footer aside form button menu dialog title fieldset annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup mover munder munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom menclose".split())
#: Start tags that end an open element of the second set (closest block level only).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table article section div body main".split())
NO_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id attributes that mark what is no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments respond disqus replies related recommended share sharing social skip alert".split()
)
HEADERS = frozenset({("header",), ("site", "header"), ("page", "header"), ("top", "header"), ("main", "header"), ("global", "header")})
OPENING = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([!?])|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)")
ATTR = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("above", "attrs", "children", "hash", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], above: Node | None):
        self.tag, self.attrs, self.above, self.children, self.hash = tag, attrs, above, [], 0


def attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace() or raw == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The root of the page's tree; children are Nodes and decoded texts."""
    root = cur = Node("#root", {}, None)
    i, n = 0, len(page)
    low = None
    held: Counter[str] = Counter()  # open elements by tag

    def up_to(node: Node) -> Node:
        at = cur
        while at is not node:
            held[at.tag] -= 1
            at = at.above
        return node

    while i < n:
        m = OPENING.search(page, i)
        if m is None:
            cur.children.append(entities.unescape(page[i:]))
            break
        if m.start() > i:
            cur.children.append(entities.unescape(page[i : m.start()]))
        i = m.end()
        if m[1]:
            end = page.find("-->", m.start() + 2)
            i = n if end < 0 else end + 3
            continue
        if m[5]:
            end = page.find(">", i)
            i = n if end < 0 else end + 1
            continue
        close, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[6], m[7], m[8])
        tag = tag.lower()
        if close:
            if held[tag]:
                at = cur
                while at.tag != tag:
                    at = at.above
                cur = up_to(at.above)
            elif tag == "br":
                cur.children.append("\n")
            continue
        if tag in NO_P and held["p"]:
            at = cur
            while at.above is not None and at.tag in INLINE:
                at = at.above
            if at.tag == "p":
                cur = up_to(at.above)
        if tag in ENDS and any(held[t] for t in ENDS[tag]):
            at = cur
            while at.above is not None and at.tag not in ENDS[tag] and at.tag not in STOPS:
                at = at.above
            if at.tag in ENDS[tag] and at.above is not None:
                cur = up_to(at.above)
                if tag == "tr" and cur.tag == "tr":
                    cur = up_to(cur.above)
        node = Node(tag, attributes(rest), cur)
        cur.children.append(node)
        if tag in RAW and not rest.endswith("/"):
            if low is None:
                low = page.lower()
                if len(low) != n:  # a letter whose lower case is longer
                    low = re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = low.find("</" + tag, i)
            if end < 0:
                i = n
            else:
                end = page.find(">", end)
                i = n if end < 0 else end + 1
        elif tag not in VOID:
            cur = node
            held[tag] += 1
    return root


def elements(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if type(c) is Node]
    return out


def hash_subtrees(order: list[Node]) -> None:
    """Sets each node's hash; 0 for subtrees without text."""
    for node in reversed(order):
        parts = []
        for c in node.children:
            if type(c) is Node:
                if c.hash:
                    parts.append(str(c.hash))
            elif t := " ".join(c.split()):
                parts.append("=" + t)
        if parts:
            head = f"{node.tag}\x00{node.attrs.get('class', '')}\x00{node.attrs.get('id', '')}"
            node.hash = xxhash.xxh64_intdigest("\x01".join([head, *parts])) - (1 << 63)


def is_boilerplate(node: Node) -> bool:
    if node.tag in DROP:
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "#root"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = tuple(w.lower() for w in TOKEN.findall(name))
        if words in HEADERS or not MARKS.isdisjoint(words):
            return True
    return False


def text_size(node: Node) -> int:
    return sum(len(c) for x in elements(node) for c in x.children if type(c) is str)


def content_root(root: Node) -> tuple[Node, bool]:
    """The article, the main element, or the root; whether one of the first two was found."""
    articles, marked, mains, stack = [], [], [], [root]
    while stack:
        node = stack.pop()
        if node is not root and is_boilerplate(node):
            if node.tag == "article":
                marked.append(node)
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or node.attrs.get("role") == "main":
            mains.append(node)
        stack += [c for c in reversed(node.children) if type(c) is Node]
    if articles:
        return (articles[0] if len(articles) == 1 else max(articles, key=text_size)), True
    top = mains[0] if mains else root
    if marked and len(text_of(best := max(marked, key=text_size), frozenset())) > len(text_of(top, frozenset())):
        return best, True
    return top, bool(mains)


def edges(top: Node) -> list[Node]:
    """The first and last blocks of an article, its title aside; a single block around all others is looked into."""
    while True:
        blocks = [c for c in top.children if type(c) is Node and c.hash and c.tag not in INLINE and not is_boilerplate(c)]
        if len(blocks) != 1 or any(type(c) is str and not c.isspace() for c in top.children):
            break
        top = blocks[0]
    blocks = [c for c in blocks if c.tag != "h1"]
    if len(blocks) < 2:  # the article itself
        return []
    return blocks[:EDGE] + blocks[max(EDGE, len(blocks) - EDGE) :]


def headings(header: Node) -> list[Node]:
    """The outermost headings of an article's header, in order."""
    out, stack = [], [header]
    while stack:
        node = stack.pop()
        if node.tag in HEADINGS:
            out.append(node)
        elif node is header or not is_boilerplate(node):
            stack += [c for c in reversed(node.children) if type(c) is Node]
    return out


def text_of(top: Node, template: frozenset[int], ends: frozenset[int] = frozenset()) -> str:
    at_edge = {id(x) for x in edges(top) if x.hash in ends} if ends else ()
    parts: list[str] = []
    stack: list = [top]
    while stack:
        x = stack.pop()
        if type(x) is str:
            parts.append(x)
            continue
        if x is not top and ((x.hash in template and x.hash) or id(x) in at_edge):
            parts.append(" ")
            continue
        if x is not top and is_boilerplate(x):
            parts.append(" ")
            if x.tag == "header" and top.tag == "article":
                stack += reversed(headings(x))
            continue
        block = x.tag not in INLINE
        if block:
            parts.append(" ")
            stack.append(" ")
        stack += reversed(x.children)
    return " ".join("".join(parts).split())


def main_text(page: str | None, outer: frozenset[int] = frozenset(), inner: frozenset[int] = frozenset(), ends: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    top, found = content_root(root)
    if outer or inner or ends:
        hash_subtrees(elements(root))
    return text_of(top, inner, ends) if found else text_of(top, outer)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_subtrees(pages: DataFrame) -> DataFrame:
    """(host, outer, inner, ends): hashes of the subtrees that recur in the articles of each host."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], bool] = {}

        def out() -> pa.RecordBatch:
            keys = list(seen)
            cols = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2)), pa.array(list(seen.values()), pa.bool_())]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, ["host", "article", "hash", "edge"])

        for b in batches:
            for h, page in zip(b["host"].to_pylist(), b["html"], strict=True):
                root = parse(page.as_py() or "")
                order = elements(root)
                hash_subtrees(order)
                top, found = content_root(root)
                article = xxhash.xxh64_intdigest(text_of(top, frozenset())) - (1 << 63)
                at_edge = {x.hash for x in edges(top)} if found else ()
                seen[h, article, 0] = False  # all articles of the host
                for x in {node.hash for node in order if node.hash}:
                    seen[h, article, x] = seen.get((h, article, x), False) or x in at_edge
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    hosts = pages.select(host(F.col("url")).alias("host"), "html").where(F.col("host") != "")
    once = hosts.mapInArrow(run, "host string, article long, hash long, edge boolean").groupBy("host", "article", "hash").agg(F.max("edge").alias("edge"))
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("long")).alias("at_edge"))
    counts = settle(counts.where(F.col("n") >= min(LEAST_PAGES, EDGE_PAGES)))
    totals = counts.where(F.col("hash") == 0).select("host", F.col("n").alias("pages"))
    # A host keeps at most its pages' mean number of elements over SHARE, however many pages it has.
    often = counts.where(F.col("hash") != 0).join(totals, "host").where(F.col("n") >= min(SHARE, EDGE_SHARE) * F.col("pages"))

    def taken(n: str, least: int, share: float) -> Column:
        return F.collect_list(F.when((F.col(n) >= least) & (F.col(n) >= share * F.col("pages")), F.col("hash")))

    return often.groupBy("host").agg(taken("n", LEAST_PAGES, SHARE).alias("outer"), taken("n", INNER_PAGES, INNER_SHARE).alias("inner"), taken("at_edge", EDGE_PAGES, EDGE_SHARE).alias("ends"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    known = settle(template_subtrees(pages))
    held = known.agg(F.sum(F.size("outer") + F.size("inner") + F.size("ends") + 8)).first()[0] or 0
    # A small table goes to the pages, which then need no shuffle; a large one meets them by host, hot hosts split by AQE.
    known = F.broadcast(known) if held <= BROADCAST_HASHES else known
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "outer", "inner", "ends")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                main_text(p.as_py(), *(frozenset(x.as_py() or ()) for x in known)) for p, *known in zip(b["html"], b["outer"], b["inner"], b["ends"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
