"""Main text of web pages by wrapper induction over all pages of a host.

Pages become trees, and trees become blocks of text with the path of tags that leads to them.
A block is constant if its path and text stand on most of the host's different pages: it belongs
to the template, inside the article too. The others are slots that vary. The element that holds
``HELD`` of a host's varying text outside links, counted over all its pages, is where its content
is; the path of that element has classes, but no positions, so it is found on every page.

Markup breaks ties. Within that element, an article or main part is read alone if the page marks
one; elements and classes of menus, headers, footers, sidebars, notices, adverts, forms and
comments below it are dropped, as are blocks that consist of links, unless they are prose of a
marked part. Prose of a marked part is constant only on ``SURE`` pages or more, as a few articles
may share a sentence. If the element lies in such a dropped part while other text varies too, the
other text decides. A page of which nothing would be left, or of a host without a second page, is
read by its markup alone, as is one of less than ``SURE`` pages that share ``SAME_ARTICLE`` of it.

Pages of equal content count once. Counts are per host and block, or per host and path, and
partial before each shuffle, so a host with a third of all pages sends one row per task for each
block of its template. Pages meet the template of their host in a join that can be split.

Defined cases: null or empty html gives an empty text; a null or unreadable url is a host of
its own; unclosed and misplaced tags are read as browsers do in the common cases; trees deeper
than ``DEEPEST`` are flattened there. Repeated pages are each extracted. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.session import settle

MOST = 0.5
SURE = 5
HELD = 0.8
SAME_ARTICLE = 0.8
DEEPEST = 200
# Fixed tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object svg canvas nav footer aside form button select textarea "
    "input label fieldset dialog menu datalist audio video map".split()
)
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video map".split())
BLOCKS = frozenset(
    "html body p div section article main header footer aside nav h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address hr form fieldset details summary".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
# An open element that the start of another one ends, and where the search for it stops.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
}
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s small span strike strong sub sup tt u var".split())
# Words in class, id and role that mark what is no article.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription share sharing social comment comments respond replies disqus related recommended widget login signup "
    "search form pagination pager toolbar copyright complementary contentinfo".split()
)
CONTENT_MARKS = frozenset("article main content post entry story body".split())
SPACE = re.compile(r"[\s ]+")
NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "kids", "text", "dropped", "main", "name")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.kids, self.text, self.dropped, self.main = tag, [], None, tag in DROPPED, tag in ("article", "main")
        self.name = tag
        for key, value in attrs:
            if key in ("class", "id", "role") and value and tag not in ("html", "body"):
                names = set(NAME.findall(value.lower()))
                if key == "class":
                    self.name = ".".join([tag, *sorted(names)])
                if key == "role" and "main" in names:
                    self.main = True
                if names & MARKS and not (self.main or tag == "body" or (tag in ("div", "section", "header") and names & CONTENT_MARKS and not names & {"comment", "comments", "ad", "ads", "sidebar"})):
                    self.dropped = True


class Reader(HTMLParser):
    """Builds the tree; text nodes are children with the tag ''."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_upto({"p"}, {"li", "td", "th", "dd", "div", "article", "section", "blockquote", "body"})
        if tag in ENDS:
            self.close_upto(*ENDS[tag])
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("script", "style"):
            self.open.pop()

    def close_upto(self, tags, stops):
        """Close the nearest open element of ``tags`` if nothing but inline or such elements lies above it."""
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                last = i
            elif tag in stops or tag not in INLINE:
                break
        if last is not None:
            del self.open[last:]

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag in INLINE and self.open[i].tag in BLOCKS:
                return

    def handle_data(self, data):
        node = Node("")
        node.text = data
        self.open[-1].kids.append(node)


def parse(html: str) -> Node:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def plain(text: str) -> str:
    return SPACE.sub(" ", text).strip()


class Block:
    """Text of a block: its key on the host, the path of its container, and what markup says of it.

    ``low`` is the depth of the deepest dropped element around it, 0 without one.
    """

    __slots__ = ("text", "key", "path", "main", "prose", "hidden", "low", "link")

    def __init__(self, text, tags, path, main, prose, hidden, low, link):
        self.text, self.path, self.main, self.prose, self.hidden, self.low, self.link = text, path, main, prose, hidden, low, link
        digest = hashlib.blake2b(f"{'/'.join(tags)} {text}".encode("utf-8", "replace"), digest_size=8).digest()
        self.key = int.from_bytes(digest, "big", signed=True)


def blocks(root: Node) -> list[Block]:
    """Blocks in page order. A path ends above the first prose element; a marked part and a dropped one show in its names."""
    out, parts, links = [], [], 0

    def flush(state):
        nonlocal links
        text = plain("".join(parts))
        if text:
            tags, path, main, prose, hidden, low, _ = state
            out.append(Block(text, tags, path, main, prose, hidden, low, links))
        parts.clear()
        links = 0

    start = ((), (), False, False, False, 0, False)
    todo = [("in", root, start)]
    while todo:
        step, node, state = todo.pop()
        if step == "out":
            flush(state)
            continue
        tags, path, main, prose, hidden, low, link = state
        if node.text is not None:
            parts.append(node.text)
            links += len(node.text.strip()) if link else 0
            continue
        if node.tag == "br":
            parts.append(" ")
            continue
        dropped = node.dropped or (node.tag == "header" and not main)
        block = node.tag in BLOCKS or node.tag in DROPPED or node.dropped and not low
        if block:
            flush(state)
            tags = (*tags, node.tag)
            inside = prose or node.tag in PROSE
            if not inside:
                path = (*path, node.name + "*" * node.main + "!" * dropped)
            low = len(path) + inside if dropped else low
        elif dropped:
            low = len(path) + 1
        inner = (
            tags, path, main or node.main, node.tag in PROSE or prose and node.tag not in ("div", "section", "aside"),
            hidden or node.tag in HIDDEN, low, link or node.tag == "a",
        )
        if block:
            todo.append(("out", node, inner))
        for kid in reversed(node.kids):
            todo.append(("in", kid, inner))
    flush(start)
    return out


def by_markup(found: list[Block], constant: set[int]) -> list[Block]:
    """What the markup calls main text; without a marked part, what is neither constant nor links."""
    seen = [b for b in found if not b.hidden and not b.low]
    marked = [b for b in seen if b.main]
    return marked or [b for b in seen if b.key not in constant and b.link <= 0.5 * len(b.text)]


def main_text(found: list[Block], pages: int, shared: dict[int, int], region: str | None) -> str:
    """The page's main text, by what ``pages`` pages of its host share and where they vary.

    ``shared`` has the number of pages of each constant block, ``region`` the path of the element that holds the content.
    """
    if pages < SURE:
        own = by_markup(found, set())
        if sum(len(b.text) for b in own if b.key in shared) >= SAME_ARTICLE * sum(len(b.text) for b in own):
            return "\n".join(b.text for b in own)
    at = tuple(region.split("/")) if region else ()
    here = [b for b in found if not b.hidden and b.path[:len(at)] == at and b.low <= len(at)]
    here = [b for b in here if b.main] or here
    kept = []
    for b in here:
        sure = b.main and b.prose
        if shared.get(b.key, 0) < (SURE if sure else 2) and (sure or b.link <= 0.5 * len(b.text)):
            kept.append(b)
    return "\n".join(b.text for b in kept or by_markup(found, set(shared)))


def templates(rows: DataFrame) -> DataFrame:
    """``host, pages, keys, counts, region``: different pages of a host, its constant blocks, and the path of its content."""

    def run(batches):
        for batch in batches:
            hosts, contents, keys, paths, chars = [], [], [], [], []
            for host, content, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen = {b.key: b for b in blocks(parse(html)) if not b.hidden}
                for key, path, n in [(0, None, 0), *((k, "/".join(b.path), max(0, len(b.text) - b.link)) for k, b in seen.items())]:
                    hosts.append(host)
                    contents.append(content)
                    keys.append(key)
                    paths.append(path)
                    chars.append(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(keys, pa.int64()), pa.array(paths, pa.string()), pa.array(chars, pa.int64()),
            ], ["host", "content", "key", "path", "chars"])

    per_page = rows.filter("html <> ''").select("host", "content", "html").mapInArrow(
        run, "host string, content long, key long, path string, chars long").distinct()
    # a row without path is the page itself
    blocks_of = settle(
        per_page.groupBy("host", "key", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        .groupBy("host", "key").agg(F.sum("n").alias("n"), F.min("path").alias("path"), F.sum("chars").alias("chars")), "page-blocks")
    hosts = blocks_of.filter("path is null").select(F.col("host").alias("h"), F.col("n").alias("pages")).filter("pages > 1")
    known = blocks_of.filter("path is not null").join(hosts, F.col("host") == F.col("h"))
    fixed = (F.col("n") > 1) & (F.col("n") > MOST * F.col("pages"))
    constant = known.filter(fixed).groupBy("host").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("counts"))
    varying = known.filter(~fixed & (F.col("chars") > 0)).groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    names = F.split("path", "/")
    # every element above a block, from the root to the first marked part
    stop = F.array_position(F.transform(names, lambda x: F.contains(x, F.lit("*"))), True)
    deep = F.when(stop > 0, stop).otherwise(F.size(names)).cast("int")
    ups = varying.select("host", "chars", F.contains("path", F.lit("!")).alias("dropped"), F.explode(
        F.transform(F.sequence(F.lit(0), deep), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(names, 1, i), "/").alias("path")))).alias("up"))
    sums = ups.groupBy("host", "up").agg(F.sum("chars").alias("every"), F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("chars"))).alias("plain"))
    total = sums.filter("up.depth = 0").select(F.col("host").alias("h"), F.col("every").alias("of"), F.col("plain").alias("of_plain"))
    sums = sums.join(total, F.col("host") == F.col("h"))
    best = sums.groupBy("host").agg(
        F.max(F.when(F.col("every") >= HELD * F.col("of"), F.col("up"))).alias("a"),
        F.max(F.when((F.col("plain") > 0) & (F.col("plain") >= HELD * F.col("of_plain")), F.col("up"))).alias("b"),
    )
    region = best.select("host", F.when(F.contains("a.path", F.lit("!")), F.coalesce("b.path", "a.path")).otherwise(F.col("a.path")).alias("region"))
    return hosts.withColumnRenamed("h", "host").join(constant, "host", "left").join(region, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("content"))
    known = settle(templates(rows), "templates").withColumnRenamed("host", "h")
    joined = rows.join(known, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "host", "pages", "keys", "counts", "region")

    def run(batches):
        shared: dict[str, dict[int, int]] = {}
        for batch in batches:
            texts = []
            column = {n: batch.column(i) for i, n in enumerate(("page_id", "url", "html", "host", "pages", "keys", "counts", "region"))}
            for i, html in enumerate(column["html"].to_pylist()):
                if not html:
                    texts.append("")
                    continue
                name = column["host"][i].as_py()
                if name not in shared:
                    if len(shared) >= 64:
                        shared.clear()
                    shared[name] = dict(zip(column["keys"][i].as_py() or (), column["counts"][i].as_py() or ()))
                texts.append(main_text(blocks(parse(html)), column["pages"][i].as_py() or 1, shared[name], column["region"][i].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
