"""Main text of web pages, with site templates removed.

Every element's subtree is hashed; Spark counts on how many pages of its host each subtree stands, and subtrees that
recur on many of them are the site's template and are deleted, along with elements that are never part of an article
(menus, footers, forms, scripts and so on). Prose inside the article element is not up for deletion, so a sentence or a
paragraph that many articles share stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_group, slices, written

# HTML element names by their role, and words in class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript iframe xmp noembed noframes head nav footer aside form button select option input template svg canvas object menu dialog label fieldset audio video math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ol ul dl dt dd table tbody thead tfoot tr td th figure figcaption caption hgroup header".split())
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navbar navigation navigationbar menu menus breadcrumb breadcrumbs footer sidebar sidebars cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription comment comments commentlist disqus replies respond contentinfo".split())
WEAK_MARKS = frozenset("share sharing social related recommended recommendations signup popup modal overlay widget widgets toolbar pagination pager login search copyright complementary".split())
OUTER_MARKS = frozenset("header masthead banner topbar".split())
OF_OTHERS = frozenset("has have no non not with without is are hide show allow free less".split())
AROUND = frozenset("area bar block box btn button container div footer header holder inner item items li link links list module outer panel region row section site slot text thread top bottom unit wrap wrapper zone banner".split())

# An end or start tag whose quoted values may hold ">", the same without regard to quotes, and what isn't text or a tag.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.S)
SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
MISREAD = 8  # tags of a page whose quotes may fail to close before quotes count for nothing, so that no text is read again and again
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SHORT, DENSE = 25, 0.5  # signs of a weakly marked element that make it no prose, and share of its text in links that does
LEAST, REST = 200, 0.25  # signs, and share of an element's own, that must be left as prose on the page where its class takes away most


class Node:
    __slots__ = ("tag", "marks", "words", "hidden", "parts", "parent", "depth", "hash", "size", "linked", "prose")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.parts, self.hash, self.size, self.linked, self.prose = tag, parent, [], 0, 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        # what the words of class, id and role name, and all parts of these words
        self.marks: frozenset = frozenset()
        self.words: frozenset = frozenset()
        self.hidden = False
        if attributes:
            whole, words = [], []
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden":
                    self.hidden = True
                elif name == "style":
                    self.hidden |= "display:none" in value.replace(" ", "")
                elif name in ("class", "id", "role"):
                    for token in value.split():
                        parts = [x for x in re.split(r"[_-]+", token) if x]
                        words += parts
                        # "comments", "site-footer" and "ad-box-2" are what they say; "has-sidebar" and "comments-open" say it of something else
                        last = next((x for x in reversed(parts) if x not in AROUND and not x.isdigit()), "")
                        whole += parts if len(parts) == 1 else [last] if OF_OTHERS.isdisjoint(parts) else []
            self.marks, self.words = frozenset(whole), frozenset(words)


class Builder:
    """The tree as it grows: the open elements by tag and the open blocks, so that no tag walks up the whole stack."""

    def __init__(self):
        self.root = self.at = Node("#root", None)
        self.opened: dict[str, list[Node]] = {}
        self.blocks: list[Node] = []

    def nearest(self, tags: str) -> Node | None:
        """The innermost open element of any of these tags."""
        found = [self.opened[t][-1] for t in tags.split() if self.opened.get(t)]
        return max(found, key=lambda x: x.depth) if found else None

    def close(self, node: Node) -> None:
        """Closes node and all open elements in it."""
        while True:
            done = self.at
            self.opened[done.tag].pop()
            if done.tag in BLOCKS:
                self.blocks.pop()
            self.at = _closed(done)
            if done is node:
                return

    def text(self, text: str) -> None:
        if self.at.tag == "head" and text.strip():
            self.close(self.at)
        self.at.parts.append(text)

    def end(self, tag: str) -> None:
        """An end tag: a block's closes what is open in it, any other only what is open in the same block."""
        node = self.nearest(tag)
        if node and (tag in BLOCKS or not self.blocks or node.depth > self.blocks[-1].depth):
            self.close(node)

    def start(self, tag: str, attributes: str) -> Node:
        """A start tag. The end tags that HTML lets one leave out, of head, p, li and the like, are put in before it."""
        if self.opened.get("head") and (tag == "body" or self.at.tag == "head" and tag not in HEAD):
            self.close(self.opened["head"][-1])
        if tag in BLOCKS and self.blocks and self.blocks[-1].tag == "p":
            self.close(self.blocks[-1])
        if tag in CLOSES:
            some, scope = CLOSES[tag]
            node, outer = self.nearest(some), self.nearest(scope)
            if node and (not outer or node.depth > outer.depth):
                self.close(node)
        node = Node(tag, self.at, attributes)
        self.at.parts.append(node)
        if tag in VOID or tag in RAW:
            return node
        self.at = node
        self.opened.setdefault(tag, []).append(node)
        if tag in BLOCKS:
            self.blocks.append(node)
        return node


def parse(page: str) -> Node:
    """The page's tree. Unclosed and wrongly nested elements are closed as a browser would, near enough for text.

    Takes time in proportion to the page: no text is read more than MISREAD times over, and no tag walks the stack of open
    elements but to close them. A tag that the page's end cuts off is dropped, as browsers do.
    """
    tree, place, misread = Builder(), 0, 0
    last = page.rfind(">")
    while place < len(page):
        here = page.find("<", place)
        if here < 0:
            here = len(page)
        if here > place:
            tree.text(page[place:here])
            place = here
            continue
        follows = page[here + 1 : here + 2]
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            place = len(page) if end < 0 else end + 3
            continue
        named = follows.isascii() and follows.isalpha() or follows == "/" and (page[here + 2 : here + 3].isascii() and page[here + 2 : here + 3].isalpha())
        if not named and follows not in ("!", "?", "/"):
            tree.text("<")
            place = here + 1
            continue
        if here > last:  # nothing closes it
            break
        if not named:
            place = page.index(">", here) + 1
            continue
        m = TAG.match(page, here) if misread < MISREAD else None
        if not m:
            misread += 1
            m = SHORT_TAG.match(page, here)
        place, tag = m.end(), m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        node = tree.start(tag, m[3])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, place)
            node.parts.append(page[place : end.start() if end else len(page)])
            close = page.find(">", end.start()) if end else -1
            place = close + 1 if close >= 0 else len(page)
        if tag in VOID or tag in RAW:
            _closed(node)
    if tree.at is not tree.root:
        while tree.at.parent is not tree.root:
            tree.close(tree.at)
        tree.close(tree.at)
    _closed(tree.root)
    return tree.root


def _closed(node: Node) -> Node | None:
    """Hashes the finished subtree: its tag, marks, texts and the hashes of its elements."""
    h = blake2b(node.tag.encode("utf-8", "surrogatepass"), digest_size=8)
    if node.words:
        h.update(" ".join(sorted(node.words)).encode("utf-8", "surrogatepass"))
    for x in node.parts:
        if isinstance(x, str):
            words = x.split()
            h.update(" ".join(["", *words]).encode("utf-8", "surrogatepass"))
            own = sum(map(len, words))
            node.size += own
            node.prose += own
        else:
            h.update(x.hash.to_bytes(8, "little"))
            node.size += x.size
            node.linked += x.linked
            node.prose += x.prose
    if node.tag == "a":
        node.linked = node.size
    if node.tag == "a" or _never(node):
        node.prose = 0
    node.hash = int.from_bytes(h.digest(), "little")
    return node.parent


def _walk(top: Node, skip) -> Iterator[Node]:
    """Elements below top in page order, without those that skip names and what is below them."""
    stack = [iter(top.parts)]
    while stack:
        for x in stack[-1]:
            if not isinstance(x, str) and not skip(x):
                yield x
                stack.append(iter(x.parts))
                break
        else:
            stack.pop()


def _never(x: Node) -> bool:
    return x.tag in DROPPED or x.hidden


def _most(x: Node, page: int) -> bool:
    """Whether the element holds most of the page's prose (text outside links), and next to none would be left without it."""
    return 2 * x.prose > page and page - x.prose < max(LEAST, REST * x.prose)


def _marked(x: Node, template: frozenset[int] | set[int], page: int) -> bool:
    """Whether the element's class, id or role tells that it isn't the article's; page is the page's prose.

    Whole words of MARKS do so, unless the element holds most of the page's prose: then it must recur on the site, too.
    Other words, such as share or widget, and parts of words, as in has-sidebar, stand on prose as well: they count only if
    the element also recurs on the site, is mostly links or has next to no text.
    """
    if not x.marks.isdisjoint(MARKS) and not _most(x, page):
        return True
    weak = not x.words.isdisjoint(WEAK_MARKS) or not x.words.isdisjoint(MARKS)
    return weak and (x.hash in template or x.linked >= DENSE * x.size or x.size < SHORT)


def candidates(root: Node) -> set[int]:
    """Hashes of the subtrees that could be the site's template: all block elements outside the article, and in it
    those that aren't prose or carry a word that may mark what isn't the article."""
    inside: set[int] = set()
    found: set[int] = set()
    for x in _walk(root, _never):
        within = id(x.parent) in inside
        if within or x.tag in ("article", "main"):
            inside.add(id(x))
        if x.tag in BLOCKS and x.tag not in ("html", "body", "article", "main") and x.size and not (within and x.tag in PROSE and x.words.isdisjoint(WEAK_MARKS) and x.words.isdisjoint(MARKS)):
            found.add(x.hash)
    return found


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the article, its blocks joined by line breaks.

    The article is all article elements outside the template (of those in one another the outermost), without those that
    are reader comments; else main, else the body without its template.
    """
    page = root.prose

    def skip(x: Node) -> bool:
        if x.tag in DROPPED or x.hidden:
            return True
        if x.tag in ("html", "body", "main", "article"):
            return x.tag == "article" and not x.words.isdisjoint(("comment", "comments", "reply")) and not _most(x, page)
        return _marked(x, template, page) or x.hash in template and x.tag in BLOCKS and x.size > 0

    def outer(x: Node) -> bool:
        return skip(x) or x.tag == "header" or not x.marks.isdisjoint(OUTER_MARKS) and x.tag not in ("html", "body", "main", "article") and not _most(x, page)

    articles, mains, taken = [], [], set()
    for x in _walk(root, lambda x: id(x.parent) in taken or outer(x)):
        if x.tag == "article":
            articles.append(x)
            taken.add(id(x))
        elif x.tag == "main" or "main" in x.words and x.tag in BLOCKS:
            mains.append(x)
    tops = articles or mains[:1] or [root]
    inner = _in_article(skip, template, page) if articles else outer
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in tops:
        stack = [(top, iter(top.parts))]
        while stack:
            node, parts = stack[-1]
            for x in parts:
                if isinstance(x, str):
                    line.append(html.unescape(x))
                elif x.tag in ("br", "wbr", "img"):
                    line.append(" " if x.tag == "br" else "")
                elif not inner(x):
                    if x.tag in BLOCKS:
                        flush()
                    stack.append((x, iter(x.parts)))
                    break
                elif x.tag in BLOCKS:
                    flush()
            else:
                if node.tag in BLOCKS:
                    flush()
                stack.pop()
        flush()
    return "\n".join(blocks)


def _in_article(skip, template, page: int):
    """Inside an article, prose stays even if it recurs on the site."""

    def inner(x: Node) -> bool:
        return skip(x) and not (x.tag in PROSE and x.hash in template and not x.hidden and x.tag not in DROPPED and not _marked(x, template, page))

    return inner


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _text_key(root: Node) -> int:
    """A page's text as far as the page alone tells it; of longer ones without regard to digits, which counters and dates change."""
    text = main_text(root)
    text = DIGITS.sub("0", text) if len(text) >= LEAST else text
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host_key, page_key, url_key, text_key, hash) of each candidate subtree of each page, and one row with a null hash for
    the page itself. page_key is of the html. Of a host's different pages both the URL and the text (_text_key) differ: copies
    have one text, later captures one URL. Pages without a URL are told apart by their html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[list] = [[], [], [], [], []]
            for host, key, url, page in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                root = parse(page or "")
                text = _text_key(root)
                for h in (None, *candidates(root)):
                    for column, value in zip(out, (host, key, url, text, h if h is None or h < 1 << 63 else h - (1 << 64)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["host_key", "page_key", "url_key", "text_key", "hash"])

    keys = host_key_of(F.col("url")), F.xxhash64("html").alias("page_key"), F.xxhash64(F.coalesce("url", "html")).alias("url_key")
    return pages.select(*keys, "html").mapInArrow(run, "host_key long, page_key long, url_key long, text_key long, hash long")


DIGITS = re.compile(r"\d+")


def host_key_of(url: Column) -> Column:
    return F.xxhash64(host_of(url)).alias("host_key")


def templates(found: DataFrame, min_pages: int = 5, min_share: float = 0.1, many: int = 50) -> DataFrame:
    """(host_key, hash, n, rows): the subtrees of found on at least min_pages of their host's different pages that are on
    min_share of them or, however many pages the host has, on at least `many`; n is the lesser number of different URLs and
    texts, rows are the pages with copies."""
    distinct = lambda key: found.groupBy("host_key", "hash", key).agg(F.count("*").alias("rows")).groupBy("host_key", "hash").agg(F.count("*").alias(f"n_{key}"), F.sum("rows").alias("rows"))
    least = lambda df: df.where(F.col("n") >= min_pages)
    texts = least(distinct("text_key").withColumnRenamed("n_text_key", "n")).withColumnRenamed("n", "n_text")
    urls = least(distinct("url_key").drop("rows").withColumnRenamed("n_url_key", "n")).withColumnRenamed("n", "n_url")
    counted = texts.join(urls, (texts["host_key"] == urls["host_key"]) & texts["hash"].eqNullSafe(urls["hash"])).select(texts["host_key"], texts["hash"], F.least("n_text", "n_url").alias("n"), "rows")
    total = counted.where("hash is null").select("host_key", F.col("n").alias("pages"))
    some = counted.where("hash is not null").join(total, "host_key")
    return some.where((F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= many)).select("host_key", "hash", "n", "rows")


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, many: int = 50, most: int = 2000) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A host's template of up to `most` subtrees goes with each of its pages; of a larger one, a page gets its own
    subtrees only, by a join, so that no row grows with its host. The join of pages with their host's template is a plain
    one of two shuffles where the templates are too large to be broadcast, so Spark splits a hot host's pages.

    Null or empty html gives an empty text; a null url is a host of its own. Rows that repeat a page_id are pages of
    their own. Copies of a page, and captures of it that differ in digits, count as one page, so they don't make its own
    text the site's template. An empty table gives no rows. Other columns are ignored.
    """
    found = written(subtrees(pages), "subtrees")
    known = written(templates(found, min_pages, min_share, many), "templates")
    sizes = known.groupBy("host_key").agg(F.count("*").alias("size"))
    small = known.join(sizes.where(F.col("size") <= most), "host_key").groupBy("host_key").agg(F.sort_array(F.collect_list("hash")).alias("template"))
    small = written(small, "small-templates")  # a small table, which Spark broadcasts if its size allows
    large = written(sizes.where(F.col("size") > most).select("host_key"), "large-hosts")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_key_of(F.col("url")))
    columns = ["page_id", "url", "html", "template"]
    if large.isEmpty():
        return _texts(keyed.join(small, "host_key", "left").select(*columns))
    wide = known.join(large, "host_key", "left_semi")
    total = wide.agg(F.sum("rows")).first()[0]
    met = join_by_group(found.where("hash is not null"), wide, ["host_key", "hash"], "rows", total)
    own = written(met.groupBy("host_key", "page_key").agg(F.collect_set("hash").alias("template")), "page-templates")
    rest = keyed.join(large, "host_key", "left_anti").join(small, "host_key", "left").select(*columns)
    pages_of_large = keyed.join(large, "host_key", "left_semi").withColumn("page_key", F.xxhash64("html"))
    return _texts(rest.unionByName(pages_of_large.join(own, ["host_key", "page_key"], "left").select(*columns)))


def _texts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [main_text(parse(page), frozenset(int(h) & 0xFFFFFFFFFFFFFFFF for h in t or ())) if page else "" for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
