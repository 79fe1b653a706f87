"""Main text of web pages by site template removal.

Each page is parsed to a tree; the subtrees of its block elements are hashed, and Spark counts in how many pages of a
host each hash occurs.  A subtree that at least ``least_pages`` pages and ``share`` of the host's pages have is part of the
site's template and deleted, as are elements that say what they are by tag, by role or by the whole name of a class or id (``SKIP``,
``BOILERPLATE``; a name of several words counts if all of them are listed, or ``NEUTRAL`` beside a listed one).  Where a page
marks its content (article, main), only that is read.  Inside it the template takes only subtrees most of whose text is links:
what many articles of a site quote, list or share is still theirs, and counts alone would delete it (an article that stands
under three addresses would be gone from all).  So on marked pages the marks decide nearly everything, and the counted template what
is around and between; on pages without marks the counted template decides.

Text: character references decoded, each run of white space in a block one space, trimmed, blocks without text left out, joined in
page order by a blank line.  ``br`` is white space.

Defined results: null, empty or tag-only html: empty text.  A null or odd url: the page belongs to the host of no name.
Markup that is cut off or never closed is closed where its parent or the page ends; an unclosed comment, script or tag
runs to the end of the page.  Repeated rows repeat.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, arrow_rows, slices, table

# Names of the HTML standard, and words of class names that pages use for what is no article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SKIP = set("head nav footer aside form menu dialog button input select option svg object canvas audio video map search".split()) | RAW
BOILERPLATE = set("ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar".split())
NEUTRAL = set("site page main top bottom left right list box block bar area section wrapper container content inner outer global primary secondary items item links link posts post articles article icons icon buttons button form panel header js region widget".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

# tags by the rules of HTML: quotes open a value only after the equals sign, and a value without quotes ends at white space
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+)*+"""
TOKEN = re.compile(rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>]*+)))?+""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "raw", "kids", "hash", "linked", "_attrs")

    def __init__(self, tag: str, raw: str):
        self.tag, self.raw, self.kids, self.hash, self.linked, self._attrs = tag, raw, [], None, False, None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in ATTRIBUTE.finditer(self.raw):  # of several of one name the first counts
                self._attrs.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return self._attrs

    def boilerplate(self) -> bool:
        if self.tag in SKIP:
            return True
        if not self.raw or self.tag in ("body", "html", "main"):
            return False
        a = self.attrs
        if a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true" or "hidden" in a:
            return True
        return any(named(token) for k in ("class", "id") for token in a.get(k, "").split())


@lru_cache(100_000)
def named(token: str) -> bool:
    """Whether a class or id says that the element is none of the article."""
    words = [w.lower() for w in NAME.findall(token)]
    return any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in NEUTRAL or w.isdigit() for w in words)


def parse(page: str | None) -> Node:
    root = Node("#root", "")
    stack, at, page = [root], 0, page or ""
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and stack[k].tag != "p":
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in FENCE.get(tag, ()):
                break
        node = Node(tag, (m[3] or "").strip())
        stack[-1].kids.append(node)
        if tag in VOID or node.raw.endswith("/") and tag not in BLOCK | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        stack.append(node)
    return root


def hashed(root: Node) -> list[tuple[Node, bool]]:
    """All block elements with their subtree hashes, children first, and whether the page marks them as content; nodes learn if most of their text is links."""
    out, todo, sizes = [], [(root, False, False)], {}
    while todo:
        node, inside, seen = todo.pop()
        if not seen:
            todo.append((node, inside, True))
            todo += [(k, inside or node.tag in ("article", "main"), False) for k in node.kids if isinstance(k, Node)]
            continue
        h = xxhash.xxh64(f"<{node.tag} {node.attrs.get('class', '')}>")
        some, text, links = False, 0, 0
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "little"))
                some = True
                a, b = sizes.pop(id(k))
                text, links = text + a, links + b
            elif w := " ".join(k.split()):
                h.update(w)
                some = True
                text += len(w)
        node.hash = h.intdigest()
        sizes[id(node)] = text, text if node.tag == "a" else links
        node.linked = 2 * sizes[id(node)][1] > text
        if some and node.tag in BLOCK:
            out.append((node, inside))
    return out


def deletable(node: Node, inside: bool) -> bool:
    """Whether the template may have the node."""
    return node.tag not in ("html", "body", "head", "article", "main") and (node.linked or not inside)


def template_candidates(root: Node) -> set[int]:
    return {n.hash for n, inside in hashed(root) if deletable(n, inside)}


def main_text(root: Node, template: set[int]) -> str:
    """The page's text; hashed(root) has run if template isn't empty."""
    starts, todo = [], [root]
    while todo:  # outermost content elements, in page order
        node = todo.pop()
        if node is not root and node.boilerplate() and node.tag != "header":
            continue
        if node.tag in ("article", "main"):
            starts.append(node)
            continue
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    blocks: list[list[str]] = [[]]

    def read(start: Node, inside: bool) -> None:
        todo: list = [(start, inside, 0)]
        while todo:
            x, inside, end = todo.pop()
            if end:
                blocks.append([])
                continue
            if isinstance(x, str):
                blocks[-1].append(x)
                continue
            if x is not start:
                if x.boilerplate() or x.tag == "header" and not inside:
                    continue
                if x.hash in template and deletable(x, inside):
                    continue
            if x.tag in BLOCK:
                blocks.append([])
                todo.append((x, inside, 1))
            elif x.tag == "br":
                blocks[-1].append(" ")
            deep = inside or x.tag in ("article", "main")
            todo += [(k, deep, 0) for k in reversed(x.kids)]

    for s in starts or [root]:
        read(s, bool(starts))
        blocks.append([])
    # references stand within one piece of text, as markup ends them
    texts = (" ".join("".join(html.unescape(p) for p in b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def host(url: Column) -> Column:
    name = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(name, F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.02) -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(id_col, url_col, F.col(html_col).alias("__html"), host(F.col(url_col)).alias("__host"))
    count_schema = pa.schema([("host", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])

    def count(batches):
        seen: dict[tuple[str, int], int] = {}

        def flush():
            out = arrow_rows(count_schema, host=[k[0] for k in seen], hash=[k[1] - (1 << 64) if k[1] >> 63 else k[1] for k in seen], n=list(seen.values()))
            seen.clear()
            return out

        for batch in batches:
            for part in slices(batch, "__html"):
                for name, page in zip(part.column("__host").to_pylist(), part.column("__html").to_pylist()):
                    for h in template_candidates(parse(page)):
                        seen[name, h] = seen.get((name, h), 0) + 1
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    counted = rows.mapInArrow(count, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pages)
    sizes = rows.groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("pages"))
    # of a host at most (subtrees of a page) / share hashes are in its template
    template = counted.join(sizes, "host").where(F.col("n") >= F.col("pages") * share).select("host", "hash")
    template = scratch.save(template)
    total = template.count()
    per = template.groupBy(F.col("host").alias("__host")).agg(F.collect_list("hash").alias("__template"))
    joined = rows.join(F.broadcast(per) if total <= BROADCAST_KEYS else per, "__host", "left")

    def text(batches):
        for batch in batches:
            for part in slices(batch, "__html"):
                known: dict[str, set[int]] = {}
                texts = []
                for name, page, hashes in zip(part.column("__host").to_pylist(), part.column("__html").to_pylist(), part.column("__template")):
                    if name not in known:
                        known[name] = {h % (1 << 64) for h in hashes.as_py() or ()}
                    root = parse(page)
                    hashed(root)
                    texts.append(main_text(root, known[name]))
                texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), texts, pc.cast(pc.utf8_length(texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([rows.schema[id_col], rows.schema[url_col]]).add("text", StringType()).add("n_chars", LongType())
    return joined.select(id_col, url_col, "__host", "__html", "__template").mapInArrow(text, schema)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
