"""Main text of web pages, with site templates removed by counting element subtrees per host.

Method. A page is read into a tree of its block elements. Every subtree that can be template is hashed with its place,
the names of the elements above it (attributes, and so link targets, left out; outside paragraphs, headings,
cells and items digits are folded, as counters and dates of furniture change); Spark counts, per host, the distinct pages
that hold a hash. A subtree is template, and deleted, where it is on at least `share` of the host's pages and on
`min_pages`; one with paragraphs or headings of its own needs `prose_share` and `prose_pages`, as ordinary prose is
quoted now and then. Headings, cells, items and tables are content wherever they recur: they go with a
whole section or division that recurs, never by themselves; so do paragraphs and lists, but for those right under the body. Inside an article
only elements without any prose can be template: what an article says is never deleted for being said elsewhere.
Elements that are never content (menus, forms, scripts, ...) go by their element or role. By class or id go elements
whose class means nothing else (`_PLAIN`), and outside articles those with a name of furniture (`_OUTSIDE`) that hold no prose:
a section of related work stays. Of what is left, the main
element gives the text if it holds all articles, else all articles outside one another in page order, else the
body: character references decoded, white space inside a block made one space, blocks joined by one newline.

Pages with one and the same text count once, so that copies of a page are not taken for a template.

Scale. Pages are read once, into blocks, each with the hashes of the subtrees that enclose it, and written to the
shared folder; whole pages are never shuffled. Hashes, distinct per page, are counted with partial aggregation; the
template ones meet the pages' hashes in a join on (host, hash, salt), so that a template of a hot host does
not meet in one task; only pages with a block that can be template are shuffled, by row.

Edge cases: null html gives an empty text; broken markup is read as browsers do in the common cases
(unclosed p, li, td; stray end tags; unclosed comments); a null or odd url belongs to the host ""; repeated
rows give repeated results; long and deeply nested pages are read whole, in time that grows with their size;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import common

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption iframe object svg canvas audio video select button noscript template textarea label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_NEVER = frozenset("head nav footer aside form menu dialog iframe object svg canvas audio video select button noscript template textarea label title script style".split())
_SAYING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li ol ul dl figcaption figure table tbody thead tfoot tr td th caption".split())
#: A start tag of the first closes an open element of the second, within the third.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dt dd", ("dl",)), "dt": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th thead tbody", ("table",)), "option": ("option", ("select",))}
_IN_P = frozenset("label button iframe object svg canvas audio video select noscript template textarea".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|dialog|alertdialog|alert|menu|menubar|form)\b""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|sidebar|side|widgets?|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead|comments?|commentlist|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommended|pagination|pager|login|search|skip|toolbar)(?:$|[\s_-])", re.I)
#: Classes that mean nothing else.
_PLAIN = frozenset("ad ads advert advertisement adsbygoogle sponsored social-share newsletter-signup cookie-banner breadcrumb breadcrumbs navbar sidebar pagination comment comments comment-list commentlist disqus_thread".split())
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "candidate", "children", "gone", "hash", "says", "size", "tag", "wraps")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.hash, self.size = tag, attrs, [], 0, 0
        #: Holds prose; holds an article or the main element; can be template; is outside the main text.
        self.says = self.wraps = self.candidate = self.gone = False

    def outside(self, in_article: bool) -> bool:
        """Never a part of the main text; `says` is known."""
        if self.tag in _NEVER:
            return True
        if self.tag == "header":
            return not in_article
        if not self.attrs:
            return False
        role = _ROLE.search(self.attrs)
        if role and not (self.says and role[1].lower() == "alert") or _HIDDEN.search(self.attrs):
            return True
        names = {x for a, b, c in _NAMED.findall(self.attrs) for x in (a or b or c).lower().split()}
        if self.tag not in ("html", "body", "main", *_SAYING) and (names & _PLAIN or not self.says and names & {"share", "sharing"}):
            return True
        if in_article or self.says or self.wraps or self.tag in ("html", "body", "main"):
            return False
        return any(map(_OUTSIDE.search, names))


def parse(text: str) -> Node:
    """The tree of block elements; children are nodes and pieces of text (references not decoded)."""
    root = Node("#", "")
    stack, at, search, is_open = [root], 0, _TOKEN.search, Counter()

    def cut(k):
        is_open.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while True:
        m = search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            return root
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCKS and is_open[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
            elif tag == "p":
                stack[-1].children.append(Node("p", ""))
            continue
        if tag in _VOID:
            stack[-1].children.append(Node("hr", "") if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            if end is None:
                return root
            close = text.find(">", end.start())
            at = close + 1 if close >= 0 else len(text)
            continue
        if tag not in _BLOCKS:
            continue
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in within and any(is_open[x] > 0 for x in closed.split()):
                if stack[k].tag in closed.split():
                    cut(k)
                k -= 1
        elif tag not in _IN_P and is_open["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in ("td", "th", "button", "object"):
                    break
        node = Node(tag, m[3].strip())
        stack[-1].children.append(node)
        if not m[3].endswith("/") or tag not in ("iframe", "svg"):
            stack.append(node)
            is_open[tag] += 1


def _ordered(root: Node) -> list[tuple[Node, bool, int, bool]]:
    """All nodes, parents first, with whether an article is above, a hash of the names above, and whether they are right under the body."""
    import xxhash

    out, todo = [], [(root, False, 0, False)]
    while todo:
        node, inside, place, high = todo.pop()
        out.append((node, inside, place, high))
        inside = inside or node.tag in ("article", "main")
        under = xxhash.xxh3_64_intdigest(f"{place} {node.tag}")
        high = node.tag in ("#", "html", "body")
        todo += [(c, inside, under, high) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _weigh(order) -> None:
    """Hash and text size of every subtree, whether it can be template, and whether it is outside the text."""
    import xxhash

    inner: dict[int, int] = {}
    for node, inside, place, high in reversed(order):
        parts, size = [node.tag], 0
        node.says = node.tag in _SAYING
        #: Where nearly all is a number, and in prose, cells and items, the number is what it says.
        fold = node.tag not in _PROSE and sum(map(str.isalpha, "".join(c for c in node.children if isinstance(c, str)))) >= 8
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"\x01{inner[id(c)]}")
                size += c.size
                node.says |= c.says
                node.wraps |= c.wraps or c.tag in ("article", "main")
            elif c:
                words = " ".join(c.split())
                parts.append(_DIGITS.sub("0", words) if fold else words)
                size += len(words)
        node.size = size
        inner[id(node)] = held = xxhash.xxh3_64_intdigest("\x00".join(parts))
        #: The last bit tells prose.
        node.hash = (xxhash.xxh3_64_intdigest(f"{place} {held}") & ~1 | node.says) - (1 << 63)
        #: An element that only wraps another one goes with it.
        alone = any(isinstance(c, Node) and c.size == size and c.tag not in _PROSE for c in node.children)
        content = node.tag in _PROSE and not (high and node.tag in ("ul", "ol", "p"))
        node.candidate = size > 0 and not alone and not node.wraps and node.tag not in ("#", "html", "body", "article", "main") and not content and not (inside and node.says)
    for node, inside, *_ in order:
        node.gone = node.gone or node.outside(inside)
        if node.gone:
            for c in node.children:
                if isinstance(c, Node):
                    c.gone = True


def blocks(root: Node) -> tuple[list[str], list[list[int]], set[int]]:
    """The main text's blocks; for each the hashes of the subtrees around it that can be template; all such hashes of the page."""
    order = _ordered(root)
    _weigh(order)
    articles = {id(n) for n, inside, *_ in order if n.tag == "article" and not n.gone and n.size}
    main = next((n for n, *_ in order if n.tag == "main" and not n.gone and n.size), None)
    body = next((n for n, *_ in order if n.tag == "body" and not n.gone), root)
    top, todo = [], [(body if body.size else root, False)]
    held = 0
    while todo:  # articles outside one another, and how many of them the main element holds
        node, within = todo.pop()
        within = within or node is main
        if id(node) in articles:
            top.append(node)
            held += within
            continue
        todo += [(c, within) for c in reversed(node.children) if isinstance(c, Node) and not c.gone]
    start = [main] if main is not None and held == len(top) else top or [body if body.size else root]
    texts, around, piece, active = [], [], [], []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            texts.append(text), around.append(list(active))

    todo = list(reversed(start))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            piece.append(x)
        elif isinstance(x, bool):
            flush()
            if x:
                active.pop()
        elif x.gone and x not in start:
            flush()
        else:
            flush()
            if x.candidate:
                active.append(x.hash)
            todo.append(x.candidate)
            todo += reversed(x.children)
    flush()
    return texts, around, {n.hash for n, *_ in order if n.candidate}


def main_text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    texts, around, _ = blocks(root)
    return "\n".join(t for t, a in zip(texts, around, strict=True) if template.isdisjoint(a))


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


SALTS = 16


def _read(rows: DataFrame) -> DataFrame:
    """rows: page_id, url, html, host. Per page: row, page_id, url, host, a hash of its text, blocks, what is around them, hashes."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [blocks(parse(t or "")) for t in batch.column(2).to_pylist()]
            copies = [xxhash.xxh3_64_intdigest("\n".join(x)) - (1 << 63) for x, *_ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(found))),
                    batch.column(0),
                    batch.column(1),
                    batch.column(3),
                    pa.array(copies, pa.int64()),
                    pa.array([x for x, *_ in found], pa.list_(pa.string())),
                    pa.array([x for _, x, _ in found], pa.list_(pa.list_(pa.int64()))),
                    pa.array([list(x) for *_, x in found], pa.list_(pa.int64())),
                ],
                names=["row", "page_id", "url", "host", "copy", "blocks", "around", "hashes"],
            )
            row += len(found)

    return rows.mapInArrow(common.tidied(work), "row bigint, page_id bigint, url string, host string, copy bigint, blocks array<string>, around array<array<bigint>>, hashes array<bigint>")


def templates(read: DataFrame, min_pages: int = 3, prose_pages: int = 10, share: float = 0.002, prose_share: float = 0.1) -> DataFrame:
    """Per host the hashes of its template subtrees, with the number of distinct pages that hold them."""
    counted = read.select("host", "copy", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    hosts = read.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    says = F.col("hash").bitwiseAND(1) == 1
    least = F.when(says, F.greatest(F.lit(prose_pages), F.col("pages") * prose_share)).otherwise(F.greatest(F.lit(min_pages), F.col("pages") * share))
    #: What is under both floors is dropped before the join with the hosts' sizes.
    return counted.filter(F.col("n") >= min(min_pages, prose_pages)).join(hosts, "host").filter(F.col("n") >= least).drop("pages")


def extract(pages: DataFrame, min_pages: int = 3, prose_pages: int = 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.002, prose_share: float = 0.1) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    common.small_batches(spark, 200)
    shelf = common.Shelf(spark)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", _host("url"))
    read = shelf.put(_read(rows.select("page_id", "url", "html", "host")))
    known = templates(read, min_pages, prose_pages, share, prose_share).select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    #: Only pages with a block that can be template meet their templates; the text of the others stays where it is.
    doubtful = F.exists("around", lambda x: F.size(x) > 0)
    some = read.filter(doubtful).select("row", "host", "page_id", "url", "blocks", "around")
    held = some.select("row", "host", F.explode(F.array_distinct(F.flatten("around"))).alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    found = held.join(known, ["host", "hash", "salt"]).groupBy("row").agg(F.collect_list("hash").alias("template"))
    kept = F.expr("transform(filter(arrays_zip(blocks, around), x -> NOT arrays_overlap(x.around, template)), x -> x.blocks)")
    cut = some.join(found, "row", "left").select("page_id", "url", F.when(F.col("template").isNull(), F.col("blocks")).otherwise(kept).alias("blocks"))
    whole = read.filter(~doubtful).select("page_id", "url", "blocks").union(cut)
    return whole.select("page_id", "url", F.array_join("blocks", "\n").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
