"""Main text of web pages with a site style tree.

Pages of a host are merged by element paths (tag and class names, numbers removed). For every path the tree keeps how its children
are laid out and what its blocks say, as counts over all pages of the host. Entropy turns both into an importance between 0 and 1:
layouts and contents that differ from page to page matter, those that every page repeats do not. A branch of low importance is
removed, and so is one whose own name says what it is (navigation, footer, advert, form, comments and the like); paragraphs and
headings inside an article are content whatever their counts are, since copies of an article may sit on many pages.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import cut_lineage

#: A branch below this importance is removed, if its host shows it on at least ``MIN_PAGES`` pages.
MIN_IMPORTANCE = 0.3
MIN_PAGES = 8
#: Weight of an element's own layout falls with the number of layouts it has.
DECAY = 0.9

# Element and class names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
RAW = frozenset("script style textarea title noscript iframe template svg object canvas noembed noframes".split())
HEAD = frozenset("meta link base title style script noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " img br wbr picture source track area map audio video embed".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption article main".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select option input fieldset dialog menu script style head header".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toc header masthead topbar toolbar footer foot colophon copyright"
    " sidebar sidebars aside rail widget widgets related recommended recommendations teaser teasers"
    " comment comments commentlist reply replies respond disqus discussion"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay lightbox newsletter subscribe subscription signup login paywall"
    " share sharing social follow search searchbox form skip hidden".split())
#: Of these, the ones that count for an inline element too.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo share social skip hidden".split())
#: Names that an article uses for its own title.
TITLE_WORDS = frozenset("header masthead".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Opening one of these closes an open one of the set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl select html body div section article main".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    name: str  # tag and class names
    path: int
    parent: Node | None
    noise: bool = False  # by its own name
    inside: bool = False  # an article
    muted: bool = False  # its text is dropped where it stands, without breaking the block around it
    children: list = field(default_factory=list)  # nodes and blocks (str), in page order


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _words(value: str) -> set[str]:
    """Words of class names; one after "with", "has" or "no" only says what stands beside the element."""
    out = set()
    for token in value.split():
        before = ""
        for w in _NAME.findall(_CAMEL.sub(" ", token)):
            if before not in ("with", "has", "no"):
                out.add(w.lower())
            before = w.lower()
    return out


def _named(tag: str, attributes: dict[str, str], inside: bool) -> tuple[str, bool]:
    """Name of an element in the style tree, and whether it says itself that it is not content."""
    classes = _words(attributes.get("class", ""))
    told = classes if inside else classes | _words(attributes.get("id", ""))
    noise = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    noise = noise or _HIDDEN.search(attributes.get("style", "").lower()) is not None
    if tag in INLINE:
        noise = noise or bool(told & INLINE_WORDS)
    elif tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        noise = noise or tag in BOILERPLATE_TAGS and not (inside and tag == "header")
        noise = noise or attributes.get("role", "").lower() in BOILERPLATE_ROLES
        noise = noise or bool(told & (BOILERPLATE_WORDS - TITLE_WORDS if inside else BOILERPLATE_WORDS))
    return ".".join([tag, *sorted(classes)]), noise


def parse(source: str) -> Node:
    """Element tree of a page; text is kept in blocks with decoded references and single blanks."""
    root = node = Node("", "", 0, None)
    text: list[str] = []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if block:
            node.children.append(block)

    def close(tags: set[str] | frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        nonlocal node
        at = node
        while at.parent is not None and at.tag not in tags:
            if at.tag in scope:
                return
            at = at.parent
        if at.parent is not None:
            node = at.parent

    position, end = 0, len(source)
    while position < end:
        m = _MARKUP.search(source, position)
        stop = end if m is None else m.start()
        if stop > position and not node.muted:
            text.append(html_lib.unescape(source[position:stop]))
        if m is None:
            break
        position = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in ("br", "wbr"):
            text.append(" ")
            continue
        if node.tag == "head" and not m[1] and tag not in HEAD:
            flush()
            node = node.parent
        inline = tag in INLINE
        if m[1]:
            if not inline:
                flush()
            close({tag}, frozenset() if not inline else SCOPE | CONTENT)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, position)
            position = stop.end() if stop else end
            continue
        if not inline:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE - CLOSES[tag])
            elif node.tag not in ("", "html"):
                close({"p"}, SCOPE | {"td", "th", "li", "blockquote"})
        if tag in VOID or m[3].endswith("/") and inline:
            continue
        inside = node.inside or tag in ("article", "main")
        name, noise = _named(tag, _attributes(m[3]), node.inside)
        path = node.path if inline else xxhash.xxh64_intdigest(f"{node.path}/{name}") >> 1
        child = Node(tag, name, path, node, noise and not inline, inside, node.muted or noise and inline)
        node.children.append(child)
        node = child
    flush()
    return root


def _visible(node: Node) -> list:
    """Blocks and elements below a node; inline elements are transparent."""
    out, stack = [], [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, Node) and child.tag in INLINE:
                stack.append(iter(child.children))
                break
            out.append(child)
        else:
            stack.pop()
    return out


def style_counts(page: str) -> Counter:
    """(path, kind, value) of a page: kind 0 the layout of an element, kind 1 a block of its own."""
    out: Counter = Counter()
    todo = [parse(page)]
    while todo:
        node = todo.pop()
        layout, last = [], None
        for child in _visible(node):
            if isinstance(child, str):
                out[node.path, 1, xxhash.xxh64_intdigest(child) >> 1] += 1
                name = "#"
            else:
                todo.append(child)
                name = child.name
            if name != last:
                layout.append(name)
            last = name
        out[node.path, 0, xxhash.xxh64_intdigest("/".join(layout)) >> 1] += 1
    return out


def site_style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, seen, layouts, layout_importance, content_importance) from pages (host, html).

    ``layout_importance`` is the entropy of the layouts over the log of how often the element occurs; ``content_importance`` is 1
    minus the mean entropy of its blocks, 1 if it has none to judge by. Counts are combined in every task before they are shuffled.
    """

    def run(batches):
        for part in slices(batches):
            totals: Counter = Counter()
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for key, n in style_counts(page).items():
                    totals[(host, *key)] += n
            columns = list(zip(*((*k, n) for k, n in totals.items()))) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "kind", "value", "n"])

    counts = pages.select("host", "html").mapInArrow(run, "host string, path long, kind int, value long, n long")
    counts = counts.select(F.xxhash64("host").alias("site"), "path", "kind", "value", "n").groupBy("site", "path", "kind", "value").agg(F.sum("n").alias("n"))
    layout = lambda c: F.when(F.col("kind") == 0, c)
    content = lambda c: F.when(F.col("kind") == 1, c)
    sums = counts.groupBy("site", "path").agg(
        F.sum(layout(F.col("n"))).alias("seen"), F.count(layout(F.col("n"))).alias("layouts"), F.sum(layout(F.col("n") * F.log(F.col("n")))).alias("nlogn"),
        F.count(content(F.col("n"))).alias("features"), F.sum(content(F.log("n"))).alias("logs"))
    log_seen = F.log(F.greatest(F.col("seen"), F.lit(2)))
    return sums.select(
        "site", "path", "seen", "layouts",
        F.when(F.col("seen") <= 1, 1.0).otherwise((F.log("seen") - F.col("nlogn") / F.col("seen")) / log_seen).alias("layout_importance"),
        F.when((F.col("seen") <= 1) | (F.col("features") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("features") / log_seen)).alias("content_importance"),
        (F.col("features") > 0).alias("has_content"))


def _importance(root: Node, tree: dict) -> dict[int, float]:
    """Composite importance of every element by identity: its own layout, and by its decay what its branches are worth on average."""
    out: dict[int, float] = {}
    stack: list[tuple[Node, list | None]] = [(root, None)]
    while stack:
        node, parts = stack.pop()
        if parts is None:
            parts = [c for c in _visible(node) if isinstance(c, Node)]
            stack.append((node, parts))
            stack.extend((c, None) for c in parts)
            continue
        _, layouts, layout, content, has_content = tree.get(node.path, (1, 1, 1.0, 1.0, True))
        branches = [out[id(c)] for c in parts] + ([content] if has_content or not parts else [])
        weight = DECAY**layouts if parts else 1.0
        out[id(node)] = (1 - weight) * layout + weight * sum(branches) / len(branches)
    return out


def main_text(page: str, tree: dict[int, tuple[int, int, float, float, bool]]) -> str:
    """Blocks of the branches that matter, one per line. ``tree``: path -> (seen, layouts, layout, content importance, has content).

    Where a page has an article or main element, the text is what stands in it; its paragraphs, headings, lists and tables go only
    by name. Elsewhere every branch is held against the tree.
    """
    root = parse(page)
    importance = _importance(root, tree)
    articles = _find(root, {"article", "main"})

    def stays(node: Node) -> bool:
        if node.noise:
            return False
        if articles and node.tag in CONTENT:
            return True
        return tree.get(node.path, (0,))[0] < MIN_PAGES or importance[id(node)] >= MIN_IMPORTANCE

    blocks: list[str] = []
    for top in articles or [root]:
        stack = [iter(_visible(top))]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    blocks.append(child)
                elif stays(child):
                    stack.append(iter(_visible(child)))
                    break
            else:
                stack.pop()
    return "\n".join(blocks)


def _find(root: Node, tags: set[str]) -> list[Node]:
    """Outermost elements of these tags that are outside named boilerplate and hold text, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in tags and not node.noise:
            out.append(node)
            continue
        stack.extend(reversed([c for c in _visible(node) if isinstance(c, Node) and not c.noise]))
    return out


#: Most (host, path) rows that are sent to every task; a larger tree is joined by host.
BROADCAST_PATHS = 200_000
_STATS = ("path", "seen", "layouts", "layout_importance", "content_importance", "has_content")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, judged by all pages of its host.

    Null html is an empty page with empty text. A page without a usable url belongs to the empty host. Repeated rows stay repeated.
    The host is the lower-cased part of the url after ``//`` without user and port. No rows: no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    tree = cut_lineage(site_style_tree(rows).where(F.col("seen") >= MIN_PAGES))
    small = tree.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    by_site = tree.groupBy("site").agg(F.collect_list(F.struct(*_STATS)).alias("tree"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    sql = "page_id long, url string, text string"

    def texts(part, trees):
        return [main_text(h, t) for h, t in zip(part.column(2).to_pylist(), trees)]

    def unpack(entries):
        return {x["path"]: tuple(x[k] for k in _STATS[1:]) for x in entries or []}

    if small:
        shared = rows.sparkSession.sparkContext.broadcast({r.site: {x.path: tuple(x)[1:] for x in r.tree} for r in by_site.collect()})

        def run(batches):
            for part in slices(batches):
                trees = [shared.value.get(s, {}) for s in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts(part, trees), pa.string())], schema=schema)

        out = rows.select("page_id", "url", "html", F.xxhash64("host").alias("site")).mapInArrow(run, sql)
    else:
        joined = rows.withColumn("site", F.xxhash64("host")).join(by_site, "site", "left").select("page_id", "url", "html", "site", "tree")

        def run(batches):
            known: dict[int, dict] = {}
            for part in slices(batches, 16):
                trees = []
                for k, s in enumerate(part.column(3).to_pylist()):
                    if s not in known:
                        if len(known) > 64:
                            known.clear()
                        known[s] = unpack(part.column(4)[k].as_py())
                    trees.append(known[s])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts(part, trees), pa.string())], schema=schema)

        out = joined.mapInArrow(run, sql)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
