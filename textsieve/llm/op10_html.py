"""Main text of web pages with a site style tree.

The DOMs of one host are merged into a tree.  Its nodes are the paths of
container elements (div, section, article, ...): for each step the tag, class and
id (digits left out), whether the element holds bare text, lists or other blocks,
and its number among equal siblings.  A node has the presentation styles seen
on the host's m pages (sequences of child elements) and, where it holds text, the
contents seen (block texts, weighed by their words).

- A content that n of the host's m pages have is worth 1 - log(n) / log(m) for each of its
  words: 1 if it is on one page, 0 if it is on all.  A branch's content is what its
  words are worth, on average of the pages that have it.
- Its presentation is the entropy of its styles to the base m.
- The most telling branch is found from the root down, by the child that holds at least
  ``SHARE`` of what its parent's words are worth.  It and its ancestors are never cut.
- Branches beside it are judged against it: their content is the share of its content.  Branches
  inside it are judged by what their words are worth on average.  The importance
  is (1 - 0.9 ** styles) * presentation + 0.9 ** styles * content.

Branches whose importance is below ``LEAST_IMPORTANCE`` are cut from every page of
the host.  A host with fewer than ``MIN_PAGES`` pages says too little about itself; its
pages use the tree of all pages, in which class and id do not count, so that all
of them share its nodes.  Nor is a branch cut that fewer than ``MIN_PAGES`` pages have.
Pages are counted by their html: copies are one page of their host and one of the
tree of all pages, so they cannot make their own main text look repeated.  Only
where most of the text is the body of an article, whose plain text elements are
never cut, copies count each.

Beside the tree, tags and roles that name a menu, header, footer, sidebar or
notice are cut on any page.  Class and id words (and form) are only a hint: such an element
is cut unless it is html, body, article or main or a container of most of the page's text; comments are cut if
there is other article text.  Where a page marks its article (or main) element and that has text, only it is read.

Scale: pages are parsed where they lie.  Styles and contents are counted per
host and path after summing in each task, so a host with a third of all pages is a
few aggregated rows.  Cut paths are rows; the distinct paths of each page are joined
with them by hash, salted, and a page gets only its own cut paths.
Pages that may have copies are known by ``MARKS`` bits of the hashes of their html;
only their counts are kept by page until copies are dropped.

Edge cases: null or empty html gives empty text; an unclosed element ends with
its parent, an unclosed script or comment with the page; null urls form one host;
paths deeper than ``DEPTH`` count as their ancestor of that depth; a page of any length is read whole.
"""
from __future__ import annotations

import html as entities
import operator
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import cut, kept, table, values

MIN_PAGES, LEAST_IMPORTANCE, DECAY, SHARE = 8, 0.2, 0.9, 0.6
ALL = "*"
SALTS = 16
DEPTH = 24
MARKS = 1 << 23
_FLUSH = 200_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table",
               "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "section", "address"}
BLOCKS = TEXT_BLOCKS | {"html", "head", "body", "div", "article", "main", "nav", "header", "footer", "aside", "form",
                        "fieldset", "title", "details", "summary", "dialog", "menu", "hgroup", "center", "select",
                        "button", "label", "option"}
BODY = {"article", "main"}
CONTAINERS = BLOCKS - TEXT_BLOCKS | {"section", "figure"}
LISTS = {"ul", "ol", "dl", "li", "menu", "select"}
NEVER = {"html", "body"} | BODY
CUT_TAGS = {"head", "title", "nav", "footer", "aside", "dialog", "menu", "select", "button", "label", "option"}
CUT_ROLES = {"navigation", "contentinfo", "complementary", "banner", "search", "dialog", "alertdialog", "menu", "menubar"}
HINT_TAGS = {"form", "fieldset"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion",
         "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "aside",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer",
         "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search",
         "widget", "toolbar", "pagination", "pager", "contentinfo", "complementary", "dialog", "form"}
HEAD_HINTS = {"header", "masthead", "topbar", "banner"}      # outside articles
COMMENTS = {"comment", "comments", "respond", "reply", "replies", "discussion"}
#: An open element of the left side ends where one of the right side opens.
ENDED_BY = {"p": BLOCKS - {"label", "button", "select", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
            "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
            "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}}
_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The end of a tag, or a value: its opening quote or, without quotes, all of it.
_VALUE = re.compile(r"""=\s*(?:(["'])|[^\s>"'][^\s>]*)|>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s/="']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMES = {"class", "id", "role"}
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_COMMENT_END = re.compile(r"--!?>")


class Node:
    """A block element: ``is_cut`` by tag, role or hint (after `settle`), ``path`` and ``plain`` (without class and id)
    in the style tree if it is a container (after `name_paths`)."""
    __slots__ = ("tag", "up", "label", "is_cut", "hint", "in_body", "children", "own", "size", "body_size", "path", "plain")

    def __init__(self, tag, up, label, is_cut, hint, in_body):
        self.tag, self.up, self.label, self.is_cut, self.hint, self.in_body = tag, up, label, is_cut, hint, in_body
        self.children, self.own, self.size, self.body_size, self.path, self.plain = [], 0, 0, 0, "", ""

    @property
    def container(self):
        node = self
        while node.tag not in CONTAINERS and node.up is not None:
            node = node.up
        return node


def _tag_end(html: str, at: int) -> int:
    """Index of the > that ends the tag open at ``at``: the first outside quoted values, however long they are.
    A quote that is never closed does not count."""
    while m := _VALUE.search(html, at):
        if m.group() == ">":
            return m.start()
        at = m.end()
        if m.group(1):
            close = html.find(m.group(1), at)
            if close < 0:
                end = html.find(">", at)
                return end if end >= 0 else len(html)
            at = close + 1
    return len(html)


def parse(html: str):
    """(blocks, nodes): blocks are (node, text) in page order, nodes are all block elements."""
    root = Node("", None, "", False, "", False)
    stack, nodes, blocks, held = [root], [root], [], []

    def close_block():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            stack[-1].own += len(text)
            blocks.append((stack[-1], text))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            held.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(html[at:m.start()]))
        if m.group(2) is None:
            if m.group() == "<!--":
                end = _COMMENT_END.search(html, m.end())
                at = end.end() if end else n
            else:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else n
            continue
        end = _tag_end(html, m.end())
        tag, attributes = m.group(2).lower(), html[m.end():end]
        at = end + 1
        if m.group(1):                                       # end tag
            if tag in BLOCKS:
                close_block()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = _END[tag].search(html, at)
                if end is None:
                    break
                at = html.find(">", end.end()) + 1 or n
            continue
        if tag == "br":
            held.append(" ")
        if tag == "hr":
            close_block()
        if tag in VOID or tag not in BLOCKS:
            continue
        close_block()
        while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
            stack.pop()
        up = stack[-1]
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in _NAMES}
        words = set(re.split(r"[^a-z]+", f"{names.get('class', '')} {names.get('id', '')}".lower())) if names else set()
        is_cut = tag in CUT_TAGS or (tag == "header" and not up.in_body) or (
            tag not in NEVER and names.get("role", "").strip().lower() in CUT_ROLES)
        hint = "" if tag in NEVER else "comments" if words & COMMENTS else "other" if (
            tag in HINT_TAGS or words & HINTS or (words & HEAD_HINTS and not up.in_body)) else ""
        label = tag + "".join(f"{mark}{re.sub(r'[0-9/>]+', '', '.'.join(sorted(names[k].split())))}"
                              for k, mark in (("class", "."), ("id", "#")) if names.get(k))
        node = Node(tag, up, label, is_cut, hint, up.in_body or tag in BODY)
        up.children.append(node)
        stack.append(node)
        nodes.append(node)
    close_block()
    settle(nodes)
    name_paths(nodes)
    return blocks, nodes


def settle(nodes: list[Node]) -> None:
    """Decide on hints: a container that holds most of the text (as far as tags and roles leave it) stays, and
    comments stay only where no other article has text."""
    for x in nodes[1:]:
        x.is_cut = x.is_cut or x.up.is_cut
    for x in reversed(nodes):
        if not x.is_cut:
            x.size += x.own
            x.body_size += x.own if x.in_body else 0
            if x.up is not None:
                x.up.size += x.size
                x.up.body_size += x.body_size
    root = nodes[0]
    for x in nodes[1:]:
        if x.up.is_cut:
            x.is_cut = True
        elif x.hint and not x.is_cut:
            elsewhere = root.body_size - x.body_size
            x.is_cut = x.tag not in CONTAINERS or (
                elsewhere > 0 if x.hint == "comments" else 2 * x.size < root.size or not x.size)


def name_paths(nodes: list[Node]) -> None:
    """Paths of containers in the tree of the host and, without class and id, in that of all pages."""
    for x in nodes:
        seen: dict[tuple, int] = {}
        for c in x.children:
            if c.tag not in CONTAINERS:
                c.path, c.plain = x.path, x.plain
                continue
            tags = {y.tag for y in c.children}
            kind = "t" if not tags else "l" if tags <= LISTS else "x"
            up = (x.path, x.plain)
            if up[0].count("/") >= DEPTH:
                c.path, c.plain = up
                continue
            numbers = []
            for label in (c.label, c.tag):
                seen[(label, kind, len(numbers))] = k = seen.get((label, kind, len(numbers)), 0) + 1
                numbers.append(f"{label}>{kind}{min(k, 9)}")
            c.path, c.plain = f"{up[0]}/{numbers[0]}", f"{up[1]}/{numbers[1]}"


def is_body(node: Node) -> bool:
    """Whether a node is an article or lies in one through plain text elements only."""
    while node is not None and node.tag not in BODY:
        if node.tag not in TEXT_BLOCKS or node.label != node.tag:
            return False
        node = node.up
    return node is not None


def main_text(html: str | None, unimportant: frozenset[str] = frozenset(), plain: bool = False) -> str:
    """Blocks of the page that are left, joined by blank lines; ``unimportant`` are paths of the tree of its host, or
    with ``plain`` of that of all pages."""
    if not html:
        return ""
    blocks, nodes = parse(html)

    def kept(node: Node) -> bool:
        if node.is_cut:
            return False
        at = node.plain if plain else node.path
        while at and unimportant:
            if at in unimportant:
                return False
            at = at.rpartition("/")[0]
        return True

    only_body = nodes[0].body_size > 0
    return "\n\n".join(t for node, t in blocks if (node.in_body or not only_body) and kept(node))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def mostly_body(blocks: list) -> bool:
    """Whether more than half of a page's text, as far as names tell, is the plain body of an article."""
    sizes = [(len(t), is_body(node)) for node, t in blocks if node.in_body and not node.is_cut]
    return 2 * sum(n for n, body in sizes if body) > sum(n for n, _ in sizes)


def copied(pages: DataFrame) -> np.ndarray:
    """``MARKS`` bits; that of a hash of html is set where a page has copies (or two pages share the bit)."""
    at = F.col("mark") + 1
    parts = (pages.groupBy("mark").count().where("count > 1")
             .select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow())     # 4 kB for 32,768 marks
    out = np.zeros(MARKS >> 3, np.uint8)
    for bucket, bits in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _seen(blocks, nodes, path_of: str, label_of: str) -> set[tuple[str, int, int, int]]:
    """(path, kind, value, words) of one page."""
    of = operator.attrgetter(path_of)
    out = {(of(x), 0, xxhash.xxh3_64_intdigest(t) - (1 << 63), min(len(t.split()), 1 << 30)) for x, t in blocks}
    for x in nodes:
        if x.tag in CONTAINERS or x.up is None:
            style = "/".join(getattr(c, label_of) for c in x.children)
            out |= {(of(x), 1, xxhash.xxh3_64_intdigest(style) - (1 << 63), 0), (of(x), 2, 0, 0)}
    return out


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, words, n): distinct pages of the host (and of all, ``*``) whose node at path has the
    value: kind 0 a content of so many words, 1 a presentation style, 2 the node itself."""
    pages = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "mark", F.pmod(F.xxhash64("html"), F.lit(MARKS)))
    marks = pages.sparkSession.sparkContext.broadcast(copied(pages))

    def counts_of(with_copies: bool):
        def run(batches):
            total: dict[tuple, int] = {}

            def flush():
                columns = list(zip(*total))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(list(total.values()), pa.int64())],
                    names=["host", "path", "kind", "value", "words", "page", "each", "n"])

            for b in batches:
                mark = b.column(2).to_numpy()
                on = ((marks.value[mark >> 3] >> (mark & 7).astype(np.uint8)) & 1).astype(bool)
                own = b.take(pa.array(np.flatnonzero(on == with_copies)))
                for host, html in zip(values(own.column(0)), values(own.column(1))):
                    blocks, nodes = parse(html)
                    page = (xxhash.xxh3_64_intdigest(html) - (1 << 63), mostly_body(blocks)) if with_copies else (0, True)
                    for tree, path_of, label_of in ((host, "path", "label"), (ALL, "plain", "tag")):
                        for key in _seen(blocks, nodes, path_of, label_of):
                            total[(tree, *key, *page)] = total.get((tree, *key, *page), 0) + 1
                    if len(total) >= _FLUSH:
                        yield flush()
                        total.clear()
            if total:
                yield flush()

        return pages.mapInArrow(run, "host string, path string, kind int, value bigint, words int, page bigint, "
                                     "each boolean, n bigint")

    key = ["host", "path", "kind", "value", "words"]
    single = counts_of(False).select(*key, "n")
    several = (counts_of(True).groupBy(*key, "page", "each").agg(F.sum("n").alias("n"))
               .select(*key, F.when(F.col("each"), F.col("n")).otherwise(F.lit(1).cast("bigint")).alias("n")))
    return single.unionByName(several).groupBy(*key).agg(F.sum("n").alias("n"))


def unimportant_branches(counts: DataFrame, min_pages: int = MIN_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, cut): a row for each path to cut of the tree of a host with enough pages (and of ``*``), and a row with
    the empty path, which cuts nothing, for each such tree."""
    trees = counts.where("path = '' AND kind = 2").select("host", F.col("n").alias("pages")).where(
        (F.col("pages") >= min_pages) | (F.col("host") == ALL))
    salted = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))      # a host may have most rows
    counts = counts.withColumn("salt", F.pmod("value", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    base = F.when(F.col("pages") > 1, F.log(F.col("pages")))
    worth = F.coalesce(1 - F.log("n") / base, F.lit(1.0)) * F.col("words") * F.col("n")
    per = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, worth).otherwise(0.0)).alias("worth"),
        F.sum(F.when(F.col("kind") == 0, F.col("words") * F.col("n")).otherwise(0)).alias("words"),
        F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, -F.col("n") * F.log("n"))).alias("nlogn"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("n_styled"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"), F.first("pages").alias("pages"))
    # entropy of n_i / N: log N - sum(n_i log n_i) / N
    entropy = F.greatest(F.log("n_styled") + F.col("nlogn") / F.col("n_styled"), F.lit(0.0))
    per = per.withColumn("presentation", F.coalesce(entropy / base, F.lit(0.0)))
    # contents count for every branch above them
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    whole = (per.select("host", F.explode(above).alias("path"), "worth", "words").groupBy("host", "path")
             .agg(F.sum("worth").alias("total"), F.sum("words").alias("all_words")))
    nodes = cut(per.where("m IS NOT NULL").select("host", "path", "m", "styles", "presentation").join(whole, ["host", "path"])
                .withColumn("up", F.regexp_replace("path", "/[^/]*$", "")))
    # down from the root by the child that holds most
    share = (nodes.where("path <> ''").join(nodes.select("host", F.col("path").alias("up"), F.col("total").alias("of")), ["host", "up"])
             .select("host", "path", (F.col("total") >= SHARE * F.col("of")).alias("most"), F.col("total") > 0))
    passed = share.where("most").select("host", F.col("path").alias("passed"))
    steps = F.split("path", "/")
    chain = (passed.select("host", F.col("passed").alias("path"))
             .select("host", "path", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(
                 F.slice(steps, 1, i), "/"))).alias("passed"), (F.size(steps) - 1).alias("depth"))
             .join(passed, ["host", "passed"], "left_semi").groupBy("host", "path", "depth").agg(F.count("*").alias("n"))
             .where("n = depth").join(nodes.where("total > 0").select("host", "path"), ["host", "path"], "left_semi"))
    main = chain.groupBy("host").agg(F.max_by("path", F.struct("depth", "path")).alias("main"))
    main = (nodes.where("path = ''").select("host", F.lit("").alias("top")).join(main, "host", "left")
            .select("host", F.coalesce("main", "top").alias("main"))
            .join(nodes.select("host", F.col("path").alias("main"), (F.col("total") / F.col("m")).alias("best")), ["host", "main"]))
    inside = F.concat("path", F.lit("/")).startswith(F.concat("main", F.lit("/")))
    around = F.concat("main", F.lit("/")).startswith(F.concat("path", F.lit("/")))
    content = (F.when(inside, F.col("total") / F.col("all_words"))
               .otherwise(F.least(F.lit(1.0), F.col("total") / F.col("m") / F.when(F.col("best") > 0, F.col("best")))))
    fade = F.pow(F.lit(DECAY), F.col("styles"))
    importance = (1 - fade) * F.col("presentation") + fade * content
    tag = F.regexp_extract("path", "/([a-z0-9]+)[^/]*$", 1)
    low = (nodes.join(main, "host").where((F.col("m") >= min_pages) & (F.col("all_words") > 0) & ~around
                                          & ~tag.isin(*sorted(NEVER)) & (importance < least)).select("host", F.col("path").alias("cut")))
    return low.unionByName(trees.select("host", F.lit("").alias("cut")))


def _page_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64(F.lit(7), "page_id", "url", "html")})


def cut_paths(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """(k1, k2, plain, cut): for every page the paths of its own that its tree cuts: that of its host, or of all."""
    def run(batches):
        for b in batches:
            rows = []
            for k1, k2, host, html in zip(*(values(b.column(i)) for i in range(4))):
                nodes = parse(html)[1] if html else []
                own = {y for x in nodes if not x.is_cut and x.tag in CONTAINERS and x.tag not in NEVER      # what may be cut yet
                       for y in ((False, x.path), (True, x.plain))} | {(False, "")}
                rows += [(k1, k2, ALL if plain else host, plain, path) for plain, path in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()))],
                names=["k1", "k2", "host", "plain", "path"])

    salt = F.pmod("k1", F.lit(SALTS)).cast("int")
    own = (pages.select("k1", "k2", "host", "html").mapInArrow(run, "k1 bigint, k2 bigint, host string, plain boolean, path string")
           .select("k1", "k2", "plain", F.xxhash64("host", "path").alias("p"), salt.alias("salt")))
    cuts = (trees.where((F.col("host") != ALL) | (F.col("cut") != ""))
            .select("cut", F.xxhash64("host", "cut").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return (own.join(cuts, ["p", "salt"]).groupBy("k1", "k2")
            .agg(F.collect_set(F.struct("plain", "cut")).alias("found"))
            .select("k1", "k2", (~F.exists("found", lambda x: ~x["plain"])).alias("plain"), "found")
            .select("k1", "k2", "plain", F.transform(F.filter("found", lambda x: (x["plain"] == F.col("plain")) & (x["cut"] != "")),
                                                     lambda x: x["cut"]).alias("cut")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars."""
    src = _page_key(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                                 F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")))
    trees = cut(unimportant_branches(kept(style_counts(src), "styles"), min_pages, least))
    dealt = src.join(cut_paths(src, trees), ["k1", "k2"], "left")

    def run(batches):
        for b in batches:
            text, n = [], []
            for html, paths, plain in zip(*(values(b.column(i)) for i in (2, 3, 4))):
                t = main_text(html, frozenset(paths or ()), bool(plain))
                text.append(t)
                n.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return (dealt.select("page_id", "url", "html", "cut", "plain")
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))


def op10_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extract": op10_html_extract}
