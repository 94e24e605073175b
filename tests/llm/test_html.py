"""HTML extraction: parser cases, style tree importance against a plain version."""
import math
import re
from collections import Counter, defaultdict

from textsieve.llm import op10_html as H


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>One
      two<br>three<p>Four &copy; f&uuml;nf &#x41;&#66;</p><ul><li>x<li>y</ul><div class="share">Share me</div>
    <form><p>Name</p></form><aside>Side</aside><section class="comments"><article><p>Nice!</p></article></section>
    <blockquote>Quote</blockquote></article><div class="sidebar">More</div><footer>&copy; us</footer></body></html>"""
    assert H.main_text(page) == "Head & line\n\nOne two three\n\nFour © fünf AB\n\nx\n\ny\n\nQuote"


def test_broken_markup():
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("just text & more") == "just text & more"
    assert H.main_text("<article><p>a<script>never closed <p>b") == "a"
    assert H.main_text("<article><p>a<!-- never closed <p>b") == "a"
    assert H.main_text("<p title='a>b'>c</p><p>1 < 2 and 3 > 2") == "c\n\n1 < 2 and 3 > 2"
    assert H.main_text('<p class="x>y</p><p>z</p>') in ("y\n\nz", "z")
    assert H.main_text("<article><p>&a &amp &amp;lt; &nosuch;</p>") == "&a & &lt; &nosuch;"
    assert H.main_text("<article><p>unclosed &am") == "unclosed &am"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert H.main_text("<article><p>" + "word " * 100_000) == "word " * 99_999 + "word"
    assert H.main_text("<a \"" * 3000) == ""


def test_long_quoted_values():
    """A closed quote ends where it closes, and nothing in a value is markup or a name."""
    for n in (1, 70_000, 1_000_000):
        fill = "x" * n
        assert H.main_text(f"<article><p data-a='{fill}><p>leak</p></article>{fill}'>in</p><p>next</p></article>") == "in\n\nnext"
        assert H.main_text(f'<p title="{fill}>" class="ad">{fill}</p><p a=1 data-b = "<i class=\'ad\'> {fill}">y</p>') == "y"
    assert H.main_text("<p a=\"" + "x" * 70_000 + "><b>y</b></p><p>z</p>") == "y\n\nz"
    assert H.main_text("<p a=b'c>d</p><p " + "x" * 200_000 + ">e'</p>") == "d\n\ne'"
    for piece in ("<a b='", "<a b=\"'", "=", "= ", "\"", "<p x ", "x='y' "):
        H.main_text("<p " + piece * 100_000)
        H.main_text("<p " + piece * 100_000 + ">")


def plain_low(pages, least, path_of="path", label_of="label"):
    """Paths to cut of one site, straight from the definition."""
    m_all = len(pages)
    on, styles, contents = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for no, page in enumerate(pages):
        blocks, nodes = H.parse(page)
        for x in nodes:
            if x.tag in H.CONTAINERS or x.up is None:
                on[getattr(x, path_of)].add(no)
                styles[getattr(x, path_of)][tuple(getattr(c, label_of) for c in x.children)].add(no)
        for x, t in blocks:
            contents[getattr(x, path_of)][t].add(no)

    def below(path):
        return [(t, s) for q, texts in contents.items() if q == path or q.startswith(path + "/") for t, s in texts.items()]

    worth = {p: sum(len(t.split()) * len(s) * (1 - math.log(len(s)) / math.log(m_all)) for t, s in below(p)) for p in on}
    words = {p: sum(len(t.split()) * len(s) for t, s in below(p)) for p in on}
    main = ""
    while True:
        children = [p for p in on if p and p.rpartition("/")[0] == main and worth[p] > 0 and worth[p] >= H.SHARE * worth[main]]
        if not children:
            break
        main = children[0]
    low = set()
    for p in on:
        tag = p.rpartition("/")[2].split(">")[0].split(".")[0].split("#")[0]
        if len(on[p]) < H.MIN_PAGES or not words[p] or (main + "/").startswith(p + "/") or tag in H.NEVER:
            continue
        n = sum(len(s) for s in styles[p].values())
        presentation = -sum(len(s) / n * math.log(len(s) / n) for s in styles[p].values()) / math.log(m_all)
        if (p + "/").startswith(main + "/"):
            content = worth[p] / words[p]
        else:
            content = min(1.0, worth[p] / len(on[p]) / (worth[main] / len(on[main])))
        fade = 0.9 ** len(styles[p])
        if (1 - fade) * presentation + fade * content < least:
            low.add(p)
    return low


def site(n):
    return [f"<html><body><div class=top>Welcome to us</div><div class=left><p>Weather {i % 2}</p></div>"
            f"<div class=post><p>Story {i} about things</p><p>Part two of {i}</p></div><div class=end>Good bye</div></body></html>"
            for i in range(n)]


def test_style_tree_cuts_what_repeats_on_a_host(spark):
    pages = site(40)
    rows = [(i, f"http://User@Big.example:80/{i}", p) for i, p in enumerate(pages)]
    rows += [(100, "https://small.example/x", "<div class=solo>Alone</div>"), (101, None, None), (None, "not a url", "<p>q</p>"),
             (0, "http://big.example/0", pages[0])]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string").repartition(5)
    got = {}
    for r in H.extract(df).collect():
        got.setdefault((r.page_id, r.url), r)
        assert r.n_chars == len(r.text)
    for i in range(1, 40):
        assert got[(i, rows[i][1])].text == f"Story {i} about things\n\nPart two of {i}"
    assert got[(100, "https://small.example/x")].text == "Alone"
    assert got[(101, None)].text == "" and got[(None, "not a url")].text == "q"
    src = df.select("page_id", "url", "html", H.host_of(df["url"]).alias("host"))
    trees = defaultdict(set)
    for r in H.unimportant_branches(H.style_counts(src)).collect():
        trees[r.host].add(r.cut)
    assert trees["big.example"] - {""} == plain_low(pages + [pages[0]], H.LEAST_IMPORTANCE)
    assert len(trees["big.example"]) == 4 and all("" in t for t in trees.values())
    assert set(trees) == {"big.example", "*"}
    distinct = [*pages, rows[40][2], "", rows[42][2]]
    assert trees["*"] - {""} == plain_low(distinct, H.LEAST_IMPORTANCE, "plain", "tag")


def test_articles_that_repeat_stay(spark):
    page = "<article><h1>Same</h1><p>The same story.</p><div class=box>Box</div></article>"
    df = spark.createDataFrame([(i, "http://a.example/", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {"Same\n\nThe same story."}
    assert H.extract(df.limit(0)).count() == 0


def test_copies_keep_their_main_text(spark):
    """Copies are one page: on one host, over many hosts, and where a host is a few groups of copies."""
    def page(name, kind):
        text = f"<p>The story of {name}.</p><p>Part two of {name}.</p>"
        return (f"<html><body><div class={kind}-story>{text}</div></body></html>" if kind != "art" else
                f"<article><h1>Head</h1><div class=content>{text}</div></article>")
    rows = []
    for kind in ("two", "eight", "many", "art"):
        n = {"two": 2, "eight": 8, "many": 1000, "art": 20}[kind]
        rows += [(f"http://{kind}.example/{i}", kind, page(kind, kind)) for i in range(n)]
        rows += [(f"http://h{i}.example/", f"{kind}-spread", page(f"{kind}-spread", kind)) for i in range(n)]
    rows += [(f"http://few.example/{i}", f"few{i % 3}", page(f"few{i % 3}", "few")) for i in range(60)]
    rows += [(f"http://big.example/{i}", f"b{i}", f"<div class=post><p>Tale {i}</p></div>") for i in range(20)]
    rows += [(f"http://big.example/c{i}", "solo", page("solo", "solo")) for i in range(9)]
    names = [r[1] for r in rows]
    df = spark.createDataFrame([(i, u, h) for i, (u, _, h) in enumerate(rows)], "page_id long, url string, html string")
    for r in H.extract(df.repartition(5)).collect():
        name = names[r.page_id]
        want = f"Tale {name[1:]}" if name[0] == "b" else f"The story of {name}.\n\nPart two of {name}."
        assert r.text == ("Head\n\n" if name.startswith("art") else "") + want


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in H.op10_html_extract(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].url == p.url and got[p.page_id].n_chars == len(got[p.page_id].text) > 0
        assert "<" not in got[p.page_id].text.replace("< ", "")


def test_names_never_cut_what_holds_the_text():
    keep = {'<body class="no-sidebar"><p>One</p></body>': "One", '<div id="search-results"><p>Two</p></div>': "Two",
            '<article class="share"><p>Three</p></article>': "Three", "<form><div><p>Four is the whole page</p></div></form>": "Four is the whole page",
            '<div class="with-sidebar"><article><p>Five</p></article><div class="sidebar">Side</div></div>': "Five",
            '<article><div class="entry-header"><h1>Six</h1></div><p>Body</p></article>': "Six\n\nBody",
            "<article></article><p>Seven</p>": "Seven"}
    for page, text in keep.items():
        assert H.main_text(page) == text, page
    long = "<p>" + "nice " * 200 + "</p>"
    assert H.main_text(f'<article><p>Story</p><section class="comments">{long}</section></article>') == "Story"
    assert H.main_text(f'<article><p>Story</p></article><div id="comments">{long}</div>') == "Story"
    assert H.main_text('<p>Some text of the page</p><div class="ad"><p>Buy</p></div>') == "Some text of the page"


_NAMING = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|form|section)\b")


def unnamed(html):
    """The page without anything that names its parts: such tags become div, classes and ids go."""
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", _NAMING.sub(r"<\1div", html))


def words_found(spark, rows, **options):
    """(precision, recall) of the words of the main text that the pages' own marks give."""
    want = {i: Counter(H.main_text(h).split()) for i, _, h in rows}
    df = spark.createDataFrame([(i, u, unnamed(h)) for i, u, h in rows], "page_id long, url string, html string").repartition(8)
    got = {r.page_id: Counter(r.text.split()) for r in H.extract(df, **options).collect()}
    both = sum(sum((want[i] & got[i]).values()) for i in want)
    return both / sum(sum(c.values()) for c in got.values()), both / sum(sum(c.values()) for c in want.values())


def test_tree_finds_the_article_where_nothing_names_it(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()]
    precision, recall = words_found(spark, rows)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)
    off, _ = words_found(spark, rows, least=-1.0)
    assert off < precision - 0.05, (off, precision)


def test_trees_cut_menu_advert_and_footer(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    src = df.select("page_id", "url", "html", H.host_of(df["url"]).alias("host"))
    found = defaultdict(set)
    for r in H.unimportant_branches(H.style_counts(src)).collect():
        found[r.host].add(r.cut.rpartition("/")[2].rstrip("0123456789"))
    hosts = [t for h, t in found.items() if h != "*"]
    assert len(hosts) > 20 and sum({"nav>l", "footer>t", "div.ad>t"} <= t for t in hosts) > 0.9 * len(hosts)
    assert not any(x.startswith(("article", "body", "html")) for t in found.values() for x in t)


def test_deep_pages_and_long_texts(spark):
    deep = "<div>" * 500 + "<p>deep text of page {}</p>" + "</div>" * 500
    rows = [(i, "http://deep.example/", deep.format(i)) for i in range(12)] + [(99, "http://deep.example/", "<p>" + "word " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(got[i] == f"deep text of page {i}" for i in range(12)) and len(got[99].split()) == 50_000
