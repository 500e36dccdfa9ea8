"""Page extraction: fixtures per feature, and both modes against each other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators.extract import RECORD_COLUMNS, extract_pages

URL = "http://h.com/dir/page.html"


@pytest.fixture(scope="module")
def extract(spark):
    def run(html, mode="auto", **options):
        df = spark.createDataFrame([(URL, html)], "url string, html string")
        return extract_pages(df, mode, **options).first()

    return run


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, content",
    [
        ("<nav>n</nav><main>m <nav>inner</nav></main><article>a</article>", "m"),
        ("<article>a<p>b</p></article><div class=content>c</div>", "a b"),
        ('<div role="main">r</div><div class="content">c</div>', "r"),
        ('<div id="content">i</div><div class="x content y">c<div>d</div></div>', "c d"),
        ('<div class="main-content">mc</div><div id="content">i</div>', "mc"),
        ('<div id="content">i</div><div id="main">j</div>', "i"),
        ('<div id="main">j<aside>s</aside><div class="sidebar">t</div><p class="menu">u</p></div>', "j"),
        ("<nav>n</nav>text <b>bold</b><footer>f</footer>", "text bold"),
        ("<article>one<article>two</article>three</article>", "one two three"),
        ("<article>a < b &amp; c &lt;d&gt; &eacute;&#33;</article>", "a < b & c <d> é!"),
        ("<article>&eacute;&amp;amp; &amp &#x41;&apos;&unknown; a&b</article>", "é&amp; &amp A'&unknown; a&b"),
        ("<article>cut &amp</article>", "cut &amp"),
        ("<article>x<!-- y -->z<script>var a='</p>';</script>w</article>", "x z w"),
        ("<article>mail me@example.org\xa0 now</article>", "mail [EMAIL] now"),
        ("<article></article>after", ""),
    ],
)
def test_main_content(extract, body, content):
    row = extract(page(body))
    assert row.content == content
    assert row.word_count == len(content.split())
    assert row.parse_error is None


def test_no_body_and_odd_input(extract):
    assert extract("<title>T</title><p>hi there").content == "hi there"
    assert extract("<title>T</title><p>hi there").title == "T"
    assert extract("").content == ""
    assert extract("<div><p>cut off <b").content == "cut off <b"
    missing = extract(None)
    assert missing.title is None and missing.links == [] and missing.headings["h1"] == []


def test_metadata(extract):
    head = (
        '<title> A  &amp; B </title><meta content="d1" name="description"><meta property="og:description" content="d2">'
        "<meta name=keywords content='k1, k2'><meta property=\"article:author\" content=\"Ann\">"
        '<link rel="stylesheet canonical" href="../c?x=1#y">'
    )
    row = extract('<html xml:lang="de">' + page("<article>a</article>", head)[6:])
    assert (row.title, row.meta_description, row.meta_keywords, row.author) == ("A & B", "d1", "k1, k2", "Ann")
    assert row.language == "de"
    assert row.canonical_url == "http://h.com/c?x=1#y"
    only_og = extract(page("<main>a</main>", '<meta property="og:description" content="d2"><meta name="author">'))
    assert only_og.meta_description == "d2" and only_og.author == "" and only_og.meta_keywords is None
    assert extract('<html lang="" xml:lang="fr"><body><main>x</main></body></html>').language == "fr"


def test_headings(extract):
    row = extract(page("<h1>One <i>x</i></h1><h2> </h2><h2>b</h2><h6>z</h6><main>m<h1>Two</h1></main>"))
    assert row.headings == {"h1": ["One x", "Two"], "h2": ["b"], "h3": [], "h4": [], "h5": [], "h6": ["z"]}


LINKS = (
    '<a href="x">1</a><a href="x#f">2</a><a href="#top">3</a><a href=" ">4</a><a href="//O.com/P">5</a><a href="mailto:a@b">6</a>'
    "<a href='/img.PNG'>7</a><a href=/q?a=1&amp;b=2>8</a><a>9</a><abbr href='/no'>10</abbr>"
)


@pytest.mark.parametrize("mode", ["sql", "tree"])
def test_links_and_images(extract, mode):
    images = '<img src="/a.png"><img alt="x" src="b.gif#f"><img src="">'
    row = extract(page(f"<main>m</main>{LINKS}{images}"), mode)
    assert row.links == ["http://h.com/dir/x", "http://h.com/q?a=1&b=2", "http://o.com/P"]
    assert row.images == ["http://h.com/a.png", "http://h.com/dir/b.gif"]
    strict = extract(page(f"<main>m</main>{images}"), mode, strict_compat=True)
    assert strict.images == []


def test_links_inside_removed_navigation(extract):
    row = extract(page('<nav><a href="/out">o</a></nav><main><nav><a href="/in">i</a></nav><a href="/m">m</a></main>'))
    assert row.links == ["http://h.com/m", "http://h.com/out"]
    body_only = extract(page('<nav><a href="/out">o</a></nav><p><a href="/m">m</a></p>'))
    assert body_only.links == ["http://h.com/m"]
    blocked = extract(page('<main><a href="http://bad.com/">b</a><a href="/m">m</a></main>'), blocked=("bad",))
    assert blocked.links == ["http://h.com/m"]


def test_structured_data(extract):
    head = (
        '<script type="application/ld+json">{"@type": "A", "n": 1}</script>'
        '<script type="application/ld+json">[{"@type": ["B", "C"]}, {"n": 2}, 5]</script>'
        '<script type="application/ld+json">{broken</script><script type="application/ld+json"></script>'
    )
    body = (
        '<main><div itemtype="http://schema.org/A"><b itemprop="p"> v <i>w</i></b><meta itemprop="q" content="c">'
        '<span itemprop="p">last</span><div itemtype="http://s.org/N/Inner"><u itemprop="r">s</u></div></div>'
        '<div itemtype="http://schema.org/Empty"></div><div itemtype="x/"><b itemprop="p">y</b></div></main>'
    )
    data = {t: [json.loads(o) for o in objects] for t, objects in extract(page(body, head)).schema_org_data.items()}
    assert data == {
        "A": [{"@type": "A", "n": 1}, {"p": "last", "q": "c", "r": "s"}], "B": [{"@type": ["B", "C"]}], "Unknown": [{"n": 2}],
        "Inner": [{"r": "s"}],
    }


def test_unclosed_elements_in_tree(extract):
    body = '<div itemtype="s/T"><p itemprop="a">x<p itemprop="b">y<ul><li itemprop="c">1<li itemprop="d">2</ul></div>'
    row = extract(page(f"<main>{body}</main>"))
    assert json.loads(row.schema_org_data["T"][0]) == {"a": "x", "b": "y", "c": "1", "d": "2"}


def test_modes_agree_on_all_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    results = [
        {r.page_id: r for r in extract_pages(pages, mode).collect()} for mode in ("sql", "tree", "auto")
    ]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == pages.count()


def test_only_complex_pages_go_to_the_tree(spark, small):
    stripped, main = F.col("s"), F.col("m")
    pages = spark.read.parquet(f"{small}/pages.parquet")

    def complex_pages(df):
        read = df.withColumn("s", H.strip_boilerplate(F.col("html"))).withColumn("m", H.main_element(stripped))
        return read.filter(H.needs_tree(stripped, main)).count()

    assert complex_pages(pages) == 0
    for odd in ("<article>&eacute;", "<article><aside>x</aside>", '<article><p class="x menu">', "<article><i itemtype=x>",
                '<article><i title="a>b">', "<article><article>"):
        changed = pages.withColumn("html", F.replace("html", F.lit("<article>"), F.lit(odd)))
        assert complex_pages(changed) == pages.count(), odd


def test_plan_is_one_scan_without_shuffle(spark, small):
    df = extract_pages(spark.read.parquet(f"{small}/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert set(RECORD_COLUMNS) <= set(df.columns)


# --- odd mark-up ------------------------------------------------------------


def random_page(rng):
    """A page of random pieces: quotes, order of attributes, nesting, comments and unclosed elements in the odd places."""
    word = lambda: rng.choice(["alpha", "b", "see href=/wrong now", "&amp;", "x y", "é", "1 < 2", "&quot;q&quot;", "a&b"])

    def attributes(*needed):
        given = [f'title="{rng.choice(["see href=/wrong now", "t", "src=x lang=de"])}"', "data-href='/no'", "data-src=/no", "disabled", "class=x", 'alt=""', "href2=/no"]
        chosen = rng.sample(given, rng.randrange(3)) + list(needed)
        rng.shuffle(chosen)
        return "".join(rng.choice([" ", "  ", "\n"]) + a for a in chosen)

    def anchor():
        target = rng.choice(["/right", "rel/p", "//o.com/x?a=1&amp;b=2", "#top", "", "/img.png", "mailto:x"])
        return f"<{rng.choice(['a', 'A'])}{attributes(rng.choice([f'href={chr(34)}{target}{chr(34)}', f'HREF={chr(39)}{target}{chr(39)}', f'href = {target or 47}']))}>{word()}</a>"

    def heading():
        level = rng.randrange(1, 4)
        inner = rng.choice([word(), f"{word()} <i>{word()}</i>", f"A <h{level % 3 + 1}>B</h{level % 3 + 1}>"])
        return f"<h{level}{attributes()}>{inner}" + rng.choice([f"</h{level}>"] * 5 + [""])

    def piece(depth=0):
        return rng.choice([
            word, anchor, heading, lambda: f"<img{attributes('src=/p.png')}>", lambda: "<!-- <a href='/c'>c</a> -->", lambda: "<br>",
            lambda: f"<p>{word()}", lambda: f"<script>var a = '<a href=/s>';</script>",
            lambda: f"<div{attributes()}>{piece(depth + 1) if depth < 3 else word()}</div>",
            lambda: rng.choice(["<nav>n <a href='/nav'>x</a></nav>", "<aside>s</aside>", '<p class="menu">m</p>', "&#65;", "&eacute;"]) if rng.random() < 0.3 else word(),
        ])()

    pieces = lambda n: "".join(piece() for _ in range(rng.randrange(n)))
    title = rng.choice(["<title>T &amp; t</title>", "<title>a <b>x</b></title>", "", "<title lang=x>u</title>", "<title>c<!-- d --></title>", "<title>open"] + ["<title>plain</title>"] * 4)
    meta = "".join(rng.sample([
        f"<meta{attributes('name=description', 'content=' + chr(34) + 'd &amp; e' + chr(34))}>", f"<meta{attributes('name=keywords')}>",
        f"<link{attributes('rel=canonical', 'href=/canon')}>", "<meta property='og:description' content='og'>", "<meta content='x name=author' name=other>",
        '<script type="application/ld+json">{"@type":"A"}</script>', '<!-- <script type="application/ld+json">{"@type":"No"}</script> -->',
    ], rng.randrange(4)))
    main = rng.choice([
        lambda: f"<main{attributes()}>{pieces(6)}</main>", lambda: f"<article{attributes()}>{pieces(6)}</article>", lambda: "<main></main><article>a</article>",
        lambda: f"<article>{pieces(4)}</article><main>{pieces(4)}</main>", lambda: pieces(4), lambda: f"<main>{pieces(4)}",
    ] + [lambda: f"<article>{word()} {pieces(6)}</article>"] * 4)()
    return f"<html{attributes(*rng.choice([['lang=en'], ['xml:lang=fr'], []]))}><head>{title}{meta}</head><body>{pieces(4)}{main}{pieces(4)}</body></html>"


def test_modes_agree_on_odd_markup(spark):
    rows = [(i, URL, random_page(random.Random(i))) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = [{r.page_id: r for r in extract_pages(pages, mode).collect()} for mode in ("auto", "tree")]
    differ = [rows[i][2] for i in results[0] if results[0][i] != results[1][i]]
    assert not differ, differ[0]


@pytest.mark.parametrize("mode", ["auto", "tree"])
def test_attributes_are_read_in_order(extract, mode):
    row = extract(page('<main>m</main><a title="see href=/wrong now" href="/right">x</a><a data-href="/no" HREF=\'/q\'>y</a><a href=/one href=/two>z</a><a href>w</a>'), mode)
    assert row.links == ["http://h.com/one", "http://h.com/q", "http://h.com/right"]
    row = extract('<html data-lang="xx" title="lang=yy" lang="en"><body><main>m</main><img alt="src=/no" src="/yes.png"></body></html>', mode)
    assert (row.language, row.images) == ("en", ["http://h.com/yes.png"])


@pytest.mark.parametrize("mode", ["auto", "tree"])
def test_nested_and_open_elements(extract, mode):
    assert extract(page("<h1>A <h2>B</h2></h1><main>m</main>"), mode).headings["h2"] == ["B"]
    assert extract(page("<main>m</main><h1>open <b>x</b>"), mode).headings["h1"] == ["open x"]
    assert extract(page("<main></main><article>a</article>"), mode).content == ""
    assert extract(page("<main>m</main>", "<title>a <b>x</b></title>"), mode).title == "a <b>x</b>"
    assert extract(page("<main>&#0000000065;&#x000000041;&#99999999999999999999;</main>"), mode).content == "AA&#99999999999999999999;"
    commented = '<!-- <script type="application/ld+json">{"@type":"No"}</script> --><script type="application/ld+json">{"@type":"A","c":"<!-- x -->"}</script>'
    assert extract(page("<main>m</main>", commented), mode).schema_org_data == {"A": ['{"@type":"A","c":"<!-- x -->"}']}
