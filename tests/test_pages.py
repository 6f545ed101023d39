"""Parsing, selectors, summaries, URLs and extraction on hand-checked pages."""

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from pagelake.functions.css import node_text, parse_selector, select_nodes, selector_problem
from pagelake.functions.text import strip
from pagelake.functions.urls import request_url, resolve_url
from pagelake.operators.extract import ALL_IMAGES, PRIMARY_IMAGE, Page, extract_fields, inline_records, literal_fields, pick
from pagelake.operators.summary import summarize
from pagelake.sources.html import parse_html
from pagelake.sources.snapshots import choose_snapshots, needs_render, read_html_files, with_snapshots

PAGE = (
    "<title>T</title><meta name=description content=' dd '><ul class='list'><li><p>a <b>x</b> y<a href='/q'>link</a>"
    "<li class='k z'>two<ul><li>in</ul></ul><p><b>q<br><p>r &amp; s <!-- c --> t</p><script>var a='</p>'</script>"
    "<article class='main x'><div><h1 id=t>Headline of this page</h1><img src=a.png></div><h1>H2</h1>"
    "<a href='javascript:x'>js</a><a href='?p=2'>n</a></article><noscript><p>hidden</p></noscript>"
)


@pytest.fixture(scope="module")
def dom(spark):
    page = spark.createDataFrame([(1, "http://h/x/y?z=1", PAGE)], "page_id int, url string, html string")
    return parse_html(page).cache()


def test_selectors_in_document_order(dom):
    expected = {
        "li": ["axylink", "twoin", "in"], "ul > li": ["axylink", "twoin", "in"], "ul ul > li": ["in"],
        "article h1, b": ["x", "q", "Headline of this page", "H2"], "article > h1": ["H2"], "#t": ["Headline of this page"],
        ".list .z": ["twoin"], "[class~='k']": ["twoin"], "li:contains('wo')": ["twoin"], "body > ul li > p b": ["x"],
        "article div > h1": ["Headline of this page"], "a[href^='?']": ["n"], "::x": [], "table": [],
    }
    selectors = F.array(*[F.lit(s) for s in expected])
    nodes, texts = F.col("nodes"), F.col("texts")
    found = F.transform(
        selectors,
        lambda s: F.transform(select_nodes(nodes, texts, F.col("places"), parse_selector(s)), lambda n: node_text(texts, n)),
    )
    assert dom.select(found.alias("found")).first().found == list(expected.values())


def test_unsupported_selector_is_reported(spark):
    rows = spark.createDataFrame([("a::x",), ("a b",), (None,)], "s string").select(selector_problem("s").alias("p"))
    assert [r.p for r in rows.collect()] == ["a::x", None, None]


def test_summary(dom):
    s = summarize(dom).first()
    assert (s.title, s.meta.description, s.meta.keywords) == ("T", "dd", "")
    assert s.headings == ["Headline of this page", "H2"]
    assert s.paragraphs == ["axylink", "q", "r & st"]
    assert [tuple(x) for x in s.links] == [("/q", "link"), ("javascript:x", "js"), ("?p=2", "n")]
    assert [(x.type, x["items"]) for x in s.lists] == [("ul", ["axylink", "twoin", "in"]), ("ul", ["in"])]
    assert s.tag_counts == {"div": 1, "article": 1, "li": 3, "img": 1, "a": 3}
    assert [tuple(h) for h in s.structure_hints] == [("article", "main x", "", "Headline of this pageH2jsn")]
    hint = s.image_hints[0]
    assert (hint.order, hint.src_preview, hint.parent_tag, hint.ancestor_chain) == (1, "a.png", "article", ["div", "article"])


def test_field_extraction(dom):
    fields = [
        ("title", "h1, h2", "css"), ("links", "a", "attr:href", 2), ("image", "img", "css"),
        ("date", "time", "css", None, "title"), ("skip", "", "css"), ("cover", "article img.hero", PRIMARY_IMAGE),
        ("images", "img", ALL_IMAGES),
    ]
    record = extract_fields(dom, fields).first().record
    assert [(c.field, c.kind, c.s, c.xs) for c in record] == [
        ("title", "str", "Headline of this page", None), ("links", "list", None, ["http://h/q", "http://h/x/y?p=2"]),
        ("image", "list", None, ["http://h/x/a.png"]), ("date", "str", "T", None), ("cover", "null", None, None),
        ("images", "list", None, ["http://h/x/a.png"]),
    ]


def test_css_link_list_limits_before_mapping(dom):
    record = F.col("record")
    two = extract_fields(dom, [("links", "article a", "css", 2)]).select(pick(record, "links").xs.alias("v")).first()
    assert two.v == ["js", "http://h/x/y?p=2"]
    one = extract_fields(dom, [("links", "article a", "css", 1)]).select(pick(record, "links").s.alias("v")).first()
    assert one.v == "js"


def test_inline_rows_are_zipped(dom):
    rows = dom.select(F.explode(inline_records(Page(), literal_fields([("t", "li", "css"), ("u", "h1", "css")]), F.lit(3))).alias("r"))
    assert [[c.s for c in r.r] for r in rows.collect()] == [["axylink", "Headline of this page"], ["twoin", "H2"], ["in", ""]]


def test_urls_match_the_standard_library(spark):
    bases = ["http://a.com", "https://a.com/b/c?q=1#f", "http://a.com/b/c/", "http://h.x:80/a/../b/./c.html?x=/y"]
    refs = ["a", "..", ".", "/", "c.html", "?q=2", "#f", "//o.com/p", "javascript:void(0)", "mailto:x@y", "https://z.org/../k",
            "/../x", "./x", "../../../y", "a//b", "/a/./b/..", "é?x#y", "../"]
    pairs = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    wrong = [(x.b, x.r, x.u) for x in pairs.select("b", "r", resolve_url("b", "r").alias("u")).collect() if x.u != urljoin(x.b, x.r)]
    assert wrong == []
    urls = ["http://a.com/é ü?q=ß ü&x=*~#é", "http://a.com", "/a b", "http://a/x%20y?z=a+b(c)", "https://x/漢😀/?k=漢"]
    for row in spark.createDataFrame([(u,) for u in urls], "u string").select("u", request_url("u").alias("e")).collect():
        p = urlsplit(row.u)
        assert row.e == urlunsplit((p.scheme, p.netloc, quote(p.path, safe="/%"), quote(p.query, safe="=&%"), p.fragment))


def test_strip_matches_python(spark):
    text = "".join(chr(c) for c in range(1, 0x3100) if chr(c).isspace())
    assert spark.createDataFrame([(text + "x" + text,)], "s string").select(strip("s").alias("v")).first().v == "x"


def test_snapshot_choice(spark):
    rich = "<html>" + "<p>data</p>" * 500 + "</html>"
    rows = [
        (1, "u1", "u1", "<html></html>", "static"), (2, "u1", "u1#r", "<html>rendered</html>", "playwright"),
        (3, "u2", "u2", rich, "static"), (4, "u2", "u2#r", "<html></html>", "playwright"),
        (5, "u3", "u3#f", "<p>short", "static"), (6, "u4", "u4", "", "static"), (7, "u5", "u5", "x", "unknown"),
    ]
    captures = spark.createDataFrame(rows, "capture_id long, requested_url string, final_url string, html string, renderer string")
    got = {r.requested_url: (r.final_url, r.renderer, r.degraded) for r in choose_snapshots(captures).collect()}
    assert got == {
        "u1": ("u1#r", "playwright", False), "u2": ("u2", "static", False), "u3": ("u3#f", "static", True), "u4": ("u4", "static", True),
    }


def test_needs_render_rules(spark):
    pad = "x" * 900
    pages = ["", "short", pad, pad + "Enable JavaScript", pad + "<script>", pad + "<p>" + "<script>" * 15, pad + "<p>" + "var " * 51 + "x"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", needs_render("h").alias("n")).orderBy("i")
    assert [r.n for r in rows.collect()] == [True, True, False, True, True, True, True]


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>é".encode() + b"\xff</p>")
    (tmp_path / "b.txt").write_text("no")
    rows = read_html_files(spark, str(tmp_path)).collect()
    assert [r.html for r in rows] == ["<p>é</p>"]


def test_deep_pages_keep_their_text_and_ancestors(spark):
    depth = 400
    html = "<html><body>" + "".join(f'<div class="d{k}">' for k in range(depth)) + "deep<b>er</b>" + "</div>" * depth + "</body></html>"
    dom = parse_html(spark.createDataFrame([(1, html)], "page_id int, html string"))
    nodes, texts = F.col("nodes"), F.col("texts")

    def texts_of(selector):
        return F.transform(select_nodes(nodes, texts, F.col("places"), parse_selector(F.lit(selector))), lambda n: node_text(texts, n))

    row = dom.select(
        texts_of(".d0").alias("outer"), texts_of(".d3 .d390 b").alias("below"), texts_of(".d398 > .d399 > b").alias("child"),
        texts_of(".d390 .d3").alias("none"), F.size(nodes).alias("n"),
    ).first()
    assert row.outer == ["deeper"] and row.below == ["er"] and row.child == ["er"] and row.none == []
    assert row.n == depth + 3


def test_html_files_keep_their_own_replacement_characters(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("x�y".encode())
    (tmp_path / "b.html").write_bytes("x�y".encode() + b"\xff\xfez")
    got = {r.path[-6:]: r.html for r in read_html_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "x�y", "b.html": "x�yz"}


def test_repeated_and_respelled_snapshots_give_one_row(spark):
    stored = spark.createDataFrame(
        [("http://h/a b", None, "old", 1), ("http://h/a%20b", None, "new", 2), ("http://h/a b", None, "older", 0), ("http://h/c", None, "c", 1)],
        "requested_url string, final_url string, html string, stored_at int",
    )
    cases = spark.createDataFrame([("http://h/a b",), ("http://h/none",)], "url string")
    assert sorted((r.url, r.html) for r in with_snapshots(cases, stored).collect()) == [("http://h/a b", "new"), ("http://h/none", None)]


def test_status_rules_come_before_the_choice(spark):
    captures = spark.createDataFrame(
        [(1, "http://h/a", None, "<html>404 " + "x" * 900 + "<p>", "static", 404), (2, "http://h/a", None, "<html>ok</html>", "playwright", 200)],
        "capture_id long, requested_url string, final_url string, html string, renderer string, status int",
    )
    assert [r.capture_id for r in choose_snapshots(captures).collect()] == [2]
