"""The page index, selectors that start from it, and reading time of hostile pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagelake.functions.css import literal_selectors, parse_selector, select_nodes
from pagelake.sources.html import _Columns, parse_html

BITS = [
    '<div class="a b">', '<div id="main" class="b  b c">', "</div>", "<p>", "<p class=a>", "</p>", "<b>", "</b>", '<a href="/x">', "<a name=k>", "</a>", "text ", "<ul>", "<li>",
    "</ul>", '<img src="i.png" class="hero">', "<span class='a c' data-k='1 2'>", "</span>", "<h1 id=t>", "</h1>", "<br>", "<table><tr><td>", "</table>", "&amp;", "<x-y class=''>",
]
SELECTORS = [
    "div", ".a", "div.b", "#main", "#t", "[href]", "a[href^='/']", "[name=k]", "a:not-supported", "*", "div > p", "div p.a", "#main .a, p, .a", "li a, ul > li, li a",
    "[class]", "[class~='c']", "[class!='a']", "img.hero[src$='.png']", "x-y", ".nothing", "span:contains('text')", ":contains('text')", "div div > .a b, h1", "[data-k~='2']", "",
]


def page(rng, n):
    return "<html><body>" + "".join(rng.choice(BITS) for _ in range(n)) + "</body></html>"


@pytest.fixture(scope="module")
def dom(spark):
    rng = random.Random(11)
    rows = [(k, page(rng, rng.randrange(0, 200))) for k in range(60)] + [(100, None), (101, ""), (102, "plain")]
    return parse_html(spark.createDataFrame(rows, "page_id int, html string").repartition(2)).cache()


def test_the_index_lists_every_node_by_what_it_has(dom):
    for row in dom.collect():
        want = {}
        for n in row.nodes:
            names = {n.tag} | {f".{c}" for c in (n.cls or "").split()} | {f"[{k}" for k in n.attrs} | ({f"#{n.attrs['id']}"} if "id" in n.attrs else set())
            for name in names:
                want.setdefault(name, []).append(n.i)
        assert row.places == want


def test_selecting_through_the_index_equals_looking_at_all_nodes(dom):
    nodes, texts, places = (F.col(c) for c in ("nodes", "texts", "places"))
    ids = lambda parsed: F.transform(select_nodes(nodes, texts, places, parsed), lambda n: n.i)
    blind = lambda parsed: F.transform(parsed, lambda chain: chain.withField("place", F.lit(None).cast("string")))
    known = F.array(*[F.struct(F.lit(s).alias("text"), p.alias("literal")) for s, p in zip(SELECTORS, literal_selectors(SELECTORS))])
    found = dom.select(F.transform(known, lambda s: F.struct(
        ids(parse_selector(s.text)).alias("indexed"), ids(blind(parse_selector(s.text))).alias("every"), ids(s.literal).alias("literal"),
    )).alias("found"))
    some = 0
    for row in found.collect():
        for selector, got in zip(SELECTORS, row.found):
            assert got.indexed == got.every == got.literal, selector
            some += len(got.indexed)
    assert some > 2000


def test_literal_selectors_are_constants_of_the_plan(dom):
    nodes, texts, places = (F.col(c) for c in ("nodes", "texts", "places"))
    (parsed,) = literal_selectors(["div > .a"])
    plan = dom.select(F.size(select_nodes(nodes, texts, places, parsed)).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "from_json" not in plan


def test_more_selectors_cost_what_they_find_not_what_the_page_has(spark):
    """A page of 60,000 nodes: 32 selectors of a few nodes each take about as long as one."""
    body = "".join(f'<p>t</p><i class="k{k % 1500}">u</i>' for k in range(30_000))
    dom = parse_html(spark.createDataFrame([(1, f"<html><body>{body}</body></html>")], "page_id int, html string")).cache()
    assert dom.select(F.size("nodes")).first()[0] > 60_000

    def seconds(n):
        # One expression over the selectors, so that the plan is as large for many as for one.
        parsed = F.array(*literal_selectors([f"body > i.k{k}" for k in range(n)]))
        query = dom.select(F.transform(parsed, lambda p: F.size(select_nodes(F.col("nodes"), F.col("texts"), F.col("places"), p))).alias("n"))
        assert query.first().n == [20] * n
        start = time.perf_counter()
        query.collect()
        return time.perf_counter() - start

    one, eight, many = (min(seconds(n) for _ in range(2)) for n in (1, 8, 32))
    assert many < 8 * one + 0.5, (one, eight, many)


HOSTILE = ["<a ", "<!", '"', '<a "', "<a '>\" ", "</a ", "<b>", "<b></i>", "<p><b>", "<a b=\"", "<td><p>", "<x'>\"", "<![", "<a <b \">'", "<!-", "</", "<a\n"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_reading_time_follows_the_length_of_the_page(unit):
    def seconds(size, tail=""):
        start = time.perf_counter()
        _Columns().add_page(unit * (size // len(unit)) + tail)
        return time.perf_counter() - start

    for tail in ("", ">"):
        small, large = min(seconds(250_000, tail) for _ in range(2)), seconds(1_000_000, tail)
        assert large < 12 * small + 0.3, (unit, tail, small, large)


def test_a_page_of_four_megabytes_is_read_in_seconds():
    for unit in ("<a ", "<!", '"', "<a '"):
        start = time.perf_counter()
        _Columns().add_page(unit * (4_000_000 // len(unit)))
        assert time.perf_counter() - start < 10


def test_parsing_holds_few_nodes_at_once(spark, monkeypatch):
    """Whatever the input, batches that leave the parser have little more than 10,000 nodes."""
    import pyarrow as pa

    from pagelake.sources.html import parse_html

    pages = spark.createDataFrame([(1, "")], "page_id int, html string")
    kept = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: kept.setdefault("run", run))
    parse_html(pages)
    page = "<p>x</p>" * 1_000
    out = list(kept["run"](iter([pa.RecordBatch.from_pydict({"page_id": pa.array(range(50), pa.int32()), "html": [page] * 50})])))
    sizes = [sum(len(nodes) for nodes in batch.column(2).to_pylist()) for batch in out]
    assert sum(batch.num_rows for batch in out) == 50 and max(sizes) < 12_000
