"""Whole flows on small sites: lists, details, galleries, lead images, pagination, misses and rejects."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators.extract import cell, pick
from pagelake.operators.flows import keyed_snapshots, missed_links, page_links, parsed_snapshots, rejected_starts, run_flows, visited_pages, walk_lists, walk_plans
from pagelake.operators.metrics import align_with_gold, latest_gold
from pagelake.operators.sinks import write_json, write_run_document, write_text
from pagelake.operators.strategies import build_strategies
from pagelake.operators.typing import classify
from pagelake.plans.site import extract_site
from pagelake.session import write_through
from pagelake.sources.cases import load_cases, load_gold, load_runs
from pagelake.sources.snapshots import store_snapshots, with_snapshots

SITE = {
    "http://h/list": '<ul><li><a class="item" href="/d1">1</a><li><a class="item" href="/d2">2</a><li><a class="item" href="/gone">3</a></ul>'
    '<a class="next" href="/list2">n</a>',
    "http://h/list2": '<a class="item" href="/d3">x</a><a class="next" href="/list">back</a>',
    "http://h/d1": "<h1>Title 1</h1><p>One</p>", "http://h/d2": "<h1>Title 2</h1><p>Two</p>", "http://h/d3": "<h1>Title 3</h1>",
    "http://h/alone": '<h1>Alone</h1><a class="item" href="/gone">3</a>',
    "http://h/gallery": '<h1>Pics</h1><div class="gallery"><img src="a.png"><img src="/b.png"></div>',
    "http://h/hero": '<h1>Hero</h1><article><img class="hero" src="h.png"><img src="o.png"></article>',
    **{f"http://h/chain{k}": f'<b class="row">r{k}</b><a class="next" href="/chain{k + 1}">n</a>' for k in range(7)},
}
LIST = '{"item_link_selector": "a.item", "max_depth": 9, "max_pages": 9, "pagination_selector": "a.next", "field_selectors": {"title": "h1"}}'
STARTS = [
    (1, "http://h/list", "list", ["title"], None, LIST), (2, "http://h/alone", "list", ["title"], None, LIST),
    (3, "http://h/gallery", "gallery", ["title", "images"], None, "{}"), (4, "http://h/hero", "news", ["title", "cover"], None, "{}"),
    (5, "http://h/nowhere", "news", ["title"], None, "{}"),
    (6, "http://h/chain0", "list", ["title"], None, '{"item_link_selector": " ", "max_pages": 9, "pagination_selector": "a.next", "field_selectors": {"title": ".row"}}'),
    (7, "http://h/list", "list", ["title"], 25, LIST.replace('"max_pages": 9', '"max_pages": 1')),
]


@pytest.fixture(scope="module")
def site(spark):
    snapshots = spark.createDataFrame([(u, None, f"<html><body>{h}</body></html>") for u, h in SITE.items()], "requested_url string, final_url string, html string")
    doms = write_through(parsed_snapshots(snapshots))
    work = spark.createDataFrame(STARTS, "walk_id int, url string, page_type string, requested_fields array<string>, max_items int, reply string")
    work = work.withColumns({"suggested_fields": F.lit(None).cast("array<string>"), "tag_counts": F.lit(None).cast("map<string,int>")})
    starts = write_through(build_strategies(work, "reply").select("walk_id", "url", "page_type", "strategy"))
    return snapshots, starts, doms


@pytest.fixture(scope="module")
def records(site):
    _, starts, doms = site
    return {
        w: [(r.no, r.title, r.xs, r.cover) for r in rows]
        for w, rows in _by_walk(run_flows(starts, doms).select(
            "walk_id", F.col("record_no").alias("no"), pick(F.col("record"), "title").s.alias("title"),
            pick(F.col("record"), "images").xs.alias("xs"), pick(F.col("record"), "cover").s.alias("cover"),
        ).collect()).items()
    }


def _by_walk(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.walk_id, r.no)):
        out.setdefault(r.walk_id, []).append(r)
    return out


def test_lists_follow_details_over_pages_without_going_round(records):
    assert [(n, t) for n, t, *_ in records[1]] == [(0, "Title 1"), (1, "Title 2"), (2, "Title 3")]
    assert [t for _, t, *_ in records[7]] == ["Title 1", "Title 2"]


def test_a_list_without_stored_targets_gives_its_own_record(records):
    assert [t for _, t, *_ in records[2]] == ["Alone"]


def test_galleries_and_lead_images(records):
    assert records[3] == [(0, "Pics", ["http://h/a.png", "http://h/b.png"], None)]
    assert [(t, c) for _, t, _, c in records[4]] == [("Hero", "http://h/h.png")]


def test_five_pages_at_most(records):
    assert [t for _, t, *_ in records[6]] == [f"r{k}" for k in range(5)]


def test_missing_pages_are_listed(site):
    _, starts, doms = site
    assert [(r.walk_id, r.url) for r in rejected_starts(starts, doms).collect()] == [(5, "http://h/nowhere")]
    lists = starts.where("page_type = 'list'")
    missed = missed_links(walk_lists(write_through(walk_plans(lists)), doms))
    assert sorted((r.walk_id, r.target) for r in missed.collect()) == [(1, "http://h/gone"), (2, "http://h/gone"), (7, "http://h/gone")]


def test_from_page_and_task_to_records(spark, site):
    snapshots, *_ = site
    work = spark.createDataFrame([(1, "http://h/d1", "get the title", '{"page_type": "news"}', None)], "walk_id int, url string, task string, t string, i string")
    rows = extract_site(snapshots, work, typing_reply="t", intent_reply="i").collect()
    assert [c.s for c in rows[0].record if c.field == "title"] == ["Title 1"]


@pytest.mark.parametrize("named, read", [("news", "news"), ("list", "list"), ("gallery", "gallery"), ("thread", "forum"), ("nonsense", "unknown")])
def test_page_types(spark, named, read):
    page = spark.createDataFrame([(1, f'Sure:\n```json\n{{"page_type": "{named}", "confidence": 0.8, "suggested_fields": ["title"]}}\n```')], "page_id int, content string")
    assert tuple(classify(page).first()) == (1, read, 0.8, ["title"])


def test_case_gold_and_run_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"site": "s", "url": "u", "task": "t", "expected_fields": ["a"], "html_path": "x.html"}]')
    assert load_cases(spark, str(tmp_path / "cases.json")).first().html_path.endswith(f"{tmp_path}/x.html")
    for name, title in (("g1", "old"), ("g2", "new")):
        (tmp_path / f"{name}.json").write_text(f'{{"runs": [{{"site": "s", "url": "u", "page_type": "news", "fields": {{"title": "{title}", "links": ["a", null], "n": 5}}}}]}}')
    gold = load_gold(spark, str(tmp_path / "g*.json"))
    last = latest_gold(gold).collect()
    assert len(last) == 1
    assert {c.field: c.xs or c.s for c in last[0].fields} == {"title": "new", "links": ["a", "None"], "n": "5"}
    (tmp_path / "runs.json").write_text('{"runs": [{"site": "s", "url": "u", "task": "t", "model": "m", "metrics": {"page_type": "news", "timings": {"fetch": 1.5}}, "records": [{"title": "new"}]}]}')
    runs = load_runs(spark, str(tmp_path / "runs.json"))
    assert runs.first().timings == {"fetch": 1.5}
    assert align_with_gold(runs, gold).first().gold_page_type == "news"


def test_json_files_and_run_document(spark, tmp_path):
    record = F.array(cell(F.lit("title"), "str", F.lit("t")), cell(F.lit("links"), "list", xs=F.array(F.lit("a"))))
    records = spark.range(2).select(record.alias("record"))
    write_json(records, str(tmp_path / "j"), ["title", "links"])
    assert [tuple(r) for r in spark.read.schema("title string, links array<string>").json(str(tmp_path / "j")).collect()] == [("t", ["a"])] * 2
    write_text(records, str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {'{"title":"t","links":["a"]}'}
    write_run_document(records, spark.range(1), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "runs")).count() == 2 and spark.read.json(str(tmp_path / "d" / "summary")).count() == 1


def test_stored_snapshots_are_found_and_replaced(spark, tmp_path):
    kind = "requested_url string, final_url string, html string"
    for html in ("first", "second"):
        store_snapshots(spark.createDataFrame([("http://h/a", None, html)], kind), str(tmp_path / "s"))
    cases = spark.createDataFrame([("http://h/a",)], "url string")
    assert [r.html for r in with_snapshots(cases, spark.read.parquet(str(tmp_path / "s"))).collect()] == ["second"]


def _walked(spark, site, starts):
    pages = spark.createDataFrame([(u, None, f"<html><body>{h}</body></html>") for u, h in site.items()], "requested_url string, final_url string, html string")
    doms = write_through(parsed_snapshots(pages))
    work = spark.createDataFrame(starts, "walk_id int, url string, page_type string, requested_fields array<string>, max_items int, reply string")
    work = work.withColumns({"suggested_fields": F.lit(None).cast("array<string>"), "tag_counts": F.lit(None).cast("map<string,int>")})
    plans = write_through(walk_plans(write_through(build_strategies(work, "reply").select("walk_id", "url", "page_type", "strategy"))))
    got = {}
    for r in sorted(walk_lists(plans, doms).collect(), key=lambda r: (r.walk_id, r.page_no)):
        got.setdefault(r.walk_id, []).append(r.base_url)
    return got, plans, doms


def test_walks_go_on_over_other_hosts_and_join(spark):
    """Next links lead from host to host, several walks meet, one page is missing and one leads to itself."""
    nxt = lambda u: f'<b class="row">r</b><a class="next" href="{u}">n</a>'
    site = {
        "http://a/1": nxt("http://b/2"), "http://b/2": nxt("http://c/3"), "http://c/3": nxt("//d/4"), "http://d/4": nxt("/5"), "http://d/5": nxt("http://a/6"), "http://a/6": nxt("http://a/1"),
        "http://e/1": nxt("http://d/4"), "http://f/1": nxt("http://gone/2"), "http://g/1": nxt("/1"), "http://h/1": nxt("http://h/2"), "http://h/2": nxt("http://h/1"),
        "http://i/1": '<b class="row">r</b><a class="more" href="http://b/2">m</a><a class="next" href="http://c/3">n</a>',
    }
    reply = '{"item_link_selector": " ", "max_pages": %d, "pagination_selector": "%s", "field_selectors": {"title": ".row"}}'
    starts = [(k, f"http://{h}/1", "list", ["title"], None, reply % (9, "a.next")) for k, h in enumerate("aefgh")]
    starts += [(7, "http://i/1", "list", ["title"], None, reply % (9, "a.more")), (8, "http://a/1", "list", ["title"], None, reply % (3, "a.next")), (9, "http://a/1", "list", ["title"], 2, reply % (9, "a.next"))]
    got, plans, doms = _walked(spark, site, starts)
    assert got == {
        0: ["http://a/1", "http://b/2", "http://c/3", "http://d/4", "http://d/5"], 1: ["http://e/1", "http://d/4", "http://d/5", "http://a/6", "http://a/1"],
        2: ["http://f/1"], 3: ["http://g/1"], 4: ["http://h/1", "http://h/2"], 7: ["http://i/1", "http://b/2"], 8: ["http://a/1", "http://b/2", "http://c/3"], 9: ["http://a/1"],
    }


def test_paths_are_worked_out_without_page_bodies(spark):
    nxt = lambda u: f'<b class="row">r</b><a class="next" href="{u}">n</a>'
    reply = '{"item_link_selector": " ", "max_pages": 9, "pagination_selector": "a.next", "field_selectors": {"title": ".row"}}'
    _, plans, doms = _walked(spark, {f"http://h/{k}": nxt(f"/{k + 1}") for k in range(6)}, [(1, "http://h/0", "list", ["title"], None, reply)])
    shown = visited_pages(plans, doms)._jdf.queryExecution().executedPlan().toString()
    assert "url_key" in shown and "nodes" not in shown and "texts" not in shown and "places" not in shown


def test_only_the_pages_that_walks_meet_are_parsed(spark, site):
    snapshots, starts, _ = site
    links, pages = page_links(write_through(walk_plans(starts.where("page_type = 'list'"))), write_through(keyed_snapshots(snapshots)))
    assert sorted(r.url_key for r in pages.select("url_key").collect()) == sorted(["http://h/list", "http://h/list2", "http://h/alone", *[f"http://h/chain{k}" for k in range(5)]])
    assert links.count() == links.distinct().count() == 6
