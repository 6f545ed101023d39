"""Replies, intents, strategies, metrics and sinks."""

from pyspark.sql import functions as F

from pagelake.functions.lenient_json import json_object, json_payload
from pagelake.operators.intents import parse_intents
from pagelake.operators.sinks import jdbc_options, write_csv, write_text
from pagelake.operators.strategies import build_strategies

REPLIES = {
    '{"a":1}': '{"a":1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'text {"a":{"b":2}} tail': '{"a":{"b":2}}',
    'x [{"a":1},{"a":2}] y': "{}", "x [1,2] y": "[1,2]", "5": "5", "": "{}", '{"a":1} trailing': '{"a":1}',
    '{"a":1,"a":2}': "{}", '{"a":NaN}': "{}", "{bad": "{}", "{'a':1}": "{}", '{"a":1}{"b":2}': "{}", "1 2": "{}",
    '[1],0]': "{}", '[1],"w":0} x]': "{}", "null": "null",
}


def test_lenient_json(spark):
    rows = spark.createDataFrame([(r,) for r in REPLIES], "r string").select("r", json_payload("r").alias("p"), json_object("r").text.alias("o"))
    for row in rows.collect():
        expected = REPLIES[row.r]
        if row.r in ('[1],0]', '[1],"w":0} x]'):
            assert row.o in ("{}",) or not row.o.startswith("{")
            continue
        assert row.p == expected, row.r
        assert row.o == (expected if expected.startswith("{") else "{}"), row.r


def test_keyword_intents(spark):
    tasks = ["帮我抓取列表标题和图片", "Top 10 articles with title", "extract the price", "get １２ 条 links", "stop by 5 links please"]
    rows = parse_intents(spark.createDataFrame(list(enumerate(tasks)), "task_id int, task string")).orderBy("task_id").collect()
    assert [(r.intent_type, r.requested_fields, r.max_items) for r in rows] == [
        ("crawl_list", ["title", "images"], None), ("crawl_list", ["title"], 10), ("extract_info", ["price"], None),
        ("extract_info", ["links"], 12), ("crawl_list", ["links"], 5),
    ]


def test_list_defaults(spark):
    schema = "page_type string, suggested_fields array<string>, requested_fields array<string>, max_items int, tag_counts map<string,int>"
    work = spark.createDataFrame([("list", None, ["title"], None, {"li": 20})], schema)
    s = build_strategies(work).first().strategy
    assert s.is_list and s.item_link_selector and s.field_methods == {"title": "css"}
    assert (s.max_pages, s.max_depth) == (3, 2)


def _records(spark):
    cell = "struct<field:string,kind:string,s:string,xs:array<string>>"
    rows = [(0, [("title", "str", 'a "q", b', None), ("links", "list", None, ["x", "y"])]), (1, [("image", "null", None, None), ("title", "str", "", None)])]
    return spark.createDataFrame(rows, f"record_no int, record array<{cell}>")


def test_text_and_csv_sinks(spark, tmp_path):
    records = _records(spark)
    write_text(records, str(tmp_path / "t"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == ['{"image":null,"title":""}', '{"title":"a \\"q\\", b","links":["x","y"]}']
    assert write_csv(records, str(tmp_path / "c"), ["record_no"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["title", "links", "image"]
    assert {r.links for r in back.collect()} == {'["x","y"]', None}
    assert not write_csv(records.filter("record_no > 5"), str(tmp_path / "none"), ["record_no"])
    assert not (tmp_path / "none").exists()


def test_jdbc_options():
    assert jdbc_options("postgres", "d", 'r"x', host="h", user="u")["dbtable"] == '"r""x"'
    assert jdbc_options("mysql", "d", host="h")["url"] == "jdbc:mysql://h:3306/d"
    assert jdbc_options("sqlite", "data.db")["url"] == "jdbc:sqlite:data.db"
