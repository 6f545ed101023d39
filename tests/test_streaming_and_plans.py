"""Streams give what batches give; plans keep their shape."""

from pyspark.sql import functions as F

from pagelake.functions.lenient_json import boolean_value, json_object, member, string_list, string_value, unit_float
from pagelake.operators.extract import extract_fields
from pagelake.operators.metrics import align_with_gold, macro_report
from pagelake.operators.summary import summarize
from pagelake.plans.catalog_metrics import _gold_and_runs
from pagelake.sources.html import parse_html
from pagelake.sources.snapshots import read_pages
from pagelake.streaming.pages import append_available, stream_fields, stream_pages, stream_summaries

SF = "/root/testdata/sf0.001"


def test_streams_equal_batches_and_go_on_where_they_stopped(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20).cache()
    fields = [("title", "h1", "css"), ("links", "a", "attr:href")]
    for part, (out, flow, batch) in enumerate([
        ("summary", stream_summaries, lambda p: summarize(parse_html(p))),
        ("fields", lambda s: stream_fields(s, fields), lambda p: extract_fields(parse_html(p), fields)),
    ]):
        source = str(tmp_path / f"in{part}")
        for half in (pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")):
            half.write.mode("append").parquet(source)
            append_available(flow(stream_pages(spark, source)), str(tmp_path / out), str(tmp_path / f"c{part}")).awaitTermination(120)
        text = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
        want = batch(pages)
        assert text(spark.read.parquet(str(tmp_path / out)).select(want.columns)) == text(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_query_needs(spark):
    pages = read_pages(spark, f"{SF}/pages.parquet").where("page_id > 3").select("page_id")
    shown = plan(pages)
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in shown and "html" not in shown.split("ReadSchema")[1]


def test_a_page_summary_adds_no_shuffle(spark):
    assert "Exchange" not in plan(summarize(parse_html(read_pages(spark, f"{SF}/pages.parquet"))))


def test_a_reply_is_parsed_once_for_all_its_members(spark):
    p = F.col("p")
    read = spark.createDataFrame([("{}",)], "r string").select(json_object("r").alias("p")).select(
        string_value(member(p, "a")).alias("a"), string_list(member(p, "b")).alias("b"), boolean_value(member(p, "c")).alias("c"), unit_float(member(p, "d")).alias("d"),
    )
    # The whole text and the widest brackets, each inside an array and, where that can be fooled, inside an object.
    assert plan(read).count("parse_json(") <= 8


def test_the_report_is_one_pass(spark):
    gold, runs = _gold_and_runs(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(macro_report(align_with_gold(runs, gold), ["doc_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Exchange ") <= 5 and "NestedLoop" not in shown and "Cartesian" not in shown
