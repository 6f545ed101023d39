"""The snapshot store: what counts, what is moved, and what a reader sees meanwhile."""

import re

import pytest
from pyspark.sql import functions as F

from pagelake.sources.snapshots import to_fetch, with_snapshots
from pagelake.sources.store import SnapshotStore

KIND = "requested_url string, final_url string, html string, stored_at timestamp_ntz"


def batch(spark, rows):
    return spark.createDataFrame(rows, "requested_url string, final_url string, html string, at string").select(
        "requested_url", "final_url", "html", F.to_timestamp("at").alias("stored_at")
    )


OLD = [(f"http://h/p {k}", None, f"old {k}", "2024-01-01 00:00:00") for k in range(40)]
NEW = [(f"http://h/p%20{k}", f"http://h/f{k}", f"new {k}", "2024-02-01 00:00:00") for k in range(0, 40, 3)] + [("http://h/late", None, "late", "2023-01-01 00:00:00")] * 2


@pytest.fixture()
def store(spark, tmp_path):
    store = SnapshotStore.create(spark, str(tmp_path / "store"), 4)
    store.append(batch(spark, OLD))
    store.append(batch(spark, NEW))
    return store


def cases(spark):
    return spark.createDataFrame([(k, f"http://h/p%20{k}") for k in range(0, 60)] * 2 + [(99, "http://h/late"), (100, None)], "case int, url string")


def test_lookup_and_work_list_equal_the_plain_ones(spark, store):
    plain = batch(spark, OLD + NEW)
    for _ in range(2):
        want = sorted((r.case, r.html or "", r.final_url or "") for r in with_snapshots(cases(spark), plain).collect())
        assert sorted((r.case, r.html or "", r.final_url or "") for r in store.lookup(cases(spark)).collect()) == want
        assert {r.request_url for r in store.to_fetch(cases(spark)).collect()} == {r.request_url for r in to_fetch(cases(spark), plain).collect()} - {None}
        assert store.newest().count() == 41
        store.compact()
    assert store.pages().count() == 41 and store.current() == (2, 4)


def test_fetched_pages_are_found_in_another_session(spark, store):
    work = store.to_fetch(cases(spark))
    store.append(work.select(F.col("request_url").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.concat(F.lit("got "), "request_url").alias("html")))
    again = SnapshotStore(spark.newSession(), store.path)
    assert again.to_fetch(cases(spark.newSession())).collect() == []
    assert {r.html for r in again.lookup(cases(spark.newSession())).where("case = 55").collect()} == {"got http://h/p%2055"}


def test_a_compaction_that_was_not_published_changes_nothing(spark, store):
    before = sorted(map(str, store.pages().collect()))
    store._write(store.pages().limit(3), 1, 4)
    assert sorted(map(str, SnapshotStore(spark, store.path).pages().collect())) == before


def exchanged(df):
    """Columns of every shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    return [line for line in text.split("\n") if re.search(r"\bExchange\b", line)], text


def test_plans_leave_pages_where_they_are(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles, text = exchanged(store.newest())
        assert shuffles == [] and "html" not in text.split("ReadSchema")[1].split("\n")[0]
        shuffles, text = exchanged(store.to_fetch(cases(spark)))
        assert "html" not in text and "ShuffledHashJoin" in text or "SortMergeJoin" in text
        wanted = cases(spark).select(F.col("url").alias("request_key")).distinct()
        shuffles, text = exchanged(store.stored_pages(wanted))
        # Only the requests are dealt out; pages are read bucket by bucket, unsorted.
        assert len(shuffles) == 1 and text.count("Bucketed: true") == 2 and "Sort [" not in text.split("html")[0].split("ShuffledHashJoin")[0]
        assert "ShuffledHashJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
