"""Captures in micro-batches of any order lead to the choice of the batch."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.plans import corpora
from pagelake.sources.snapshots import choose_snapshots
from pagelake.streaming.captures import choose_on_stream, settled

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def rows(frame):
    return sorted((r.capture_id, r.requested_url, r.final_url, r.html, r.renderer, r.degraded) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_batch_result(rocks, tmp_path, seed):
    spark, rng = rocks, random.Random(seed)
    captures = corpora.captures(spark, "/root/testdata/sf0.001").where("page_id < 12").cache()
    ids = [r.capture_id for r in captures.select("capture_id").collect()]
    rng.shuffle(ids)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (ids[: len(ids) // 3], ids[len(ids) // 3 : -2], ids[-2:]):
        captures.where(F.col("capture_id").isin(part)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(captures.schema).parquet(source)
        query = choose_on_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        query.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).start().awaitTermination(120)
    got = spark.read.parquet(out)
    assert rows(settled(got)) == rows(choose_snapshots(captures))
    assert got.groupBy("request_key", "version").count().where("count > 1").count() == 0
