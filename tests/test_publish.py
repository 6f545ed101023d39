"""Published results: whole or not at all, once per run."""

import os

import pytest
from pyspark.sql import functions as F

from pagelake.operators.extract import cell
from pagelake.operators.publish import forget_attempts, publish, publish_csv, publish_json, publish_run_document, published


def records(spark, *titles):
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    return rows.select(F.array(cell(F.lit("title"), "str", F.col("t"))).alias("record"), "t")


def titles(spark, path):
    return sorted(r.title for r in spark.read.schema("title string").json(published(spark, path)).collect())


def test_a_write_that_dies_half_way_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    assert published(spark, path) is None
    assert publish_json(records(spark, "a", "b"), path, "one", ["title"])

    def dies(folder):
        records(spark, "c").select(F.col("t").alias("title")).write.json(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish(spark, path, "two", dies)
    assert titles(spark, path) == ["a", "b"]
    failing = records(spark, "d").withColumn("record", F.when(F.raise_error(F.lit("task failed")).isNull(), F.col("record")))
    with pytest.raises(Exception, match="task failed"):
        publish_json(failing, path, "two", ["title"])
    assert titles(spark, path) == ["a", "b"]
    assert publish_json(records(spark, "e"), path, "two", ["title"])
    assert titles(spark, path) == ["e"]
    assert len([n for n in os.listdir(path) if n.startswith("attempt-")]) >= 3
    forget_attempts(spark, path)
    assert len([n for n in os.listdir(path) if n.startswith("attempt-")]) == 1 and titles(spark, path) == ["e"]


def test_a_run_is_published_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert publish_json(records(spark, "a"), path, "one", ["title"])
    assert not publish_json(records(spark, "other"), path, "one", ["title"])
    assert titles(spark, path) == ["a"]
    assert publish_json(records(spark, "b"), path, "two", ["title"])
    assert titles(spark, path) == ["b"] and published(spark, path, "one") != published(spark, path)


def test_documents_and_empty_results(spark, tmp_path):
    path = str(tmp_path / "doc")
    assert publish_run_document(records(spark, "a", "b"), spark.range(1), path, "one")
    folder = published(spark, path)
    assert spark.read.json(f"{folder}/runs").count() == 2 and spark.read.json(f"{folder}/summary").count() == 1
    assert publish_csv(records(spark), str(tmp_path / "csv"), "one", ["t"])
