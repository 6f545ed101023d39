"""Incremental page processing: the page-local operators on a stream of newly saved snapshots.

No state is kept across pages, so the same Columns serve batch and stream and there is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelake.operators.extract import extract_fields
from pagelake.operators.summary import summarize
from pagelake.sources.html import parse_html

PAGE_SCHEMA = "page_id bigint, url string, html string"


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_summaries(pages: DataFrame) -> DataFrame:
    return summarize(parse_html(pages))


def stream_fields(pages: DataFrame, fields: list[tuple], max_items: int | None = None) -> DataFrame:
    return extract_fields(parse_html(pages), fields, max_items)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, append it as parquet, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
