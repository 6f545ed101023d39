"""Queries over stored pages: the keyed snapshot store (newer captures, look-ups, work lists, compaction), packed archives,
and the choice of snapshots on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.plans import corpora
from pagelake.plans import catalog_pages  # noqa: F401  (registers the batch choice, whose SQL serves the stream as well)
from pagelake.plans.registry import ORACLES, query
from pagelake.session import shared_folder
from pagelake.sources.archive import read_archive, write_archive
from pagelake.sources.store import SnapshotStore
from pagelake.streaming.captures import choose_on_stream, settled

_STORED = """
captures AS (
  SELECT page_id, html, 1 AS batch FROM pages
  UNION ALL SELECT page_id, replace(html, '<h1>', '<h1>Newer '), 2 FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 'too late', 0 FROM pages WHERE page_id % 5 = 1),
newest AS (SELECT page_id, max_by(html, batch) AS html, max(batch) AS batch FROM captures GROUP BY page_id)
"""
_CASES = """SELECT doc_id, doc_id // 2 AS page_id FROM documents"""


def _filled(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """A store of all pages; a fifth of them stored again later, and another fifth with an older capture that came late."""
    page = F.col("page_id")
    rows = corpora.pages(spark, sf_dir).select(
        "page_id", corpora.text("http://stored.example.com/p ", page).alias("requested_url"), F.lit(None).cast("string").alias("final_url"), "html",
    )
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day} 00:00:00"))
    store = SnapshotStore.create(spark, shared_folder(spark, "store"))
    store.append(rows.withColumn("stored_at", at("10")))
    newer = rows.where(page % 5 == 0).withColumns({
        "requested_url": F.replace("requested_url", F.lit(" "), F.lit("%20")), "html": F.replace("html", F.lit("<h1>"), F.lit("<h1>Newer ")),
        "final_url": corpora.text("http://stored.example.com/moved/", page),
    })
    late = rows.where(page % 5 == 1).withColumn("html", F.lit("too late"))
    store.append(newer.withColumn("stored_at", at("20")).unionByName(late.withColumn("stored_at", at("05"))))
    return store


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "documents").select("doc_id", corpora.text("http://stored.example.com/p%20", F.expr("doc_id div 2")).alias("url"))


@query(
    "store_lookup",
    f"""WITH {_STORED} SELECT doc_id, md5(html) AS html_md5, CASE WHEN batch = 2 THEN 'http://stored.example.com/moved/' || n.page_id END AS final_url
    FROM ({_CASES}) c LEFT JOIN newest n USING (page_id)""",
)
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).lookup(_cases(spark, sf_dir)).select("doc_id", F.md5("html").alias("html_md5"), "final_url")


@query(
    "store_worklist",
    f"""WITH {_STORED} SELECT DISTINCT 'http://stored.example.com/p%20' || page_id AS request_url
    FROM ({_CASES}) WHERE page_id NOT IN (SELECT page_id FROM newest)""",
)
def store_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).to_fetch(_cases(spark, sf_dir))


@query(
    "store_compaction",
    f"""WITH {_STORED} SELECT 'http://stored.example.com/p%20' || page_id AS request_key, md5(html) AS html_md5, (SELECT count(*) FROM captures) AS captures_before
    FROM newest""",
)
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the store when superseded captures are dropped."""
    store = _filled(spark, sf_dir)
    before = store.pages().count()
    store.compact()
    return store.pages().select("request_key", F.md5("html").alias("html_md5"), F.lit(before).cast("long").alias("captures_before"))


def _archive(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "archive")
    write_archive(corpora.pages(spark, sf_dir).select(corpora.text("http://packed.example.com/", F.col("page_id")).alias("url"), "html"), path)
    return path


@query("archived_pages", "SELECT 'http://packed.example.com/' || page_id AS url, md5(html) AS html_md5 FROM pages")
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, packed and read back by byte ranges."""
    return read_archive(spark, _archive(spark, sf_dir)).select("url", F.md5("html").alias("html_md5"))


@query(
    "archived_titles",
    """SELECT 'http://packed.example.com/' || page_id AS url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages
    WHERE starts_with('http://packed.example.com/' || page_id, 'http://packed.example.com/1')""",
)
def archived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of URLs out of an archive; packs that cannot hold any are not opened."""
    asked = read_archive(spark, _archive(spark, sf_dir)).where(F.col("url").startswith("http://packed.example.com/1"))
    return asked.select("url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("streamed_choice", ORACLES["snapshot_choice"])
def streamed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of snapshots from captures that arrive in three batches, the best ones not last."""
    folder, captures = shared_folder(spark, "stream"), corpora.captures(spark, sf_dir)
    out, provider = f"{folder}/out", "spark.sql.streaming.stateStore.providerClass"
    for part in (1, 2, 0):
        captures.where(F.col("capture_id") % 3 == part).write.parquet(f"{folder}/in/{part}")
    stream = spark.readStream.schema(captures.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = choose_on_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    chosen = settled(spark.read.parquet(out))
    return chosen.select("requested_url", "final_url", "renderer", "degraded", F.md5("html").alias("html_md5"))
