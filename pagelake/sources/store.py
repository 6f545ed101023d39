"""A keyed snapshot store: stored pages found by request without moving their HTML.

The store is a bucketed table: a page lies in the bucket of its request, so rows that ask for it are dealt to the
buckets and the pages stay where they are. Its narrow columns (request, time, digest, capture) are the index; a scan of
them does not touch the HTML, and since it is bucketed the newest capture of every request is found without a shuffle.

Writing only appends, and readers choose the newest capture (merge on read). ``compact`` writes the newest captures
alone as the next version of the table. Which version counts is said by the last row of ``versions``, added when its
files are complete, so a reader sees either the old version or the new one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.urls import request_url

PAGE_COLUMNS = "request_key string, capture string, stored_at timestamp, digest long, requested_url string, final_url string, html string"
INDEX = ["request_key", "capture", "stored_at", "digest", "requested_url", "final_url"]
BUCKET_COLUMN = "request_key"


class SnapshotStore:
    """The store below ``path``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int | None = None) -> SnapshotStore:
        """A new, empty store. Fewer buckets than the session's shuffle partitions would have Spark deal the pages out anew."""
        store = cls(spark, path)
        store._publish(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        return store

    def _publish(self, version: int, buckets: int) -> None:
        row = self.spark.createDataFrame([(version, buckets)], "version int, buckets int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def current(self) -> tuple[int, int]:
        """Version that counts, and its number of buckets."""
        newest = self.spark.read.schema("version int, buckets int").parquet(f"{self.path}/versions").agg(F.max(F.struct("version", "buckets")).alias("v"))
        row = newest.first().v
        return row.version, row.buckets

    def _table(self, version: int, buckets: int) -> str:
        """Name of a version's table in this session's catalog; registered where it is not."""
        name = f"snapshots_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{version}"
        columns = ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in PAGE_COLUMNS.split(", "))
        location = f"{self.path}/pages-{version}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({BUCKET_COLUMN}) SORTED BY ({BUCKET_COLUMN}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return name

    def _write(self, rows: DataFrame, version: int, buckets: int) -> None:
        name = self._table(version, buckets)
        rows = rows.select(*[c.split()[0] for c in PAGE_COLUMNS.split(", ")])
        # One task a bucket, so that a batch adds one file to each.
        dealt = rows.repartition(buckets, BUCKET_COLUMN)
        dealt.write.mode("append").format("parquet").bucketBy(buckets, BUCKET_COLUMN).sortBy(BUCKET_COLUMN).saveAsTable(name)

    def append(self, snapshots: DataFrame) -> None:
        """Add fetched snapshots (requested_url, final_url, html and, if they have one, stored_at). Later ones win on reading."""
        at = F.col("stored_at").cast("timestamp") if "stored_at" in snapshots.columns else F.current_timestamp()
        self._write(
            snapshots.select(
                request_url("requested_url").alias("request_key"), F.uuid().alias("capture"), at.alias("stored_at"), F.xxhash64("html").alias("digest"),
                "requested_url", "final_url", "html",
            ),
            *self.current(),
        )

    def pages(self) -> DataFrame:
        """All captures, superseded ones too."""
        name = self._table(*self.current())
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def newest(self) -> DataFrame:
        """(request_key, capture, final_url): the capture that counts for each request. Reads no HTML and shuffles nothing."""
        index = self.pages().select(*INDEX)
        # Of captures stored at one time the larger by URL and content wins, so that reruns agree.
        order: list[Column] = [F.col(c) for c in ("stored_at", "requested_url", "final_url", "digest", "capture")]
        return index.groupBy("request_key").agg(F.max(F.struct(*order)).alias("best")).select("request_key", "best.capture", "best.final_url")

    def _wanted(self, cases: DataFrame, url: str) -> DataFrame:
        return cases.select(request_url(url).alias("request_key")).where("request_key is not null").distinct()

    def stored_pages(self, requests: DataFrame) -> DataFrame:
        """(request_key, requested_url, final_url, html) of the newest captures of the requests (request_key) that are stored."""
        chosen = requests.select("request_key").join(self.newest(), "request_key")
        return self._captures(chosen).drop("capture")

    def _captures(self, chosen: DataFrame) -> DataFrame:
        """The pages of chosen captures (request_key, capture), at most one for a request.

        The join is on the bucketing column alone, so the pages stay in their buckets; the capture is a filter on it. The
        narrow side is the one that is hashed, so the pages are not sorted either.
        """
        pages = self.pages().select("request_key", "capture", "requested_url", "final_url", "html")
        wanted = chosen.select("request_key", F.col("capture").alias("chosen")).hint("shuffle_hash")
        return pages.join(wanted, "request_key").where(F.col("capture").between(F.col("chosen"), F.col("chosen"))).drop("chosen")

    def lookup(self, cases: DataFrame, url: str = "url") -> DataFrame:
        """Cases with (requested_url, final_url, html) of their stored page, NULL where none is; equal requests meet however spelled.

        Pages go to the cases only here, one copy for each case that asks for one.
        """
        found = self.stored_pages(self._wanted(cases, url)).withColumnRenamed("request_key", "__key")
        return cases.withColumn("__key", request_url(url)).join(found, "__key", "left").drop("__key")

    def to_fetch(self, cases: DataFrame, url: str = "url") -> DataFrame:
        """(request_url) that no snapshot covers, once each. Reads only the index."""
        stored = self.pages().select("request_key")
        return self._wanted(cases, url).join(stored, "request_key", "left_anti").withColumnRenamed("request_key", "request_url")

    def compact(self, buckets: int | None = None) -> None:
        """Write the newest captures as the next version. The old version's files stay for those who are reading them."""
        version, before = self.current()
        newest = self.newest().select("request_key", F.col("capture").alias("chosen"))
        kept = self.pages().join(newest.hint("shuffle_hash"), "request_key").where(F.col("capture").between(F.col("chosen"), F.col("chosen")))
        self._write(kept, version + 1, buckets or before)
        self._publish(version + 1, buckets or before)
