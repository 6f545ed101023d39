"""Page snapshots: reading them, choosing one per URL, and listing what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import as_col, count_occurrences, let, strip
from pagelake.functions.urls import final_or_requested, request_url

# Capture kinds and the limits of the rendering check.
STATIC = "static"
RENDER_BACKENDS = ["playwright", "selenium"]
MIN_LENGTH = 800
SCRIPT_PHRASES = ["enable javascript", "requires javascript"]
TEXT_BLOCK_MARKS = ["<p", "<article", "<section", "<li"]
MANY_SCRIPTS = 15
MANY_VARS = 50
FEW_BLOCKS = 3
OWN_REPLACEMENT = "\ue000\ufdd0\ue001"


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Stored pages, as the scan splits them.

    A row group is one split at least. Where a store has a few large ones, the caller may name ``partitions``
    to deal the pages out to; that moves all HTML once.
    """
    pages = spark.read.parquet(path)
    return pages.repartition(partitions) if partitions else pages


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved ``.html`` files as (path, html); bytes that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    raw = F.col("content").cast("string")
    # A cast never fails on malformed bytes, and repairing puts U+FFFD in their place. Those are dropped, not the
    # ones the file has itself, which private characters stand for meanwhile.
    kept = F.replace(raw, F.lit("\ufffd"), F.lit(OWN_REPLACEMENT))
    repaired = F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit(OWN_REPLACEMENT), F.lit("\ufffd"))
    return files.select("path", F.when(F.is_valid_utf8(raw), raw).otherwise(repaired).alias("html"))


def needs_render(html: Column | str) -> Column:
    """Whether a statically fetched page looks as if scripts were to fill it."""

    def check(sample: Column) -> Column:
        scripts = count_occurrences(sample, "<script")
        blocks = sum((count_occurrences(sample, mark) for mark in TEXT_BLOCK_MARKS), F.lit(0))
        return let(
            F.struct(scripts.alias("scripts"), blocks.alias("blocks")),
            lambda n: (F.length(sample) < MIN_LENGTH)
            | sample.rlike("|".join(SCRIPT_PHRASES))
            | ((n.blocks == 0) & (n.scripts > 0))
            | ((n.scripts >= MANY_SCRIPTS) & (n.scripts > n.blocks * 2))
            | ((count_occurrences(sample, "var ") > MANY_VARS) & (n.blocks < FEW_BLOCKS)),
        )

    html = as_col(html)
    return F.when(html.isNull() | (html == ""), True).otherwise(let(F.lower(strip(html)), check))


def usable_html(html: Column, status: Column) -> Column:
    """A 403 answer counts as an empty page."""
    return F.when(status == 403, "").otherwise(F.coalesce(html, F.lit("")))


def apply_status(captures: DataFrame) -> DataFrame:
    """Status rules on raw captures: adds ``rejected`` and ``has_html_tag``, blanks 403 pages."""
    failed = F.col("status") >= 400
    html = usable_html(F.col("html"), F.col("status"))
    return captures.withColumns(
        {
            "final_url": final_or_requested(F.col("final_url"), F.col("requested_url")),
            "html": html,
            "rejected": F.coalesce(failed & (F.col("status") != 403), F.lit(False)),
            "has_html_tag": F.lower(html).contains("<html"),
        }
    )


def capture_rank(
    html: Column, renderer: Column, backends: list[str] | None = None, auto_render: bool = True
) -> Column:
    """Preference of a capture, lower is better; NULL when it can never be chosen.

    A usable static page comes first, then the backends in their configured order, then a static
    page that needs rendering, then an empty static page.
    """
    order = RENDER_BACKENDS if backends is None else backends
    position = F.array_position(F.array(*[F.lit(b) for b in order]).cast("array<string>"), renderer).cast("int")
    is_static = renderer == STATIC
    filled = html != ""
    dynamic = needs_render(html) if auto_render else F.lit(False)
    return (
        F.when(is_static & filled & ~dynamic, 0)
        .when(~is_static & F.lit(auto_render) & filled & (position > 0), position)
        .when(is_static & filled, len(order) + 1)
        .when(is_static, len(order) + 2)
    )


def choose_snapshots(
    captures: DataFrame, backends: list[str] | None = None, auto_render: bool = True
) -> DataFrame:
    """One snapshot per request out of its captures (capture_id, requested_url, final_url, html, renderer).

    Captures with a ``status`` go through the status rules first; rejected ones cannot be chosen.

    The choice aggregates narrow rows only (URL, rank, id), combined before the shuffle, so a URL
    with very many captures costs one row per map task; HTML is moved for the winners alone.
    """
    if "status" in captures.columns and "rejected" not in captures.columns:
        captures = apply_status(captures)
    if "rejected" in captures.columns:
        captures = captures.where(~F.col("rejected"))
    last_static = len(RENDER_BACKENDS if backends is None else backends) + 1
    ranked = captures.withColumn(
        "rank", capture_rank(F.coalesce("html", F.lit("")), F.col("renderer"), backends, auto_render)
    ).filter(F.col("rank").isNotNull())
    # Spellings of one request compete with each other; of equal captures the newest (largest id) wins.
    newest = (-F.col("capture_id")).alias("newest")
    best = ranked.groupBy(request_url("requested_url").alias("_key")).agg(F.min(F.struct("rank", newest, "capture_id")).alias("best"))
    winners = best.select("best.capture_id", "best.rank")
    return (
        captures.join(winners, "capture_id")
        .select(
            "capture_id",
            "requested_url",
            F.when(F.col("rank") > last_static, F.col("requested_url"))
            .otherwise(final_or_requested(F.col("final_url"), F.col("requested_url")))
            .alias("final_url"),
            F.coalesce("html", F.lit("")).alias("html"),
            "renderer",
            (F.col("rank") >= last_static).alias("degraded"),
        )
    )


def rejected_urls(captures: DataFrame, chosen: DataFrame) -> DataFrame:
    """Requested URLs without any snapshot that can be used."""
    return captures.select("requested_url").distinct().join(
        chosen.select("requested_url"), "requested_url", "left_anti"
    )


def one_per_request(snapshots: DataFrame) -> DataFrame:
    """(request_url, requested_url, final_url, html), one row per request however it is spelled and however often stored.

    The row stored last wins where the table has ``stored_at``; else the largest by URL and content, so that reruns agree.
    The grouping key is the one that later joins use, so they find the rows dealt out already.
    """
    order = ["stored_at"] if "stored_at" in snapshots.columns else []
    page = F.struct(*order, "requested_url", "final_url", "html")
    best = snapshots.groupBy(request_url("requested_url").alias("request_url")).agg(F.max(page).alias("page"))
    return best.select("request_url", "page.requested_url", "page.final_url", "page.html")


def with_snapshots(cases: DataFrame, snapshots: DataFrame, url: str = "url") -> DataFrame:
    """Cases with the stored page of their URL; ``html`` is NULL where none is stored.

    URLs meet in their requested form, so differently written but equal requests match.
    """
    keyed = cases.withColumn("_key", request_url(url))
    stored = one_per_request(snapshots).withColumnRenamed("request_url", "_key")
    return keyed.join(stored, "_key", "left").drop("_key")


def to_fetch(cases: DataFrame, snapshots: DataFrame, url: str = "url") -> DataFrame:
    """Work list of URLs that no snapshot covers, once each, in the form to request."""
    wanted = cases.select(request_url(url).alias("request_url")).distinct()
    stored = snapshots.select(request_url("requested_url").alias("request_url"))
    return wanted.join(stored, "request_url", "left_anti")


def store_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append newly fetched snapshots with the time of storing; nothing stored is rewritten, later ones win on reading."""
    snapshots.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)
