"""Page corpora derived from the driver tables, for queries whose features raw pages lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.snapshots import read_pages

SHOP = "http://shop.example.com"
ITEMS_PER_PAGE = 10
PAGES_PER_CHAIN = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet", asked_partitions(spark))


def asked_partitions(spark: SparkSession) -> int | None:
    """``spark.pagelake.scanPartitions``, where the session sets it: for stores of few large row groups, which scans cannot split."""
    asked = spark.conf.get("spark.pagelake.scanPartitions", None)
    return int(asked) if asked else None


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to as many partitions as the session asks for; left as scanned where it asks for none."""
    asked = asked_partitions(df.sparkSession)
    return df.repartition(asked) if asked else df


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def text(*parts: Column | str | int) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts])


def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages changed by page_id so that every rule of the rendering check applies to some."""
    html, kind = F.col("html"), F.col("page_id") % 7
    bare = html
    for mark in ("<p", "<article", "<li"):
        bare = F.replace(bare, F.lit(mark), F.lit("<x"))
    changed = (
        F.when(kind == 1, "")
        .when(kind == 2, F.substring(html, 1, 500))
        .when(kind == 3, text(html, " Please Enable JavaScript"))
        .when(kind == 4, bare)
        .when(kind == 5, F.concat(html, F.repeat(F.lit("<script></script>"), 300)))
        .when(kind == 6, F.concat(F.replace(bare, F.lit("<script"), F.lit("<scrip")), F.repeat(F.lit("var "), 60)))
        .otherwise(html)
    )
    return pages(spark, sf_dir).withColumn("html", changed)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three captures per URL: a static one and two rendered ones, some of them empty."""
    page_id = F.col("page_id")
    entries = F.array(
        F.struct(
            F.lit(0).alias("k"), F.lit("static").alias("renderer"), F.col("html").alias("html"),
            F.when(page_id % 4 == 0, "").otherwise(text(F.col("url"), "#final")).alias("final_url"),
        ),
        F.struct(
            F.lit(1).alias("k"), F.lit("selenium").alias("renderer"),
            F.when(page_id % 3 == 0, "").otherwise(text("<html>selenium ", page_id, "</html>")).alias("html"),
            text(F.col("url"), "#s").alias("final_url"),
        ),
        F.struct(
            F.lit(2).alias("k"), F.lit("playwright").alias("renderer"),
            F.when(page_id % 5 < 2, "").otherwise(text("<html>playwright ", page_id, "</html>")).alias("html"),
            text(F.col("url"), "#p").alias("final_url"),
        ),
    )
    exploded = page_variants(spark, sf_dir).select("page_id", "url", F.inline(entries))
    return exploded.select(
        (page_id * 3 + F.col("k")).alias("capture_id"),
        text(F.col("url"), "&id=", page_id).alias("requested_url"),
        "final_url", "html", "renderer",
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article page per document, with containers and images placed by doc_id."""
    doc_id = F.col("doc_id")
    head = text("<html><head><title>Doc ", doc_id, "</title></head><body>")
    body = F.when(
        doc_id % 2 == 0,
        text(
            '<div id="top"><article class="Post  ', F.col("source"), '" id="doc-', doc_id, '"><h1>Doc ', doc_id, "</h1>",
            '<img class="hero" src="/a/', doc_id, '.png"><section class="s"><figure><img src="/b/', doc_id % 3,
            '.png"></figure><img src="/a/', doc_id, '.png"></section><p>', escaped(F.col("text")), "</p></article></div>",
        ),
    ).otherwise(
        text(
            '<div class="news-', F.col("lang"), '"><h1>Doc ', doc_id, '</h1><p>', escaped(F.col("text")), "</p></div>",
            '<div class="gallery pic"><img src="/d/', doc_id, '.png"><img src=""><img src="x', doc_id % 5, '.png"></div>',
        )
    )
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", text("http://docs.example.com/", F.col("lang"), "/", doc_id).alias("url"),
        F.concat(head, body, F.lit("</body></html>")).alias("html"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail page per order."""
    key = F.col("o_orderkey")
    html = text(
        "<html><head><title>Order ", key, "</title></head><body><article><h1>Order ", key, '</h1><span class="price">',
        F.col("o_orderpriority"), "</span><time>", F.date_format("o_orderdate", "yyyy-MM-dd"),
        "</time></article></body></html>",
    )
    return spread(table(spark, sf_dir, "orders")).select(text(SHOP, "/orders/", key).alias("requested_url"), html.alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages of ten orders each, chained by next links in runs of seven.

    A list holds the orders of one key range, so its size is bounded by the key, not by the data.
    """
    key = F.col("o_orderkey")
    item = text('<li><a class="item" href="/orders/', key, '">Order ', key, '</a> <b class="price">', F.col("o_orderstatus"), "</b></li>")
    grouped = (
        table(spark, sf_dir, "orders")
        .select(F.expr(f"o_orderkey div {ITEMS_PER_PAGE}").alias("list_no"), F.struct(key.alias("key"), item.alias("item")).alias("entry"))
        .groupBy("list_no")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    )
    list_no = F.col("list_no")
    more = F.when(
        list_no % PAGES_PER_CHAIN != PAGES_PER_CHAIN - 1,
        text('<div class="pagination"><a class="next" href="/list/', list_no + 1, '">next</a></div>'),
    ).otherwise("")
    html = F.concat(
        text("<html><head><title>List ", list_no, '</title></head><body><h1>Orders</h1><ul class="list">'),
        F.array_join(F.transform("entries", lambda e: e.item), ""), F.lit("</ul>"), more, F.lit("</body></html>"),
    )
    return grouped.select("list_no", text(SHOP, "/list/", list_no).alias("requested_url"), html.alias("html"))


def shop_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail and list pages as one snapshot table; some detail pages are missing."""
    details = order_pages(spark, sf_dir).filter(~F.col("requested_url").endswith("77"))
    lists = list_pages(spark, sf_dir).drop("list_no")
    return details.unionByName(lists).withColumn("final_url", F.lit(None).cast("string"))


def list_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One walk per chain of list pages; task and model reply vary with the walk."""
    walk = F.col("walk_id")
    kind = walk % 4
    chains = (
        table(spark, sf_dir, "orders")
        .select(F.expr(f"o_orderkey div {ITEMS_PER_PAGE}").alias("list_no"))
        .filter(F.col("list_no") % PAGES_PER_CHAIN == 0)
        .distinct()
        .select(F.expr(f"list_no div {PAGES_PER_CHAIN}").alias("walk_id"), "list_no")
    )
    task = F.when(kind == 2, "Top 25 title and price").otherwise("title and price of the list")
    reply = (
        F.when(kind == 1, '{"item_link_selector": " ", "field_selectors": {"title": ".list a", "price": "b.price"}}')
        .when(kind == 3, '{"item_link_selector": ".nothing a", "max_pages": 2}')
        .otherwise('{"item_link_selector": ".list a.item", "max_depth": 8, "max_pages": 7}')
    )
    return chains.select(
        "walk_id", text(SHOP, "/list/", F.col("list_no")).alias("url"), task.alias("task"), reply.alias("strategy_reply")
    )
